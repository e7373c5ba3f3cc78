"""Signals of method bodies, weighted scores, tiers, context lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ascii_lower, term_count

# The terms, weights and thresholds of the scores.
BODY_TERMS = {
    "branches": (["if", "else if", "?"], 3),
    "switches": (["switch", "case "], 3),
    "loops": (["for", "while", "do {"], 2),
    "exceptions": (["throw ", "catch "], 3),
    "assignments": (["="], 1),
    "method_calls": (["("], 1),
}
LOWER_TERMS = {
    "persistence_terms": (["repository", ".save(", ".delete(", ".update(", "entitymanager", "@transactional"], 3),
    "business_terms": (["approve", "reject", "validate", "status", "order", "customer", "payment", "invoice", "policy", "rule"], 2),
}
ANNOTATION_TERMS = (["transactional", "preauthorize", "postauthorize", "mapping", "listener", "scheduled"], 2)
HIGH, MEDIUM = 18, 8

TIERS = ["low", "medium", "high"]


def tier(score: Column, high: int = HIGH, medium: int = MEDIUM) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def at_least(threshold: str) -> list[str]:
    """The tiers that a threshold selects: itself and all above it."""
    return TIERS[TIERS.index(threshold) :]


SIGNALS = "array<struct<name:string,count:bigint,weight:bigint>>"


def signal(name: str, count: Column, weight: int) -> Column:
    return F.struct(F.lit(name).alias("name"), count.cast("long").alias("count"), F.lit(weight).cast("long").alias("weight"))


def term_signals(text: Column, terms: dict[str, tuple[list[str], int]]) -> list[Column]:
    """A signal for each name: how often its terms stand in the text as substrings, and its weight."""
    return [signal(name, term_count(text, own), weight) for name, (own, weight) in terms.items()]


def weighted(signals: Column) -> Column:
    """The sum of count times weight over a row's signals."""
    return F.aggregate(signals, F.lit(0).cast("long"), lambda total, s: total + s["count"] * s["weight"])


def signals_of() -> Column:
    """All signals of a method's row, those that do not occur included. A null body counts nothing."""
    marks, weight = ANNOTATION_TERMS
    marked = F.size(F.filter(F.coalesce("annotations", F.array().cast("array<string>")), lambda a: F.regexp_like(ascii_lower(a), F.lit("|".join(marks))))).cast("long")
    body = F.coalesce("body_text", F.lit(""))
    both = F.array(F.struct(body.alias("body"), ascii_lower(body).alias("low")))  # bound in the lambda, so that a body is lowered once
    return F.flatten(F.transform(both, lambda x: F.array(*term_signals(x["body"], BODY_TERMS), *term_signals(x["low"], LOWER_TERMS), signal("framework_annotations", marked, weight))))


def method_signals(methods: DataFrame) -> DataFrame:
    """One row per method and signal that occurs: method_id, name, count, weight. Columns read: id, body_text, annotations. One narrow pass."""
    return methods.select(F.col("id").alias("method_id"), F.explode(signals_of()).alias("s")).select("method_id", "s.*").where(F.col("count") > 0)


def candidate_scores(methods: DataFrame) -> DataFrame:
    """method_id, score, priority of every method, one without signals included. Each row holds all that its score needs, so nothing is shuffled."""
    return methods.select(F.col("id").alias("method_id"), weighted(signals_of()).alias("score")).withColumn("priority", tier(F.col("score")))


def priority_counts(scores: DataFrame) -> DataFrame:
    """How many methods each tier has, tiers without any included."""
    return scores.agg(*(F.count_if(F.col("priority") == t).alias(t) for t in TIERS), F.count(F.lit(1)).alias("total"))


def evidence_ranges(methods: DataFrame) -> DataFrame:
    return methods.select(F.col("id").alias("method_id"), "file", "start_line", "end_line", F.lit("scanner").alias("source"))


def context_packets(methods: DataFrame, scores: DataFrame) -> DataFrame:
    """A summary line per method."""
    joined = methods.join(scores, methods["id"] == scores["method_id"])
    return joined.select("method_id", F.format_string("%s:%d-%d score=%d priority=%s", "file", "start_line", "end_line", "score", "priority").alias("summary"))


def select_candidates(methods: DataFrame, classes: DataFrame, scores: DataFrame, threshold: str, limit: int) -> DataFrame:
    """The best methods of a tier and above: score descending, ties by id."""
    m = methods.select(F.col("id").alias("method_id"), "class_id", "name", "signature", "file", "start_line", "end_line")
    c = classes.select(F.col("id").alias("class_id"), "qualified_name")
    ranked = m.join(c, "class_id").join(scores.where(F.col("priority").isin(at_least(threshold))), "method_id")
    return ranked.orderBy(F.desc("score"), "method_id").limit(limit)
