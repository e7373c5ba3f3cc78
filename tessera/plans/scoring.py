"""Signals of a text, its weighted score and its tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import ascii_lower
from tessera.operators import score
from tessera.plans.registry import read

#: signal, terms, weight; stand-ins on prose for the signals of code
SIGNALS = [("branching", ["if", "or "], 2), ("repetition", ["re", "ing"], 1), ("statements", [". "], 1), ("emphasis", ["th"], 1)]
HIGH, MEDIUM = 400, 100


def signals(docs: DataFrame) -> DataFrame:
    """doc_id and its signals, in the order of SIGNALS, by the operators that score methods."""
    low = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.array(*score.term_signals(low, {name: (terms, weight) for name, terms, weight in SIGNALS})).alias("signals"))


def wide(docs: DataFrame) -> DataFrame:
    return signals(docs).select("doc_id", *(F.get("signals", F.lit(i))["count"].alias(name) for i, (name, _, _) in enumerate(SIGNALS)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(read(spark, sf_dir, "documents")).withColumn("score", score.weighted(F.col("signals"))).withColumn("priority", score.tier(F.col("score"), HIGH, MEDIUM))


def _count_sql(terms: list[str]) -> str:
    return " + ".join(f"CAST((length(t) - length(replace(t, '{x}', ''))) / {len(x)} AS bigint)" for x in terms)


SIGNALS_SQL = "SELECT doc_id, " + ", ".join(f"{_count_sql(terms)} AS {name}" for name, terms, _ in SIGNALS) + " FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)"
SCORE_SQL = "CAST(" + " + ".join(f"{name} * {weight}" for name, _, weight in SIGNALS) + " AS bigint)"
SCORED_SQL = f"SELECT *, CASE WHEN score >= {HIGH} THEN 'high' WHEN score >= {MEDIUM} THEN 'medium' ELSE 'low' END AS priority FROM (SELECT *, {SCORE_SQL} AS score FROM ({SIGNALS_SQL}))"
