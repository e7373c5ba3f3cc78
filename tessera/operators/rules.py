"""Matching rows against rule catalogues: wildcards, version gates, first rule, all rules, terms, hints, replacements.

A short catalogue is compiled into one expression of the row, so rows neither shuffle nor multiply. A longer one is an index
(`rule_index`) that distinct values are looked up in, with the same rows; regular expressions, which no index can hold, are data that
each distinct value is tested against.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import version_below
from tessera.operators import rule_index

#: up to so many rules (or terms) are compiled into the row's expression; more are an index, with the same rows
CODED_RULES = 100


def wildcard(value: Column, pattern: str | None) -> Column:
    """"*" matches anything, a leading star is a suffix test, a trailing one a prefix test; a leading star wins over a trailing one, which is then literal. No pattern: no match."""
    if pattern is None:
        return F.lit(False)
    if pattern == "*":
        return value.isNotNull()
    if pattern.startswith("*"):
        hit = value.endswith(pattern[1:])
    elif pattern.endswith("*"):
        hit = value.startswith(pattern[:-1])
    else:
        hit = value == pattern
    return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Column patterns that must all match, and values by name."""

    id: str
    patterns: dict[str, str]
    values: dict[str, str | None] = field(default_factory=dict)

    def matches(self, columns: Callable[[str], Column] = F.col) -> Column:
        hit = F.lit(True)
        for name, pattern in self.patterns.items():
            hit = hit & wildcard(columns(name), pattern)
        return hit


def first_match(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """`rows` with rule_id of the first rule in list order that matches, else null."""
    if len(rules) > CODED_RULES:
        return rule_index.first_match(rows, rules)
    hit = F.lit(None).cast("string")
    for rule in reversed(rules):
        hit = F.when(rule.matches(), rule.id).otherwise(hit)
    return rows.withColumn("rule_id", hit)


def unmatched(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that no rule matches; a rule that matches without firing still counts as known."""
    return first_match(rows, rules).where("rule_id is null").drop("rule_id")


def all_matches(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each rule that matches."""
    if len(rules) > CODED_RULES:
        return rule_index.all_matches(rows, rules)
    hits = F.filter(F.array(*(F.when(r.matches(), r.id) for r in rules)).cast("array<string>"), lambda x: x.isNotNull())
    return rows.withColumn("rule_id", F.explode(hits))


def upgrade_due(current: Column, minimum: Column, has_target: Column, manual: Column | None = None) -> Column:
    """Without data for the target false; without a minimum true; a minimum to be settled by hand true; no current version true; else current < minimum."""
    manual = F.lit(False) if manual is None else manual
    return F.when(~has_target, False).when(minimum.isNull() | manual | current.isNull(), True).otherwise(version_below(current, minimum))


def recommendations(dependencies: DataFrame, rules: list[Rule], target: int) -> DataFrame:
    """Dependencies whose first matching rule asks for a newer version under `target`: rule_id, minimum, recommended added."""
    def of(r: Rule) -> tuple:
        least, best = f"minimum_{target}", f"recommended_{target}"
        return r.id, r.values.get(least), r.values.get(best), best in r.values or least in r.values

    values = dependencies.sparkSession.createDataFrame(list({r.id: of(r) for r in rules}.values()), "rule_id string, minimum string, recommended string, has__ boolean")
    known = first_match(dependencies, rules).where("rule_id is not null").join(values, "rule_id").select(*dependencies.columns, "rule_id", "minimum", "recommended", "has__")
    manual = F.lower(F.coalesce("minimum", F.lit(""))).isin("manual", "review")
    return known.where(upgrade_due(F.col("version"), F.col("minimum"), F.col("has__"), manual)).drop("has__")


@dataclass(frozen=True)
class ApiRule:
    id: str
    severity: str = "warning"
    symbols: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    excluded_prefixes: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    applies_from: int | None = None


def any_prefix(symbol: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | symbol.startswith(p)
    return hit


def whole_or_below(term: str, symbol: Column) -> Column:
    return (symbol == term) | symbol.startswith(term + ".")


def matched_terms(symbols: Column, rule: ApiRule) -> Column:
    """The terms of a rule that a row's symbols match, sorted, each once; a symbol under an excluded prefix matches nothing.

    symbols match whole or up to a dot, prefixes as prefixes, patterns as substrings with stars as gaps.
    """
    excluded = list(rule.excluded_prefixes)
    allowed = F.filter(symbols, lambda s: ~any_prefix(s, excluded)) if excluded else symbols

    def hit(term: str, test: Callable[[Column], Column]) -> Column:
        return F.when(F.exists(allowed, lambda s: test(s)), term)

    hits = [hit(t, functools.partial(whole_or_below, t)) for t in rule.symbols]
    hits += [hit(t, functools.partial(any_prefix, prefixes=[t])) for t in rule.prefixes]
    hits += [hit(t, functools.partial(F.regexp_like, regexp=F.lit(".*".join(quoted(x) for x in t.split("*"))))) for t in rule.patterns]
    return F.array_sort(F.array_distinct(F.filter(F.array(*hits).cast("array<string>"), lambda x: x.isNotNull())))


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if text else ""


def api_findings(rows: DataFrame, rules: list[ApiRule], target: int) -> DataFrame:
    """A row for each rule in force at `target` and each row (file, line, symbols) that it matches: rule_id, severity, terms."""
    active = [r for r in rules if (r.applies_from or 0) <= target]
    if sum(len(r.symbols) + len(r.prefixes) + len(r.patterns) for r in active) > CODED_RULES:
        return rule_index.api_findings(rows, active)
    found = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), matched_terms(F.col("symbols"), r).alias("terms")) for r in active))
    return rows.withColumn("f", F.explode(F.filter(found, lambda x: F.size(x["terms"]) > 0))).select(*rows.columns, "f.*")


def mutual_prefix(rows: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """A row for each listed text that is a prefix of the column's value or the other way round: columns and `prefix`."""
    if len(prefixes) > CODED_RULES:
        found = rule_index.mutual_prefixes(rows.select(F.col(column).alias("value")), prefixes)
        return rows.join(found.withColumnRenamed("value", column), column).select(*rows.columns, "prefix")
    value = F.col(column)
    hits = F.filter(F.array(*(F.when(value.startswith(p) | F.lit(p).startswith(value), p) for p in dict.fromkeys(prefixes))).cast("array<string>"), lambda x: x.isNotNull())
    return rows.withColumn("prefix", F.explode(hits))


def replacements(findings: DataFrame, listed: dict[str, list[str]]) -> DataFrame:
    """replacement_id and the sorted distinct symbols of findings that share a prefix with one of its texts; a replacement without findings gives no row."""
    texts = findings.sparkSession.createDataFrame([(name, p) for name, own in listed.items() for p in own], "replacement_id string, prefix string")
    hits = mutual_prefix(findings.select("symbol").distinct(), "symbol", sorted({p for own in listed.values() for p in own})).join(texts, "prefix")
    return hits.groupBy("replacement_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


@dataclass(frozen=True)
class ConfigRule:
    id: str
    type: str = "UNKNOWN"
    framework: str | None = None
    categories: tuple[str, ...] = ("configuration",)
    names: tuple[str, ...] = ()
    file_patterns: tuple[str, ...] = ()
    path_patterns: tuple[str, ...] = ()
    xml_roots: tuple[str, ...] = ()
    namespaces: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()


def key_under(key: Column, prefix: str) -> Column:
    """A prefix with a final dot is a plain prefix; one without is a whole key or the key's parent."""
    return key.startswith(prefix) if prefix.endswith(".") else (key == prefix) | key.startswith(prefix + ".")


def _any_key_under(prefix: str) -> Column:
    return F.exists("keys", lambda k: key_under(k, prefix))


def valid_pattern(pattern: str) -> bool:
    """Whether Spark can read a regular expression."""
    session = SparkSession.active()
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def any_pattern(value: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the regular expressions is found; one that cannot be read finds nothing."""
    hit = F.lit(False)
    for p in filter(valid_pattern, patterns):
        hit = hit | F.regexp_like(value, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def config_signs(rule: ConfigRule) -> dict[str, Column]:
    """Each sign by which a configuration file (file_name, path, contents, xml_root, keys) may be of a rule's kind."""
    spaces, keys = F.lit(False), F.lit(False)
    for n in rule.namespaces:
        spaces = spaces | F.col("contents").contains(n)
    for p in rule.prefixes:
        keys = keys | _any_key_under(p)
    return {
        "filename": F.col("file_name").isin(list(rule.names)),
        "filename_pattern": any_pattern(F.col("file_name"), rule.file_patterns),
        "path_pattern": any_pattern(F.col("path"), rule.path_patterns),
        "xml_root": F.coalesce(F.col("xml_root").isin(list(rule.xml_roots)), F.lit(False)),
        "xml_namespace": F.coalesce(spaces, F.lit(False)),
        "property_prefix": F.coalesce(keys, F.lit(False)),
    }


def config_match(rule: ConfigRule) -> Column:
    """Whether a configuration file is of a rule's kind: any one sign is enough."""
    hit = F.lit(False)
    for sign in config_signs(rule).values():
        hit = hit | sign
    return F.coalesce(hit, F.lit(False))


def config_evidence(rule: ConfigRule) -> Column:
    """The names of the signs by which a file is of a rule's kind, and the rule's id."""
    return F.array_compact(F.array(F.lit(rule.id), *(F.when(sign, name) for name, sign in config_signs(rule).items())))


def config_files(files: DataFrame, rules: list[ConfigRule]) -> DataFrame:
    """Files of any rule's kind: type of the first rule, its or the next known framework, all categories, rule ids and evidence."""
    if sum(len(r.names) + len(r.file_patterns) + len(r.path_patterns) + len(r.xml_roots) + len(r.namespaces) + len(r.prefixes) for r in rules) > CODED_RULES:
        patterns = [p for field in ("file_patterns", "path_patterns") for r in rules for p in getattr(r, field)]
        return rule_index.config_files(files, rules, [valid_pattern(p) for p in patterns])
    fields = lambda r: F.struct(F.lit(r.id).alias("id"), F.lit(r.type).alias("type"), F.lit(r.framework).cast("string").alias("framework"), F.array(*(F.lit(c) for c in r.categories)).cast("array<string>").alias("categories"), config_evidence(r).alias("evidence"))
    rows = F.array(*(F.when(config_match(r), fields(r)) for r in rules))
    hit = files.withColumn("hits", F.filter(rows, lambda x: x.isNotNull())).where(F.size("hits") > 0)
    frameworks = F.filter(F.transform("hits", lambda h: h["framework"]), lambda x: x.isNotNull())
    return hit.withColumns(
        {
            "type": F.element_at("hits", 1)["type"],
            "framework": F.get(frameworks, F.lit(0)),
            "categories": F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["categories"])))),
            "rule_ids": F.transform("hits", lambda h: h["id"]),
            "evidence": F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["evidence"])))),
        }
    ).drop("hits")


def config_summary(modules: DataFrame, files: DataFrame, properties: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row: modules, configuration_files, properties, linked_dependencies (distinct by module and coordinates)."""
    linked = dependencies.select("module_id", "group_id", "artifact_id").distinct()
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in {"modules": modules, "configuration_files": files, "properties": properties, "linked_dependencies": linked}.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.groupBy().pivot("name", ["modules", "configuration_files", "properties", "linked_dependencies"]).agg(F.first("n"))


def hint_links(rows: DataFrame, hints: dict[str, str], columns: list[str]) -> DataFrame:
    """A row for each hint (a regular expression) that any of the columns matches: columns and `hint`."""
    listed = {name: p for name, p in hints.items() if valid_pattern(p)}
    if len(listed) > CODED_RULES:
        number = dict(enumerate(listed))
        values = rows.select(F.explode(F.array_compact(F.array(*columns))).alias("value"))
        hits = rule_index.pattern_hits(values, [(n, listed[name]) for n, name in number.items()])
        names = rows.sparkSession.createDataFrame(list(number.items()), "ordinal int, hint string")
        keyed = rows.withColumn("key__", F.to_json(F.array(*(F.col(c).cast("string") for c in columns))))
        each = keyed.select("key__", F.explode(F.array_compact(F.array(*columns))).alias("value")).distinct()
        found = each.join(hits, "value").join(names, "ordinal").select("key__", "hint").distinct()
        return keyed.join(found, "key__").select(*rows.columns, "hint")
    texts = F.array_compact(F.array(*columns))

    def found(pattern: str) -> Column:
        return F.exists(texts, lambda v: F.regexp_like(v, F.lit(pattern)))

    tests = F.array(*(F.when(found(p), name) for name, p in listed.items())).cast("array<string>")
    return rows.withColumn("hint", F.explode(F.filter(tests, lambda x: x.isNotNull())))


def updated_versions(declared: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Declared rows with the resolved version where there is one, the first by ordinal; else their own."""
    first = resolved.groupBy(*keys).agg(F.min_by("version", "ordinal").alias("resolved"))
    return declared.join(first, keys, "left").withColumn("version", F.coalesce("resolved", "version")).drop("resolved")


def preferred_first(rows: DataFrame, key: str, kind: str, preferred: list[str], order: str, value: str) -> DataFrame:
    """For each key the value of the first row of a preferred kind, else of the first row."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(~F.col(kind).isin(preferred), F.col(order))).alias(value))
