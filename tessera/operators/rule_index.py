"""Rule catalogues of any size as inverted indexes, met by equi-joins.

A rule is filed under one of its tests, the most telling: a whole value, else the longest prefix or suffix. A value looks itself up, and
those of its beginnings and ends whose lengths the catalogue has; candidates are then tested in full, so the rows are those of testing
every rule. Only distinct values are looked up, so one that a third of all rows share is looked up once. The catalogue is data, not code:
planning takes the same time for ten rules and for a hundred thousand. Spark broadcasts the smaller side where its size allows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tessera.operators.rules import ApiRule, ConfigRule, Rule

#: characters of a pattern's longest literal that it is filed under
GRAM = 6


def text_keys(value: Column, kind: str, lengths: Sequence[int]) -> Column:
    """What a value is looked up by under tests of one kind: itself, or its beginnings or ends of the given lengths."""
    if kind == "whole":
        return F.array(value)
    fit = F.filter(F.lit(sorted(lengths)).cast("array<int>"), lambda n: n <= F.length(value))
    return F.transform(fit, lambda n: F.substr(value, F.lit(1), n) if kind == "prefix" else F.when(n == 0, "").otherwise(F.substr(value, F.length(value) - n + 1, n)))


def labelled(texts: Column, name: str, **labels: object) -> Column:
    """Each text of an array as a struct of the labels and the text by its name."""
    return F.transform(texts, lambda t: F.struct(*(F.lit(v).alias(k) for k, v in labels.items()), t.alias(name)))


def substrings(text: Column, n: int) -> Column:
    """All substrings of n characters; of a shorter text the text itself."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0))), lambda i: F.substr(text, i + 1, F.lit(n)))


def part_of(pattern: str) -> tuple[str, str]:
    """Kind and text of a wildcard."""
    if pattern == "*":
        return "any", ""
    if pattern.startswith("*"):
        return "suffix", pattern[1:]
    return ("prefix", pattern[:-1]) if pattern.endswith("*") else ("whole", pattern)


def filed(rules: list[Rule], names: list[str]) -> tuple[list[tuple], list[tuple]]:
    """Rules as (ordinal, id, tests, column, kind, text) under their most telling test; those that test for presence alone apart."""
    indexed, present = [], []
    for ordinal, rule in enumerate(rules):
        if None in rule.patterns.values():
            continue  # a test without a pattern never holds
        tests = [(names.index(n), *part_of(p)) for n, p in rule.patterns.items()]
        telling = max((t for t in tests if t[1] != "any"), key=lambda t: (t[1] == "whole", len(t[2])), default=None)
        if telling is None:
            present.append((ordinal, rule.id, [t[0] for t in tests]))
        else:
            indexed.append((ordinal, rule.id, tests, *telling))
    return indexed, present


def passes(values: Column, tests: Column) -> Column:
    def one(t: Column) -> Column:
        v = F.get(values, t["column"])
        hit = F.when(t["kind"] == "any", v.isNotNull()).when(t["kind"] == "suffix", v.endswith(t["text"])).when(t["kind"] == "prefix", v.startswith(t["text"])).otherwise(v == t["text"])
        return F.coalesce(hit, F.lit(False))

    return F.forall(tests, one)


def rule_matches(rows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """`rows` with key__ (the values that rules test, as one text), and (key__, ordinal, rule_id) of every rule that a key's values match.

    Null values match no test; a rule without tests matches every row.
    """
    spark = rows.sparkSession
    names = sorted({n for r in rules for n in r.patterns})
    indexed, present = filed(rules, names)
    texts = [F.col(n).cast("string") for n in names]
    out = rows.withColumn("key__", F.to_json(F.array(*texts)) if names else F.lit("[]"))
    values = out.select("key__", F.array(*texts).cast("array<string>").alias("values")).distinct()
    test = "struct<column:int,kind:string,text:string>"
    index = spark.createDataFrame(indexed, f"ordinal int, rule_id string, tests array<{test}>, column int, kind string, text string")
    lengths: dict[tuple[int, str], set[int]] = {}
    for *_, column, kind, text in indexed:
        lengths.setdefault((column, kind), set()).add(len(text))
    found = spark.createDataFrame([], "key__ string, ordinal int, rule_id string")
    if lengths:
        keys = [labelled(text_keys(F.get("values", F.lit(c)), kind, have), "text", column=c, kind=kind) for (c, kind), have in sorted(lengths.items())]
        asked = values.select("key__", "values", F.explode(F.concat(*(F.coalesce(k, F.array().cast("array<struct<column:int,kind:string,text:string>>")) for k in keys))).alias("k")).select("key__", "values", "k.*").where("text is not null")
        found = asked.join(index, ["column", "kind", "text"]).where(passes(F.col("values"), F.col("tests"))).select("key__", "ordinal", "rule_id")
    if present:
        listed = spark.createDataFrame(present, "ordinal int, rule_id string, columns array<int>").groupBy("columns").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rule_id"))).alias("rules"))
        # rules that ask for the presence of the same columns stand together; the sets of columns are few
        held = values.select("key__", F.explode(F.lit([list(x) for x in {tuple(p[2]) for p in present}])).alias("columns") if any(p[2] for p in present) else F.array().cast("array<int>").alias("columns"), "values")
        held = held.where(F.forall("columns", lambda c: F.get("values", c).isNotNull()))
        found = found.unionByName(held.join(listed, "columns").select("key__", F.explode("rules").alias("r")).select("key__", "r.*"))
    return out, found


def first_match(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """`rows` with rule_id of the first rule in list order that matches, else null."""
    keyed, found = rule_matches(rows, rules)
    first = found.groupBy("key__").agg(F.min(F.struct("ordinal", "rule_id")).alias("first__"))
    return keyed.join(first, "key__", "left").select(*rows.columns, F.col("first__.rule_id").alias("rule_id"))


def all_matches(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each row and rule that matches."""
    keyed, found = rule_matches(rows, rules)
    return keyed.join(found.select("key__", "rule_id"), "key__").select(*rows.columns, "rule_id")


def pieces(pattern: str) -> str:
    """The longest literal of a pattern whose stars are gaps."""
    return max(pattern.split("*"), key=len)


def symbol_terms(symbols: DataFrame, rules: list[ApiRule]) -> DataFrame:
    """(symbol, ordinal, term) for each rule (by its place in the list) and term that a symbol matches; symbols are distinct.

    A rule's symbols match whole or up to a dot, its prefixes as prefixes, its patterns as substrings with stars as gaps; what lies under
    an excluded prefix of the rule matches nothing of it.
    """
    spark = symbols.sparkSession
    terms = [(n, "below", t, t) for n, r in enumerate(rules) for t in r.symbols] + [(n, "prefix", t, t) for n, r in enumerate(rules) for t in r.prefixes]
    terms += [(n, "pattern", pieces(t)[:GRAM], t) for n, r in enumerate(rules) for t in r.patterns]
    excluded = [(n, t) for n, r in enumerate(rules) for t in r.excluded_prefixes]
    index = spark.createDataFrame(terms, "ordinal int, kind string, key string, term string")
    s = F.col("symbol")

    def lengths(kind: str) -> list[int]:
        return sorted({len(k) for _, of, k, _ in terms if of == kind})

    grams = [substrings(s, n) if n else F.array(F.lit("")) for n in lengths("pattern")]
    keys = {"below": below(s), "prefix": text_keys(s, "prefix", lengths("prefix")), "pattern": F.array_distinct(F.concat(*grams)) if grams else F.array().cast("array<string>")}
    every = F.concat(*(labelled(k, "key", kind=kind) for kind, k in keys.items()))
    found = symbols.where("symbol is not null").select("symbol", F.explode(every).alias("k")).select("symbol", "k.*").join(index, ["kind", "key"])
    gap = F.concat(F.lit(r"\Q"), F.regexp_replace(F.replace("term", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), r"\*", r"\\E.*\\Q"), F.lit(r"\E"))
    literal = ~F.contains("term", F.lit("*"))
    fits = F.when(F.col("kind") != "pattern", True).when(literal, F.contains("symbol", F.col("term"))).otherwise(F.regexp_like("symbol", gap))
    found = found.where(fits).select("symbol", "ordinal", "term").distinct()
    if excluded:
        out = spark.createDataFrame(excluded, "ordinal int, key string")
        gone = symbols.where("symbol is not null").select("symbol", F.explode(text_keys(s, "prefix", sorted({len(t) for _, t in excluded}))).alias("key")).join(out, "key").select("symbol", "ordinal").distinct()
        found = found.join(gone, ["symbol", "ordinal"], "left_anti")
    return found


def api_findings(rows: DataFrame, rules: list[ApiRule]) -> DataFrame:
    """A row for each row (symbols: an array) and rule that it matches: rule_id, severity, terms (sorted, each once)."""
    known = rows.sparkSession.createDataFrame([(n, r.id, r.severity) for n, r in enumerate(rules)], "ordinal int, rule_id string, severity string")
    keyed = rows.withColumn("key__", F.to_json("symbols"))
    each = keyed.select("key__", F.explode("symbols").alias("symbol")).distinct()
    found = symbol_terms(each.select("symbol").distinct(), rules)
    by_key = each.join(found, "symbol").groupBy("key__", "ordinal").agg(F.array_sort(F.collect_set("term")).alias("terms")).join(known, "ordinal")
    return keyed.join(by_key, "key__").select(*rows.columns, "rule_id", "severity", "terms")


def mutual_prefixes(values: DataFrame, texts: Sequence[str]) -> DataFrame:
    """(value, prefix) for each distinct value and text of which one begins the other."""
    listed = values.sparkSession.createDataFrame([(t,) for t in sorted(set(texts))], "prefix string")
    values = values.where("value is not null").distinct()
    over = values.select("value", F.explode(text_keys(F.col("value"), "prefix", sorted({len(t) for t in texts}))).alias("prefix")).join(listed, "prefix")
    longer = listed.where("length(prefix) > 0").select("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix") - 1), lambda n: F.substr(F.col("prefix"), F.lit(1), n))).alias("value"))
    return over.select("value", "prefix").unionByName(values.join(longer, "value").select("value", "prefix"))


def pattern_hits(values: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """(value, ordinal) for each distinct value and regular expression that is found in it. Expressions can't be filed; they are data that each distinct value is tested against."""
    listed = F.from_json(F.lit(json.dumps([{"ordinal": n, "pattern": p} for n, p in patterns])), "array<struct<ordinal:int,pattern:string>>")
    hits = F.filter(listed, lambda p: F.regexp_like(F.col("value"), p["pattern"]))
    return values.where("value is not null").distinct().select("value", F.explode(hits).alias("p")).select("value", "p.ordinal").distinct()


def below(value: Column) -> Column:
    """A dotted name's beginnings at its dots, itself included."""
    parts = F.split(value, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def telling_grams(texts: Sequence[str]) -> dict[str, str]:
    """For each text the substring of GRAM characters (a shorter text: itself) that the fewest of the texts hold; of equals the last, as names differ in their ends."""
    distinct = set(texts)
    grams = {t: [t[i : i + GRAM] for i in range(max(1, len(t) - GRAM + 1))] for t in distinct}
    held = Counter(g for own in grams.values() for g in set(own))
    return {t: min(reversed(own), key=held.__getitem__) for t, own in grams.items()}


def config_signs(files: DataFrame, rules: list[ConfigRule], readable: list[bool]) -> DataFrame:
    """key__, ordinal, sign: by which signs a configuration file is of the kind of which rules. `readable` tells of each regular expression, in the order of the rules, whether it can be read."""
    spark = files.sparkSession

    def table(texts: list[tuple[int, str]], name: str) -> DataFrame:
        return spark.createDataFrame(texts, f"ordinal int, {name} string").distinct()

    def of(field: str) -> list[tuple[int, str]]:
        return [(n, t) for n, r in enumerate(rules) for t in getattr(r, field)]

    can_read = iter(readable)
    patterns = {sign: [(n, p) for n, r in enumerate(rules) for p in getattr(r, field) if next(can_read)] for sign, field in (("filename_pattern", "file_patterns"), ("path_pattern", "path_patterns"))}
    found = files.select("key__", "file_name").join(table(of("names"), "file_name"), "file_name").select("key__", "ordinal", F.lit("filename").alias("sign"))
    roots = files.select("key__", "xml_root").join(table(of("xml_roots"), "xml_root"), "xml_root").select("key__", "ordinal", F.lit("xml_root").alias("sign"))
    found = found.unionByName(roots)
    for sign, column in (("filename_pattern", "file_name"), ("path_pattern", "path")):
        if patterns[sign]:
            hits = pattern_hits(files.select(F.col(column).alias("value")), patterns[sign]).withColumnRenamed("value", column)
            found = found.unionByName(files.select("key__", column).join(hits, column).select("key__", "ordinal", F.lit(sign).alias("sign")))
    prefixes = of("prefixes")
    if prefixes:
        each = files.select("key__", F.explode("keys").alias("key")).where("key is not null").distinct()
        # a key's beginnings at its dots meet whole prefixes, the same with their dot those that end in one; an odd prefix such as "." is a beginning of a length
        odd = sorted({len(t) for _, t in prefixes if t.endswith(".")})
        starts = F.concat(labelled(below(F.col("key")), "prefix", dotted=False), labelled(text_keys(F.col("key"), "prefix", odd), "prefix", dotted=True))
        looked = each.select("key").distinct().select("key", F.explode(starts).alias("s")).select("key", "s.*")
        listed = spark.createDataFrame([(n, t, t.endswith(".")) for n, t in prefixes], "ordinal int, prefix string, dotted boolean").distinct()
        hits = looked.join(listed, ["prefix", "dotted"]).select("key", "ordinal").distinct()
        found = found.unionByName(each.join(hits, "key").select("key__", "ordinal", F.lit("property_prefix").alias("sign")))
    spaces = of("namespaces")
    if spaces:
        sizes = sorted({min(len(t), GRAM) for _, t in spaces})
        grams = F.array_distinct(F.concat(*(substrings(F.col("contents"), n) if n else F.array(F.lit("")) for n in sizes)))
        filed_under = telling_grams([t for _, t in spaces])
        listed = spark.createDataFrame([(n, filed_under[t], t) for n, t in spaces], "ordinal int, gram string, namespace string").distinct()
        # equal contents are looked up once; a text travels with its grams, so that it meets each rule's namespace in the same join
        texts = files.where("contents is not null").select("contents").distinct()
        hits = texts.select("contents", F.explode(grams).alias("gram")).join(listed, "gram").where(F.contains("contents", F.col("namespace"))).select("contents", "ordinal").distinct()
        found = found.unionByName(files.select("key__", "contents").join(hits, "contents").select("key__", "ordinal", F.lit("xml_namespace").alias("sign")))
    return found.distinct()


def config_files(files: DataFrame, rules: list[ConfigRule], readable: list[bool]) -> DataFrame:
    """Files of any rule's kind, as `rules.config_files` has them. Files that are equal in all that rules read are looked up once."""
    read = ["path", "file_name", "contents", "xml_root", "keys"]
    keyed = files.withColumn("key__", F.concat_ws("|", "path", F.xxhash64(*read).cast("string")))
    once = keyed.select("key__", *read).dropDuplicates(["key__"])
    known = files.sparkSession.createDataFrame([(n, r.id, r.type, r.framework, list(r.categories)) for n, r in enumerate(rules)], "ordinal int, id string, type string, framework string, categories array<string>")
    hits = config_signs(once, rules, readable).groupBy("key__", "ordinal").agg(F.collect_set("sign").alias("signs")).join(known, "ordinal")
    of = hits.groupBy("key__").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "type", "framework", "categories", "signs"))).alias("hits__"))
    frameworks = F.filter(F.col("hits__")["framework"], lambda x: x.isNotNull())
    return keyed.join(of, "key__").select(
        *files.columns,
        F.element_at("hits__", 1)["type"].alias("type"),
        F.get(frameworks, F.lit(0)).alias("framework"),
        F.array_sort(F.array_distinct(F.flatten(F.col("hits__")["categories"]))).alias("categories"),
        F.col("hits__")["id"].alias("rule_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits__", lambda h: F.concat(F.array(h["id"]), h["signs"]))))).alias("evidence"),
    )
