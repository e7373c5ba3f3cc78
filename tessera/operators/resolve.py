"""Resolution of places to their owners: intervals of lines, and prefixes of paths.

A place meets intervals without a pair of the two ever being made. Every interval is cut into the at most 2 log(width) dyadic segments
(level, node) of a segment tree that make it up, and each segment keeps the best interval over it, by an aggregation that combines before
the shuffle. A distinct place then looks up its own segment of each level that its key has, by an equi-join with one row a segment, and
takes the best of those few. Work grows with places and intervals, not with how many of them overlap, and a key with very many rows is
dealt over its segments. Prefixes are met by an equi-join on the point's own prefixes, never by a theta join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(start: Column, end: Column) -> Column:
    """The dyadic segments of [start, end], both integers: node n of level j is [n * 2 ** j, (n + 1) * 2 ** j)."""
    levels = F.sequence(F.lit(0), F.floor(F.log2((end - start + 1).cast("double"))).cast("int"))

    def of_level(j: Column) -> Column:
        # the part of the interval in whole nodes of this level begins at low and ends before high
        low, high = -F.call_function("shiftright", -start, j), F.call_function("shiftright", end + 1, j)
        odd_low, odd_high = low.bitwiseAND(F.lit(1)), high.bitwiseAND(F.lit(1))
        left = F.when((odd_low == 1) & (low < high), F.struct(j.alias("level"), low.alias("node")))
        right = F.when((odd_high == 1) & (low + odd_low < high), F.struct(j.alias("level"), (high - 1).alias("node")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(levels, of_level))


def best_covering(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, order: list[Column], value: str) -> DataFrame:
    """`points` with the `value` of the first interval in `order` of those of the same key with start <= at <= end; null where none is.

    Places and ends are integers. Null keys, places and ends match nothing; intervals that end before they start cover nothing.
    """
    spans = intervals.where(F.col(start) <= F.col(end)).select(F.col(key), F.struct(*order).alias("order__"), F.col(value).alias("value__"), F.explode(segments(F.col(start).cast("long"), F.col(end).cast("long"))).alias("s__"))
    best = spans.groupBy(key, F.col("s__.level").alias("level__"), F.col("s__.node").alias("node__")).agg(F.min(F.struct("order__", "value__")).alias("best__"))
    levels = best.groupBy(key).agg(F.collect_set("level__").alias("levels__"))  # at most 64 a key
    places = points.select(key, at).distinct().join(levels, key).withColumn("level__", F.explode("levels__")).drop("levels__")
    places = places.withColumn("node__", F.call_function("shiftright", F.col(at).cast("long"), F.col("level__")))
    found = places.join(best, [key, "level__", "node__"]).groupBy(key, at).agg(F.min("best__").alias("best__")).select(key, at, F.col("best__.value__").alias(value))
    return points.join(found, [key, at], "left").select(*points.columns, value)


def first_interval(points: DataFrame, intervals: DataFrame, key: str, point_id: str, at: str, start: str, end: str, owner: str) -> DataFrame:
    """`points` with the first covering interval's `owner` in owner order, null where none covers."""
    return best_covering(points, intervals, key, at, start, end, [F.col(owner)], owner)


def innermost_interval(points: DataFrame, intervals: DataFrame, key: str, point_id: str, at: str, start: str, end: str, owner: str) -> DataFrame:
    """`points` with the narrowest covering interval's `owner`, ties in owner order; null where none covers."""
    return best_covering(points, intervals, key, at, start, end, [F.col(end) - F.col(start), F.col(owner)], owner)


def innermost_target(points: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """point_id with target_kind and target_id: the innermost method that covers (file, line), else the innermost class."""
    in_method = innermost_interval(points, methods.select("file", "start_line", "end_line", F.col("id").alias("method_id")), "file", "point_id", "line", "start_line", "end_line", "method_id")
    both = innermost_interval(in_method, classes.select("file", "start_line", "end_line", F.col("id").alias("class_id")), "file", "point_id", "line", "start_line", "end_line", "class_id")
    kind = F.when(F.col("method_id").isNotNull(), "method").when(F.col("class_id").isNotNull(), "class")
    return both.withColumns({"target_kind": kind, "target_id": F.coalesce("method_id", "class_id")}).drop("method_id", "class_id")


def test_targets(definitions: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """What test cases exercise or mention: test_case_id, target_kind, target_id, relationship, confidence, source.

    A definition (test_case_id, name, file, line: where what a case calls is defined) leads to the innermost method around its place,
    which the case exercises, else to the innermost class, which it mentions; one outside both leads nowhere. Of definitions with one
    case, kind, target and relationship the first by file, line and name stays. Distinct places are resolved once.
    """
    places = definitions.select("file", "line").distinct().withColumn("point_id", F.xxhash64("file", "line"))
    found = innermost_target(places, methods, classes).where("target_id is not null").select("file", "line", "target_kind", "target_id")
    # fixed values: the words for kinds and relationships, the confidence, and what a source is told by
    source = F.concat(F.lit("jdtls_definition:"), "name", F.lit("@"), "file", F.lit(":"), "line")
    rows = definitions.join(found, ["file", "line"]).withColumns({"relationship": F.when(F.col("target_kind") == "method", "exercises").otherwise("mentions"), "source": source})
    first = rows.groupBy("test_case_id", "target_kind", "target_id", "relationship").agg(F.min_by("source", F.struct("file", "line", "name")).alias("source"))
    return first.select("test_case_id", "target_kind", "target_id", "relationship", F.lit(0.95).alias("confidence"), "source")


def path_prefixes(path: Column, separator: str = "/", proper: bool = False) -> Column:
    """All prefixes of a path at its separators, the shortest first, and "." for the root."""
    parts = F.split(path, separator)
    n = F.size(parts) - (1 if proper else 0)
    longer = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, 1, k), separator))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), longer)


def longest_prefix_owner(paths: DataFrame, owners: DataFrame, path: str, prefix: str, owner: str, proper: bool = False) -> DataFrame:
    """`paths` with the owner of the longest prefix (whole segments; "." owns all); ties by owner; null where none is one."""
    steps = paths.select(path).distinct().withColumn(prefix, F.explode(path_prefixes(F.col(path), proper=proper)))
    found = steps.join(owners.select(prefix, owner), prefix)
    best = found.groupBy(path).agg(F.min_by(owner, F.struct(-F.length(prefix) + F.when(F.col(prefix) == ".", 1).otherwise(0), F.col(owner))).alias(owner))
    return paths.join(best, path, "left")


def parent_owner(modules: DataFrame) -> DataFrame:
    """Modules (id, path) with parent_id, the module of the longest proper prefix; the root has none."""
    below = modules.where("path <> '.'")
    found = longest_prefix_owner(below.select("id", "path"), modules.select(F.col("path").alias("prefix"), F.col("id").alias("parent_id")), "path", "prefix", "parent_id", proper=True)
    return modules.join(found.select("id", "parent_id"), "id", "left")


def first_scope(findings: DataFrame, scopes: DataFrame) -> DataFrame:
    """`findings` (finding_id, file) with the scope_id of the first scope, by ordinal, whose path the file lies in."""
    steps = findings.select("finding_id", F.explode(path_prefixes(F.col("file"))).alias("path"))
    first = steps.join(scopes.select("path", "ordinal", "scope_id"), "path").groupBy("finding_id").agg(F.min_by("scope_id", F.struct("ordinal", "scope_id")).alias("scope_id"))
    return findings.join(first, "finding_id", "left")
