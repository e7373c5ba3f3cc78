"""Reports of a tree of modules: each module's rows by type, its children inside it, and totals over everything below a module.

Rows become JSON and are gathered by module, all types in one shuffle. The tree is folded from its deepest level up: a level's reports are
gathered by parent, in the order of their ids, and put into the level above. A report is as large as what it reports; of a tree that is
too large for one, `with_tables` has the same a module, and `totals` the same numbers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.classify import ROW_TYPES
from tessera.operators.resolve import path_prefixes

#: what a module's rows of a type are in the order of
ORDER = {"models": "qualified_name", "dtos": "qualified_name", "request_bodies": "type_name", "response_bodies": "type_name", "repositories": "qualified_name", "entities": "qualified_name", "tables": "name", "columns": "field_name"}
#: levels that are folded before their lineage is cut
LEVELS = 8


def tagged(rows: Mapping[str, DataFrame]) -> DataFrame:
    """module_id, type, key and json of all rows."""
    out = None
    for kind, t in rows.items():
        columns = [c for c in t.columns if c != "module_id"]
        part = t.select("module_id", F.lit(kind).alias("type"), F.col(ORDER[kind]).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("json"))
        out = part if out is None else out.unionByName(part)
    return out


def with_tables(modules: DataFrame, rows: Mapping[str, DataFrame], used: DataFrame | None = None) -> DataFrame:
    """Modules with `report`, their own JSON up to where their children stand: id, name, path, the rows of each type, and used dependencies.

    Every module has a report, one without rows empty lists. Rows of unknown modules are left out; a module's rows of equal keys stand in
    the order of their JSON. `used` holds module_id and further columns, all of them part of the report, as its last list.
    """
    every = tagged(rows)
    kinds = [*ROW_TYPES, "used_dependencies"]
    if used is not None:
        whole = F.to_json(F.struct(*[c for c in used.columns if c != "module_id"]))
        every = every.unionByName(used.select("module_id", F.lit("used_dependencies").alias("type"), whole.alias("key"), whole.alias("json")))
    lists = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == k, F.struct("key", "json")))), lambda x: x["json"]), ",").alias(k) for k in kinds]
    of = every.groupBy(F.col("module_id").alias("id")).agg(*lists)
    own = F.to_json(F.struct("id", "name", "path"))
    parts = [F.concat(F.lit(f',"{k}":['), F.coalesce(k, F.lit("")), F.lit("]")) for k in kinds]
    return modules.join(of, "id", "left").select(*modules.columns, F.concat(F.substr(own, F.lit(1), F.length(own) - 1), *parts).alias("report"))


def folded(modules: DataFrame) -> DataFrame:
    """The roots (depth 0) with their whole report. Columns read: id, parent_id, depth, report (open at its end).

    As many rounds as the tree is deep; each touches the rows of one level. Modules whose parent is unknown are left out with what is in
    them.
    """
    deepest = modules.agg(F.max("depth")).first()[0] or 0
    level = modules.where(F.col("depth") == deepest).withColumn("report", F.concat("report", F.lit(',"children":[]}')))
    for depth in range(deepest - 1, -1, -1):
        inside = level.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "report"))), lambda x: x["report"]), ",").alias("children__"))
        above = modules.where(F.col("depth") == depth).join(inside, "id", "left")
        level = above.withColumn("report", F.concat("report", F.lit(',"children":['), F.coalesce("children__", F.lit("")), F.lit("]}"))).select(*modules.columns)
        if (deepest - depth) % LEVELS == 0 and depth:
            level = level.checkpoint()
    return level


def nested_report(tree: DataFrame, rows: Mapping[str, DataFrame], used: DataFrame | None = None) -> DataFrame:
    """id and report of the root of a tree (`classify.module_tree`): every module's rows, children in them, as one JSON document."""
    return folded(with_tables(tree, rows, used).select("id", "parent_id", "depth", "report")).select("id", "report")


def totals(modules: DataFrame, rows: Mapping[str, DataFrame]) -> DataFrame:
    """id and for each type the rows of a module and of everything below it. Modules: id, path.

    Rows are counted by module before they meet the modules above, of which a module has as many as its path has parts.
    """
    counted = None
    for kind, t in rows.items():
        part = t.groupBy("module_id").agg(F.count(F.lit(1)).alias("n")).select("module_id", F.lit(kind).alias("type"), "n")
        counted = part if counted is None else counted.unionByName(part)
    steps = modules.select(F.col("id").alias("module_id"), F.explode(F.array_distinct(path_prefixes(F.col("path")))).alias("path"))
    above = steps.join(modules.select("path", "id"), "path").select("module_id", "id")
    sums = above.join(counted, "module_id").groupBy("id").agg(*(F.sum(F.when(F.col("type") == k, F.col("n")).otherwise(0)).alias(k) for k in rows))
    return modules.select("id").join(sums, "id", "left").select("id", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in rows))
