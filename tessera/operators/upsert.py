"""Write semantics over Parquet tables: insert or ignore, insert or replace, resume, run rows, and the commit of proposals.

Nothing updates in place. A table and new rows give the next table, which the caller publishes with one overwrite of a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clipped_lines, content_id
from tessera.operators.graph import EDGE_KINDS, NODE_KINDS, first_per_key, node_id


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    hit = F.lit(True)
    for k in keys:
        hit = hit & left[k].eqNullSafe(right[k])
    return hit


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of `new` that are inserted: keys that `existing` lacks, the first row of each. Null keys are equal to each other."""
    fresh = first_per_key(new, keys, order)
    return fresh.join(existing, same_keys(fresh, existing, keys), "left_anti")


def insert_replace(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The next table: all keys, the last new row of a key replacing what was there."""
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last__")).select(*keys, "last__.*").select(*existing.columns)
    return existing.join(last, same_keys(existing, last, keys), "left_anti").unionByName(last)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def updated(rows: DataFrame, id_column: str, id_value: object, changes: dict[str, object]) -> DataFrame:
    """`rows` with some columns of one id changed; unknown columns are refused."""
    if unknown := [c for c in (id_column, *changes) if c not in rows.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    hit = F.col(id_column) == F.lit(id_value)
    return rows.withColumns({c: F.when(hit, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def inserted(rows: DataFrame, values: dict[str, object]) -> DataFrame:
    """`rows` and one more, its other columns null; unknown columns are refused."""
    if unknown := [c for c in values if c not in rows.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    one = rows.sparkSession.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    return rows.unionByName(one)


def quoted_name(name: str) -> str:
    """A name as an identifier of Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def run_rows(progress: DataFrame) -> DataFrame:
    """One row a run from its progress events (run_id, seq, status, failed, message, tokens): counters, last status, failures in order."""
    failures = F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("seq", "message"))))
    return progress.groupBy("run_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.count(F.lit(1)).alias("processed"),
        F.count_if("failed").alias("failures"),
        F.sum("tokens").alias("tokens"),
        F.array_join(F.transform(failures, lambda x: x["message"]), "\n").alias("error"),
    )


# --- proposals: (method_id, nodes, edges) rows handed in by a model, outside the engine ---


def _evidence_ok(e: Column) -> Column:
    lines = e["source_lines"]
    inside = F.forall(lines, lambda x: (x >= F.col("start_line")) & (x <= F.col("end_line")))
    return (e["method_id"] == F.col("method_id")) & (F.trim(e["reason"]) != "") & (F.size(lines) > 0) & inside & (F.array_sort(F.array_distinct(lines)) == lines)


def _node_ok(n: Column) -> Column:
    confident = (n["confidence"] >= 0) & (n["confidence"] <= 1)
    return F.coalesce(n["kind"].isin(NODE_KINDS) & confident & (F.trim(n["name"]) != "") & (F.trim(n["statement"]) != "") & (F.size(n["evidence"]) > 0) & F.forall(n["evidence"], _evidence_ok), F.lit(False))


def repaired_edges(proposals: DataFrame) -> DataFrame:
    """Proposals with edges made whole: references routed by prefix, confidence 0 to 0.75, evidence from the reason and known lines."""

    def reference(e: Column, side: str) -> tuple[Column, Column]:
        client, node, fallback = e[f"{side}_client_id"], e[f"{side}_node_id"], F.trim(e[side])
        free = client.isNull() & node.isNull() & (F.coalesce(fallback, F.lit("")) != "")
        is_node = fallback.startswith("business-node:")
        return F.when(free & ~is_node, fallback).otherwise(client), F.when(free & is_node, fallback).otherwise(node)

    def lines_of(client: Column) -> Column:
        own = F.filter("nodes", lambda n: n["client_id"] == client)
        return F.flatten(F.transform(F.flatten(F.transform(own, lambda n: n["evidence"])), lambda v: v["source_lines"]))

    def repaired(e: Column) -> Column:
        (sc, sn), (tc, tn) = reference(e, "source"), reference(e, "target")
        given = F.when(F.size(F.coalesce(e["source_lines"], F.array().cast("array<bigint>"))) > 0, e["source_lines"]).otherwise(F.concat(lines_of(sc), lines_of(tc)))
        lines = clipped_lines(given, F.col("start_line"), F.col("end_line"))
        made = F.array(F.struct(F.col("method_id").alias("method_id"), lines.alias("source_lines"), e["reason"].alias("reason")))
        lacks = (F.size(e["evidence"]) == 0) & (F.trim(F.coalesce(e["reason"], F.lit(""))) != "") & (F.size(lines) > 0)
        return F.struct(
            sc.alias("source_client_id"), sn.alias("source_node_id"), tc.alias("target_client_id"), tn.alias("target_node_id"), e["kind"].alias("kind"),
            F.when(e["confidence"] == 0, 0.75).otherwise(e["confidence"]).alias("confidence"), F.when(lacks, made).otherwise(e["evidence"]).alias("evidence"),
        )

    return proposals.withColumn("edges", F.transform("edges", repaired))


def valid_methods(proposals: DataFrame) -> DataFrame:
    """Proposals whose nodes are all valid; one bad node, or one client id given twice, rejects the whole method."""
    clients = F.filter(F.transform("nodes", lambda n: n["client_id"]), lambda c: c.isNotNull())
    return proposals.where(F.forall("nodes", _node_ok) & (F.size(clients) == F.size(F.array_distinct(clients))))


def accepted_nodes(proposals: DataFrame) -> DataFrame:
    """method_id and the nodes of valid methods, with their content ids."""
    return valid_methods(proposals).select("method_id", F.explode("nodes").alias("n")).select("method_id", "n.*").withColumn("id", node_id())


def _id_of(n: Column) -> Column:
    return content_id("business-node:", n["kind"], n["name"], n["statement"])


def _resolved(side: str) -> Column:
    """The node id of an edge's side: its own, or that of the method's node with its client id."""
    own = F.filter("ids", lambda x: x["client_id"] == F.col(f"e.{side}_client_id"))
    return F.coalesce(F.col(f"e.{side}_node_id"), F.try_element_at(F.transform(own, lambda x: x["id"]), F.lit(1)))


def accepted_edges(proposals: DataFrame) -> DataFrame:
    """Edges of accepted methods that are valid one by one, their client references resolved: method_id, source_id, target_id, kind, confidence, evidence."""

    clean = F.transform("nodes", lambda n: F.struct(n["client_id"].alias("client_id"), _id_of(n).alias("id")))
    rows = valid_methods(repaired_edges(proposals)).withColumn("ids", clean).withColumn("e", F.explode("edges"))
    e = F.col("e")
    one = lambda side: e[f"{side}_client_id"].isNull() != e[f"{side}_node_id"].isNull()
    good = e["kind"].isin(EDGE_KINDS) & (e["confidence"] > 0) & (e["confidence"] <= 1) & one("source") & one("target") & (F.size(e["evidence"]) > 0) & F.forall(e["evidence"], _evidence_ok)
    sides = rows.where(F.coalesce(good, F.lit(False))).withColumns({f"{s}_id": _resolved(s) for s in ("source", "target")})
    return sides.where("source_id is not null and target_id is not null").select("method_id", "source_id", "target_id", e["kind"].alias("kind"), e["confidence"].alias("confidence"), e["evidence"].alias("evidence"))


def proposed(proposals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted nodes, accepted edges, and the evidence of both: node_id or source_id, target_id and kind of what it is of, method_id, source_lines, reason."""
    found, linked = accepted_nodes(proposals), accepted_edges(proposals)
    none = F.lit(None).cast("string")
    of_nodes = found.select(F.col("id").alias("node_id"), none.alias("source_id"), none.alias("target_id"), none.alias("kind"), F.explode("evidence").alias("v"))
    of_edges = linked.select(none.alias("node_id"), "source_id", "target_id", "kind", F.explode("evidence").alias("v"))
    return found, linked, of_nodes.unionByName(of_edges).select("node_id", "source_id", "target_id", "kind", "v.method_id", "v.source_lines", "v.reason")


def commit(proposals: DataFrame, nodes: DataFrame, edges: DataFrame, run_id: int) -> dict[str, DataFrame]:
    """New rows for nodes, edges and evidence, as one batch over all methods: the first proposal of a key, in method order, is inserted.

    Edges are told by their key, and evidence that is stored already is not known here; `commit_to` keeps ids and all three tables.
    """
    found, linked, evidence = proposed(proposals)
    new_nodes = insert_ignore(nodes.select("id"), found.select("id", "kind", "name", "statement", "confidence", "method_id"), ["id"], ["method_id", "name", "statement"]).withColumn("created_by_run_id", F.lit(run_id))
    new_edges = insert_ignore(edges.select("source_id", "target_id", "kind"), linked.select("source_id", "target_id", "kind", "confidence", "method_id"), ["source_id", "target_id", "kind"], ["method_id", "confidence"]).withColumn("created_by_run_id", F.lit(run_id))
    key = F.when(F.col("node_id").isNull(), F.concat_ws("|", "source_id", "target_id", "kind"))
    rows = evidence.withColumn("edge_key", key).select("node_id", "edge_key", "method_id", "source_lines", "reason")
    return {"nodes": new_nodes, "edges": new_edges, "evidence": first_per_key(rows, ["node_id", "edge_key", "method_id", "source_lines"], ["reason"])}


STORE = {
    "nodes": "id string, kind string, name string, statement string, confidence double, created_by_run_id bigint",
    "edges": "id bigint, source_id string, target_id string, kind string, confidence double, created_by_run_id bigint",
    "evidence": "node_id string, edge_id bigint, method_id string, source_lines_json string, reason string, created_by_run_id bigint",
}


def numbered(rows: DataFrame, keys: list[str], above: int, buckets: int = 4096) -> DataFrame:
    """`rows`, distinct by `keys`, with gapless ids above all stored ones.

    An id follows from the keys alone, not from how rows lie in partitions, so every plan that holds these rows numbers them alike. Rows
    are numbered within buckets of a hash, behind those of the buckets before; only the buckets' counts meet in one task.
    """
    dealt = rows.withColumn("bucket__", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = dealt.groupBy("bucket__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    place = F.row_number().over(Window.partitionBy("bucket__").orderBy(*keys))
    return dealt.withColumn("place__", place).join(offsets, "bucket__").withColumn("id", F.col("before__") + F.col("place__") + F.lit(above)).drop("bucket__", "place__", "before__")


def commit_to(store: dict[str, DataFrame], proposals: DataFrame, run_id: int) -> dict[str, DataFrame]:
    """The rows that a batch adds to the three tables of a store (STORE); committing a batch again adds none.

    Nodes are new by id, edges by (source_id, target_id, kind). Evidence is of a node or of an edge, never both, so its unique keys are
    partial: (node_id, method_id, lines, reason) where it is of a node, (edge_id, ...) where of an edge. Evidence of an edge takes the id
    that the edge has in the store, or is given now. Of equal keys within a batch the first in method order stays. No table is read whole
    by one task; all meet by equi-joins.
    """
    found, linked, evidence = proposed(proposals)
    key, run = ["source_id", "target_id", "kind"], F.lit(run_id).cast("bigint").alias("created_by_run_id")
    nodes = insert_ignore(store["nodes"].select("id"), found.select("id", "kind", "name", "statement", "confidence", "method_id"), ["id"], ["method_id", "name", "statement"])
    edges = insert_ignore(store["edges"].select(*key), linked.select(*key, "confidence", "method_id"), key, ["method_id", "confidence"])
    last = store["edges"].agg(F.max("id")).first()[0] or 0
    edges = numbered(edges, key, last)
    ids = store["edges"].select("id", *key).unionByName(edges.select("id", *key)).withColumnRenamed("id", "edge_id")
    rows = evidence.join(ids, key, "left").select("node_id", "edge_id", "method_id", F.to_json("source_lines").alias("source_lines_json"), "reason")
    fresh = insert_ignore(store["evidence"], rows, ["node_id", "edge_id", "method_id", "source_lines_json", "reason"], [])
    return {
        "nodes": nodes.select("id", "kind", "name", "statement", "confidence", run),
        "edges": edges.select("id", *key, "confidence", run),
        "evidence": fresh.select("node_id", "edge_id", "method_id", "source_lines_json", "reason", run),
    }
