"""Nodes and edges: content ids, deduplication, neighbours in both directions, locations to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_id
from tessera.operators.resolve import first_interval

# Node and edge kinds, and the lookup bound.
NODE_KINDS = ["BusinessRule", "Workflow", "Invariant", "StateTransition", "SideEffect", "BusinessConcept"]
EDGE_KINDS = ["SUPPORTED_BY", "DEPENDS_ON", "TRIGGERS", "TRANSITIONS_TO", "MENTIONS"]
NEIGHBOURS = 20


def node_id(kind: str = "kind", name: str = "name", statement: str = "statement"):
    return content_id("business-node:", F.col(kind), F.col(name), F.col(statement))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order. Rows of a key are not gathered: an aggregation keeps the least."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("best__"))
    return best.select(*keys, "best__.*").select(*rows.columns)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source_id, target_id, kind, source), that of the highest confidence."""
    return edges.groupBy("source_id", "target_id", "kind", "source").agg(F.max("confidence").alias("confidence"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge seen from both of its ends: node_id, other_id, direction and the edge's other columns."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"), F.lit("outgoing").alias("direction"), *rest)
    return out.unionByName(edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other_id"), F.lit("incoming").alias("direction"), *rest))


def top_per_key(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first `n` rows of each key. Spark keeps only `n` rows a key and task before the shuffle (window group limit)."""
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank__") <= n).drop("rank__")


def neighbours(edges: DataFrame, nodes: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """At most `n` edges of each node and direction, best confidence first, with the other node's name where it is known."""
    seen = top_per_key(both_directions(edges), ["node_id", "direction"], [F.desc("confidence"), F.col("id")], n)
    return seen.join(nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id", "left")


def location_edges(locations: DataFrame, methods: DataFrame, kind: str, confidence: float) -> DataFrame:
    """Edges from the method at (file, line) to target_id, from answers of a language server handed in as rows; loops are dropped."""
    found = first_interval(locations, methods.select("file", "start_line", "end_line", F.col("id").alias("source_id")), "file", "location_id", "line", "start_line", "end_line", "source_id")
    kept = found.where("source_id is not null and source_id <> target_id")
    return distinct_edges(kept.select("source_id", "target_id", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit("language_server").alias("source")))
