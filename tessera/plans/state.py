"""Deduplication, upserts, coverage and progress as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import coverage, graph, lookups, rules, upsert
from tessera.plans.registry import Registry, read

query = Registry()


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def grouped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.pending(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


#: the progress of a conversation stands in for that of a scenario
_STATUS = "CASE WHEN max(turn) >= 6 THEN 'accepted' WHEN count(*) = 1 THEN 'failed' ELSE 'pending' END"


@query(
    f"SELECT bucket, CAST(count(*) AS bigint) AS total, CAST(count_if(status = 'accepted') AS bigint) AS finished, CAST(count_if(status = 'failed') AS bigint) AS failed "
    f"FROM (SELECT conv_id % 100 AS bucket, conv_id, {_STATUS} AS status FROM conversations GROUP BY conv_id) GROUP BY bucket"
)
def status_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.expr(_STATUS).alias("status")).withColumn("bucket", F.col("conv_id") % 100)
    return coverage.status_funnel(scenarios, "bucket")


@query(
    "SELECT n_nationkey AS id, CAST(count(DISTINCT c_custkey) AS bigint) AS n_inputs, CAST(count(DISTINCT s_suppkey) AS bigint) AS n_observations FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"
)
def two_sided_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is counted before the join, so the sides do not multiply."""
    inputs = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scenario_id"))
    observations = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scenario_id"))
    return coverage.scenario_counts(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), inputs, observations)


@query(
    "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS missing FROM (SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events) "
    "EXCEPT SELECT user_id, event_type FROM events WHERE value > 150) GROUP BY user_id"
)
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types expected of each user that no event of a value over 150 covers."""
    events = read(spark, sf_dir, "events")
    # all types as one array, which a scalar subquery gives to every row
    listed = events.agg(F.array_sort(F.collect_set("event_type")).alias("methods")).scalar()
    expected = events.select(F.col("user_id").alias("scenario_id")).distinct().withColumn("methods", listed)
    observed = events.where("value > 150").groupBy(F.col("user_id").alias("scenario_id")).agg(F.collect_set("event_type").alias("methods"))
    gaps = coverage.coverage_gaps(expected, observed).where(F.size("missing") > 0)
    return gaps.select(F.col("scenario_id").alias("user_id"), F.array_join("missing", ",").alias("missing"))


_EXISTING = "event_id % 10 = 0"


def _upsert_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-ins: users' first events of every tenth id are there already, all other events are new."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    there = graph.first_per_key(events.where(_EXISTING), ["user_id", "event_type"], [F.col("event_id")])
    return there, events.where(f"not ({_EXISTING})")


@query(
    f"""WITH there AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE {_EXISTING} GROUP BY user_id, event_type), fresh AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE NOT ({_EXISTING}) GROUP BY user_id, event_type)
SELECT * FROM there UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.user_id = f.user_id AND t.event_type = f.event_type)"""
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    there, new = _upsert_tables(spark, sf_dir)
    return there.unionByName(upsert.insert_ignore(there, new, ["user_id", "event_type"], ["event_id"]))


@query(
    f"""WITH there AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE {_EXISTING} GROUP BY user_id, event_type), fresh AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE NOT ({_EXISTING}) GROUP BY user_id, event_type)
SELECT * FROM fresh UNION ALL SELECT * FROM there t WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE t.user_id = f.user_id AND t.event_type = f.event_type)"""
)
def insert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    there, new = _upsert_tables(spark, sf_dir)
    return upsert.insert_replace(there, new, ["user_id", "event_type"], ["event_id"])


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, min(url) AS path FROM pages GROUP BY 1")
def min_path_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.min("url").alias("path"))


@query("SELECT user_id, arg_min(event_id, row(CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE 1 END, event_id)) AS event_id FROM events GROUP BY user_id")
def preferred_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("value"))
    return rules.preferred_first(events, "user_id", "event_type", ["purchase", "signup"], "event_id", "value").withColumnRenamed("value", "event_id")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'case' ELSE 'suite' END AS scope FROM conversations")
def scope_label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    own = rows.where("role = 'user'").withColumn("scope", F.lit("case"))
    shared = rows.where("role is null or role <> 'user'").withColumn("scope", F.lit("suite"))
    return own.unionByName(shared).drop("role")


_RANK = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END"


@query(f"SELECT event_id, event_type FROM events ORDER BY {_RANK}, event_id LIMIT 50")
def case_ranked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.ranked_by(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["purchase", "click"], ["event_id"], 50)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10")
def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.page(read(spark, sf_dir, "nation"), ["n_nationkey"], 5, 10).select("n_nationkey", "n_name")


@query(
    "SELECT column_name AS name, CASE WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type LIKE 'TIMESTAMP WITH%' THEN 'timestamp' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type, "
    "true AS nullable, CAST(column_index - 1 AS int) AS position FROM duckdb_columns() WHERE table_name = 'lineitem'"
)
def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.table_schema(read(spark, sf_dir, "lineitem"))


@query(
    "SELECT r_regionkey, r_name, CAST(to_json(nations) AS varchar) AS nations FROM region LEFT JOIN (SELECT n_regionkey, list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey) AS nations FROM nation GROUP BY n_regionkey) ON n_regionkey = r_regionkey"
)
def nested_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region with its nations as one nested list, written as JSON."""
    nations = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return read(spark, sf_dir, "region").join(nations, "r_regionkey", "left").withColumn("nations", F.to_json("nations"))


@query(
    "SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, CAST(count(*) AS bigint) AS processed, CAST(count_if(value < 10) AS bigint) AS failures, CAST(sum(event_id % 7) AS bigint) AS tokens, "
    "coalesce(string_agg(CASE WHEN value < 10 THEN 'failed ' || event_id END, chr(10) ORDER BY event_id), '') AS error FROM events GROUP BY user_id"
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run from its progress events, with the failures' messages in order."""
    events = read(spark, sf_dir, "events")
    message = F.when(F.col("value") < 10, F.concat(F.lit("failed "), F.col("event_id").cast("string")))
    progress = events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.expr("value < 10").alias("failed"), message.alias("message"), (F.col("event_id") % 7).alias("tokens"))
    return upsert.run_rows(progress)


@query("SELECT l_orderkey AS source_id, l_partkey AS target_id, l_returnflag AS kind, l_linestatus AS source, max(l_discount) AS confidence FROM lineitem GROUP BY ALL")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("source"), F.col("l_discount").alias("confidence"))
    return graph.distinct_edges(edges)
