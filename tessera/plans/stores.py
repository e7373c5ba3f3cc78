"""Publications, reports, logs, phases and the checks of proposals as queries: what is written is read back and compared."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import builds, lookups, rules, sinks, upsert
from tessera.plans import sources
from tessera.plans.registry import Registry, read
from tessera.functions import text as T
from tessera.sources import java, java_model

query = Registry()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; a temporary one only where Spark runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/stores-{uuid.uuid4().hex}"


@query(
    "SELECT 'customers' AS name, count(*) AS n, CAST(sum(c_custkey) AS bigint) AS total FROM customer UNION ALL SELECT 'parts', count(*), CAST(sum(p_partkey) AS bigint) FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'nations', count(*), CAST(sum(n_nationkey) AS bigint) FROM nation"
)
def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables are published, one is replaced, and the newest publication is read; the others stay where they were."""
    base = scratch(spark)
    tables = {"customers": read(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), "parts": read(spark, sf_dir, "part").selectExpr("p_partkey AS k"), "nations": read(spark, sf_dir, "nation").selectExpr("n_nationkey AS k")}
    first = sinks.publish(tables, base)
    sinks.replace_tables(spark, base, {"parts": tables["parts"].where("k % 3 = 0")})
    assert sinks.places(spark, base)["customers"] == f"{first}/customers"
    parts = [t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("k").cast("long").alias("total")) for name, t in sinks.published(spark, base).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT 'report' AS what, s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'log', s_suppkey FROM supplier UNION ALL SELECT 'log', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'rows', s_suppkey FROM supplier UNION ALL SELECT 'rows', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def written_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: a report keeps the second, a log and a table of rows keep both."""
    base = scratch(spark)
    every = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k")
    for batch in (every, every.where("k % 2 = 0")):
        path = sinks.write_report(batch, base, "/w/shop/", "report.json")
        sinks.append_log(batch, f"{base}/log")
        sinks.append(batch, f"{base}/rows")
    found = {"report": spark.read.schema("k long").json(path), "log": spark.read.schema("k long").json(f"{base}/log"), "rows": spark.read.parquet(f"{base}/rows")}
    parts = [t.select(F.lit(name).alias("what"), "k") for name, t in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT n_regionkey AS region, count(*) AS n, 'structure,scored' AS first_run, 'scored' AS second_run FROM nation GROUP BY n_regionkey")
def stored_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phases run once; after a run that only knew the first, a second run makes the second phase alone."""
    base, ran = scratch(spark), []

    def structure(_: dict[str, DataFrame]) -> dict[str, DataFrame]:
        ran.append("structure")
        return {"nations": read(spark, sf_dir, "nation").selectExpr("n_regionkey AS region")}

    def scored(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        ran.append("scored")
        return {"counts": tables["nations"].groupBy("region").agg(F.count(F.lit(1)).alias("n"))}

    sinks.run_phases(spark, f"{base}/whole", "root", [("structure", structure), ("scored", scored)])
    sinks.run_phases(spark, f"{base}/part", "root", [("structure", structure)])
    before = len(ran)
    tables = sinks.run_phases(spark, f"{base}/part", "root", [("structure", structure), ("scored", scored)])
    return tables["counts"].select("region", "n", F.lit(",".join(ran[:2])).alias("first_run"), F.lit(",".join(ran[before:])).alias("second_run"))


@query("SELECT 'g' || s_suppkey AS path, s_suppkey % 3 = 1 AS refused FROM supplier")
def refused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated files may take the place of generated ones alone: of three there is none, one by hand, one generated."""
    s = read(spark, sf_dir, "supplier")
    new = s.selectExpr("concat('g', s_suppkey) AS path", "'// generated by x' AS text")
    existing = s.where("s_suppkey % 3 > 0").selectExpr("concat('g', s_suppkey) AS path", "if(s_suppkey % 3 = 1, 'by hand', '// generated by x, long ago') AS text")
    return sinks.writable(new, existing, "generated by x").select("path", "refused")


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of which some nodes are wrong in one of six ways, and edges in need of repair or wrong in one of four."""
    lines = "CASE WHEN k % 9 = 3 THEN array(11) WHEN k % 9 = 4 THEN array(4, 3) ELSE array(3, 4) END"
    evidence = f"array(named_struct('method_id', if(k % 9 = 5, 'other', m), 'source_lines', {lines}, 'reason', 'seen'))"
    node = f"named_struct('client_id', 'a', 'kind', if(k % 9 = 1, 'Nonsense', 'Workflow'), 'name', if(k % 9 = 6, ' ', concat('N', k)), 'statement', 's', 'confidence', if(k % 9 = 2, 1.5D, 0.5D), 'evidence', {evidence})"
    target = "CASE k % 5 WHEN 0 THEN 'zz' WHEN 1 THEN 'a' ELSE concat('business-node:', k) END"
    edge = (
        f"named_struct('source_client_id', if(k % 5 = 2, 'a', string(null)), 'source_node_id', if(k % 5 = 2, 'business-node:too', string(null)), 'target_client_id', string(null), 'target_node_id', string(null), 'source', 'a', 'target', {target}, "
        f"'kind', if(k % 5 = 3, 'NONSENSE', 'TRIGGERS'), 'confidence', if(k % 2 = 0, 0.0D, 0.25D), 'reason', 'calls', 'source_lines', if(k % 2 = 0, array(bigint(9), bigint(2), bigint(99)), array()), 'evidence', array())"
    )
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat('m', c_custkey) AS m")
    kind = "array<struct<method_id:string,source_lines:array<bigint>,reason:string>>"
    found = rows.selectExpr("m AS method_id", "bigint(1) AS start_line", "bigint(10) AS end_line", f"array({node}) AS nodes", f"array({edge}) AS edges")
    return found.withColumns(
        {
            "nodes": F.col("nodes").cast(f"array<struct<client_id:string,kind:string,name:string,statement:string,confidence:double,evidence:{kind}>>"),
            "edges": F.col("edges").cast(f"array<struct<source_client_id:string,source_node_id:string,target_client_id:string,target_node_id:string,source:string,target:string,kind:string,confidence:double,reason:string,source_lines:array<bigint>,evidence:{kind}>>"),
        }
    )


@query(
    """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 NOT IN (1, 2, 3, 4, 5, 6))
SELECT 'node' AS what, 'm' || k AS method_id, NULL AS target, 0.5::double AS confidence, '3,4' AS lines FROM c
UNION ALL SELECT 'edge', 'm' || k, CASE WHEN k % 5 = 1 THEN 'own' ELSE 'business-node:' || k END, CASE WHEN k % 2 = 0 THEN 0.75 ELSE 0.25 END, CASE WHEN k % 2 = 0 THEN '2,9' ELSE CASE WHEN k % 5 = 1 THEN '3,4' ELSE '3,4' END END FROM c WHERE k % 5 IN (1, 4)"""
)
def accepted_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of proposals: whole methods are refused for a bad node, edges one by one; edges are repaired first."""
    proposals = _proposals(spark, sf_dir)
    text = lambda c: F.array_join(F.flatten(F.transform(c, lambda v: v["source_lines"])).cast("array<string>"), ",")
    nodes = upsert.accepted_nodes(proposals).select(F.lit("node").alias("what"), "method_id", F.lit(None).cast("string").alias("target"), "confidence", text(F.col("evidence")).alias("lines"))
    own = F.when(F.col("target_id") == F.col("source_id"), "own").otherwise(F.col("target_id"))
    edges = upsert.accepted_edges(proposals).select(F.lit("edge").alias("what"), "method_id", own.alias("target"), "confidence", text(F.col("evidence")).alias("lines"))
    return nodes.unionByName(edges)


@query(
    f"""WITH {sources.WHOLE} SELECT 'entry:method:' || q || '#m' || j || '(int,_)@' || file || ':' || (first + j) || ':GetMapping' AS id, 'Http' AS kind, 'Spring MVC' AS framework, '/' || k || '/' || j AS route, 'GET' AS http_method FROM m"""
)
def java_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.entry_points(java_model.methods(java.nodes(sources.files(spark, sf_dir)))).select("id", "kind", "framework", "route", "http_method")


@query(
    f"""WITH {sources.WHOLE} SELECT file AS path, 'import' AS kind, 'jakarta.persistence.*' AS name FROM c UNION ALL SELECT file, 'annotation', '@Entity' FROM c
UNION ALL SELECT file, 'annotation', '@Column(name="f' || i || '")' FROM f UNION ALL SELECT file, 'annotation', '@GetMapping("/' || k || '/' || j || '")' FROM m UNION ALL SELECT file, 'call', 'call' || j || '(a)' FROM m"""
)
def java_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of sources that may name something of another library, without white space."""
    found = java.syntax_candidates(sources.files(spark, sf_dir))
    return found.select("path", "kind", T.compacted(F.col("name")).alias("name"))


@query("SELECT CAST((SELECT count(*) FROM nation) AS bigint) AS modules, CAST((SELECT count(*) FROM supplier) AS bigint) AS configuration_files, CAST((SELECT count(*) FROM customer) AS bigint) AS properties, CAST((SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) AS bigint) AS linked_dependencies")
def configuration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = read(spark, sf_dir, "customer").selectExpr("c_nationkey AS module_id", "c_mktsegment AS group_id", "'a' AS artifact_id")
    return rules.config_summary(read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer"), linked)


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'runs' || c_custkey || ',shouldA' WHEN 1 THEN 'one' ELSE '' END AS names FROM customer")
def generated_test_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted names of the test methods in generated sources."""
    text = r"""CASE c_custkey % 3 WHEN 0 THEN concat('@Test\n  void shouldA() {}\n  @Test void runs', c_custkey, '() { x(); }') WHEN 1 THEN '@Test public void one() {}' ELSE 'void none() {}' END"""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("text"))
    return rows.select("c_custkey", F.array_join(T.test_method_names(F.col("text")), ",").alias("names"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'v' || p_size END AS value FROM part")
def target_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What catalogues say for one target of several."""
    values = F.expr("if(p_partkey % 3 = 0, map('17', 'x'), map('17', 'x', '21', concat('v', p_size)))")
    rows = read(spark, sf_dir, "part").select("p_partkey", values.alias("values"))
    builds.require_tables({"parts": rows}, ["parts"], "the catalogue")
    return rows.select("p_partkey", builds.target_value(F.col("values"), 21).alias("value"))


@query("SELECT c_custkey, 'a%20b%23' || c_custkey || '%25%3F.java' AS coded, TRUE AS same FROM customer")
def percent_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('a b#', c_custkey, '%?.java') AS path").withColumn("coded", T.percent_coded(F.col("path")))
    return rows.select("c_custkey", "coded", (T.percent_decoded(F.col("coded")) == F.col("path")).alias("same"))


@query("SELECT method_id, seq FROM (SELECT 'm' || user_id AS method_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 5")
def allowed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.allowed_calls(read(spark, sf_dir, "events").selectExpr("concat('m', user_id) AS method_id", "event_id AS seq"))


@query(
    f"""WITH {sources.WHOLE} SELECT file AS path, 2 AS line, 'import' AS kind, 'jpa' AS rule_id, 'jakarta.persistence' AS terms FROM c
UNION ALL SELECT file, first + j, 'call', 'calls', 'call*(a)' FROM m WHERE j = 1"""
)
def java_api_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over what sources name; one is not yet in force, and what a rule excludes is left out."""
    listed = [
        rules.ApiRule("jpa", "error", symbols=("jakarta.persistence",)),
        rules.ApiRule("calls", "info", patterns=("call*(a)",), excluded_prefixes=("call0", "call2")),
        rules.ApiRule("later", prefixes=("jakarta",), applies_from=25),
    ]
    found = java.api_scan(sources.files(spark, sf_dir), listed, 21)
    return found.select("path", "line", "kind", "rule_id", F.array_join("terms", ",").alias("terms"))
