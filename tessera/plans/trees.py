"""Nested reports, totals of modules, contexts of methods and commits of proposals as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classify, contexts, reports, upsert
from tessera.plans.extraction import stand_ins, w
from tessera.plans.registry import Registry, read

query = Registry()


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A root, a module for each nation, and one in it for each fiftieth customer; customers are entities and columns of their module."""
    customers = read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat('n', c_nationkey) AS nation", "concat('n', c_nationkey, if(c_custkey % 50 = 0, concat('/c', c_custkey), '')) AS path")
    modules = spark.range(1).selectExpr("'.' AS path", "'root' AS name").unionByName(read(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS path", "n_name AS name")).unionByName(customers.where("k % 50 = 0").selectExpr("path", "concat('c', k) AS name"))
    rows = {
        "entities": customers.where("k % 7 < 2").selectExpr("concat('module:', path) AS module_id", "concat('E', k) AS qualified_name", "k AS start_line"),
        "columns": customers.where("k % 3 = 0").selectExpr("concat('module:', path) AS module_id", "concat('f', k) AS field_name"),
    }
    return modules.selectExpr("concat('module:', path) AS id", "name", "path"), rows


_ROWS = """cust AS (SELECT c_custkey AS k, 'n' || c_nationkey AS nation, 'n' || c_nationkey || CASE WHEN c_custkey % 50 = 0 THEN '/c' || c_custkey ELSE '' END AS path FROM customer),
modules AS (SELECT '.' AS path, 'root' AS name UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT path, 'c' || k FROM cust WHERE k % 50 = 0),
ents AS (SELECT path, string_agg('{"qualified_name":"E' || k || '","start_line":' || k || '}', ',' ORDER BY 'E' || k) AS ents, count(*) AS n FROM cust WHERE k % 7 < 2 GROUP BY path),
cols AS (SELECT path, string_agg('{"field_name":"f' || k || '"}', ',' ORDER BY 'f' || k) AS cols, count(*) AS n FROM cust WHERE k % 3 = 0 GROUP BY path)"""


@query(
    f"""WITH {_ROWS}, own AS (
  SELECT path, '{{"id":"module:' || path || '","name":"' || name || '","path":"' || path || '","models":[],"dtos":[],"request_bodies":[],"response_bodies":[],"repositories":[],"entities":[' || coalesce(ents, '') || '],"tables":[],"columns":[' || coalesce(cols, '')
         || '],"used_dependencies":[],"children":[' AS head FROM modules LEFT JOIN ents USING (path) LEFT JOIN cols USING (path)
), leaves AS (SELECT split_part(path, '/', 1) AS parent, string_agg(head || ']}}', ',' ORDER BY 'module:' || path) AS inside FROM own WHERE contains(path, '/') GROUP BY 1
), nations AS (SELECT string_agg(head || coalesce(inside, '') || ']}}', ',' ORDER BY 'module:' || path) AS inside FROM own LEFT JOIN leaves ON parent = path WHERE path <> '.' AND NOT contains(path, '/'))
SELECT 'module:.' AS id, sha256(head || inside || ']}}') AS digest, CAST(length(head || inside) + 2 AS bigint) AS size FROM own, nations WHERE path = '.'"""
)
def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree as one document, by its digest and length."""
    modules, rows = _tree(spark, sf_dir)
    report = reports.nested_report(classify.module_tree(modules), rows)
    return report.select("id", F.sha2("report", 256).alias("digest"), F.length("report").cast("long").alias("size"))


@query(
    f"""WITH {_ROWS} SELECT 'module:' || m.path AS id, CAST(coalesce(sum(e.n), 0) AS bigint) AS entities, CAST(coalesce(sum(c.n), 0) AS bigint) AS columns
FROM modules m JOIN modules b ON m.path = '.' OR b.path = m.path OR starts_with(b.path, m.path || '/') LEFT JOIN ents e ON e.path = b.path LEFT JOIN cols c ON c.path = b.path GROUP BY m.path"""
)
def module_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules, rows = _tree(spark, sf_dir)
    return reports.totals(modules, rows)


def _first(name: str, table: str, key: str, order: str, text: str, most: int) -> str:
    return f"{name} AS (SELECT {key} AS k, string_agg({text}, ';' ORDER BY r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {table} WHERE {key} IS NOT NULL) WHERE r <= {most} GROUP BY {key})"


_ENTRY = "concat_ws('|', kind, http_method, route)"
_RELATED = "related AS (SELECT target_id, c.*, s.qualified_name AS suite FROM test_targets JOIN test_cases c ON c.id = test_case_id LEFT JOIN test_suites s ON s.id = suite_id WHERE target_kind = 'method')"
_TEST = "concat_ws('#', coalesce(suite, '-'), r.name, r.file, r.start_line, coalesce(a.t, '-'), coalesce(f.t, '-'), coalesce(te.t, '-'))"


@query(
    w("methods", "entry_points", "candidate_signals", "test_targets", "test_cases", "test_suites", "test_assertions", "test_fixtures", "test_entry_points")
    + ", "
    + ", ".join(
        [
            _first("e", "entry_points", "method_id", "kind, route, http_method, id", _ENTRY, 5),
            _first("g", "candidate_signals", "method_id", "weight DESC, count DESC, name", "name || count", 8),
            _first("a", "test_assertions", "test_case_id", "line, id", "'eq: ' || expression", 6),
            _first("f", "test_fixtures", "test_case_id", "line, id", "fixture_kind || ': ' || name", 6),
            _first("te", "test_entry_points", "test_case_id", "kind, route, http_method, id", _ENTRY, 4),
            _RELATED,
            f"x AS (SELECT target_id AS k, string_agg({_TEST}, '&' ORDER BY r.r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY file, start_line, id) AS r FROM related) r "
            "LEFT JOIN a ON a.k = r.id LEFT JOIN f ON f.k = r.id LEFT JOIN te ON te.k = r.id WHERE r.r <= 5 GROUP BY target_id)",
        ]
    )
    + " SELECT DISTINCT m.id AS method_id, coalesce(e.t, '-') AS entry_points, coalesce(g.t, '-') AS signals, coalesce(x.t, '-') AS tests FROM methods m LEFT JOIN e ON e.k = m.id LEFT JOIN g ON g.k = m.id LEFT JOIN x ON x.k = m.id"
)
def method_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins(spark, sf_dir, "methods", "entry_points", "candidate_signals", "test_targets", "test_cases", "test_suites", "test_assertions", "test_fixtures", "test_entry_points", keys={"orders": "o_orderkey", "events": "event_id"})
    t["test_suites"] = t["test_suites"].withColumn("class_name", F.col("qualified_name"))
    t["test_cases"] = t["test_cases"].withColumn("end_line", F.col("start_line"))
    t["test_assertions"] = t["test_assertions"].withColumn("assertion_kind", F.lit("eq"))

    def entries(e):
        return F.transform(e, lambda x: F.concat_ws("|", x["kind"], x["http_method"], x["route"]))

    def joined(texts, sign=";"):
        return F.when(F.size(texts) > 0, F.array_join(texts, sign)).otherwise("-")

    found = contexts.method_contexts(t, t["methods"])
    test = lambda x: F.concat_ws("#", F.coalesce(x["suite_name"], F.lit("-")), x["case_name"], x["file"], x["start_line"].cast("string"), joined(x["assertions"]), joined(x["fixtures"]), joined(entries(x["entry_points"])))
    return found.select("method_id", joined(entries(F.col("entry_points"))).alias("entry_points"), joined(F.transform("signals", lambda s: F.concat(s["name"], s["count"].cast("string")))).alias("signals"), joined(F.transform("tests", test), "&").alias("tests"))


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer proposes one of 50 rules, seen in a line of its own, and an edge from it to a known node."""
    evidence = "array(named_struct('method_id', m, 'source_lines', array(k % 10 + 1), 'reason', 'seen'))"
    edge = (
        f"named_struct('source_client_id', 'a', 'source_node_id', string(null), 'target_client_id', string(null), 'target_node_id', concat('business-node:', k % 5), 'source', string(null), 'target', string(null), "
        f"'kind', 'DEPENDS_ON', 'confidence', 0.5D, 'reason', 'uses', 'source_lines', array(bigint(2)), 'evidence', {evidence})"
    )
    node = f"named_struct('client_id', 'a', 'kind', 'BusinessRule', 'name', concat('N', k % 50), 'statement', concat('S', k % 50), 'confidence', 0.9D, 'evidence', {evidence})"
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat('m', c_custkey) AS m")
    return rows.selectExpr("k", "m AS method_id", "bigint(1) AS start_line", "bigint(10) AS end_line", f"array({node}) AS nodes", f"array({edge}) AS edges")


@query(
    """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS run FROM customer), e AS (
  SELECT k % 50 AS n, k % 5 AS t, k, run FROM c)
SELECT 'node' AS what, 'N' || n AS name, NULL AS target, NULL AS method_id, NULL AS lines, CAST(min(run) AS bigint) AS run FROM e GROUP BY n
UNION ALL SELECT 'edge', 'N' || n, 'business-node:' || t, NULL, NULL, CAST(min(run) AS bigint) FROM e GROUP BY n, t
UNION ALL SELECT 'evidence', 'N' || n, NULL, 'm' || k, '[' || (k % 10 + 1) || ']', CAST(run AS bigint) FROM e
UNION ALL SELECT 'evidence', 'N' || n, 'business-node:' || t, 'm' || k, '[' || (k % 10 + 1) || ']', CAST(run AS bigint) FROM e"""
)
def committed_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after two commits: half of the methods, then all of them, so that half come a second time."""
    every = _proposals(spark, sf_dir)
    store = {k: spark.createDataFrame([], s) for k, s in upsert.STORE.items()}
    for run, batch in enumerate([every.where("k % 2 = 0"), every], 1):
        # each commit is a table of its own, as a writer would leave it
        new = {k: v.persist() for k, v in upsert.commit_to(store, batch.drop("k"), run).items()}
        store = {k: store[k].unionByName(new[k]) for k in store}
    names = store["nodes"].select(F.col("id").alias("node_id"), "name")
    none = F.lit(None).cast("string")
    run = F.col("created_by_run_id").alias("run")
    of_edges = store["edges"].join(names.withColumnRenamed("node_id", "source_id"), "source_id").select(F.col("id").alias("edge_id"), "name", F.col("target_id").alias("target"), "created_by_run_id")
    nodes = store["nodes"].select(F.lit("node").alias("what"), "name", none.alias("target"), none.alias("method_id"), none.alias("lines"), run)
    edges = of_edges.select(F.lit("edge").alias("what"), "name", "target", none.alias("method_id"), none.alias("lines"), run)
    seen = store["evidence"].withColumnRenamed("source_lines_json", "lines")
    of_nodes = seen.join(names, "node_id").select(F.lit("evidence").alias("what"), "name", none.alias("target"), "method_id", "lines", run)
    on_edges = seen.join(of_edges.drop("created_by_run_id"), "edge_id").select(F.lit("evidence").alias("what"), "name", "target", "method_id", "lines", run)
    return nodes.unionByName(edges).unionByName(of_nodes).unionByName(on_edges)
