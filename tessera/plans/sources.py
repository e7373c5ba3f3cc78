"""Java source trees as queries: every customer becomes a file whose members follow from its key, read by the parser; the SQL works the same rows out by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dealing import dealt
from tessera.operators import classify
from tessera.plans.registry import Registry, read
from tessera.sources import java, java_model

query = Registry()

REGISTRY = {"jakarta_persistence": classify.Group(symbols=("jakarta.persistence.Entity", "jakarta.persistence.Column")), "spring_mvc": classify.Group(important_symbols=("org.springframework.web.bind.annotation.GetMapping",))}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a customer: an entity with key % 3 columns and key % 4 methods, each with an anonymous class; every tenth lacks its end."""
    return dealt(read(spark, sf_dir, "customer"), "c_custkey").selectExpr(
        "concat('n', c_nationkey, '/C', c_custkey, '.java') AS path",
        r"""concat('package shop.n', c_nationkey, ';\nimport jakarta.persistence.*;\n@Entity\nclass C', c_custkey, ' extends Base<C', c_custkey, '> {\n',
            array_join(transform(filter(sequence(0, 2), i -> i < c_custkey % 3), i -> concat('  @Column(name = "f', i, '") Map<String, List<T', i, '>> f', i, ';\n')), ''),
            array_join(transform(filter(sequence(0, 3), j -> j < c_custkey % 4), j -> concat('  @GetMapping("/', c_custkey, '/', j, '") T', j, ' m', j, '(int a, T', j, '... r) { new Object() { void in() { call', j, '(a); } }; }\n')), ''),
            if(c_custkey % 10 = 7, '', '}\n')) AS text""",
    )


WHOLE = """c AS (SELECT c_custkey AS k, c_nationkey AS n, 'shop.n' || c_nationkey || '.C' || c_custkey AS q, 'n' || c_nationkey || '/C' || c_custkey || '.java' AS file FROM customer WHERE c_custkey % 10 <> 7),
f AS (SELECT *, unnest(range(k % 3)) AS i FROM c), m AS (SELECT *, unnest(range(k % 4)) AS j, 5 + k % 3 AS first FROM c)"""


@query(
    f"""WITH {WHOLE}, a AS (SELECT k, '@Entity' AS a FROM c UNION ALL SELECT k, '@Column(name = "f' || i || '")' FROM f UNION ALL SELECT k, '@GetMapping("/' || k || '/' || j || '")' FROM m)
SELECT 'class:' || q || '@' || file || ':3' AS id, 'C' || k AS name, q AS qualified_name, 'class' AS kind, file, CAST(3 AS bigint) AS start_line, 5 + k % 3 + k % 4 AS end_line, 'Base' AS superclass, string_agg(a, '|' ORDER BY a) AS annotations
FROM c JOIN a USING (k) GROUP BY k, q, file"""
)
def java_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = java_model.classes(java.nodes(files(spark, sf_dir)))
    return found.select("id", "name", "qualified_name", "kind", "file", "start_line", "end_line", "superclass", F.array_join("annotations", "|").alias("annotations"))


@query(
    f"""WITH {WHOLE}
SELECT 'method:' || q || '#m' || j || '(int,_)@' || file || ':' || (first + j) AS id, 'class:' || q || '@' || file || ':3' AS class_id, 'm' || j AS name, 'T' || j AS return_type, first + j AS start_line,
       2 + length('@GetMapping("/' || k || '/' || j || '") T' || j || ' ') AS name_column, '{{ new Object() {{ void in() {{ call' || j || '(a); }} }}; }}' AS body_text FROM m
UNION ALL SELECT 'method:' || q || '#in()@' || file || ':' || (first + j), 'class:' || q || '@' || file || ':3', 'in', 'void', first + j,
       2 + length('@GetMapping("/' || k || '/' || j || '") T' || j || ' m' || j || '(int a, T' || j || '... r) {{ new Object() {{ void '), '{{ call' || j || '(a); }}' FROM m"""
)
def java_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = java_model.methods(java.nodes(files(spark, sf_dir)))
    return found.select("id", "class_id", "name", "return_type", "start_line", "name_column", "body_text")


@query(
    f"""WITH {WHOLE}, calls AS (SELECT file, first + j AS line, 'call' || j AS name, unnest(['m' || j || '(int,_)', 'in()']) AS signature, q FROM m)
SELECT 'method:' || q || '#' || signature || '@' || file || ':' || line AS source_id, 'unresolved-call:' || name AS target_id, 'CALLS' AS kind, 0.25::double AS confidence FROM calls
UNION ALL SELECT 'class:' || q || '@' || file || ':3', 'type:Base', 'EXTENDS', 0.6::double FROM c"""
)
def java_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = java.nodes(files(spark, sf_dir)).persist()
    return java_model.relationships(java_model.classes(nodes), java_model.invocations(nodes)).drop("source")


@query("SELECT 'n' || c_nationkey || '/C' || c_custkey || '.java' AS path, 'failed to parse Java source n' || c_nationkey || '/C' || c_custkey || '.java' AS message FROM customer WHERE c_custkey % 10 = 7")
def java_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.broken(java.nodes(files(spark, sf_dir))).select("path", "message")


def _classified(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    modules = read(spark, sf_dir, "nation").selectExpr("concat('module:n', n_nationkey) AS id", "concat('n', n_nationkey) AS path").union(spark.range(1).selectExpr("'module:.'", "'.'"))
    dependencies = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").selectExpr("concat('module:n', n_nationkey) AS module_id", "0 AS ordinal", "'jakarta.persistence' AS group_id", "'jakarta.persistence-api' AS artifact_id", "cast(n_nationkey AS string) AS version")
    return java_model.classification(files(spark, sf_dir), modules, dependencies, REGISTRY)


@query(
    f"""WITH {WHOLE} SELECT q AS entity, 'module:n' || n AS module_id, file, 5 + i AS line, 'f' || i AS field_name, 'Map<String, List<T' || i || '>>' AS java_type, 'f' || i AS column_name,
       'jakarta.persistence.Column:' || CASE WHEN n % 2 = 0 THEN CAST(n AS varchar) ELSE '' END AS evidence FROM f"""
)
def java_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text to the columns of entities, with what the imported package tells of their annotations."""
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat(e["symbol"], F.lit(":"), F.coalesce(e["dependency"]["version"], F.lit("")))), ",")
    return _classified(spark, sf_dir)["columns"].select("entity", "module_id", "file", "line", "field_name", "java_type", "column_name", evidence.alias("evidence"))


@query(
    f"""WITH {WHOLE}, v AS (
  SELECT file, 'Entity' AS simple, ['Entity', 'jakarta.persistence.Entity'] AS values FROM c
  UNION ALL SELECT DISTINCT file, 'Column', ['Column', 'jakarta.persistence.Column'] FROM f
  UNION ALL SELECT DISTINCT file, 'GetMapping', ['GetMapping', 'jakarta.persistence.GetMapping', 'org.springframework.web.bind.annotation.GetMapping'] FROM m)
SELECT file AS path, simple, array_to_string(values, '|') AS values FROM v"""
)
def java_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the simple names of annotations may mean, against a registry of as many further symbols as there are customers."""
    nodes = java.nodes(files(spark, sf_dir)).persist()
    wanted = nodes.select("path", F.explode("inside").alias("raw")).select("path", F.regexp_extract("raw", r"^@(\w+)", 1).alias("simple"))
    many = read(spark, sf_dir, "customer").selectExpr("concat('org.x', c_custkey, '.Name', c_custkey) AS symbol")
    symbols = spark.createDataFrame(java_model.registry_symbols(REGISTRY), "symbol string").union(many)
    return java_model.resolved_names(wanted, java.imports_of(nodes), symbols).select("path", "simple", F.array_join("values", "|").alias("values"))
