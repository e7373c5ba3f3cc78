"""Build files, reports and tests as queries: rows of the driver's tables become texts, and the SQL works out the same rows by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dealing import dealt
from tessera.plans.registry import Registry, read
from tessera.sources import catalogues, formats, java

query = Registry()


def poms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A POM for each part: properties, key % 3 modules, key % 4 dependencies of which every other names an unknown property, a plugin."""
    return dealt(read(spark, sf_dir, "part"), "p_partkey").selectExpr(
        "concat('n', p_partkey, '/pom.xml') AS path",
        """concat('<?xml version="1.0"?><!-- <modelVersion>x</modelVersion> is above --><project><properties><v>', p_partkey % 10, '.0</v><java.version>', 8 + p_partkey % 4, '</java.version><own>4.0.', p_partkey % 2, '</own></properties>',
            '<modules>', array_join(transform(filter(sequence(0, 2), i -> i < p_partkey % 3), i -> concat('<module> m', i, ' </module>')), ''), '</modules><dependencies>',
            array_join(transform(filter(sequence(0, 3), i -> i < p_partkey % 4), i -> concat('<dependency><groupId>g', i, '</groupId>\\n<artifactId>a', p_partkey, '</artifactId><version>', concat('$', if(i % 2 = 0, '{v}', '{unknown}')), '</version>', if(i = 2, '<scope>test</scope>', ''), '</dependency>')), ''),
            '</dependencies><build><plugins><plugin><groupId>p</groupId><artifactId>plug', p_partkey % 5, '</artifactId></plugin></plugins></build></project>') AS text""",
    )


_POM = "(SELECT p_partkey AS k, 'n' || p_partkey || '/pom.xml' AS path FROM part)"


@query(
    f"SELECT path, 'g' || i AS group_id, 'a' || k AS artifact_id, CASE WHEN i % 2 = 0 THEN (k % 10) || '.0' ELSE '${{unknown}}' END AS version, CASE WHEN i = 2 THEN 'test' END AS scope FROM (SELECT *, unnest(range(k % 4)) AS i FROM {_POM})"
)
def pom_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.pom_rows(poms(spark, sf_dir), "dependency")


@query(f"SELECT path, 'p' AS group_id, 'plug' || k % 5 AS artifact_id FROM {_POM}")
def pom_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.pom_rows(poms(spark, sf_dir), "plugin").select("path", "group_id", "artifact_id")


@query(f"SELECT path, 'java.version' AS source, CAST(8 + k % 4 AS varchar) AS version FROM {_POM}")
def pom_java_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.pom_java_versions(poms(spark, sf_dir))


@query(f"SELECT 'n' || k AS parent, 'n' || k || '/m' || i AS module FROM (SELECT *, unnest(range(k % 3)) AS i FROM {_POM})")
def pom_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.pom_modules(poms(spark, sf_dir))


@query(
    "SELECT 'maven-model' AS tool, '4.0.' || p_partkey % 2 AS version, 'n' || p_partkey || '/pom.xml' AS file, 'pom.xml' AS source FROM part UNION ALL "
    "SELECT 'gradle', (s_suppkey % 9) || '.2', 'w' || s_suppkey || '/gradle-wrapper.properties', 'gradle-wrapper.properties' FROM supplier WHERE s_suppkey % 4 > 0"
)
def build_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = poms(spark, sf_dir).withColumn("text", F.regexp_replace("text", "</properties>", r"</properties><modelVersion>\${own}</modelVersion>")).withColumn("text", F.regexp_replace("text", "<!--.*?-->", ""))
    wrappers = read(spark, sf_dir, "supplier").selectExpr("concat('w', s_suppkey, '/gradle-wrapper.properties') AS path", "if(s_suppkey % 4 > 0, concat('a=b\\ndistributionUrl=https\\\\://x/gradle-', s_suppkey % 9, '.2-', if(s_suppkey % 2 = 0, 'bin', 'all'), '.zip\\n'), 'a=b') AS text")
    return formats.pom_tools(models).unionByName(formats.wrapper_tools(wrappers))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gradle script for each supplier, with plugins, a Java version told in one of three ways, dependencies and a call that is none."""
    return read(spark, sf_dir, "supplier").selectExpr(
        "concat('s', s_suppkey, '/build.gradle') AS path",
        r"""concat("plugins {\n  id 'java'\n  id(\"org.p", s_suppkey, "\") version \"", s_suppkey % 7, ".1\"\n}\n",
            CASE s_suppkey % 3 WHEN 0 THEN 'sourceCompatibility = JavaVersion.VERSION_1_8' WHEN 1 THEN concat('languageVersion = JavaLanguageVersion.of(', 10 + s_suppkey % 8, ')') ELSE concat('options.release.set(', 11 + s_suppkey % 5, ')') END,
            "\ndependencies {\n  implementation 'g", s_suppkey, ":lib:", s_suppkey % 4, ".0'\n  testImplementation(\"g:t", s_suppkey, "\")\n  other 'x:y:1'\n  itestImplementation platform('q:w:2')\n}\n") AS text""",
    )


_SCRIPT = "(SELECT s_suppkey AS k, 's' || s_suppkey || '/build.gradle' AS path FROM supplier)"


@query(
    f"SELECT path, 'implementation' AS configuration, 'g' || k AS group_id, 'lib' AS artifact_id, (k % 4) || '.0' AS version FROM {_SCRIPT} UNION ALL SELECT path, 'testImplementation', 'g', 't' || k, NULL FROM {_SCRIPT} "
    f"UNION ALL SELECT path, 'itestImplementation', 'q', 'w', '2' FROM {_SCRIPT}"
)
def gradle_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.gradle_dependencies(scripts(spark, sf_dir))


@query(f"SELECT path, 'java' AS plugin_id, NULL AS version FROM {_SCRIPT} UNION ALL SELECT path, 'org.p' || k, (k % 7) || '.1' FROM {_SCRIPT}")
def gradle_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.gradle_plugins(scripts(spark, sf_dir))


@query(f"SELECT path, CASE k % 3 WHEN 0 THEN '1.8' WHEN 1 THEN CAST(10 + k % 8 AS varchar) ELSE CAST(11 + k % 5 AS varchar) END AS version FROM {_SCRIPT}")
def gradle_java_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.gradle_java_versions(scripts(spark, sf_dir))


@query("SELECT DISTINCT unnest(['a' || s_suppkey, 'b/c' || s_suppkey % 10, 'd']) AS module FROM supplier")
def gradle_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = read(spark, sf_dir, "supplier").selectExpr("'settings.gradle' AS path", r"""concat("rootProject.name = 'x'\ninclude ':a", s_suppkey, "', ':b:c", s_suppkey % 10, "'\n  include(\":d\")\n") AS text""")
    return formats.gradle_modules(settings)


@query(
    "WITH f AS (SELECT s_suppkey AS k, 't' || s_suppkey AS path FROM supplier) SELECT path, 'libraries' AS section, 'l' || i AS alias, 'g' || k || ':a' || i AS name, CASE i WHEN 0 THEN (k % 6) || '.0' WHEN 1 THEN '1.' || k ELSE NULL END AS version FROM (SELECT *, unnest([0, 1, 2]) AS i FROM f) "
    "UNION ALL SELECT path, 'plugins', 'p-one', 'pl.' || k, '3' FROM f"
)
def version_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "supplier").selectExpr(
        "concat('t', s_suppkey) AS path",
        r"""concat('[versions]\nk = "', s_suppkey % 6, '.0"\nz = "9"\n[libraries]\nl0 = { module = "g', s_suppkey, ':a0", version.ref = "k" }\nl1 = "g', s_suppkey, ':a1:1.', s_suppkey, '"\nl2 = { group = "g', s_suppkey, '", name = "a2" }\n\n[plugins]\np-one = { id = "pl.', s_suppkey, '", version = "3" }\n[bundles]\nb = ["l0"]\n') AS text""",
    )
    return formats.catalogue_rows(texts)


@query(
    "SELECT DISTINCT 'g' || l_partkey % 50 AS group_id, 'a' || l_suppkey AS artifact_id, CASE WHEN l_linenumber % 3 = 0 THEN '9.' || l_linenumber ELSE '1.' || l_linenumber END AS version FROM lineitem WHERE l_linenumber % 5 > 0"
)
def resolved_gradle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates from the lines of printed dependency trees; a version behind an arrow wins, other lines count for nothing."""
    tree = "concat('|    +--- g', l_partkey % 50, ':a', l_suppkey, ':1.', l_linenumber, if(l_linenumber % 3 = 0, concat(' -> 9.', l_linenumber, ' (*)'), ''))"
    lines = read(spark, sf_dir, "lineitem").selectExpr(f"if(l_linenumber % 5 = 0, 'no tree', {tree}) AS line")
    return formats.resolved_gradle(lines)


@query("SELECT DISTINCT 'g' || i AS group_id, 'a' || k AS artifact_id, CASE WHEN i % 2 = 0 THEN (k % 10) || '.0' ELSE '${unknown}' END AS version, CASE WHEN i = 2 THEN 'test' END AS scope FROM (SELECT p_partkey AS k, unnest(range(p_partkey % 4)) AS i FROM part)")
def resolved_maven_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.resolved_maven(poms(spark, sf_dir))


@query("SELECT 'org.x.C' || o_custkey AS source, 'sun.misc.U' || o_orderkey % 20 AS symbol FROM orders WHERE o_orderkey % 3 = 0")
def internal_api_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "orders").selectExpr("concat('   org.x.C', o_custkey, '  -> sun.misc.U', o_orderkey % 20, if(o_orderkey % 3 = 0, '   JDK internal API (jdk.unsupported)', '  java.base')) AS line")
    return formats.internal_uses(lines)


@query("SELECT 'org.x.C' || o_custkey AS class_name, count(*) AS n FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1")
def removal_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "orders").selectExpr("concat('class org/x/C', o_custkey, ' uses deprecated method java/lang/T::stop (', if(o_orderkey % 4 = 1, 'forRemoval=true', ''), ')') AS line")
    return formats.removal_uses(lines).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


_KEYS = "WITH d AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 6 <> 5) SELECT 'c' || k AS path, unnest(['a.b', 'a.list[]', 'on', 'none']) AS key, unnest([CAST(k AS varchar), '[1, ' || k || ']', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, '']) AS value FROM d"


@query(_KEYS)
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted keys of JSON documents; one in six is cut off and gives none."""
    files = dealt(read(spark, sf_dir, "customer"), "c_custkey").selectExpr("concat('c', c_custkey) AS path", """concat('{"a": {"b": ', c_custkey, ', "list": [1, ', c_custkey, ']}, "on": ', c_custkey % 2 = 0, ', "none": null', if(c_custkey % 6 = 5, '', '}')) AS text""")
    return formats.flattened(files, "json")


@query(_KEYS)
def yaml_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = dealt(read(spark, sf_dir, "customer"), "c_custkey").selectExpr("concat('c', c_custkey) AS path", r"concat('a:\n  b: ', c_custkey, '\n  list:\n  - 1\n  - ', c_custkey, '\n', if(c_custkey % 6 = 5, ']', ''), '\"on\": ', c_custkey % 2 = 0, '\n---\nnone:\n') AS text")
    return formats.flattened(files, "yaml")


def build_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build report for each nation, with a module for each of its suppliers; some hold a field too many, others flat lists of their own."""
    modules = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.expr("concat('{\"name\":\"\",\"path\":\"m', s_suppkey, '\",\"direct_dependencies\":[{\"group_id\":\"g\",\"artifact_id\":\"a', s_suppkey, '\"}]}')"))), ",").alias("modules"))
    joined = read(spark, sf_dir, "nation").join(modules, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.selectExpr(
        "concat('r', n_nationkey) AS path",
        """concat('{"project_root":"/w/p', n_nationkey, '","parent":{"name":"","path":".","build_tools":[{"tool":"maven-model","file":"pom.xml"}],"direct_dependencies":[{"group_id":"g","artifact_id":"root"}]},"modules":[', coalesce(modules, ''), '],"diagnostics":[]',
            if(n_nationkey % 5 = 1, ',"surprise":1', ''), if(n_nationkey % 5 = 2, ',"direct_dependencies":[{"group_id":"own","artifact_id":"flat"}]', ''), '}') AS text""",
    )


@query(
    """SELECT 'r' || n_nationkey AS path, CASE WHEN n_nationkey % 5 = 1 THEN 'unknown fields: surprise' END AS error,
CAST(CASE n_nationkey % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 1 + count(s_suppkey) END AS bigint) AS dependencies, CAST(CASE WHEN n_nationkey % 5 IN (1, 2) THEN 0 ELSE 1 END AS bigint) AS tools
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"""
)
def build_report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat lists of reports, made anew from the scopes where all are empty."""
    found = catalogues.build_reports(build_reports(spark, sf_dir))
    size = lambda name: F.coalesce(F.when(F.col("error").isNull(), F.size(name)), F.lit(0)).cast("long")
    return found.select("path", "error", size("direct_dependencies").alias("dependencies"), size("build_tools").alias("tools"))


@query(
    """SELECT 'module:.' AS id, '.' AS path, 'p' || n_nationkey AS name, 'maven-model' AS build_system FROM nation WHERE n_nationkey % 5 <> 1
UNION ALL SELECT 'module:m' || s_suppkey, 'm' || s_suppkey, 'm' || s_suppkey, NULL FROM supplier WHERE s_nationkey % 5 <> 1"""
)
def build_report_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogues.report_modules(catalogues.build_reports(build_reports(spark, sf_dir))).select("id", "path", "name", "build_system")


@query(
    """SELECT '/w/p' || n_nationkey AS project_root, '.' AS module_path, 0 AS ordinal, 'root' AS artifact_id FROM nation WHERE n_nationkey % 5 <> 1
UNION ALL SELECT '/w/p' || s_nationkey, 'm' || s_suppkey, 0, 'a' || s_suppkey FROM supplier WHERE s_nationkey % 5 <> 1"""
)
def build_report_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogues.scope_rows(catalogues.build_reports(build_reports(spark, sf_dir)), "direct_dependencies")
    return found.select("project_root", "module_path", "ordinal", "artifact_id")


# --- tests ---


def tests(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The model of test sources: a suite for each customer with key % 3 cases, in folders that tell their kind or not."""
    files = dealt(read(spark, sf_dir, "customer"), "c_custkey").selectExpr(
        "concat(CASE c_custkey % 4 WHEN 0 THEN 'e2e/' WHEN 1 THEN 'acceptance/' ELSE 'it/' END, 'S', c_custkey, '.java') AS path",
        r"""concat('package t.n', c_nationkey, ';\n', if(c_custkey % 4 = 3, '@SpringBootTest\n', ''), 'class S', c_custkey, ' {\n  @BeforeEach void up() {}\n',
            array_join(transform(filter(sequence(0, 2), j -> j < c_custkey % 3), j -> concat('  @Test @DisplayName("d', j, '")\n  void c', j, '() { mock(A.class); assertEquals(', j, ', api.getForObject("/r/', c_custkey, '", B.class)); queue.send("q', j, '", 1); }\n')), ''),
            '  void shouldRun() { helper(); }\n  void helper() {}\n}\n') AS text""",
    )
    return java.test_model(files)


_SUITE = """s AS (SELECT c_custkey AS k, 't.n' || c_nationkey || '.S' || c_custkey AS q, CASE c_custkey % 4 WHEN 0 THEN 'e2e/' WHEN 1 THEN 'acceptance/' ELSE 'it/' END || 'S' || c_custkey || '.java' AS file,
  CASE c_custkey % 4 WHEN 0 THEN 'e2e' WHEN 1 THEN 'acceptance' WHEN 3 THEN 'integration' ELSE 'unknown_test' END AS kind, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END AS m FROM customer),
c AS (SELECT *, unnest(range(k % 3)) AS j FROM s)"""
_CASE_ID = "'test-case:' || q || '#c' || j || '@' || file || ':' || (4 + m + 2 * j)"


@query(f"WITH {_SUITE} SELECT 'test-suite:' || q || '@' || file || ':2' AS id, 'S' || k AS class_name, q AS qualified_name, kind AS test_kind, file, CAST(2 AS bigint) AS start_line, 6 + m + 2 * (k % 3) AS end_line FROM s")
def test_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests(spark, sf_dir)["suites"].select("id", "class_name", "qualified_name", "test_kind", "file", "start_line", "end_line")


@query(
    f"""WITH {_SUITE} SELECT {_CASE_ID} AS id, 'c' || j AS name, 'd' || j AS display_name, kind AS test_kind, 5 + m + 2 * j AS end_line FROM c
UNION ALL SELECT 'test-case:' || q || '#shouldRun@' || file || ':' || (4 + m + 2 * (k % 3)), 'shouldRun', NULL, kind, 4 + m + 2 * (k % 3) FROM s"""
)
def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests(spark, sf_dir)["cases"].select("id", "name", "display_name", "test_kind", "end_line")


@query(f"WITH {_SUITE} SELECT {_CASE_ID} AS test_case_id, 'equality' AS assertion_kind, 'assertEquals(' || j || ', api.getForObject(\"/r/' || k || '\", B.class))' AS expression, '/r/' || k AS expected_value FROM c")
def test_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests(spark, sf_dir)["assertions"].select("test_case_id", "assertion_kind", "expression", "expected_value")


@query(
    f"""WITH {_SUITE} SELECT {_CASE_ID} AS test_case_id, 'Http' AS kind, 'HTTP client' AS framework, '/r/' || k AS route, 'GET' AS http_method, NULL AS topic FROM c
UNION ALL SELECT {_CASE_ID}, 'Message', NULL, NULL, NULL, 'q' || j FROM c"""
)
def test_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests(spark, sf_dir)["entry_points"].select("test_case_id", "kind", "framework", "route", "http_method", "topic")


@query(
    f"""WITH {_SUITE} SELECT {_CASE_ID} AS test_case_id, NULL AS suite_id, 'mock' AS fixture_kind, 'mock' AS name, '["mock(A.class)"]' AS details_json FROM c
UNION ALL SELECT NULL, 'test-suite:' || q || '@' || file || ':2', 'setup', 'up', '["@BeforeEach"]' FROM s
UNION ALL SELECT NULL, 'test-suite:' || q || '@' || file || ':2', 'framework', 'SpringBootTest', '["@SpringBootTest"]' FROM s WHERE m = 1"""
)
def test_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests(spark, sf_dir)["fixtures"].select("test_case_id", "suite_id", "fixture_kind", "name", "details_json")


@query(f"WITH {_SUITE} SELECT test_case_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT {_CASE_ID} AS test_case_id, unnest(['mock', 'assertEquals', 'getForObject', 'send']) AS name FROM c UNION ALL SELECT 'test-case:' || q || '#shouldRun@' || file || ':' || (4 + m + 2 * (k % 3)), 'helper' FROM s) GROUP BY test_case_id")
def test_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tests(spark, sf_dir)["invocations"]
    return found.groupBy("test_case_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
