"""Calls know the methods around them, so nothing is joined, and nothing broadcast, however many files a tree has."""

import pytest

from tessera.plans import builds, sources
from tessera.sources import java, java_model

#: two anonymous classes on one line, whose methods have one id
TWINS = "class A { void f() { a(); new R() { void in() { b(); } }; new R() { void in() { c(); } }; } int x = d(); }"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Files that take little room in the table, so that Spark thinks their methods few."""
    at = str(tmp_path_factory.mktemp("joins"))
    spark.range(0, 100, 1, 1).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(f"{at}/customer.parquet")
    return at


def joins(found):
    plan = found._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line or "Broadcast" in line]


def test_relationships_join_nothing(spark, folder):
    assert joins(sources.java_relationships(spark, folder)) == []


def test_fixtures_join_nothing(spark, folder):
    assert joins(builds.test_fixtures(spark, folder)) == []


def test_assertions_join_nothing(spark, folder):
    assert joins(builds.test_assertions(spark, folder)) == []


def test_entry_points_join_nothing(spark, folder):
    assert joins(builds.test_entry_points(spark, folder)) == []


def test_invocations_join_nothing(spark, folder):
    assert joins(builds.test_invocations(spark, folder)) == []


def test_calls_of_paths_that_repeat_count_once_a_file(spark):
    nodes = java.nodes(spark.createDataFrame([("A.java", TWINS), ("A.java", TWINS), (None, TWINS)], "path string, text string"))
    called = [(r["file"], r["caller_method_id"].split("#")[1].split("@")[0], r["name"]) for r in java_model.invocations(nodes).collect()]
    assert sorted(called) == sorted(2 * [("A.java", m, n) for m, n in (("f()", "a"), ("f()", "b"), ("f()", "c"), ("in()", "b"), ("in()", "c"))])
    inside = [(r["name"], r["method_id"]) for r in java.calls_of(nodes).where("path is not null").collect()]
    assert sorted(inside, key=repr) == sorted(2 * [(n, m and f"method:A.java:A.{m}:1") for n, m in (("a", "f()"), ("b", "in()"), ("c", "in()"), ("d", None))], key=repr)


#: two classes of one name in two methods, and a nested suite
SUITES = """package p; class A {
  @Test void x() { class L { @Test void y() { verify(1); } void z() { other(); } } }
  void u() { class L { @Test void y() { assertTrue(2); } } }
  @SpringBootTest class In { void shouldRun() { assertEquals(3); Runnable r = new Runnable() { public void run() { send(4); } }; } @Mock void m() {} }
}"""


def test_rows_of_tests_belong_to_their_own_class(spark):
    files = spark.createDataFrame([("A.java", SUITES), ("A.java", SUITES), (None, SUITES)], "path string, text string")
    model = {k: v.collect() for k, v in java.test_model(files).items() if k != "suites"}
    assert sorted((r["id"], r["suite_id"], r["test_kind"]) for r in model["cases"]) == sorted(2 * [
        ("test-case:p.A#x@A.java:2", "test-suite:p.A@A.java:1", "unknown_test"), ("test-case:p.L#y@A.java:2", "test-suite:p.L@A.java:2", "unknown_test"),
        ("test-case:p.L#y@A.java:3", "test-suite:p.L@A.java:3", "unknown_test"), ("test-case:p.In#shouldRun@A.java:4", "test-suite:p.In@A.java:4", "integration")])
    assert sorted((r["test_case_id"], r["name"]) for r in model["invocations"]) == sorted(2 * [("test-case:p.L#y@A.java:2", "verify"), ("test-case:p.L#y@A.java:3", "assertTrue"), ("test-case:p.In#shouldRun@A.java:4", "assertEquals")])
    assert sorted((r["test_case_id"], r["expression"]) for r in model["assertions"]) == sorted(2 * [("test-case:p.L#y@A.java:2", "verify(1)"), ("test-case:p.L#y@A.java:3", "assertTrue(2)"), ("test-case:p.In#shouldRun@A.java:4", "assertEquals(3)")])
    assert sorted((r["suite_id"], r["name"]) for r in model["fixtures"] if r["file"]) == sorted(2 * [("test-suite:p.In@A.java:4", "SpringBootTest"), ("test-suite:p.In@A.java:4", "m")])
    assert model["entry_points"] == []
