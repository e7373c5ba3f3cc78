"""Texts are made and read by as many tasks as there are rows for, whatever the files of the table."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.dealing import dealt
from tessera.plans import builds, sources


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("one"))
    keys = spark.range(0, 24_000, 1, 1)
    keys.selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(f"{at}/customer.parquet")
    keys.selectExpr("id AS p_partkey").write.parquet(f"{at}/part.parquet")
    return at


def test_one_file_is_many_tasks(spark, folder):
    """24,000 rows in one file and row group are read by all eight cores, none with a fifth of them."""
    assert spark.read.parquet(f"{folder}/customer.parquet").select(F.spark_partition_id()).distinct().count() == 1
    for files in (sources.files(spark, folder), builds.poms(spark, folder), builds.tests(spark, folder)["suites"]):
        sizes = [r["count"] for r in files.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 8 and sum(sizes) == 24_000 and max(sizes) < 4_800


def test_tasks_grow_with_rows(spark):
    rows = spark.range(0, 3_000, 1, 1)
    assert [dealt(rows, "id", per_task=n).rdd.getNumPartitions() for n in (100, 200, 10_000)] == [30, 15, 6]
    assert dealt(rows.limit(400), "id").select(F.spark_partition_id()).distinct().count() == 1
    assert dealt(rows.limit(0), "id").count() == 0
    assert sorted(r["id"] for r in dealt(rows, "id").collect()) == list(range(3_000))


def test_filters_on_texts_stay_behind_the_deal(spark, folder):
    """What a query asks of a text is worked out by all tasks, not by the one that reads the table."""
    tools = builds.formats.pom_tools(builds.poms(spark, folder).withColumn("text", F.replace("text", F.lit("<own>"), F.lit("<modelVersion>4</modelVersion><own>"))))
    lines = tools._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [n for n, line in enumerate(lines) if "modelVersion" in line and "Filter" in line]
    assert filters and max(filters) < next(n for n, line in enumerate(lines) if "Repartition" in line)
    assert tools.count() == 24_000


def test_versions_of_poms_are_worked_out_once(spark, folder):
    """A filter on the version does not make the text, and read its properties, a second time; POMs without one give no row."""
    texts = builds.poms(spark, folder).withColumn("text", F.replace("text", F.lit("<own>"), F.lit("<modelVersion>${own}</modelVersion><own>")))
    plan = builds.formats.pom_tools(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<?xml") <= 2  # the text of a row, and the look for the tag in it
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "<modelVersion></modelVersion>"), ("d", "<modelVersion>4"), ("e", "<modelVersion> ${x}.${y} </modelVersion><properties><x>1</x></properties>")], "path string, text string")
    assert [(r["file"], r["version"]) for r in builds.formats.pom_tools(odd).collect()] == [("e", "1.${y}")]


def test_rows_sorted_for_their_first_ones_are_dealt(spark, tmp_path):
    """What a task sorts for the first rows of each method or case does not grow with the table's files."""
    spark.range(0, 24_000, 1, 1).selectExpr("id AS event_id", "id % 90 AS user_id", "'k' AS event_type", "'p' AS props").write.parquet(f"{tmp_path}/events.parquet")
    from tessera.plans import extraction, trees

    rows = extraction.stand_ins(spark, str(tmp_path), "entry_points", keys={"events": "event_id"})["entry_points"]
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 24_000 and max(sizes) < 4_800
    plan = trees.method_contexts(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [o_orderkey" in plan and "RepartitionByExpression [event_id" in plan
