"""Classes that are kept for a classification are as many parts as they need, whatever spark.sql.shuffle.partitions says."""

from tessera.operators import classify
from tessera.plans import sources


def test_kept_classes_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    spark.range(0, 12_000, 1, 1).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 25, 1, 1).selectExpr("cast(id AS int) AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    kept, classified = [], classify.classified
    monkeypatch.setattr(classify, "classified", lambda owned, *rest: (kept.append(owned), classified(owned, *rest))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        columns = sources.java_columns(spark, str(tmp_path))
        sizes = kept[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 12_000 - 1_200 and max(sizes) < 10_000 / 4
        assert columns.count() == sum(k % 3 for k in range(12_000) if k % 10 != 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.catalog.clearCache()
