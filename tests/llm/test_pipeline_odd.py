"""The pipeline on an empty table, and on odd rows with further columns whose names clash with the operators' own."""

import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "row_hash", "c0", "key", "bucket"]


@pytest.fixture(scope="module")
def folder(spark, odd_rows, docs, sf_dir, tmp_path_factory):
    def write(name, rows):
        at = str(tmp_path_factory.mktemp(name))
        rows.write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
        return at

    more = [F.lit("h").alias("row_hash"), F.lit(1).alias("c0"), F.lit("k").alias("key"), F.lit(None).cast("double").alias("bucket")]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id >= 20")
    odd = spark.createDataFrame([(d, t, None, None, len(t or "")) for d, t in odd_rows], plain.schema)
    whole = plain.unionByName(odd).select("*", *more)
    return {"odd": write("odd", whole), "none": write("none", whole.limit(0))}


def test_empty_table(spark, folder):
    now = spark.read.parquet(f"{folder['none']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder["none"])
        assert now.columns == COLUMNS and now.count() == 0, name
    assert corpus_pipeline.run(spark, folder["none"]).count() == 0


def test_odd_rows_and_clashing_columns(spark, folder, odd_rows):
    now = spark.read.parquet(f"{folder['odd']}/documents.parquet")
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder["odd"])
        assert out.columns == COLUMNS and out.schema == now.schema, name
        now = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(now.count())
        if name == "language_id":
            assert now.where("text is null or not rlike(text, '[A-Za-z]')").count() == 0
        if name == "line_dedup":
            assert sizes[-1] == sizes[-2]
        if name == "near_dedup":
            assert now.groupBy("doc_id", "text").count().where("count > 1").count() == 0
    assert sizes == sorted(sizes, reverse=True) and now.where("row_hash <> 'h' or c0 <> 1 or key <> 'k' or bucket is not null").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, folder["odd"]).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in now.select("doc_id").collect()}
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and p["length"] & (p["length"] - 1) == 0 for p in pieces)
