"""From raw documents to packed sequences in five stages: language, repeated lines, near-duplicates, benchmark leaks, packing.

Every stage works on all that the one before it kept, which is written as Parquet and read again, so each starts with no lineage. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontam, langid, line_dedup, near_dedup, packing


#: rows, and bytes, of a batch between Spark and its Python workers; documents are long, and an executor and each worker hold a batch at least
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: rows that Spark's Parquet reader unpacks at once; it holds their texts in one array, which doubles as it grows
READ_ROWS = 512

#: settings, their defaults, and what the stages set in their place
SMALL = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{BATCH_BYTES}b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", str(READ_ROWS)),
}


def in_small_batches(spark: SparkSession) -> None:
    """Have the session read and send small batches, unless it has settings of its own."""
    for setting, (default, small) in SMALL.items():
        if spark.conf.get(setting, default) == default:
            spark.conf.set(setting, small)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence, by a model of the labelled documents that are not held out.

    A null text, an empty one and one without letters go; rows that repeat stay or go alike. Where no document is labelled none stays; an
    empty table stays empty.
    """
    in_small_batches(spark)
    model = langid.train(docs.where(~langid.train_held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, model)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line resembles.

    No row goes, whatever its text; a document that loses every line keeps an empty text. Lines of rows that repeat in id and text stand
    for one document's.
    """
    in_small_batches(spark)
    return line_dedup.dedup_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 of five-word shingles), that of the smallest id.

    SimHash fingerprints propose pairs, their sets are compared, and an exact join finds the pairs whose fingerprints lie further apart.

    Rows that repeat stay once; of equal ids the text of the smallest hash stays; null ids order last.
    """
    in_small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question. Null and empty texts hold none; of rows that share an id each is judged by its own text."""
    in_small_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths, with their ids; a null or empty text is one piece, its end id."""
    in_small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: no stage but the filters' effects can be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
