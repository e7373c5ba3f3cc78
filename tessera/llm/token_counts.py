"""Token counts by an exact histogram of encoded lengths.

Documents are aggregated by length (map-side combine; a hot length is one row a task). Suffix sums over the histogram then answer, for
every context limit, how many documents are longer, how many tokens a cut at the limit keeps, and any quantile of the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.tokenizing import encoder

#: lengths of one bucket are summed by one window; the buckets, longest text / SPAN at most, by another
SPAN = 1024


def lengths(df: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of each whole text; null and empty texts have 0."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for rows in batches:
            texts = rows.column("text")
            _, offsets = common.byte_buffer(texts)
            n = [code.lengths(texts.slice(lo, hi - lo)) for lo, hi in common.row_blocks(offsets, 2 * common.BLOCK)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.concatenate(n) if n else [], pa.int64())], ["doc_id", "n_tokens"])

    return common.pick(df, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """From n_tokens of each document, one row a length, as a context limit of that length sees it.

    n_tokens; n_docs of that length; docs_from and tokens_from (this length or longer); kept_tokens (all documents cut at this
    length); share_to (documents of this length or shorter, as a share of all). Lengths that no document has are left out: a limit
    between two rows keeps what `answer` works out from the next one. No documents give no rows.
    """
    hist = counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN).cast("long"))
    hist = common.stored(hist)  # read twice below, so that texts are encoded once
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = spans.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_above"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    own = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    joined = hist.join(above, "span")
    out = joined.withColumns({"docs_from": F.sum("n_docs").over(own) + F.col("d_above"), "tokens_from": F.sum(F.col("n_docs") * F.col("n_tokens")).over(own) + F.col("t_above")})
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("t_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("kept_tokens"),
        ((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all")).alias("share_to"),
    )


def answer(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over (longer than it) and kept_tokens for each context limit asked for; the limits are a driver-side list."""
    asked = hist.withColumn("limit", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))))
    longer = F.col("n_tokens") > F.col("limit")
    over = asked.groupBy("limit").agg(
        F.coalesce(F.max(F.when(longer, F.col("docs_from"))), F.lit(0)).alias("docs_over"), F.coalesce(F.max(F.when(longer, F.col("tokens_from"))), F.lit(0)).alias("tokens_over"), F.max("kept_tokens").alias("all_tokens")
    )
    return over.select("limit", "docs_over", (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("limit")).alias("kept_tokens"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the smallest length that at least this share of the documents does not exceed."""
    asked = hist.withColumn("share", F.explode(F.array(*(F.lit(float(x)) for x in shares))))
    return asked.where("share_to >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
