"""Near-duplicate documents by SimHash, checked and made whole by an exact join of their shingle sets: Jaccard 0.8 of five-word shingles.

Fingerprints of five-word shingles that differ in at most 4 bits meet by `simhash.links`, and each link's sets are compared: what has
Jaccard 0.8 is one component. Fingerprints alone cannot tell this likeness: at Jaccard 0.8 about 10 of their bits differ, often 15, and no
blocks that so many bits leave equal are selective. So documents of different components then meet under the shingles of their prefixes,
as lines do in `line_dedup`: a shared table of counts orders shingles by rarity, two sets of Jaccard 0.8 share a shingle within both
prefixes, and pairs pass a length, a positional and a bitmap filter before their whole sets are compared.

There each document proposes one candidate a group at first. Documents that this links are one component too, and only pairs of different
components are proposed after that, all of them: nothing is lost, and a thousand copies of one text do not make a million pairs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, line_dedup, simhash

WIDTH = 5
_COUNT_MASK = np.uint64((1 << line_dedup.LOG2_COUNTS) - 1)


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of five lower-cased words; a text of fewer words is one shingle, one without words has none."""
    starts, ends, first = common.word_spans(buf, offsets)
    words = common.span_hashes(buf, starts, ends, line_dedup.LOWER_VALUES)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    tokens, rows = [], []
    for w in range(1, WIDTH + 1):
        hashes = common.window_hashes(words, w) ^ np.uint64(w)
        own = row[: len(hashes)]
        at = np.flatnonzero((own == row[w - 1 :]) & ((n[own] == w) | (w == WIDTH)))
        tokens.append(hashes[at])
        rows.append(own[at])
    return np.concatenate(tokens), np.concatenate(rows)


class Sets:
    """Distinct shingles of each text, in the attributes of `line_dedup.Lines`; a text without words has an empty set and key 0."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        token, line = shingles(buf, offsets)
        order = common.order_in_groups(line, len(offsets), token)
        token, line = token[order], line[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        self.token, self.line = token[keep], line[keep]
        self.size = np.bincount(self.line, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.key, self.sketch = np.zeros(len(self.size), np.uint64), np.zeros(len(self.size), np.uint64)
        some = np.flatnonzero(self.size)
        if len(some):
            at = self.first[some]
            with np.errstate(over="ignore"):
                self.key[some] = common.mixed(np.add.reduceat(common.mixed(self.token ^ np.uint64(0x5555)), at) + self.size[some].astype(np.uint64))
            self.sketch[some] = np.bitwise_xor.reduceat(np.uint64(1) << (self.token >> np.uint64(58)), at)


ROW = np.dtype([("token", "<u4"), ("size", "<u4"), ("pos", "<u2"), ("key", "<i8"), ("root", "<i8"), ("sketch", "<u8")])
FIELDS = {"key": "key", "root": "root", "sketch": "sketch"}


def proposals(group: np.ndarray, label: np.ndarray, rows: np.ndarray, everything: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of different roots among prefix rows: all, or for each row the one of the smallest key."""
    group, _, rows, _ = line_dedup.in_groups(group, label, rows)
    key = rows["key"].copy()
    best = key.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in line_dedup.meeting(group, rows, "root"):
        if everything:
            found.append((np.minimum(key[a], key[b]), np.maximum(key[a], key[b])))
        else:
            np.minimum.at(best, b, key[a])
            np.minimum.at(best, a, key[b])
        if sum(len(x) for x, _ in found) > 1 << 18:
            yield pairs(found)
            found = []
    if not everything:
        found = [(best[best != key], key[best != key])]
    if sum(len(x) for x, _ in found):
        yield pairs(found)


def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = common.distinct_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return common.batch(a=a, b=b)


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (key, fp) that connect all whose fingerprints are equal or linked: one a set and one a link, never all pairs."""
    first = common.stored(distinct.groupBy("fp").agg(F.min("key").alias("least")), "snappy")
    same = distinct.join(first, "fp").select(F.col("least").alias("a"), F.col("key").alias("b"))
    of_a, of_b = (first.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_key")) for c in "ab")
    near = simhash.links(first.select("fp")).join(of_a, "a").join(of_b, "b").select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))
    return common.stored(same.unionByName(near).where("a < b").distinct(), "snappy")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_hash, root of each row; rows of one root are connected by pairs of Jaccard 0.8 or more. Texts without words are one component.

    Equal sets count as one before anything is compared. An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = line_dedup.inputs(df, id_col, text_col)
    ranks = spark.sparkContext.broadcast(line_dedup.token_ranks(spark, docs, lambda buf, offsets: shingles(buf, offsets)[0])[0])  # 4 MB whatever the corpus

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in line_dedup.blocks(batches):
            x = Sets(buf, offsets)
            rank = ranks.value[(x.token & _COUNT_MASK).astype(np.int64)]
            order = common.order_in_groups(x.line, len(x.size), x.token, rank)
            lengths = np.where(x.size > 0, line_dedup.prefix_length(x.size), 0)
            ends = np.cumsum(lengths)
            data = memoryview(buf)
            fp = np.fromiter((simhash.fingerprint(bytes(data[a:b]), WIDTH) for a, b in itertools.pairwise(offsets.tolist())), np.uint64, len(x.size))
            at = order[np.repeat(x.first[:-1] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
            yield common.batch(
                key=common.signed(x.key), k_id=rows.column("k_id"), k_hash=rows.column("k_hash"), size=x.size.astype(np.int32), sketch=common.signed(x.sketch), fp=common.signed(fp),
                **line_dedup.packed_prefixes(lengths, x.token[at], rank[at] > 0, rank[at] > line_dedup.COMMON),
            )

    sets = common.stored(docs.mapInArrow(read, f"key long, k_id long, k_hash long, size int, sketch long, fp long, {line_dedup.PREFIX}"), "snappy")
    ranks.destroy()
    distinct = sets.groupBy("key").agg(F.min(F.struct("k_id", "k_hash")).alias("at"), F.min("fp").alias("fp"), F.any_value(F.struct("size", "sketch", "prefix", "plain", "common")).alias("line"))
    distinct = common.stored(distinct.select("key", "at", "fp", "line.*"), "snappy")

    def rooted(roots: DataFrame) -> DataFrame:
        return common.stored(distinct.drop("fp").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "snappy")

    def alike(roots: DataFrame, everything: bool) -> DataFrame:
        prefixes = line_dedup.Prefixes(rooted(roots), ROW, FIELDS)
        found = prefixes.candidates(functools.partial(proposals, everything=everything), "a long, b long")
        return line_dedup.similar(docs, distinct, common.stored(found.distinct(), "snappy"), Sets)

    links = line_dedup.similar(docs, distinct, fingerprint_pairs(distinct.select("key", "fp")), Sets)
    roots = common.stored(common.components(links))
    for everything in (False, True):
        more = alike(roots, everything)
        if more.take(1):
            links = links.unionByName(more)
            roots = common.stored(common.components(links))
    return sets.select("key", "k_id", "k_hash").join(roots.withColumnRenamed("node", "key"), "key", "left").select("k_id", "k_hash", F.coalesce("root", "key").alias("root"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one document of each component: the one of the smallest id; of rows that repeat it, the one of the smallest text hash, once.

    A component whose ids are all null keeps the row of the smallest text hash. Columns stay as they are.
    """
    plain, named = common.keyed(df, id_col, text_col)
    keys = ["k_id", "k_hash"]
    rows = near_duplicates(df, id_col, text_col).groupBy("root", *keys).agg(F.count(F.lit(1)).alias("n"))
    first = common.stored(rows.groupBy("root").agg(F.min(F.struct(*keys, "n")).alias("first")).select("first.*").distinct())
    if not common.few(first):
        return named(plain.join(first, keys, "left_semi").dropDuplicates(keys))
    # documents stay where they are, but for those whose row is there more than once
    once, often = (plain.join(F.broadcast(first.where(test).select(*keys)), keys, "left_semi") for test in ("n = 1", "n > 1"))
    return named(once.unionByName(often.dropDuplicates(keys)))
