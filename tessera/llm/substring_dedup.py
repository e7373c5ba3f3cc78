"""Repeated passages by prefix-partitioned suffix trees, and their removal.

A passage counts as repeated from `words` words (50). Every run of 50 words has an anchor, the 16 words in it with the smallest hash, so
equal passages have equal anchors; anchors that only one document holds are dropped. The suffixes that begin a run with a shared anchor
are dealt out by that prefix, one subtree each, together with their words. A subtree is built as a suffix array by prefix doubling over
the words themselves: suffixes that agree in 1, 2, 4 ... 32 and at last 50 words take one rank, and the ranks at 50 words are the tree's
internal nodes cut at that depth. A node over two documents is a repeat, and adjacent repeated suffixes make a maximal one.

Where a prefix has too many suffixes for one task's memory it is lengthened to all 50 words. That leaves one node to a prefix, whose
smallest document an aggregation with map-side combine finds; these words are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

WORDS = 50
PREFIX = 16
#: prefixes with more runs of suffixes than this (some 5 MB of words) are lengthened
GROUP = 8192
_OTHER, _CHECK = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def anchored(buf: np.ndarray, offsets: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], words: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window (word within the row), windows, anchor hash; and word hashes, run starts."""
    starts, ends, first = spans
    hashes = common.span_hashes(buf, starts, ends)
    n = len(hashes) - words + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), hashes, none
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    grams = common.window_hashes(hashes, prefix)
    span = words - prefix + 1
    anchor = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        anchor[lo:hi] = np.lib.stride_tricks.sliding_window_view(grams[lo : hi + span - 1], span).argmin(axis=1)
    anchor += np.arange(n)
    valid = row[:n] == row[words - 1 :]
    begin = valid.copy()
    begin[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]) & (row[1:n] == row[: n - 1]))
    at = np.flatnonzero(begin)
    if not len(at):
        return none, none, none, none.view(np.uint64), hashes, none
    stop = np.append(at[1:], n)
    total = np.concatenate([[0], np.cumsum(valid)])
    return row[at], at - first[row[at]], total[stop] - total[at], grams[anchor[at]], hashes, at


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with their bytes and row offsets."""
    for rows in batches:
        buf, offsets = common.byte_buffer(rows.column("text"))
        for lo, hi in common.row_blocks(offsets):
            yield rows.slice(lo, hi - lo), buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def inputs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = common.documents(df, id_col, text_col)
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("k_id"), F.col("row_hash").alias("k_hash"), "text")


def run_texts(buf: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, n: np.ndarray) -> pa.Array:
    """The words of runs (first word, number of words), parted by one space each."""
    starts, ends, _ = spans
    inside = ~common.SPACE[buf]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    place = np.cumsum(keep) - 1
    plain = memoryview(np.where(inside, buf, np.uint8(0x20))[keep])
    lo, hi = place[starts[at]], place[ends[at + n - 1] - 1] + 1
    return pa.array([bytes(plain[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())


def nodes(ids: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of the words `ids` with at least `depth` words its node at that depth: equal for suffixes that agree so far, in their order."""
    rank, d = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while d < depth:
        step = min(d, depth - d)
        key = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        rank, d = np.unique(key, return_inverse=True)[1].astype(np.int64), d + step
    return rank


def subtrees(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Covered word ranges from runs of suffixes sorted by prefix: k_id, k_hash, start, stop."""
    for table in common.whole_groups(batches, ["prefix"]):
        doc, count, first = (table[c].to_numpy() for c in ("k_id", "windows", "first"))
        buf, offsets = common.byte_buffer(table["words"].chunk(0))
        starts, ends, word = common.word_spans(buf, offsets)
        texts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(texts), pa.py_buffer(np.ascontiguousarray(buf[buf != 0x20]))]).dictionary_encode()
        node_at = nodes(coded.indices.to_numpy(), words)
        run = np.repeat(np.arange(len(count)), count)
        before = np.concatenate([[0], np.cumsum(count)])
        node = node_at[word[run] + np.arange(before[-1]) - before[run]]
        owner = doc[run]
        least = np.full(int(node.max(initial=-1)) + 1, common.NULL_ID)
        np.minimum.at(least, node, owner)
        later = owner > least[node]
        edge = later.copy()
        edge[1:] &= ~(later[:-1] & (run[1:] == run[:-1]))
        at = np.flatnonzero(edge)
        if not len(at):
            continue
        total = np.concatenate([[0], np.cumsum(later)])
        n = total[np.append(at[1:], len(later))] - total[at]
        own = run[at]
        start = first[own] + at - before[own]
        yield common.batch(k_id=doc[own], k_hash=table["k_hash"].to_numpy()[own], start=start, stop=start + n - 1 + words)


def repeated_spans(df: DataFrame, words: int = WORDS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_hash, start, stop: word ranges of documents covered by windows that also start in a document with a smaller id.

    Ranges of a document may touch or overlap. Null ids count as larger than all others and equal among themselves; rows that repeat an
    id are no earlier document to each other. Texts under `words` words, null and empty ones have no window. An empty table gives none.
    """
    if words <= PREFIX:
        raise ValueError(f"passages are longer than the prefix of {PREFIX} words")
    docs = inputs(df, id_col, text_col)
    spark = df.sparkSession

    @common.tidy
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in blocks(batches):
            row, _, _, key, _, _ = anchored(buf, offsets, common.word_spans(buf, offsets), words, PREFIX)
            yield common.batch(prefix=common.signed(key), k_id=rows.column("k_id").to_numpy()[row])

    held = docs.mapInArrow(anchors, "prefix long, k_id long").groupBy("prefix").agg(F.min("k_id").alias("low"), F.max("k_id").alias("high"), F.count(F.lit(1)).alias("n"))
    repeated = common.stored(held.where("low < high").select("prefix", "n"))
    shared = common.Bloom(spark, repeated, "prefix", 26)
    large = common.Bloom(spark, repeated.where(F.col("n") > group), "prefix", 22)

    @common.tidy
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in blocks(batches):
            spans = common.word_spans(buf, offsets)
            row, first, count, key, hashes, at = anchored(buf, offsets, spans, words, PREFIX)
            kept = np.flatnonzero(shared.has(key)) if len(key) else np.zeros(0, np.int64)
            if not len(kept):
                continue
            owner = {c: rows.column(c).to_numpy() for c in ("k_id", "k_hash")}
            long_prefix = large.has(key[kept])
            some = kept[~long_prefix]
            if len(some):
                texts = run_texts(buf, spans, at[some], count[some] + words - 1)
                yield common.batch(prefix=common.signed(key[some]), check=pa.nulls(len(some), pa.int64()), **{c: x[row[some]] for c, x in owner.items()}, first=first[some], windows=count[some], words=texts)
            some = kept[long_prefix]
            if len(some):
                n = count[some]
                ends = np.cumsum(n)
                inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
                place = np.repeat(at[some], n) + inner
                prefix, check = (common.window_hashes(hashes, words, m)[place] for m in (_OTHER, _CHECK))
                yield common.batch(prefix=common.signed(prefix), check=common.signed(check), **{c: np.repeat(x[row[some]], n) for c, x in owner.items()}, first=np.repeat(first[some], n) + inner, windows=np.ones(len(place), np.int64), words=pa.nulls(len(place), pa.binary()))

    found = common.stored(docs.mapInArrow(suffixes, "prefix long, check long, k_id long, k_hash long, first long, windows long, words binary"))
    shared.drop()
    large.drop()
    grouped = found.where("check is null").drop("check").repartition("prefix").sortWithinPartitions("prefix")
    small = grouped.mapInArrow(common.tidy(lambda x: subtrees(x, words)), "k_id long, k_hash long, start long, stop long")
    hot = found.where("check is not null").select("prefix", "check", "k_id", "k_hash", "first")
    firsts = common.stored(hot.groupBy("prefix", "check").agg(F.min("k_id").alias("least"), F.max("k_id").alias("most")).where("least < most").drop("most"))
    if not common.few(firsts):
        later = hot.join(firsts, ["prefix", "check"]).where("k_id > least").select("k_id", "k_hash", F.col("first").alias("start"), (F.col("first") + words).alias("stop"))
        return small.unionByName(later)
    # the copies of a hot passage stay where they are and look their node up
    table = firsts.toArrow()
    order = np.argsort(table["prefix"].to_numpy())
    listed = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("prefix", "check", "least")))  # BROADCAST_ROWS at most

    @common.tidy
    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, check, least = listed.value
        for rows in batches:
            own, mark, doc, text, first = (rows.column(c).to_numpy() for c in ("prefix", "check", "k_id", "k_hash", "first"))
            gone = np.zeros(len(own), bool)
            at, end = np.searchsorted(prefix, own, "left"), np.searchsorted(prefix, own, "right")
            for step in range(int((end - at).max(initial=0))):  # one, unless prefixes collide
                k = np.minimum(at + step, len(prefix) - 1)
                gone |= (at + step < end) & (check[k] == mark) & (doc > least[k])
            use = np.flatnonzero(gone)
            doc, text, first = doc[use], text[use], first[use]
            begin = np.ones(len(use), bool)
            begin[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1] + 1)
            start = np.flatnonzero(begin)
            if len(start):
                yield common.batch(k_id=doc[start], k_hash=text[start], start=first[start], stop=first[np.append(start[1:], len(use)) - 1] + words)

    return small.unionByName(hot.mapInArrow(looked_up, "k_id long, k_hash long, start long, stop long"))


TEXTS = "doc_id long, k_hash long, n_words long, n_removed long, text string"


def remove_repeats(df: DataFrame, words: int = WORDS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k_hash, n_words, n_removed and text (the kept words joined by one space) of every row.

    Documents without a repeat never move. The others meet their ranges in a join, their words compressed on the way.
    """
    docs = inputs(df, id_col, text_col).withColumn("key", F.xxhash64("k_id", "k_hash"))
    spans = repeated_spans(df, words, group, id_col, text_col)
    by_doc = common.stored(spans.groupBy("k_id", "k_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))  # at most the document's words
    touched = common.Bloom(df.sparkSession, by_doc.select(F.xxhash64("k_id", "k_hash").alias("key")), "key", 24)

    def split(rows: pa.RecordBatch, wanted: bool) -> pa.RecordBatch:
        return rows.filter(pa.array(touched.has(rows.column("key").to_numpy().view(np.uint64)) == wanted))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            rows = split(rows, False)
            kept = [(x.as_py() or b"").split() for x in rows.column("text").cast(pa.binary())]
            n = pa.array(list(map(len, kept)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("k_hash"), n, pa.array(np.zeros(len(kept), np.int64)), pa.array([b" ".join(x) for x in kept], pa.binary()).cast(pa.string())], [x.split()[0] for x in TEXTS.split(", ")])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            rows = split(rows, True)
            yield common.batch(doc_id=rows.column("doc_id"), k_id=rows.column("k_id"), k_hash=rows.column("k_hash"), packed=pa.array([press.compress(b" ".join((x.as_py() or b"").split())) for x in rows.column("text").cast(pa.binary())], pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for rows in batches:
            sizes, removed, texts = [], [], []
            for data, own in zip(rows.column("packed"), rows.column("spans"), strict=True):
                text = np.array(unpress.decompress(data.as_py()).split(), object)
                drop = np.zeros(len(text) + 1, np.int64)
                if own.is_valid:
                    flat = own.values
                    np.add.at(drop, flat.field("start").to_numpy(), 1)
                    np.add.at(drop, flat.field("stop").to_numpy(), -1)
                gone = np.cumsum(drop)[:-1] > 0
                sizes.append(len(text))
                removed.append(int(gone.sum()))
                texts.append(b" ".join(text[~gone]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("k_hash"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], [x.split()[0] for x in TEXTS.split(", ")])

    moved = docs.mapInArrow(packed, "doc_id long, k_id long, k_hash long, packed binary").join(by_doc, ["k_id", "k_hash"], "left")
    return docs.mapInArrow(whole, TEXTS).unionByName(moved.select("doc_id", "k_hash", "packed", "spans").mapInArrow(cut, TEXTS))
