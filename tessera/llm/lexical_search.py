"""Ranked lexical search: exact top-k documents of a query by a BM25-like integer score, over dual-sorted wavelet trees.

A shard holds some documents. Its postings lists, one a term, each by falling impact (the term's share of the score but for its weight),
stand one after another, and a wavelet matrix holds their document numbers. A node of it is a range of document numbers; a list's part in
a node is an interval, which two rank look-ups carry to each child, and in it the order by impact is kept, so the interval's first entry
has the largest impact of the node. Documents are numbered by id within the shard, so nodes also run in the order of ids.

A query walks all its lists down together: the sum of weight times first impact bounds every document of a node, and at a leaf it is the
document's score. Nodes are taken best first; those that cannot reach the k-th best score, or reach it with larger ids only, are cut. The
k best found so far go from shard to shard of a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: bytes outside terms: all of ASCII but digits and letters
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: text of a shard, at most (but one document)
SHARD_BYTES = 16 << 20
#: queries of one pass over the index, and bytes of their texts, at most (but one query)
CHUNK = 4096
CHUNK_BYTES = 16 << 20
#: nodes that are taken from the frontier at once
STEP = 64
SHARD = "docs binary, terms binary, term_ends binary, starts binary, impacts binary, bits binary"


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, A-Z lower-cased, and the number of each text's first one (one entry more than texts)."""
    low = common.LOWER[buf]
    starts, ends, first = common.word_spans(low, offsets, GAP)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[~GAP[low]]))]), first


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats, of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            buf, offsets = common.byte_buffer(rows.column("text"))
            holding = terms = 0
            for lo, hi in common.row_blocks(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                _, _, first = common.word_spans(buf[offsets[lo] : offsets[hi]], own, GAP)
                holding += int((np.diff(first) > 0).sum())
                terms += int(first[-1])
            yield common.batch(holding=[holding], terms=[terms])

    got = docs.select("text").mapInArrow(run, "holding long, terms long").agg(F.sum("holding"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def impacts_of(tf: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The score of a term of weight 1 that stands tf times in a document of so many terms."""
    m = 100 - 75 + (75 * lengths * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def matrix_bits(docs: np.ndarray, levels: int) -> np.ndarray:
    """The wavelet matrix of the document numbers: for each level, from the highest bit, the entries' bits in words of 64, a free bit at least at the end."""
    words = len(docs) // 64 + 1
    out = np.zeros((levels, words * 8), np.uint8)
    for level in range(levels):
        bit = (docs >> (levels - 1 - level)) & 1
        packed = np.packbits(bit.astype(bool), bitorder="little")
        out[level, : len(packed)] = packed
        docs = np.concatenate([docs[bit == 0], docs[bit == 1]])
    return out.view("<u8")


def levels_for(documents: int) -> int:
    return max(1, (documents - 1).bit_length())


def shard(ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray, documents: int, terms: int) -> dict[str, bytes]:
    """The index of some documents, as SHARD."""
    order = np.argsort(ids, kind="stable")
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    found, first = terms_of(buf, offsets)
    lengths = np.diff(first)
    coded = found.dictionary_encode()
    vocabulary, size = coded.dictionary, max(1, len(ids))
    key = coded.indices.to_numpy().astype(np.int64) * size + np.repeat(number, lengths)
    key.sort()
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    tf = np.diff(np.append(begins, len(key)))
    term, doc = np.divmod(key[begins], size)
    impact = impacts_of(tf, lengths[order][doc], documents, max(1, terms))
    # impacts are under 2^20: one integer orders by term, falling impact and document
    key = (term << 20 | ((1 << 20) - 1 - impact)) * size + doc
    key.sort()
    high, doc = np.divmod(key, size)
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
    data, ends = common.byte_buffer(vocabulary)
    return {
        "docs": ids[order].astype("<i8").tobytes(),
        "terms": data.tobytes(),
        "term_ends": ends.astype("<i8").tobytes(),
        "starts": starts.astype("<i8").tobytes(),
        "impacts": ((1 << 20) - 1 - (high & ((1 << 20) - 1))).astype("<u4").tobytes(),
        "bits": matrix_bits(doc, levels_for(len(ids))).tobytes(),
    }


def build(docs: DataFrame) -> tuple[DataFrame, int]:
    """The stored index of all documents (doc_id, text), and how many hold a term. A shard holds documents that lie together, so nothing is shuffled."""
    documents, terms = corpus_size(docs)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            buf, offsets = common.byte_buffer(rows.column("text"))
            ids = pc.fill_null(rows.column("doc_id"), common.NULL_ID).to_numpy()
            for lo, hi in common.row_blocks(offsets, SHARD_BYTES):
                own = shard(ids[lo:hi], buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], documents, terms)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own.values()], list(own))

    return common.stored(docs.select("doc_id", "text").mapInArrow(run, SHARD)), documents


def vocabulary_of(part: pa.RecordBatch, i: int) -> pa.Array:
    ends = np.frombuffer(part.column("term_ends")[i].as_py(), "<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), part.column("terms")[i].as_buffer()])


def frequencies(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """For each of the terms: the documents that hold it."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for part in batches:
            for i in range(part.num_rows):
                at = pc.index_in(vocabulary_of(part, i), value_set=shared.value)
                own = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                total[at.take(pa.array(own)).to_numpy()] += np.diff(np.frombuffer(part.column("starts")[i].as_py(), "<i8"))[own]
        held = np.flatnonzero(total)
        yield common.batch(term=held, df=total[held])

    got = index.select("terms", "term_ends", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[got["term"].to_numpy()] = got["df"].to_numpy()
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Ranking:
    """The k best documents of a query so far, by score, then by id: what a further one has to beat."""

    def __init__(self, k: int) -> None:
        self.k, self.hits = k, []

    @property
    def full(self) -> bool:
        return len(self.hits) >= self.k

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.hits = sorted([*self.hits, *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]

    def open(self, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether a document of at most this score and at least this id may still enter."""
        if not self.full:
            return bound > 0
        score, worst = -self.hits[-1][0], self.hits[-1][1]
        return (bound > score) | ((bound == score) & (first_id < worst))


class Tree:
    """A shard opened for search: rank look-ups of the wavelet matrix, and the impacts in the order of each level."""

    def __init__(self, part: pa.RecordBatch, i: int) -> None:
        self.docs = np.frombuffer(part.column("docs")[i].as_py(), "<i8")
        impacts = np.frombuffer(part.column("impacts")[i].as_py(), "<u4")
        self.n, self.levels = len(impacts), levels_for(len(self.docs))
        bits = np.frombuffer(part.column("bits")[i].as_py(), "<u8").reshape(self.levels, -1)
        self.width = bits.shape[1]
        before = np.cumsum(np.bitwise_count(bits), axis=1, dtype=np.int64)
        self.zeros = self.n - before[:, -1]
        self.words = bits.reshape(-1)
        self.before = (before - np.bitwise_count(bits)).reshape(-1)
        self.impacts = np.empty((self.levels + 1, self.n + 1), np.int64)
        self.impacts[:, -1] = 0  # behind the last entry, where empty intervals may begin
        self.impacts[0, :-1] = impacts
        for level in range(self.levels):
            bit = np.unpackbits(bits[level].view(np.uint8), bitorder="little")[: self.n].astype(bool)
            own, zeros = self.impacts[level, :-1], int(self.zeros[level])
            self.impacts[level + 1, :zeros] = own[~bit]
            self.impacts[level + 1, zeros:-1] = own[bit]
        self.flat = self.impacts.reshape(-1)

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` entries of the level have their bit set."""
        word = level * self.width + (at >> 6)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def search(self, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray, ranking: Ranking) -> None:
        """Add to the ranking what this shard's documents give for lists [lo, hi) of these weights."""
        node, level = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = lo[None], hi[None]
        bound = (self.flat[lo] * weights).sum(1)
        while True:
            first_id = self.docs[np.minimum(node << (self.levels - level), len(self.docs) - 1)]
            alive = np.flatnonzero(ranking.open(bound, first_id))
            if not len(alive):
                return
            if len(alive) > STEP:  # best first, of equal bounds the deepest
                order = np.argpartition(-(bound[alive] * (self.levels + 1) + level[alive]), STEP)
                taken, rest = alive[order[:STEP]], alive[order[STEP:]]
            else:
                taken, rest = alive, alive[:0]
            deep = level[taken][:, None]
            one_lo, one_hi = self.ones(deep, lo[taken]), self.ones(deep, hi[taken])
            zeros = self.zeros[deep]
            below_lo = np.concatenate([lo[taken] - one_lo, zeros + one_lo])
            below_hi = np.concatenate([hi[taken] - one_hi, zeros + one_hi])
            below, under = np.concatenate([2 * node[taken], 2 * node[taken] + 1]), np.tile(level[taken] + 1, 2)
            best = (np.where(below_lo < below_hi, self.flat[under[:, None] * (self.n + 1) + below_lo], 0) * weights).sum(1)
            held = best > 0
            leaf = held & (under == self.levels)
            if leaf.any():
                ranking.add(best[leaf], self.docs[below[leaf]])
            more = held & ~leaf
            node, level, bound = (np.concatenate([x[rest], y[more]]) for x, y in ((node, below), (level, under), (bound, best)))
            lo, hi = np.concatenate([lo[rest], below_lo[more]]), np.concatenate([hi[rest], below_hi[more]])


def ranked(index: DataFrame, terms: pa.Array, queries: dict[int, dict[int, int]], k: int) -> DataFrame:
    """n, doc_id, score: the k best documents of every task for each query, given as weights by the numbers of its terms."""
    arrays = {n: (np.fromiter(q, np.int64, len(q)), np.fromiter(q.values(), np.int64, len(q))) for n, q in queries.items()}
    shared = index.sparkSession.sparkContext.broadcast((terms, arrays))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, asked = shared.value
        rankings = {n: Ranking(k) for n in asked}
        for part in batches:
            for i in range(part.num_rows):
                at = pc.index_in(vocabulary_of(part, i), value_set=wanted)
                own = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                if not len(own):
                    continue
                starts = np.frombuffer(part.column("starts")[i].as_py(), "<i8")
                lists = np.full(len(wanted), -1)
                lists[at.take(pa.array(own)).to_numpy()] = own
                tree = Tree(part, i)
                for n, (numbers, weights) in asked.items():
                    held = lists[numbers]
                    some = held >= 0
                    if some.any():
                        tree.search(starts[held[some]], starts[held[some] + 1], weights[some], rankings[n])
        rows = [(n, doc, -score) for n, r in rankings.items() for score, doc in r.hits]
        n, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (n, doc, score)], ["n", "doc_id", "score"])

    return index.mapInArrow(run, "n long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents that score most for each item, above 0, ties to the smaller doc_id.

    Whole texts of documents and items are read. A null text has no terms; a document or item without terms is never in a result. Rows that
    repeat, or that repeat an id, are documents or items of their own; a null doc_id orders behind all others, a null item_id is kept.
    Columns of other names are left out, names that clash included. No documents or no items give no rows.
    """
    corpus = common.pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    asked = common.pick(items, item_id=(item_id_col, "long"), text=(item_text_col, "string"))
    asked = common.stored(asked.withColumn("n", F.monotonically_increasing_id()))
    (index, documents), found = build(corpus), None
    width = asked.agg(F.max(F.octet_length("text"))).first()[0] or 0
    for rows in common.chunks(asked, width, CHUNK, CHUNK_BYTES):
        words = {r["n"]: Counter(terms_of(*common.byte_buffer(pa.array([r["text"]], pa.string())))[0].to_pylist()) for r in rows}
        every = sorted({w for own in words.values() for w in own})
        if not every:
            continue
        terms = pa.array(every, pa.large_binary())
        number = {w: i for i, w in enumerate(every)}
        df = frequencies(index, terms).tolist()
        weights = [weight(documents, d) if d else 0 for d in df]
        queries = {n: {number[w]: c * weights[number[w]] for w, c in own.items() if df[number[w]]} for n, own in words.items()}
        part = common.stored(ranked(index, terms, {n: q for n, q in queries.items() if q}, k))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("n").orderBy(F.desc("score"), "doc_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = top.join(asked.select("n", "item_id"), "n")
    return named.select("item_id", "rank", F.when(F.col("doc_id") != common.NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
