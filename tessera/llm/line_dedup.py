"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words; lines of at least `least` distinct words take part (1: all but blank ones). Lines of 1 to 3 words resemble only their equals, so they need no prefix. Tokens are ordered by rarity, by counts in a
table of fixed size (any one order is exact; rarer first is fast). Two lines of Jaccard 0.8 share a token within both prefixes, so lines
meet under their prefix tokens only, and pairs pass a length, a positional and a bitmap filter before their whole sets are compared.
Equal sets count as one line, its first occurrence. A line goes if an earlier line, in the order of (doc_id, line number), is similar.

In a group of many lines only each line's earliest candidate is proposed at first; lines that this settles propose nothing more, so a
thousand variants of one line do not make a million pairs. The lines still open then propose all their candidates: nothing is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: distinct words a line needs to take part, unless the caller says otherwise: all lines but blank ones
LEAST = 1
#: a line of fewer words has Jaccard 0.8 with its equals only
MIXED = 4
#: counts of tokens, by the low bits of their hashes
LOG2_COUNTS = 22
#: rows of one group that propose all pairs at once, and rows of one tile
SMALL, TILE = 64, 20_000
#: rank of tokens that may be in more lines than a tile holds
COMMON = 57
LOWER_VALUES = common.BYTE_VALUES[common.LOWER]
_COUNT_MASK = np.uint64((1 << LOG2_COUNTS) - 1)


def prefix_length(size: np.ndarray) -> np.ndarray:
    """How many of its rarest words a line of `size` distinct words is found by: one more than Jaccard 4 / 5 lets it miss."""
    return size - (4 * size + 4) // 5 + 1


class Lines:
    """Distinct tokens of each line of at least `least` of them, by row and line number; with `ranks`, the rarest first and their ranks."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, least: int = LEAST, ranks: np.ndarray | None = None) -> None:
        starts, ends, _ = common.word_spans(buf, offsets)
        breaks = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(buf == 0x0A) + 1]))
        words = np.diff(np.append(np.searchsorted(starts, breaks), len(starts)))
        many = words >= least
        if least > 1:
            use = np.repeat(many, words)
            starts, ends = starts[use], ends[use]
        at, line = breaks[many], np.repeat(np.arange(np.count_nonzero(many)), words[many])
        token = common.span_hashes(buf, starts, ends, LOWER_VALUES)
        rank = None if ranks is None else ranks[(token & _COUNT_MASK).astype(np.int64)]
        order = common.order_in_groups(line, len(at), token, rank)  # lines stay in their order
        token = token[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        self.token, self.line, self.rank = token[keep], line[keep], None if rank is None else rank[order[keep]]
        self.size = np.bincount(self.line, minlength=len(at))
        enough = self.size >= least
        if not enough.all():
            use = enough[self.line]
            self.token, self.line = self.token[use], (np.cumsum(enough) - 1)[self.line[use]]
            self.size, at, self.rank = self.size[enough], at[enough], None if rank is None else self.rank[use]
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.row = np.searchsorted(offsets, at, "right") - 1
        self.number = np.searchsorted(breaks, at) - np.searchsorted(breaks, offsets[self.row])
        if len(self.size):
            with np.errstate(over="ignore"):
                self.key = common.mixed(np.add.reduceat(common.mixed(self.token ^ np.uint64(0x5555)), self.first[:-1]) + self.size.astype(np.uint64))
            bit, half = np.uint64(1) << (self.token >> np.uint64(58)), (self.token >> np.uint64(57)) & np.uint64(1)
            self.sketches = [np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), self.first[:-1]) for k in (0, 1)]
        else:
            self.key = np.zeros(0, np.uint64)
            self.sketches = [self.key, self.key]


def inputs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = common.documents(df, id_col, text_col)
    return docs.select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("k_id"), F.col("row_hash").alias("k_hash"), "text")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for rows in batches:
        buf, offsets = common.byte_buffer(rows.column("text"))
        for lo, hi in common.row_blocks(offsets):
            yield rows.slice(lo, hi - lo), buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def word_tokens(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, _ = common.word_spans(buf, offsets)
    return common.span_hashes(buf, starts, ends, LOWER_VALUES)


def rarity(n: np.ndarray) -> np.ndarray:
    """A byte that orders counts: 0 up to 1, else four times the binary logarithm, 127 at most."""
    return np.minimum(np.log2(np.maximum(n, 1)) * 4, 127).astype(np.uint8)


def token_ranks(spark: SparkSession, docs: DataFrame, tokens: Callable[[np.ndarray, np.ndarray], np.ndarray] = word_tokens) -> tuple[np.ndarray, int]:
    """The rarity of each slot of a table of fixed size, hit by the tokens of all documents, and the number of all lines.

    Slots come to the driver, tokens do not; parts of the table travel compressed, as a task hits few of their slots.
    """
    part, lines = 1 << 12, -1

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, since, n_lines = np.zeros(1 << LOG2_COUNTS, np.uint32), 0, 0
        for _, buf, offsets in blocks(batches):
            slot = (tokens(buf, offsets) & _COUNT_MASK).astype(np.int64)
            np.add.at(total, slot, np.uint32(1))
            n_lines, since = n_lines + np.count_nonzero(buf == 0x0A) + len(offsets) - 1, since + len(slot)
            if since > 1 << 30:  # counts stay far below 2 ** 32
                np.minimum(total, np.uint32(1 << 31), out=total)
                since = 0
        press = zstandard.ZstdCompressor(level=1)
        used = np.flatnonzero(total.reshape(-1, part).any(axis=1))
        data = [np.array([n_lines], "<i8").tobytes(), *(press.compress(total[k * part : (k + 1) * part].astype("<u4").tobytes()) for k in used)]
        yield common.batch(part=np.append(lines, used).astype(np.int32), n=pa.array(data, pa.binary()))

    @common.tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor()
        for rows in batches:
            for k, n in zip(rows.column("part").to_pylist(), rows.column("n"), strict=True):
                own = np.frombuffer(n.as_buffer(), "<i8") if k == lines else np.frombuffer(unpress.decompress(n.as_buffer()), "<u4").astype(np.int64)
                total[k] = total[k] + own if k in total else own
        for k, n in total.items():
            yield common.batch(part=np.array([k], np.int32), n=pa.array([n.tobytes() if k == lines else rarity(n).tobytes()], pa.binary()))

    rows = docs.select("text").mapInArrow(count, "part int, n binary").repartition("part").mapInArrow(add, "part int, n binary").toArrow()
    out, n_lines = np.zeros(1 << LOG2_COUNTS, np.uint8), 0
    for k, n in zip(rows["part"].to_pylist(), rows["n"].to_pylist(), strict=True):
        if k == lines:
            n_lines = int(np.frombuffer(n, "<i8")[0])
        else:
            out[k * part : (k + 1) * part] = np.frombuffer(n, np.uint8)
    return out, n_lines


def packed_prefixes(lengths: np.ndarray, token: np.ndarray, shared: np.ndarray, often: np.ndarray) -> dict[str, object]:
    """Columns of each set's prefix: its tokens as one binary (0 for one that meets no other set, the last bit set for common ones), how
    many plain and whether common ones are among them.

    The sets' prefixes stand behind each other in `token`, `lengths` of each; `shared` tells the tokens by which sets meet, `often` common ones.
    """
    own = np.repeat(np.arange(len(lengths)), lengths)
    prefix = np.where(shared, token, np.uint64(0))
    prefix = np.where(prefix > 0, (prefix & ~np.uint64(1)) | often, np.uint64(0))
    bounds = np.concatenate([[0], 8 * np.cumsum(lengths)]).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(prefix))])
    plain = np.bincount(own, (prefix > 1) & (prefix & np.uint64(1) == 0), len(lengths)).astype(np.int32)
    return {"prefix": data, "plain": plain, "common": np.bincount(own, often & (prefix > 0), len(lengths)) > 0}


PREFIX = "prefix binary, plain int, common boolean"


def prefix_rows(part: pa.RecordBatch, kind: np.dtype, fields: dict[str, str], wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The prefix tokens for which `wanted` holds, and their rows: token, size, pos and the columns of `fields` (row's name = column's)."""
    data, offsets = common.byte_buffer(part.column("prefix"))
    token, n = data.view(np.uint64), np.diff(offsets) // 8
    use = np.flatnonzero(wanted(token))
    line = np.repeat(np.arange(len(n)), n)[use]
    rows = np.empty(len(use), kind)
    # a place beyond 65,535 only filters less
    rows["token"], rows["pos"], rows["size"] = token[use] & np.uint64(0xFFFFFFFF), np.minimum(use - offsets[line] // 8, 0xFFFF), part.column("size").to_numpy()[line]
    for name, column in fields.items():
        rows[name] = part.column(column).to_numpy()[line]
    return token[use], rows


def buckets_of(token: np.ndarray, n: int) -> np.ndarray:
    return ((token >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def labels_of(bucket: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Names of the groups of plain tokens: bucket and lower half of the token. Tokens that share both only make more candidates."""
    return common.mixed(bucket.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64)).view(np.int64)


class Prefixes:
    """The prefix rows of the sets in `distinct`, dealt out by token: packed for plain tokens, in tiles for common ones."""

    def __init__(self, distinct: DataFrame, kind: np.dtype, fields: dict[str, str]) -> None:
        self.rows, self.kind, self.fields = distinct.select(*dict.fromkeys(fields.values()), "size", "prefix"), kind, fields
        self.often = distinct.where("common").select(*self.rows.columns)
        self.buckets = max(1, (distinct.agg(F.sum("plain")).first()[0] or 0) // common.BUCKET_ROWS)

    def candidates(self, propose: Callable, schema: str, only: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """What `propose` (label, rows) gives of the groups, those alone whose label `only` may hold."""
        kind, fields, n = self.kind, self.fields, self.buckets

        @common.tidy
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                def wanted(token: np.ndarray) -> np.ndarray:
                    use = (token != 0) & (token & np.uint64(1) == 0)
                    if only is not None:
                        use[use] = only(labels_of(buckets_of(token[use], n), token[use] & np.uint64(0xFFFFFFFF)).view(np.uint64))
                    return use

                token, rows = prefix_rows(part, kind, fields, wanted)
                yield common.packed_rows(buckets_of(token, n), rows)

        @common.tidy
        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in common.whole_buckets(batches, kind):
                label = labels_of(bucket, rows["token"])
                yield from propose(label, label, rows)

        plain = common.by_bucket(self.rows.mapInArrow(spread, "bucket int, data binary")).mapInArrow(meet, schema)

        def spread_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                token, rows = prefix_rows(part, kind, fields, lambda x: (x & np.uint64(1) == 1) & (only(x) if only is not None else True))
                data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * kind.itemsize), pa.py_buffer(rows.view(np.uint8))])
                yield common.batch(token=common.signed(token), key=rows["key"].copy(), data=data)

        @common.tidy
        def meet_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in common.whole_groups(batches, ["token", "tile_a", "tile_b"]):
                token, a, b = (table[c].to_numpy() for c in ("token", "tile_a", "tile_b"))
                group = np.zeros(len(token), np.int64)
                group[1:] = np.cumsum((token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                yield from propose(group, token, common.byte_buffer(table["data"].chunk(0))[0].view(kind))

        if not self.often.take(1):
            return plain
        often = common.stored(self.often.mapInArrow(spread_common, "token long, key long, data binary"), "snappy")
        tiles = common.tiled(often, "token", "key", TILE)
        names = ["token", "tile_a", "tile_b"]
        return plain.unionByName(tiles.repartition(*names).sortWithinPartitions(*names).mapInArrow(meet_common, schema))


def meeting(group: np.ndarray, rows: np.ndarray, apart: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in `rows` (sorted by group and size) that pass the length, positional and bitmap filters and differ in field `apart`."""
    size, pos, name = rows["size"].astype(np.int64), rows["pos"].astype(np.int64), rows[apart].copy()
    sketches = [rows[x].copy() for x in rows.dtype.names if x.startswith("sketch")]
    active, step = np.arange(max(0, len(size) - 1)), 1
    while len(active):
        active = active[active + step < len(size)]
        other = active + step
        near = (group[active] == group[other]) & (5 * size[active] >= 4 * size[other])
        active, other = active[near], other[near]
        overlap = -(-4 * (size[active] + size[other]) // 9)
        fits = np.minimum(size[active] - pos[active], size[other] - pos[other]) >= overlap
        fits &= name[active] != name[other]
        a, b = active[fits], other[fits]
        apart_bits = sum((np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in sketches), np.zeros(len(a), np.int64))
        near = size[a] + size[b] - apart_bits >= 2 * overlap[fits]
        yield a[near], b[near]
        step += 1


def in_groups(group: np.ndarray, label: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, label, row and size of group of each row that is not alone in its group, by group and set size."""
    order = np.argsort(group)
    group = group[order]
    new = np.ones(len(group) + 1, bool)
    new[1:-1] = group[1:] != group[:-1]
    use = ~(new[1:] & new[:-1])
    order, number = order[use], np.cumsum(new[:-1])[use] - 1
    by_size = np.argsort(number << 32 | rows["size"][order])  # as by lexsort, in one sort
    order, number = order[by_size], number[by_size]
    return number, label[order], rows[order], np.bincount(number)[number]


ROW = np.dtype([("token", "<u4"), ("size", "<u4"), ("pos", "<u2"), ("number", "<u4"), ("key", "<i8"), ("doc", "<i8"), ("sketch", "<u8"), ("sketch2", "<u8")])
FIELDS = {"key": "key", "doc": "k_id", "number": "number", "sketch": "sketch", "sketch2": "sketch2"}


def proposals(group: np.ndarray, label: np.ndarray, rows: np.ndarray, small: int, open_lines: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Candidate pairs among prefix rows: earlier line, later line, and the label of a large group, one of over `small` rows.

    `open_lines` given: all candidates whose later line it may hold; else all of small groups and the earliest one of each line in a large one.
    """
    group, label, rows, many = in_groups(group, label, rows)
    key, large = rows["key"].copy(), many > small
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((key, rows["number"], rows["doc"]))] = np.arange(len(key))
    best = np.full(len(key), len(key))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in meeting(group, rows, "key"):
        swap = rank[a] > rank[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        if open_lines is None:
            np.minimum.at(best, b[large[b]], rank[a[large[b]]])
            a, b = a[~large[b]], b[~large[b]]
        elif len(b):
            keep = open_lines(key[b].view(np.uint64))
            a, b = a[keep], b[keep]
        if len(a):
            found.append((key[a], key[b]))
        if sum(len(x) for x, _ in found) > 1 << 18:
            yield proposed_pairs(found)
            found = []
    if found:
        yield proposed_pairs(found)
    b = np.flatnonzero(best < len(key))
    if len(b):
        yield common.batch(a=key[np.argsort(rank)[best[b]]], b=key[b], token=label[b])


def proposed_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Pairs once each, though lines that are alike meet under most of their prefix tokens."""
    a, b = common.distinct_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return common.batch(a=a, b=b, token=pa.nulls(len(a), pa.int64()))


PAIRS = "a long, b long, token long"


def similar(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, parse: Callable = Lines) -> DataFrame:
    """The pairs (a, b), stored, whose token sets have Jaccard 0.8 or more.

    The sets (lines, or what else `parse` reads) are read anew from the documents that hold their first places, which a checked broadcast or
    a Bloom filter of fixed size tells; both joins share one exchange of the sets, and one set of each pair moves to the other's.
    """
    spark = docs.sparkSession
    keys = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "snappy")
    wanted = common.Bloom(spark, keys, "key", 24)
    holders = common.stored(distinct.select("key", F.xxhash64("at.k_id", "at.k_hash").alias("holder")).join(keys, "key", "left_semi").select("holder").distinct(), "snappy")
    docs = docs.select(F.xxhash64("k_id", "k_hash").alias("holder"), "text")
    held = None
    if common.few(holders):  # other documents do not even reach the workers
        docs = docs.join(F.broadcast(holders), "holder", "left_semi")
    else:
        held = common.Bloom(spark, holders, "holder", 24)

    @common.tidy
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = batches if held is None else (part.filter(pa.array(held.has(part.column("holder").to_numpy().view(np.uint64)))) for part in batches)
        for _, buf, offsets in blocks(parts):
            x = parse(buf, offsets)
            _, once = np.unique(x.key, return_index=True)
            once = once[wanted.has(x.key[once])]
            lengths = x.size[once]
            ends = np.cumsum(lengths)
            at = np.repeat(x.first[once] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
            yield common.batch(key=common.signed(x.key[once]), tokens=pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), common.signed(x.token[at])))

    sets = docs.mapInArrow(fetch, "key long, tokens array<long>").dropDuplicates(["key"])
    of_a, of_b = (sets.select(F.col("key").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in "ab")
    both = pairs.join(of_b, "b").join(of_a, "a")
    alike = both.where(9 * F.size(F.array_intersect("a_tokens", "b_tokens")) >= 4 * (F.size("a_tokens") + F.size("b_tokens"))).select("a", "b")
    out = common.stored(alike)
    wanted.drop()
    if held is not None:
        held.drop()
    return out


#: a line on its way to the lines of equal sets; its prefix goes beside it. Size 0: an earlier line has the same set
LINE = np.dtype([("key", "<i8"), ("k_id", "<i8"), ("k_hash", "<i8"), ("number", "<u4"), ("size", "<u4"), ("sketch", "<u8"), ("sketch2", "<u8")])


def line_prefix(size: np.ndarray) -> np.ndarray:
    """The prefix length of lines: none where only equals are similar."""
    return np.where(size >= MIXED, prefix_length(size.astype(np.int64)), 0)


def firsts_and_copies(rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first line of each set, then all at later places, their size 0, and the prefixes of these lines; `tokens` has those of `rows`.

    Of lines at one place (rows that repeat id and text) one is left.
    """
    lengths = line_prefix(rows["size"])
    old = np.flatnonzero(rows["size"])
    order = old[np.argsort(rows["key"][old])]
    key = rows["key"][order]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    alike = again.copy()
    alike[:-1] |= again[1:]
    some = order[alike]
    some = some[np.lexsort((rows["k_hash"][some], rows["number"][some], rows["k_id"][some], rows["key"][some]))]
    new = np.ones(len(some), bool)
    new[1:] = rows["key"][some[1:]] != rows["key"][some[:-1]]
    head = some[new][np.cumsum(new) - 1] if len(some) else some
    later = np.zeros(len(some), bool)
    for name in ("k_id", "number", "k_hash"):
        later |= rows[name][some] != rows[name][head]
    firsts = np.concatenate([order[~alike], some[new]])
    out = rows[np.concatenate([firsts, some[later], np.flatnonzero(rows["size"] == 0)])]
    out["size"][len(firsts) :] = 0
    return out, ragged(tokens, lengths, firsts)


def ragged(tokens: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens of the rows `at`, `lengths` of each row standing behind each other in `tokens`."""
    n, before = lengths[at], np.cumsum(lengths) - lengths
    ends = np.cumsum(n)
    return tokens[np.repeat(before[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def dealt_lines(rows: np.ndarray, tokens: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Lines packed by a bucket of their set, after those at later places than another one here are known as copies, which go to any bucket."""
    rows, tokens = firsts_and_copies(rows, tokens)
    place = common.mixed(rows["k_hash"].view(np.uint64) ^ rows["number"])
    bucket = buckets_of(np.where(rows["size"] > 0, rows["key"].view(np.uint64), place), buckets)
    order, lengths = np.argsort(bucket, kind="stable"), line_prefix(rows["size"])
    tokens = ragged(tokens, lengths, order)
    out = common.packed_rows(bucket, rows)
    ends = np.cumsum(lengths[order])[np.append(np.flatnonzero(np.diff(bucket[order])), len(order) - 1)] if len(order) else np.zeros(0, np.int64)
    bounds = np.append(0, 8 * ends).astype(np.int32)
    return out.append_column("prefix", pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(tokens)]))


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """k_id, k_hash, number of each line (from 0, lines parted by line feeds) to which an earlier line is similar.

    Null ids order last. Rows that repeat both id and text count as one document, which its own lines repeat in all of them alike. Lines
    under `least` distinct words, blank lines, null and empty texts give nothing.

    Lines move once, packed, to those of equal sets: what is not the first of its set is known to go from then on, and a task sends the
    first line alone of each set among its last BUCKET_ROWS lines, so a very common line fills no bucket.
    """
    spark = df.sparkSession
    docs = inputs(df, id_col, text_col)
    parse = functools.partial(Lines, least=least)
    table, n_lines = token_ranks(spark, docs)
    ranks = spark.sparkContext.broadcast(table)  # 4 MB whatever the corpus
    buckets = max(1, 4 * n_lines // common.BUCKET_ROWS)  # some a task, so that tasks are even

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, buf, offsets in blocks(batches):
            x = Lines(buf, offsets, least, ranks.value)
            lengths = line_prefix(x.size)
            at = np.repeat(x.first[:-1] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            token = np.where(x.rank[at] > 0, x.token[at] & ~np.uint64(1) | (x.rank[at] > COMMON), np.uint64(0))
            own = np.empty(len(x.size), LINE)
            own["key"], own["size"], own["number"], own["sketch"], own["sketch2"] = x.key.view(np.int64), x.size, x.number, *x.sketches
            own["k_id"], own["k_hash"] = (rows.column(c).to_numpy()[x.row] for c in ("k_id", "k_hash"))
            held.append((own, token))
            if sum(len(x) for x, _ in held) >= common.BUCKET_ROWS:
                yield dealt_lines(*map(np.concatenate, zip(*held, strict=True)), buckets)
                held = []
        if held:
            yield dealt_lines(*map(np.concatenate, zip(*held, strict=True)), buckets)

    @common.tidy
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.bucket_tables(batches, LINE.itemsize):
            rows, tokens = (common.byte_buffer(part[c].chunk(0))[0] for c in ("data", "prefix"))
            rows, tokens = firsts_and_copies(rows.view(LINE), tokens.view(np.uint64))
            columns = {c: rows[c].astype(kind) for c, kind in (("key", "i8"), ("k_id", "i8"), ("k_hash", "i8"), ("number", "i4"), ("size", "i4"), ("sketch", "i8"), ("sketch2", "i8"))}
            yield common.batch(**columns, **packed_prefixes(line_prefix(rows["size"]), tokens, tokens > 0, tokens & np.uint64(1) > 0))

    packed = common.by_bucket(docs.mapInArrow(read, "bucket int, data binary, prefix binary"))
    lines = common.stored(packed.mapInArrow(settle, f"key long, k_id long, k_hash long, number int, size int, sketch long, sketch2 long, {PREFIX}"), "snappy")
    ranks.destroy()
    places = ["k_id", "k_hash", "number"]
    distinct, copies = lines.where("size > 0").withColumn("at", F.struct(*places)), lines.where("size = 0").select(*places)
    prefixes = Prefixes(distinct, ROW, FIELDS)
    proposed = common.stored(prefixes.candidates(functools.partial(proposals, small=SMALL), PAIRS))
    gone = similar(docs, distinct, proposed.select("a", "b").distinct(), parse).select(F.col("b").alias("key")).distinct()
    left = common.stored(proposed.where("token is not null").select(F.col("b").alias("key"), "token").join(gone, "key", "left_anti"))
    if left.take(1):  # lines of large groups whose earliest candidate is not similar
        groups, lasting = common.Bloom(spark, left, "token", 24), common.Bloom(spark, left, "key", 24)
        more = common.stored(prefixes.candidates(functools.partial(proposals, small=SMALL, open_lines=lasting.has), PAIRS, groups.has), "snappy")
        groups.drop()
        lasting.drop()
        fresh = common.stored(more.select("a", "b").distinct().join(gone.withColumnRenamed("key", "b"), "b", "left_anti"), "snappy")
        gone = gone.unionByName(similar(docs, distinct, fresh, parse).select(F.col("b").alias("key")))
    near = common.stored(gone.distinct(), "snappy")
    return copies.unionByName(distinct.join(F.broadcast(near) if common.few(near) else near, "key", "left_semi").select(*places))


def remove_lines(text: str, numbers: set[int]) -> str:
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in numbers)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, row_hash, n_lines, removed (sorted numbers of the lines that go) and text (what is left) of each row; null stays null.

    Documents without a repeated line never move. The others meet their line numbers in a join, their text compressed on the way. Which
    are which a broadcast of checked size tells, or a Bloom filter.
    """
    docs = common.documents(df, id_col, text_col).withColumn("k_id", F.coalesce("doc_id", F.lit(common.NULL_ID))).withColumn("pair", F.xxhash64("k_id", "row_hash"))
    gone = repeated_lines(df, id_col, text_col, least).groupBy("k_id", F.col("k_hash").alias("row_hash")).agg(F.array_sort(F.collect_set("number")).alias("removed"))
    gone = common.stored(gone)  # at most a document's own lines in a row
    changed = common.stored(gone.select(F.xxhash64("k_id", "row_hash").alias("pair")).distinct(), "snappy")
    if common.few(changed):
        same, moving = (docs.join(F.broadcast(changed), "pair", how) for how in ("left_anti", "left_semi"))
    else:
        touched = common.Bloom(df.sparkSession, changed, "pair", 24)

        def split(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                yield rows.filter(pa.array(touched.has(rows.column("pair").to_numpy().view(np.uint64)) == wanted))

        same, moving = (docs.mapInArrow(functools.partial(split, wanted=w), docs.schema) for w in (False, True))
    out = "doc_id long, row_hash long, n_lines long, removed array<int>, text string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column("text")
            n = [0 if not x.as_py() else x.as_py().count("\n") + 1 for x in texts]
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(n) + 1), pa.int32()), pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row_hash"), pa.array(n, pa.int64()), none, texts], ["doc_id", "row_hash", "n_lines", "removed", "text"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            data = [None if not x.is_valid else press.compress(x.as_buffer()) for x in rows.column("text").cast(pa.binary())]
            yield common.batch(doc_id=rows.column("doc_id"), k_id=rows.column("k_id"), row_hash=rows.column("row_hash"), packed=pa.array(data, pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for rows in batches:
            n, removed, texts = [], [], []
            for data, own in zip(rows.column("packed"), rows.column("removed"), strict=True):
                numbers = own.as_py() or []
                text = None if not data.is_valid else unpress.decompress(data.as_py()).decode()
                n.append(text.count("\n") + 1 if text else 0)
                removed.append(numbers)
                texts.append(remove_lines(text, set(numbers)) if text else text)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row_hash"), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "row_hash", "n_lines", "removed", "text"])

    moved = moving.mapInArrow(packed, "doc_id long, k_id long, row_hash long, packed binary").join(gone, ["k_id", "row_hash"], "left")
    return same.mapInArrow(whole, out).unionByName(moved.select("doc_id", "row_hash", "packed", "removed").mapInArrow(cut, out))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", least: int = LEAST) -> DataFrame:
    """`df` with each text rid of its repeated lines, in the same columns; `chars_col`, where there is one, is counted anew.

    No row goes: a document that loses every line keeps an empty text.
    """
    names = df.columns
    plain, named = common.keyed(df, id_col, text_col)
    t = common.position(df, text_col)
    gone = common.stored(repeated_lines(df, id_col, text_col, least).groupBy("k_id", "k_hash").agg(F.collect_set("number").alias("gone")))
    lines = F.split(f"c{t}", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    changed = {f"c{t}": kept}
    if chars_col is not None and chars_col in names:
        c = names.index(chars_col)
        changed[f"c{c}"] = F.length(kept).cast(df.schema[c].dataType)
    keys = ["k_id", "k_hash"]
    if common.few(gone):  # only documents that change move
        same, moving = (plain.join(F.broadcast(gone.select(*keys)), keys, how) for how in ("left_anti", "left_semi"))
        return named(same.select(*plain.columns).unionByName(moving.join(gone, keys).withColumns(changed).select(*plain.columns)))
    out = plain.join(gone, keys, "left")
    return named(out.withColumns({c: F.when(F.col("gone").isNull(), F.col(c)).otherwise(x) for c, x in changed.items()}))
