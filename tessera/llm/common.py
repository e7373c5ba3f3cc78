"""Helpers that the corpus operators share: column picking, word hashing, bounded Bloom filters, shared tables."""

from __future__ import annotations

import ctypes
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: bytes 0x20 and 0x09-0x0D part words
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: a document id that is null orders behind every other
NULL_ID = (1 << 63) - 1
BLOCK = 1 << 20
#: rows of a few numbers that may be broadcast (some 16 MB); a longer table is joined by a shuffle
BROADCAST_ROWS = 400_000
#: rows that are packed for one bucket, about
BUCKET_ROWS = 100_000

_MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def position(df: DataFrame, name: str) -> int:
    """Index of column `name`: the exact spelling first, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    found = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"no single column {name!r} among {df.columns}")
    return found[0]


def pick(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """The columns named in `wanted` (new name = (column, type)), whatever else `df` holds, names that clash included."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{position(df, name)}").cast(kind).alias(new) for new, (name, kind) in wanted.items()))


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and row_hash; (doc_id, row_hash) tells rows apart that repeat an id with another text."""
    return pick(df, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("row_hash", row_hash(F.col("text")))


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` under plain names with key columns k_id, k_hash, and a function that gives the old names back."""
    names, n = df.columns, len(df.columns)
    i, t = position(df, id_col), position(df, text_col)
    out = df.toDF(*(f"c{k}" for k in range(n)))
    out = out.withColumns({"k_id": F.coalesce(F.col(f"c{i}").cast("long"), F.lit(NULL_ID)), "k_hash": row_hash(F.col(f"c{t}").cast("string"))})
    return out, lambda x: x.select(*(f"c{k}" for k in range(n))).toDF(*names)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset and Spark runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.environ.setdefault("TESSERA_TEST_SHARED", tempfile.mkdtemp(prefix="tessera-"))
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.option("compression", codec).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def few(df: DataFrame) -> bool:
    """Whether a stored table of a few numbers a row may be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def chunks(table: DataFrame, width: int, rows: int, size: int) -> Iterator[list[dict]]:
    """A stored table in the order of its distinct numbers n, in pieces of at most `rows` rows and, rows being `width` bytes at most, `size` bytes (but one row)."""
    most, last = max(1, min(rows, size // max(1, width))), -1
    while part := table.where(F.col("n") > last).orderBy("n").limit(most).toArrow().to_pylist():
        yield part
        last = part[-1]["n"]


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without copying, and where each row begins (one more offset than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (one more entry than rows). No word crosses rows."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = np.frombuffer(buf.tobytes().translate((~gap).astype(np.uint8).tobytes()), np.uint8)
    edges = [np.flatnonzero(inside[1:] != inside[:-1]) + 1]  # where a word starts or ends, in turn
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    cuts = np.unique(cuts[(inside[cuts - 1] & inside[cuts]) > 0])
    if len(cuts):
        edges = [np.sort(np.concatenate([*edges, cuts, cuts]))]
    edge = np.concatenate([np.zeros(int(inside[0]), np.int64), *edges, np.full(int(inside[-1]), len(buf))])
    starts = edge[0::2].copy()
    return starts, edge[1::2].copy(), np.searchsorted(starts, offsets)


def powers(n: int, multiplier: int = _MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """multiplier ** i and its inverse modulo 2 ** 64 for i below n."""
    have = _powers.get(multiplier)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = np.full(size, multiplier, U64), np.full(size, pow(multiplier, -1, 1 << 64), U64)
            up[0] = down[0] = 1
            have = _powers[multiplier] = np.cumprod(up), np.cumprod(down)
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


#: a random 64-bit value for each byte, by rule: seed 7
BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, U64) * U64(2) + U64(1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes, equal hash, wherever the span stands."""
    out = np.empty(len(starts), U64)
    j = 0
    with np.errstate(over="ignore"):
        while j < len(starts):
            k = max(j + 1, int(np.searchsorted(ends, starts[j] + BLOCK // 16, "right")))  # what a processor's cache holds
            base, stop = starts[j], ends[k - 1]
            up, down = powers(int(stop - base))
            total = np.zeros(stop - base + 1, U64)
            own = values.take(buf[base:stop].astype(np.intp))
            own *= up
            np.cumsum(own, out=total[1:])
            out[j:k] = (total[ends[j:k] - base] - total[starts[j:k] - base]) * down[starts[j:k] - base] + (ends[j:k] - starts[j:k]).astype(U64)
            j = k
    return mixed(out)


def order_in_groups(group: np.ndarray, groups: int, value: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The order by group (under `groups`), then rank (under 128), if given, then value."""
    bits = max(1, int(groups).bit_length())
    key = group.astype(U64) << U64(64 - bits)
    key |= value >> U64(bits) if rank is None else (rank.astype(U64) << U64(57 - bits)) | (value >> U64(7 + bits))
    order = np.argsort(key)
    key, own = key[order], value[order]
    if ((key[1:] == key[:-1]) & (own[1:] != own[:-1])).any():  # values that differ in their lowest bits alone
        return np.lexsort((value, group) if rank is None else (value, rank, group))
    return order


def window_hashes(words: np.ndarray, width: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, by word hashes; entry i begins at word i."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    step = BLOCK // 4
    with np.errstate(over="ignore"):
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            part = words[lo : hi + width - 1]
            up, down = powers(len(part), multiplier)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(part * up, out=total[1:])
            out[lo:hi] = (total[width:] - total[: hi - lo]) * down[: hi - lo]
    return mixed(out)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs once each, but for a few that stay twice where their hashes collide."""
    key = mixed(a.view(U64) ^ mixed(b.view(U64) ^ U64(0x9E37)))
    order = np.argsort(key)
    a, b, key = a[order], b[order], key[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[once], b[once]


class Bloom:
    """A Bloom filter of a fixed number of bits over 64-bit hashes; it only spares rows the way to an exact join that follows.

    Its size does not depend on the data, so it can always be broadcast; a fuller filter lets more rows pass and loses none.
    """

    def __init__(self, spark: SparkSession, hashes: DataFrame, column: str, log2_bits: int = 24) -> None:
        mask, shift = (1 << log2_bits) - 1, 64 - log2_bits
        h = F.col(column)
        spots = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, shift))).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
        got = words.toArrow()
        bits = np.zeros(1 << (log2_bits - 6), U64)
        bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(U64)
        self.mask, self.shift, self.bits = U64(mask), U64(shift), spark.sparkContext.broadcast(bits)

    def drop(self) -> None:
        """Free the filter where it was sent, once the tables that needed it are stored."""
        self.bits.destroy()

    def has(self, h: np.ndarray) -> np.ndarray:
        bits = self.bits.value
        low, high = h & self.mask, h >> self.shift
        one = U64(1)
        return ((bits[low >> U64(6)] >> (low & U64(63))) & (bits[high >> U64(6)] >> (high & U64(63))) & one).astype(bool)


def tiled(df: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """`df` with columns tile_a, tile_b so that any two rows of one `key` meet in some (key, tile_a, tile_b), and none of these holds over about 2 x `limit` rows.

    A key of up to `limit` rows is one tile. A larger one is cut by a hash of `member`, and each of its rows goes to as many tile pairs as it has tiles.
    """
    large = stored(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("tiles")))
    if not large.take(1):
        return df.withColumns({"tile_a": F.lit(0), "tile_b": F.lit(0)})
    small = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    cut = df.join(F.broadcast(large) if small else large, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64(member), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("tile_a"), F.greatest(F.col("own"), other).alias("tile_b")))
    return cut.withColumn("own", own).withColumn("pair", F.explode(pairs)).select(*df.columns, "pair.tile_a", "pair.tile_b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by `keys`: tables in which every group is whole."""
    kept: pa.Table | None = None
    for part in batches:
        table = pa.Table.from_batches([part])
        if not table.num_rows:
            continue
        table = pa.concat_tables([kept, table]).combine_chunks() if kept is not None else table
        same = np.ones(table.num_rows, bool)
        for k in keys:
            x = table[k].to_numpy()
            same &= x == x[-1]
        at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if at:
            yield table.slice(0, at).combine_chunks()
        kept = table.slice(at)
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks()


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """`run` for mapInArrow, after which a worker gives its free memory back, as it outlives the task."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def packed_rows(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of a record type as bucket and data, one binary for each bucket, so that a shuffle moves few long rows in place of many short ones."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
    ends = (np.append(at, len(bucket)) * rows.dtype.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(rows[order].view(np.uint8))])
    return batch(bucket=bucket[at], data=data)


def bucket_tables(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """From packed rows of `width` bytes sorted by bucket: tables of whole buckets, about BUCKET_ROWS or one bucket at a time."""
    for table in whole_groups(batches, ["bucket"]):
        _, offsets = byte_buffer(table["data"].chunk(0))
        bucket, before = table["bucket"].to_numpy(), offsets // width
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        lo = 0
        while lo < len(bucket):
            k = max(int(np.searchsorted(before[ends], before[lo] + BUCKET_ROWS, "right")) - 1, int(np.searchsorted(ends, lo, "right")))
            yield table.slice(lo, int(ends[k]) - lo)
            lo = int(ends[k])


def whole_buckets(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets and rows of `bucket_tables`."""
    for table in bucket_tables(batches, kind.itemsize):
        data, offsets = byte_buffer(table["data"].chunk(0))
        yield np.repeat(table["bucket"].to_numpy(), np.diff(offsets // kind.itemsize)), data.view(kind)


def by_bucket(packed: DataFrame) -> DataFrame:
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as connect what the links (a, b) connect: each node with the smallest of its part, itself left out."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        at_x, at_y = label[x], label[y]
        least, low = label.copy(), np.minimum(at_x, at_y)
        np.minimum.at(least, at_x, low)
        np.minimum.at(least, at_y, low)
        while not np.array_equal(least, jump := least[least]):
            least = jump
        if np.array_equal(least, label):
            break
        label = least
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the undirected links, root being the smallest node it reaches.

    Large-star and small-star rounds in turn (Kiveris et al. 2014): every round joins the links with the smallest neighbour of each
    node, which an aggregation with map-side combine finds, so a hub is never gathered. A checkpoint ends each round's lineage.
    Nulls and loops are left out; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    edges = edges.checkpoint()
    seen = None
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small_least, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small_least.select("v", F.col("m").alias("u"))).where("u < v").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
