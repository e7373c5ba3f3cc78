"""Near-duplicates by SimHash: fingerprints of word shingles, pigeonhole blocks, Hamming distance, components.

Fingerprints that differ in at most 4 of 64 bits agree in at least two of six blocks, so each distinct fingerprint goes to the 15 pairs
of blocks and only fingerprints under the same pair are compared. A pair has 21 or 22 bits, too few to part very many fingerprints; then
seven or eight blocks, of which three or four agree, make keys of 27 or 32 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: blocks for so many distinct fingerprints
BLOCKS = ((6, 1 << 24), (7, 1 << 30), (8, 1 << 62))
DISTANCE = 4
TILE = 4096


def fingerprint(text: bytes, width: int = 4) -> int:
    """64 bits, each set where it is set in over half the XXH64 (seed 42) of the shingles; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        part = slice(lo, min(n, lo + (1 << 15)))
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[part].tolist(), ends[k - 1 :][part].tolist(), strict=True)], np.uint64)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash and fp (the fingerprint as a signed long) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            buf, offsets = common.byte_buffer(rows.column("text"))
            data = memoryview(buf)
            found = np.fromiter((fingerprint(bytes(data[a:b]), width) for a, b in itertools.pairwise(offsets.tolist())), np.uint64, len(offsets) - 1)
            yield common.batch(doc_id=rows.column("doc_id"), row_hash=rows.column("row_hash"), fp=common.signed(found))

    return common.documents(df, id_col, text_col).mapInArrow(run, "doc_id long, row_hash long, fp long")


def close_pairs(batches: Iterator[pa.RecordBatch], distance: int = DISTANCE) -> Iterator[pa.RecordBatch]:
    """From fingerprints sorted by (key, tile_a, tile_b): links that connect whatever lies within `distance` under one key."""
    for table in common.whole_groups(batches, ["key", "tile_a", "tile_b"]):
        fp = table["fp"].to_numpy().view(np.uint64)
        group = np.zeros(len(fp), np.int64)
        for k in ("key", "tile_a", "tile_b"):
            x = table[k].to_numpy()
            group[1:] |= x[1:] != x[:-1]
        group = np.cumsum(group)
        active, step = np.arange(len(fp) - 1), 1
        a, b = [], []
        while len(active):  # rows i and i + step of one group; a group that has ended stays ended
            active = active[active + step < len(fp)]
            active = active[group[active] == group[active + step]]
            near = active[np.bitwise_count(fp[active] ^ fp[active + step]) <= distance]
            a.append(fp[near])
            b.append(fp[near + step])
            step += 1
            if sum(map(len, a)) > 1 << 20:
                x, y = common.forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
                a, b = [x.view(np.uint64)], [y.view(np.uint64)]
        if a and sum(map(len, a)):
            x, y = common.forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
            yield common.batch(a=x, b=y)


def block_keys(blocks: int, distance: int) -> list[Column]:
    """A key for each set of blocks that may be equal in fingerprints (column fp) within `distance` bits: its number above its bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(edges)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - distance)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(block[i])
        keys.append(key)
    return keys


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all those within `distance` bits, at most 4."""
    if blocks is None:
        n = distinct.count()
        blocks = next(b for b, most in BLOCKS if n < most)
    if distance > min(DISTANCE, blocks - 2):
        raise ValueError(f"{blocks} blocks find at most {min(DISTANCE, blocks - 2)} differing bits")
    spread = distinct.select(F.explode(F.array(*block_keys(blocks, distance))).alias("key"), "fp")
    cut = common.tiled(spread, "key", "fp", TILE)
    group = ["key", "tile_a", "tile_b"]
    near = cut.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda x: close_pairs(x, distance), "a long, b long")
    return near.distinct()


def near_duplicates(df: DataFrame, width: int = 4, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, fp, root (one fingerprint of the component) and component_id, the smallest doc_id that links reach.

    Equal fingerprints (exact copies, all texts without words) count as one before anything is compared. Null ids never win the
    minimum; a component without an id has component_id null. Repeated rows each keep their row. An empty table gives no rows.
    """
    docs = common.stored(fingerprints(df, width, id_col, text_col))
    distinct = common.stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = common.components(links(distinct, distance)).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only fingerprints with a link share a root: the aggregation is of roots, the join of at most as many rows as fingerprints
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = common.stored(named.join(ids, "root").select("fp", "root", "component_id", "n"))
    hot = labels.where(F.col("n") > TILE).drop("n")
    if not (hot.take(1) and common.few(hot)):
        return docs.join(labels.drop("n"), "fp")
    # the copies of a very common text stay where they are
    rest = docs.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(labels.drop("n"), "fp")
    return rest.unionByName(docs.join(F.broadcast(hot), "fp"))


def drop_near_duplicates(df: DataFrame, width: int = 4, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one document of each component: the one of the smallest id; of rows that repeat it, the one of the smallest text hash, once.

    A component whose ids are all null keeps the row of the smallest text hash. Columns stay as they are.
    """
    plain, named = common.keyed(df, id_col, text_col)
    found = near_duplicates(df, width, distance, id_col, text_col).select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("k_id"), F.col("row_hash").alias("k_hash"), "root")
    first = found.groupBy("root").agg(F.min(F.struct("k_id", "k_hash")).alias("first")).select("first.*").distinct()
    return named(plain.join(first, ["k_id", "k_hash"], "left_semi").dropDuplicates(["k_id", "k_hash"]))
