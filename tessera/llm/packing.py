"""Packing without padding: documents cut into pieces of binary lengths, equal lengths in one bucket.

A document of n tokens gives n // limit pieces of `limit` tokens and one piece for each bit of the rest, longest first. A piece is a
sequence by itself: no sequence crosses documents and none needs padding, as every length is a power of two. Batches are drawn from
one bucket (all its sequences have the same length), so a batch of token budget B holds B / 2 ** bucket sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.tokenizing import ChunkEncoder, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"


def binary_lengths(n: int, limit: int) -> list[int]:
    """Lengths that add up to `n`: `limit` as often as it fits, then the set bits of the rest from the highest."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_block(rows: pa.RecordBatch, code: ChunkEncoder, limit: int, end_id: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of a few documents (doc_id, text)."""
    ids, first = code.encode(rows.column("text"))
    out: list[tuple] = []
    for k, name in enumerate(rows.column("doc_id").to_pylist()):
        own = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4").tobytes()
        start, n = 0, len(own) // 4
        for length in binary_lengths(n, limit):
            piece = own[4 * start : 4 * (start + length)]
            out.append((name, start, length, zlib.crc32(piece), n, length.bit_length() - 1, piece if with_ids else None))
            start += length
    doc, start, length, crc, n, bucket, piece = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(bucket, pa.int32()), pa.array(piece, pa.binary())],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"],
    )


def cut_blocks(batches: Iterator[pa.RecordBatch], code: ChunkEncoder, limit: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of all batches, about a BLOCK of text at a time; what a block took is given back before the next."""
    for rows in batches:
        _, offsets = common.byte_buffer(rows.column("text"))
        for lo, hi in common.row_blocks(offsets):
            yield cut_block(rows.slice(lo, hi - lo), code, limit, end_id, with_ids)
            common.give_back()


def pack(
    df: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids.

    ids are little-endian unsigned 32-bit integers; `with_ids=False` leaves them null. A null or empty text is the end id alone. Rows
    that repeat, nulls in doc_id and columns of any other name give pieces of their own; an empty table gives no rows. sequence_id is
    unique in the result and counts up within a partition of the input, so it takes no shuffle.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    @common.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_blocks(batches, encoder(vocabulary), limit, end_id, with_ids)

    pieces = common.pick(df, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(cut, PIECES)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", "ids")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each sequence length; a large bucket is as many files as the writing tasks make of it."""
    pieces.select("doc_id", "start", "sequence_id", "ids", "bucket").write.partitionBy("bucket").parquet(path)
