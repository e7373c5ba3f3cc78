"""Byte payloads as PNG in binary columns: chunks with checksum tests, zlib, row filters undone in numpy, cosine-transform hashes.

A payload of n x 192 bytes is an 8-bit grey image 192 samples wide. Reading checks the signature, every chunk's CRC, the declared size
and zlib's own checksum; a damaged value gives a row with an error and no features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: compressed bytes in one IDAT chunk
CHUNK = 1 << 16
#: samples a byte of the rows, by PNG colour type (8-bit: grey, RGB, grey and alpha, RGBA)
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, row by row; its length must be a positive multiple of `width`.

    Each row takes the filter none, unless its difference to the row above (filter up) repeats more.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    use_up = (up == 0).sum(axis=1) > width // 2
    filtered = np.empty((len(rows), width + 1), np.uint8)
    filtered[:, 0] = np.where(use_up, 2, 0)
    filtered[:, 1:] = np.where(use_up[:, None], up, rows)
    data = zlib.compress(filtered.tobytes(), level)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Chunk types and data up to IEND; ValueError where the signature, a length or a checksum is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(png):
            raise ValueError("cut short")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(png):
            raise ValueError("cut short")
        if zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + n


def unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of samples with their PNG filters (0 none, 1 sub, 2 up, 3 average, 4 Paeth) undone; `step` bytes make a pixel."""
    out = np.zeros_like(raw)
    height, width = raw.shape
    y = 0
    while y < height:
        kind = kinds[y]
        if kind in (0, 2):  # runs of rows at once
            stop = y + 1
            while stop < height and kinds[stop] == kind:
                stop += 1
            out[y:stop] = raw[y:stop] if kind == 0 else np.cumsum(raw[y:stop], axis=0, dtype=np.uint8)
            if kind == 2 and y:
                out[y:stop] += out[y - 1]
            y = stop
            continue
        above = out[y - 1] if y else np.zeros(width, np.uint8)
        if kind == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(raw[y, c::step], dtype=np.uint8)
        elif kind in (3, 4):
            row, up, left = out[y], above.astype(np.int32), np.zeros(step, np.int32)
            corner = np.zeros(step, np.int32)
            for x in range(0, width, step):
                b = up[x : x + step]
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    pa_, pb, pc_ = abs(p - left), abs(p - b), abs(p - corner)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc_), left, np.where(pb <= pc_, b, corner))
                row[x : x + step] = (raw[y, x : x + step] + guess) & 255
                left, corner = row[x : x + step].astype(np.int32), b
        else:
            raise ValueError(f"row filter {kind}")
        y += 1
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples as rows x (width x channels) of an 8-bit image that is not interlaced; ValueError for any other or damaged value.

    The header tells how many bytes the data must hold; no more than these are ever unpacked.
    """
    head, data = None, []
    for kind, part in chunks(png):
        if kind == b"IHDR":
            if len(part) != 13:
                raise ValueError("header of another size")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[4] or head[5] or head[6] or not head[0] or not head[1]:
        raise ValueError("not an 8-bit image without interlace")
    step = CHANNELS[head[3]]
    size = head[1] * (head[0] * step + 1)
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(data), size + 1)
    except (zlib.error, OverflowError, MemoryError) as e:
        raise ValueError(str(e)) from None
    if len(raw) != size or not unpacker.eof:
        raise ValueError("image data of another size")
    rows = np.frombuffer(raw, np.uint8).reshape(head[1], -1)
    return unfilter(rows[:, 1:], rows[:, 0], step)


def cosine_basis(size: int, kept: int) -> np.ndarray:
    """The first `kept` rows of the orthonormal cosine transform (DCT-II) of `size` points."""
    k, x = np.arange(kept)[:, None], np.arange(size)[None]
    out = np.cos(np.pi * k * (2 * x + 1) / (2 * size)) * np.sqrt(2 / size)
    out[0] /= np.sqrt(2)
    return out


BASIS = cosine_basis(32, 8)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: the 8 x 8 lowest-frequency coefficients against the median of all of them but the mean.

    The image is averaged into 32 x 32 cells first; one with fewer rows repeats them.
    """
    small = image
    for axis in (0, 1):
        n = small.shape[axis]
        edges = np.linspace(0, n, 33)
        lo = np.minimum(np.floor(edges[:-1]).astype(int), n - 1)
        hi = np.maximum(np.ceil(edges[1:]).astype(int), lo + 1)
        total = np.concatenate([np.zeros_like(np.take(small, [0], axis), np.float64), np.cumsum(small, axis=axis, dtype=np.float64)], axis=axis)
        small = (np.take(total, hi, axis) - np.take(total, lo, axis)) / np.expand_dims(hi - lo, 1 - axis)
    low = (BASIS @ small @ BASIS.T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: bytes, width: int = WIDTH) -> bytes:
    """The text and spaces up to a positive multiple of `width`."""
    return text + b" " * (-len(text) % width if text else width)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8) and media, the text's payload as PNG. A null text is empty: one row of spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            buf, offsets = common.byte_buffer(rows.column("text"))
            data = memoryview(buf)
            for lo, hi in common.row_blocks(offsets, 4 * common.BLOCK):
                media = [encode_png(payload_of(bytes(data[offsets[k] : offsets[k + 1]]))) for k in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.pick(df, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(media: DataFrame) -> DataFrame:
    """Digests and the cosine hash of each stored image (columns doc_id, n_bytes, media), from its own bytes.

    A null or damaged value keeps its row with media_bytes and media_sha256, an error and nulls. Equal media, equal features; rows stay
    where they are, so nothing is shuffled.
    """

    def read(png: bytes | None) -> tuple:
        png = png or b""
        own = (len(png), hashlib.sha256(png).hexdigest())
        try:
            image = decode_png(png)
        except ValueError as e:
            return (None, None, None, *own, None, str(e))
        payload = image.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, cosine_hash(image), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = list(zip(*(read(x.as_py()) for x in rows.column("media")), strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
