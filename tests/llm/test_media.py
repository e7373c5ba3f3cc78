import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import media


def test_round_trip_of_all_rows(odd, odd_rows, docs, doc_rows, none):
    for df, rows in ((odd, odd_rows), (docs, doc_rows)):
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) for r in media.features(media.store(df)).collect())
        want = []
        for d, t in rows:
            b = (t or "").encode()
            p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
            want.append((str(d), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), None))
        assert got == sorted(want)
    assert media.features(media.store(none)).count() == 0


def test_damage_is_found(spark):
    png = media.encode_png(b"x" * 384)
    bad = [None, b"", png[:-3], png[:40] + bytes([png[40] ^ 1]) + png[41:], b"JUNK" + png, png[:50], media.SIGNATURE + media.chunk(b"IEND", b"")]
    df = spark.createDataFrame([(i, 1, b) for i, b in enumerate([png, *bad])], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.features(df).collect()}
    assert got[0]["error"] is None and all(got[i]["error"] and got[i]["feature"] is None for i in range(1, len(bad) + 1))


def image(head, data):
    return media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"IDAT", zlib.compress(data)) + media.chunk(b"IEND", b"")


def test_wrong_headers_and_bombs(spark):
    full = struct.pack(">IIBBBBB", 192, 1, 8, 0, 0, 0, 0)
    row = b"\0" + b"x" * 192
    bad = [
        image(full[:12], row), image(full + b"\0", row), image(struct.pack(">IIBBBBB", 0, 1, 8, 0, 0, 0, 0), b"\0"), image(struct.pack(">IIBBBBB", 192, 0, 8, 0, 0, 0, 0), b""), image(full, row + b"y"), image(full, bytes(50_000_000)),
        image(struct.pack(">IIBBBBB", 4_000_000_000, 4_000_000_000, 8, 6, 0, 0, 0), row), image(full, b"\7" + row[1:]), image(struct.pack(">IIBBBBB", 192, 1, 8, 0, 1, 0, 0), row), media.SIGNATURE + media.chunk(b"IHDR", full) + media.chunk(b"IDAT", zlib.compress(row)[:-3]) + media.chunk(b"IEND", b""),
    ]
    df = spark.createDataFrame([(i, 192, b) for i, b in enumerate([image(full, row), *bad])], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r["error"] for r in media.features(df).collect()}
    assert got[0] is None and all(got[i] for i in range(1, len(bad) + 1))


def filtered(rows, kinds, step):
    """Rows with PNG filters applied, by the format's definition, sample by sample."""
    out = bytearray()
    for y, (row, kind) in enumerate(zip(rows, kinds, strict=True)):
        out.append(kind)
        for x, v in enumerate(row):
            a = int(row[x - step]) if x >= step else 0
            b = int(rows[y - 1][x]) if y else 0
            c = int(rows[y - 1][x - step]) if y and x >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((int(v) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
    return bytes(out)


@pytest.mark.parametrize(("colour", "step"), media.CHANNELS.items())
def test_every_filter_is_undone(colour, step):
    rng = np.random.default_rng(colour)
    rows = rng.integers(0, 256, (20, 9 * step), np.uint8)
    kinds = [0, 1, 2, 3, 4, *rng.integers(0, 5, 15).tolist()]
    data = zlib.compress(filtered(rows, kinds, step))
    png = media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 20, 8, colour, 0, 0, 0)) + media.chunk(b"IDAT", data[:10]) + media.chunk(b"IDAT", data[10:]) + media.chunk(b"IEND", b"")
    assert (media.decode_png(png) == rows).all() and io


def test_cosine_hash():
    y, x = np.mgrid[0:192, 0:192]
    soft = (127 + sum(100 / (k + m + 2) ** 1.5 * np.cos(np.pi * k * x / 192 + m) * np.cos(np.pi * m * y / 192 + k) for k in range(8) for m in range(8))).clip(0, 255).astype(np.uint8)
    noisy = np.clip(soft + np.random.default_rng(1).normal(0, 4, soft.shape), 0, 255).astype(np.uint8)
    other = np.random.default_rng(2).integers(0, 256, soft.shape, np.uint8)
    bits = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert bits(soft, noisy) <= 12 < bits(soft, other)
    basis = media.cosine_basis(32, 32)
    assert np.allclose(basis @ basis.T, np.eye(32))
    assert len(media.cosine_hash(np.zeros((1, 192), np.uint8))) == 16


def plain_hash(payload):
    """The cosine hash by its definition, cell by cell and coefficient by coefficient."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, 192).astype(float)

    def cells(n):
        edges = np.linspace(0, n, 33)
        return [(min(int(np.floor(a)), n - 1), max(int(np.ceil(b)), min(int(np.floor(a)), n - 1) + 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    small = np.array([[image[a:b, c:d].mean() for c, d in cells(192)] for a, b in cells(len(image))])
    wave = lambda k: np.cos(np.pi * k * (2 * np.arange(32) + 1) / 64) * np.sqrt((1 if k == 0 else 2) / 32)
    low = np.array([(np.outer(wave(k), wave(m)) * small).sum() for k in range(8) for m in range(8)]).round(6)
    return sum(1 << (63 - i) for i, c in enumerate(low) if c > np.median(low[1:]))


def test_features_against_the_definition(spark, docs, doc_rows, odd, odd_rows):
    for df, rows in ((docs, doc_rows), (odd, odd_rows)):
        got = {(str(r["doc_id"]), r["payload_sha256"]): int(r["feature"], 16) for r in media.features(media.store(df)).collect()}
        for d, t in rows:
            p = media.payload_of((t or "").encode())
            assert got[str(d), hashlib.sha256(p).hexdigest()] == plain_hash(p)
