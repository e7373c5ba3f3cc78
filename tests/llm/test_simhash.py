import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    nodes = sorted(set(fps))
    label = plain_components(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 4])
    ids = defaultdict(list)
    for (d, _), f in zip(rows, fps, strict=True):
        ids[label[f]].append(d)
    return Counter((d, f, min((x for x in ids[label[f]] if x is not None), default=None)) for (d, _), f in zip(rows, fps, strict=True))


def test_against_brute_force(odd, odd_rows, docs, doc_rows):
    for df, rows in ((odd, odd_rows), (docs, doc_rows)):
        got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect())
        assert got == expected(rows)


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).columns == none.columns


def test_one_of_each_group_stays(docs, doc_rows, odd):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in expected(doc_rows)}
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(odd).collect()]
    assert len(got) == len(set(got)) and (None, "a text without an id") in got and sum(d == 7 for d, _ in got) == 1 and all(d != 11 for d, _ in got)


def test_links_in_large_groups(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "TILE", 8)  # every key of a group is cut
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base:
        for _ in range(30):
            values.add(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))) & (2**64 - 1))
    values = sorted(values)
    frame = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    got = simhash.links(frame).collect()
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in got]
    want = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert plain_components(values, pairs) == plain_components(values, want)


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    frame = spark.createDataFrame([*chain, (1, 1), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(frame).collect()}
    want = plain_components({n for e in chain for n in e}, chain)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in chain)}
    assert common.components(frame.where("a = -1")).count() == 0


def test_forest():
    a, b = np.array([5, 3, 9, 9, 1]), np.array([3, 2, 8, 9, 1])
    x, y = common.forest(a, b)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(2, 3), (2, 5), (8, 9)]


def test_bloom_loses_nothing(spark):
    values = np.random.default_rng(1).integers(-(2**62), 2**62, 3000)
    bloom = common.Bloom(spark, spark.createDataFrame([(int(v),) for v in values[:1000]], "h long"), "h", 16)
    has = bloom.has(values.view(np.uint64))
    assert has[:1000].all() and has[1000:].mean() < 0.1


def test_tiles_meet(spark):
    frame = spark.createDataFrame([(k % 3 // 2, k) for k in range(300)], "key int, m int")
    cut = common.tiled(frame, "key", "m", 40).collect()
    groups = defaultdict(set)
    for r in cut:
        groups[r["key"], r["tile_a"], r["tile_b"]].add(r["m"])
    meet = {(x, y) for g in groups.values() for x in g for y in g}
    assert all((x, y) in meet for x in range(300) for y in range(300) if x % 3 // 2 == y % 3 // 2)
    assert max(map(len, groups.values())) <= 120
    assert cut and F


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_blocks_lose_no_link(spark, blocks):
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 7))) for b in base for _ in range(6)]
    every = sorted({*base, *near})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in every], "fp long")
    got = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.links(df, blocks=blocks).collect()}
    want = {(a, b) for i, a in enumerate(every) for b in every[:i] if (a ^ b).bit_count() <= 4}
    assert plain_components(every, [tuple(x) for x in got]) == plain_components(every, want)


def test_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    rows = [(i, "the very same words here") for i in range(20)] + [(i + 20, f"other words {i}") for i in range(5)] + [(None, None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()) == expected(rows)
