import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, score long, n string"


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * float(np.float32(x))) for x in v]


def brute(rows, k=10, is_query=lambda i: i % 100 == 0):
    kept = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for at, (q, x) in enumerate(kept):
        if is_query(q):
            hits = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True)))), i) for j, (i, y) in enumerate(kept) if j != at and len(x) == len(y)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def check(spark, rows, k=10, **kw):
    df = spark.createDataFrame([(i, v, 5, "n") for i, v in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in vector_search.search(df, F.col("vec_id") % 100 == 0, k, **kw).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == brute(rows, k)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.5, -0.25]), (1, None), (200, None), (2, [1.0, None]), (300, [float("nan"), 0.0]), (3, [float("inf"), 1.0]), (400, []), (4, []), (5, [-0.0, 0.0]), (500, [0.0, 0.0]),
            (600, [1.0, 2.0, 3.0]), (6, [0.1, 0.2, 0.3]), (None, [9.0, 9.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (-100, [-1.0, -2.0]), (0, [1.0, 2.0]), (9, [1.0, 2.0]), (700, [7.0])]
    check(spark, rows)
    check(spark, rows, k=2, pivots=1)


def test_integers_beyond_float64(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 6, 20, 38]) for _ in range(3)]) for i in range(0, 900, 10)]
    check(spark, rows)


def test_against_brute_force_with_many_annuli(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ANNULUS", 7)
    monkeypatch.setattr(vector_search, "CHUNK", 5)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] * rng.uniform(0.2, 2) + rng.normal(size=8) * 0.1]) for i in range(1500)]
    rows += [(i, rows[0][1]) for i in range(1500, 2300)]
    check(spark, rows, sample=64, pivots=9)


def test_annuli_are_cut(spark):
    """Of clustered vectors most annuli are out of reach of a query's threshold."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = (centres[np.arange(4000) % 40] + rng.normal(size=(4000, 16)) * 0.02).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows = vector_search.quantized(df, 1024, "vec_id", "embedding").cache()
    pivots = vector_search.fit_pivots(rows, 1000, 40)
    blocks = vector_search.build(rows, pivots, 11).collect()
    asked = [r.asDict() | {"n": i} for i, r in enumerate(rows.where("vec_id % 100 = 0").collect())]
    group = vector_search.Queries(asked, 16, pivots[16])
    truth = np.sort(group.x @ np.floor(x.astype(float) * 1024).T, 1)[:, -11]
    reached = sum(int((group.bounds(b.asDict()) >= truth).sum()) for b in blocks)
    assert reached < 0.3 * len(blocks) * len(asked)
    for b in blocks:
        best = (group.x @ vector_search.numbers(b["vecs"], 16, b["wide"]).T).max(1)
        assert (best <= group.bounds(b.asDict())).all()


def test_given_queries(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(3, [1.0, 0.0]), (90, [-1.0, 0.0]), (91, None)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in vector_search.search(df, queries=asked, k=2).collect())
    assert got == [(3, 1, 29, 29 * 1024 * 1024), (3, 2, 28, 28 * 1024 * 1024), (90, 1, 0, 0), (90, 2, 1, -1024 * 1024)]
    with pytest.raises(ValueError):
        vector_search.search(df)


def test_none(spark):
    check(spark, [])
    check(spark, [(1, [1.0]), (2, [2.0])])
    check(spark, [(100, [1.0])])


def test_vectors(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = vector_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
