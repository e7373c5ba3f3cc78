"""Places to their owners through segments, against brute force."""

import random

from pyspark.sql import functions as F

from tessera.operators import resolve


def test_segments_make_up_their_interval(spark):
    rng = random.Random(1)
    spans = [(s, s + rng.choice([0, 1, 2, 7, 8, 100, 1000])) for s in [rng.randrange(-300, 300) for _ in range(300)]] + [(0, 2**40), (-(2**50), 2**50), (5, 4)]
    df = spark.createDataFrame(spans, "s long, e long").where("s <= e").withColumn("parts", resolve.segments(F.col("s"), F.col("e")))
    for r in df.collect():
        parts = sorted((p["node"] << p["level"], (p["node"] + 1) << p["level"]) for p in r["parts"])
        assert parts[0][0] == r["s"] and parts[-1][1] == r["e"] + 1
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) <= 2 * (r["e"] - r["s"] + 1).bit_length()


def test_against_brute_force(spark):
    rng = random.Random(2)
    intervals = [(rng.choice(["a", "b", None]), s, s + rng.choice([-1, 0, 1, 3, 20, 400]), rng.randrange(60)) for s in [rng.randrange(-50, 500) for _ in range(400)]] + [("a", None, 3, 1), ("a", 3, None, 1)]
    points = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-60, 600)])) for i in range(800)]
    points += [(i, "a", 7) for i in range(800, 900)]
    p = spark.createDataFrame(points, "point_id long, file string, line long")
    i = spark.createDataFrame(intervals, "file string, s long, e long, owner long")

    def covering(file, line):
        return [(e - s, o) for f, s, e, o in intervals if None not in (f, s, e, file, line) and f == file and s <= line <= e]

    inner = {r["point_id"]: r["owner"] for r in resolve.innermost_interval(p, i, "file", "point_id", "line", "s", "e", "owner").collect()}
    first = {r["point_id"]: r["owner"] for r in resolve.first_interval(p, i, "file", "point_id", "line", "s", "e", "owner").collect()}
    for n, file, line in points:
        hits = covering(file, line)
        assert inner[n] == (min(hits)[1] if hits else None)
        assert first[n] == (min(o for _, o in hits) if hits else None)
    assert len(inner) == len(points)


def test_empty_tables(spark):
    p = spark.createDataFrame([(1, "a", 2)], "point_id long, file string, line long")
    i = spark.createDataFrame([], "file string, s long, e long, owner long")
    assert [r["owner"] for r in resolve.innermost_interval(p, i, "file", "point_id", "line", "s", "e", "owner").collect()] == [None]
    assert resolve.innermost_interval(p.limit(0), i, "file", "point_id", "line", "s", "e", "owner").collect() == []
