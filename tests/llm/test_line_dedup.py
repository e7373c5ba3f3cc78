import random
import re
from collections import Counter

import pytest
import xxhash

from tessera.llm import line_dedup


def token_set(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def expected(rows):
    """(doc_id, n_lines, removed, text) of each row, by all pairs of distinct lines; rows that repeat an id are told apart by their texts' hashes."""

    def place(d, k, t):
        return (1 << 63) - 1 if d is None else d, k, (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)

    first = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if s := token_set(line):
                first[s] = min(first.get(s, (1 << 63, 0, 0)), place(d, k, t))
    sets = sorted(first, key=first.get)
    near = {y for i, y in enumerate(sets) if any(5 * len(x & y) >= 4 * len(x | y) for x in sets[:i])}
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = tuple(k for k, line in enumerate(lines) if (s := token_set(line)) in first and (s in near or first[s] != place(d, k, t)))
        out[d, len(lines) if t else 0, gone, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)] += 1
    return out


def found(df):
    return Counter((r["doc_id"], r["n_lines"], tuple(r["removed"]), r["text"]) for r in line_dedup.without_repeats(df).collect())


def test_against_brute_force(odd, odd_rows, docs, doc_rows):
    assert found(odd) == expected(odd_rows)
    assert found(docs) == expected(doc_rows)


@pytest.mark.parametrize("tiles", [True, False])
@pytest.mark.parametrize("small", [64, 1])
def test_variants_of_a_line(spark, small, tiles, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "TILE", 20)
    monkeypatch.setattr(line_dedup, "COMMON", 17 if tiles else 57)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        line = rng.sample(words[:14], 11) if i % 3 else rng.sample(words, rng.randrange(3, 13))
        rows.append((i, " ".join(line) + "\nshort line\n" + " ".join(line[:6]).upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == expected(rows)


def test_repeated_rows_and_ids(spark):
    text = "a b c d e f\nother words of some line here"
    rows = [(1, text), (1, text), (1, "a b c d e f"), (2, text), (2, "x\n" + text)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(n for (d, _, gone, _), n in got.items() if d == 2 and gone) == 2
    assert sum(n for (d, *_), n in got.items() if d == 1) == 3


def test_columns_stay(docs, odd, none):
    out = line_dedup.dedup_lines(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert out.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
    assert line_dedup.dedup_lines(odd).columns == odd.columns
    assert line_dedup.dedup_lines(none).count() == 0 and found(none) == Counter()
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert got == {(r["doc_id"], r["text"]) for r in line_dedup.without_repeats(docs).collect()}
