import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import substring_dedup


def expected(rows, words=50):
    """(doc_id, n_words, n_removed, text) of each row, window by window."""
    order = lambda d: (1, 0) if d is None else (0, d)
    least = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - words + 1):
            key = tuple(w[i : i + words])
            least[key] = min(least.get(key, (2, 0)), order(d))
    out = Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - words + 1):
            if least[tuple(w[i : i + words])] < order(d):
                gone.update(range(i, i + words))
        out[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("group", [2000, 1])
def test_against_brute_force(odd, odd_rows, docs, doc_rows, group):
    for df, rows in ((odd, odd_rows), (docs, doc_rows)):
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(df, group=group).collect())
        assert got == expected(rows)


def test_shorter_passages(docs, doc_rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs, words=20).collect())
    assert got == expected(doc_rows, 20)


def test_few_distinct_words(spark):
    rows = [(i, " ".join("ab"[(k * k + i) % 3 % 2] for k in range(150 + i))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(df).collect()) == expected(rows)


def test_empty(none):
    assert substring_dedup.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(none, words=10)
    assert defaultdict
