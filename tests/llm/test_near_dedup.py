import random
import re

import pytest

import corpus_pipeline
from tessera.llm import line_dedup, near_dedup
from tests.llm.test_simhash import plain_components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept(rows):
    """(doc_id, text) of one row of each component, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    linked = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0]
    root = plain_components(range(len(rows)), linked)
    return {min(d for k, (d, _) in enumerate(rows) if root[k] == r) for r in set(root.values())}


@pytest.mark.parametrize("tile", [20_000, 20])
def test_word_edits_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE", tile)  # 20: shingles of the group are cut into tiles
    monkeypatch.setattr(line_dedup, "COMMON", 57 if tile > 20 else 17)
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 40, 200, 600]))]
        for _ in range(12 if g else 60):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 20))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == kept(rows)


def test_documents(docs, doc_rows, odd, none):
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept(doc_rows)
    got = [(r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(odd).collect()]
    assert len(got) == len(set(got)) and (None, "a text without an id") in got and sum(d == 7 for d, _ in got) == 1 and all(d not in (3, 4, 11) for d, _ in got)
    assert near_dedup.drop_near_duplicates(none).count() == 0


def test_fingerprints_do_their_part(spark, monkeypatch):
    """Near copies meet by their fingerprints before any prefix is joined; what fingerprints link without likeness stays apart."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(500)]
    rows = [(n, " ".join([*base[:at], f"x{n}", *base[at:]])) for n, at in enumerate(range(0, 500, 50))]
    rows += [(100 + n, " ".join(f"y{n}z{k}" for k in range(30))) for n in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    linked = []
    whole = near_dedup.line_dedup.similar
    monkeypatch.setattr(near_dedup.line_dedup, "similar", lambda *args: linked.append(whole(*args)) or linked[-1])
    got = {r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, df, "").collect()}
    assert got == kept(rows) == {0, *range(100, 120)}
    assert linked[0].count() >= 5  # the links of fingerprints, checked
    monkeypatch.setattr(near_dedup.simhash, "fingerprint", lambda text, width: 0)
    assert {r["doc_id"] for r in near_dedup.drop_near_duplicates(df).collect()} == kept(rows)
