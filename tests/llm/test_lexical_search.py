import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import common, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 75 + (75 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def check(spark, docs, items, k=10):
    df = spark.createDataFrame([(d, t, 1.5, "x") for d, t in docs], "doc_id long, text string, n double, score string").repartition(4)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in lexical_search.search(df, asked, k).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == brute(docs, items, k)


ITEMS = [(1, "alpha BETA gamma"), (2, None), (3, ""), (4, "... !"), (5, "nowhere"), (6, "four five six seven eight nine one one one"), (7, "w5 w9 w16 w225"), (None, "naïve café 12"), (8, "text text an id"), (1, "tail of five")]


def test_odd_rows(spark, odd_rows):
    check(spark, odd_rows, ITEMS)
    check(spark, odd_rows, ITEMS, k=1)


def test_none(spark, odd_rows):
    check(spark, [], ITEMS)
    check(spark, odd_rows, [])
    check(spark, [(1, None), (2, " - ")], ITEMS)


def test_many_shards_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 900)
    monkeypatch.setattr(lexical_search, "CHUNK", 3)
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)]
    docs = [(rng.randrange(10**6) * rng.choice([-1, 1]), " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randrange(1, 30)))) for _ in range(500)]
    docs += [(i, docs[3][1]) for i in range(10**6, 10**6 + 300)]  # copies: ties
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(20)] + [(20, docs[3][1])]
    check(spark, docs, items)


def test_tree_takes_best_nodes_first(monkeypatch):
    """With one node at a time a search opens few nodes, and finds what brute force finds."""
    monkeypatch.setattr(lexical_search, "STEP", 1)
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefgh", [8, 4, 2, 2, 1, 1, 1, 1], k=rng.randrange(1, 40))) for _ in range(700)]
    buf, offsets = common.byte_buffer(pa.array(texts))
    ids = np.array(rng.sample(range(5000), 700))
    total = sum(len(t.split()) for t in texts)
    row = lexical_search.shard(ids, buf, offsets, 700, total)
    part = pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row.values()], list(row))
    tree = lexical_search.Tree(part, 0)
    opened = []
    ones = tree.ones
    monkeypatch.setattr(tree, "ones", lambda level, at: opened.append(len(level)) or ones(level, at))
    words = lexical_search.vocabulary_of(part, 0).to_pylist()
    starts = np.frombuffer(row["starts"], "<i8")
    df = Counter(w for t in texts for w in set(t.split()))
    wanted = [words.index(w.encode()) for w in "ach"]
    weights = np.array([lexical_search.weight(700, df[w]) for w in "ach"])
    ranking = lexical_search.Ranking(5)
    tree.search(starts[wanted], starts[np.array(wanted) + 1], weights, ranking)
    assert [(1, r + 1, d, -s) for r, (s, d) in enumerate(ranking.hits)] == brute(list(zip(ids.tolist(), texts, strict=True)), [(1, "a c h")], 5)
    assert sum(opened) / 2 < 400


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(2)
    docs = rng.integers(0, 37, 300)
    bits = lexical_search.matrix_bits(docs, lexical_search.levels_for(37))
    got = np.unpackbits(bits[0].view(np.uint8), bitorder="little")
    assert bits.shape == (6, 5) and (got[:300] == docs >> 5).all() and not got[300:].any()


def test_documents(spark, docs, doc_rows, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = [tuple(r) for r in lexical_search.search(docs, items).collect()]
    assert sorted(got, key=repr) == brute(doc_rows, [(r["item_id"], r["text"]) for r in items.collect()])
