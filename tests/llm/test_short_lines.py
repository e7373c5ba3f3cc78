import hashlib
import random

import corpus_pipeline
from tessera.llm import queries
from tests.llm.test_line_dedup import token_set


def removed(rows):
    """Numbers of the lines of each doc_id that an earlier line resembles, by all pairs of lines with a word."""
    first, out = {}, {}
    for d, t in sorted(rows):
        for k, line in enumerate(t.split("\n")):
            if s := token_set(line):
                first.setdefault(s, (d, k))
    sets = list(first)
    near = {y for i, y in enumerate(sets) if any(5 * len(x & y) >= 4 * len(x | y) for x in sets[:i])}
    for d, t in rows:
        out[d] = [k for k, line in enumerate(t.split("\n")) if (s := token_set(line)) and (s in near or first[s] != (d, k))]
    return out


def test_lines_of_any_length(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, "\n".join(" ".join(rng.sample(words, rng.randrange(0, 7))) for _ in range(6))) for i in range(40)]
    rows += [(100, "Read more\none two three four"), (101, "READ more\none two three four five\n\n"), (102, "more read\nfooter\nfooter")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = removed(rows)
    assert want[101] == [0, 1] and want[102] == [0, 2]
    kept = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]) for d, t in rows}
    got = {r["doc_id"]: (r["removed"], r["kept_sha256"]) for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (want[d], hashlib.sha256(kept[d].encode()).hexdigest()) for d, _ in rows}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.distinct_lines(spark, df, "").collect()} == kept
