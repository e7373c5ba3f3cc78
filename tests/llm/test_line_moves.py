import numpy as np

from tessera.llm import common, line_dedup
from tests.llm.test_line_dedup import expected, found


def test_lines_are_stored_once(spark, monkeypatch):
    tables, whole = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, *args: tables.append(whole(df, *args)) or tables[-1])
    monkeypatch.setattr(common, "BUCKET_ROWS", 7)  # several buckets, and several rounds of a task
    rows = [(i, f"one very common line\nline {i // 2} of a few words more\nx") for i in range(30)] + [(3, "x\nx"), (3, "x\nx"), (None, "X")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected(rows)
    assert sum("prefix" in t.columns for t in tables) == 1  # all lines, then the distinct ones once more, before


def test_a_common_line_is_sent_once():
    rows = np.zeros(1000, line_dedup.LINE)
    rows["key"], rows["k_id"], rows["size"] = 5, np.arange(1000)[::-1], 6
    tokens = np.arange(3000, dtype=np.uint64)[: int(line_dedup.line_prefix(rows["size"]).sum())]
    sent = line_dedup.dealt_lines(rows, tokens, 50)
    own = np.concatenate([np.frombuffer(x.as_py(), line_dedup.LINE) for x in sent["data"]])
    assert len(own) == 1000 and own["k_id"][own["size"] > 0].tolist() == [0]
    assert sum(len(x.as_py()) for x in sent["prefix"]) == 8 * int(line_dedup.line_prefix(np.array([6]))[0])


def test_words_at_the_edges_of_rows():
    texts = ["", "ab c", "d", "", " e\n", "f"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, first = common.word_spans(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    assert ["".join(texts)[a:b] for a, b in zip(starts, ends, strict=True)] == ["ab", "c", "d", "e", "f"]
    assert first.tolist() == [0, 0, 2, 3, 3, 4, 5]
