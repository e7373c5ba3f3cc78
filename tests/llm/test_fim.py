import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, rate=50, spm_rate=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in fim.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def rows_of(df, **kw):
    cut = fim.fill_in_middle(df, **kw)
    return cut.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()


def check(df, rows, **kw):
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows_of(df, **kw)), key=repr)
    assert got == sorted(((d, *plain(d, t, **kw)) for d, t in rows), key=repr)


def test_odd_rows(odd, odd_rows):
    check(odd, odd_rows)
    check(odd, odd_rows, rate=100, spm_rate=0, seed=7)
    check(odd, odd_rows, rate=100, spm_rate=100)


def test_round_trip_of_random_texts(spark):
    rng = random.Random(1)
    alphabet = ["<", "P", "S", "M", ">", " ", "\n", " ", "é", "𝒳", "a", "\x0b", "<P", "S>"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows, rate=100)
    found = {r["doc_id"]: r for r in rows_of(df, rate=100)}
    assert {r["form"] for r in found.values()} == {"plain", "psm", "spm"}
    for i, text in rows:
        r = found[i]
        assert r["back"]["text"] == text and r["back"]["sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()


def test_documents(docs, doc_rows):
    check(docs, doc_rows)


def test_long_white_space_and_one_word(spark):
    rows = [(1, " " * 200_000), (2, "x" * 200_000), (4, " " * 100_000 + "y" + "\t" * 100_000), (8, "<P> is here")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, rate=100)


def test_empty(none):
    assert rows_of(none) == []


@pytest.mark.parametrize("marks", [("a", "a", "b"), ("<P>", "<S>", ""), ("ab", "bc", "d"), ("aa", "b", "c"), ("abc", "b", "x")])
def test_sentinels_that_could_be_misread(none, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(none, marks=marks)


def test_other_sentinels(spark):
    df = spark.createDataFrame([(i, f"one {i} two\nthree four") for i in range(40)], "doc_id long, text string")
    marks = ("|pre|"[:-1] + ")", "{suf}", "[mid]")
    cut = fim.fill_in_middle(df, rate=100, marks=marks)
    assert {r["t"] for r in cut.select(fim.restored(F.col("output"), F.col("form"), marks)["text"].alias("t")).collect()} == {f"one {i} two\nthree four" for i in range(40)}
