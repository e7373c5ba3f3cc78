import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.queries import op4_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, rejected = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 150 and right / n > 0.97 and rejected / n < 0.02


def test_held_out_rows(spark):
    import zlib

    got = spark.range(300).select("id", langid.train_held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_odd_rows(docs, odd, odd_rows, none):
    model = langid.train(docs)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert 0 <= r["score"] <= 1
    blank = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {2, 3, 4} <= blank and 8 not in blank
    assert langid.predict(none, model).count() == 0
    assert langid.keep_identified(odd, model).columns == odd.columns
    rejected = {r["doc_id"] for r in got if r["rejected"]} | {None}
    assert {2, 3, 4} <= rejected and {r["doc_id"] for r in langid.keep_identified(odd, model).collect()} | {None} == {d for d, _ in odd_rows} - rejected | {None}
    twice = docs.where("doc_id = 1").union(docs.where("doc_id = 1"))
    assert langid.keep_identified(twice, model).count() == 2


def test_no_labels(docs, spark):
    model = langid.train(docs.where("lang is null"))
    got = langid.predict(docs, model).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, True)}
    one = langid.train(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(docs, one).collect()} == {"en"}


def test_subwords_stay_in_words():
    assert len(langid.subwords(langid.letters("12 34"))) == 0
    assert len(langid.subwords(langid.letters("ab"))) == 2 + 3 + 2 + 1  # a b, _a ab b_, _ab ab_, _ab_


def test_long_texts_are_read_whole(docs):
    model = langid.train(docs)
    assert model.predict("the of and " * 100_000)[0] == model.predict("the of and " * 10)[0]
    at, n = langid.features("ab " * 200_000)
    assert n.sum() >= 200_000 * 8


FOREIGN = [
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van, az emberek ésszel és lelkiismerettel bírván egymással szemben testvéri szellemben kell hogy viseltessenek",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
    "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
    "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である",
]


def test_rejection(spark):
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.train_held_out(F.col("doc_id"))))
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzyaeiou") for _ in range(rng.randrange(2, 12))) for _ in range(n)) for n in (20, 60, 300)]
    for text in FOREIGN + noise:
        assert model.predict(text)[2], text[:30]
    one = langid.train(docs.where("lang = 'en'"))
    assert all(one.predict(t)[2] for t in FOREIGN + noise)
    n, kept = docs.count(), langid.keep_identified(docs, model).count()
    assert kept >= 0.995 * n


def test_many_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"l{a}{b}", " ".join(f"{x}{a}{y}{b}" for x in letters[k::5] for y in letters[k::7])) for a in letters[:15] for b in letters[:15] for k in range(4)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.train(df, epochs=12)
    assert len(model.languages) == len(model.familiar) == 225 and model.table.shape[1] == 16
    assert np.isfinite(model.floors).all()  # every language rejects, though most have a single calibration row
    assert sum(model.predict(t)[0] == lang for lang, t in rows) > 0.8 * len(rows)


def plain_prediction(model, text):
    """A prediction done again, subword by subword, from the model's arrays."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    pieces = Counter()
    for w in words:
        edged = " " + w + " "
        for n in range(1, 5):
            for i in range(len(edged) - n + 1):
                piece = edged[i : i + n]
                if piece != " " and " " not in piece[1:-1] and piece != "  ":
                    h = 0
                    for k, c in enumerate(piece, 1):
                        h = (h * 0x100000001B3 + ord(c) + k) % 2**64
                    pieces[((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> 49] += 1
    n = sum(pieces.values())
    if not n:
        return "und", 0.0, True
    mean = [sum(c * float(model.table[b, j]) for b, c in pieces.items()) / n for j in range(model.table.shape[1])]
    logits = [(sum(m * float(model.output[j, k]) for j, m in enumerate(mean)) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
    top = max(logits)
    shares = [math.exp(x - top) for x in logits]
    best = max(range(len(shares)), key=shares.__getitem__)
    buckets, logs, otherwise = model.familiar[best]
    known = dict(zip(buckets.tolist(), logs.tolist(), strict=True))
    seen = sum(c * known.get(b, otherwise) for b, c in pieces.items()) / n
    at = min(max(math.log(n), math.log(langid.LENGTHS[0])), math.log(langid.LENGTHS[-1]))
    k = max(i for i, x in enumerate(langid.LENGTHS[:-1]) if math.log(x) <= at)
    lo, hi = math.log(langid.LENGTHS[k]), math.log(langid.LENGTHS[k + 1])
    floor = model.floors[best][k] + (model.floors[best][k + 1] - model.floors[best][k]) * (at - lo) / (hi - lo)
    return model.languages[best], shares[best] / sum(shares), seen < floor


def test_predictions_against_brute_force(docs, odd, odd_rows, doc_rows):
    model = langid.train(docs.where(~langid.train_held_out(F.col("doc_id"))))
    for df, rows in ((odd, odd_rows), (docs, [r for r in doc_rows if len(r[1] or "") < 3000])):
        got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6), r["rejected"]) for r in langid.predict(df, model).collect())
        for d, t in rows:
            lang, score, rejected = plain_prediction(model, t)
            assert got[d, lang, round(score, 6), rejected] > 0, (d, lang, score)


def test_all_subwords_of_a_sampled_text_count(spark):
    """What stands at the end of a long text is learned too."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    start = " ".join(a + b + c for a in letters for b in letters for c in letters[:8])
    rows = [("x", f"{start} {'ωψχ φυτ ' * 3}{i * 'ω'}") for i in range(6)] + [("y", f"{start} {'жщш эюя ' * 3}{i * 'ж'}") for i in range(6)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), epochs=1)
    for language, word in enumerate(("ωψχ", "жщш")):
        assert set(langid.features(word)[0].tolist()) <= set(model.familiar[language][0].tolist())


def test_repeated_rows_and_ties(docs, spark):
    once = docs.select("lang", "text").where("lang is not null")
    one, two = langid.train(once), langid.train(once.union(once).repartition(7))
    assert one.languages == two.languages and one.bias == pytest.approx(two.bias) and (one.table == two.table).all()
    same = langid.train(spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string"))
    assert same.predict("same words")[0] == same.predict("same words")[0] and same.languages == ["a", "b"]
