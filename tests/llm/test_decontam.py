import numpy as np
import pytest

from tessera.llm import common, decontam


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "A train leaves Paris at 90 km per hour and another leaves Rome at 120 km per hour when do they meet"),
        (2, "Anna has 12 apples and gives 5 apples to Bob so how many apples are left with her now"),
        (3, None),
        (4, ""),
        (5, "four words are here"),
        (6, "too short"),
        (2, "Anna has 12 apples and gives 5 apples to Bob so how many apples are left with her now"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def flagged(docs, items):
    return {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(decontam.contamination(docs, items)).collect()}


def test_exact_and_with_other_values(spark, items):
    rows = [
        (1, "Intro. A train leaves Paris at 90 km per hour and another leaves Rome at 120 km per hour when do they meet. End"),
        (2, "A train leaves Paris at 75 km per hour and another leaves Rome at 80 km per hour when do they meet?"),
        (3, "Anna has 31 apples and gives 7 apples to Bob so how many apples are left with her now"),
        (4, "a train of thought leaves nobody at rest and another hour goes by"),
        (5, "see: four words are here, no more"),
        (6, "too short"),
        (7, None),
        (None, "Anna has 12 apples and gives 5 apples to Bob so how many apples are left with her now"),
        (8, "Anna has 12 pears and sells 5 plums to Bob so how many cherries are eaten with her now"),
    ]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    assert flagged(docs, items) == {(1, 1), (2, 1), (3, 2), (5, 5), (6, 6), (None, 2)}
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 7, 8}


def test_slots_must_be_consistent(spark):
    items = spark.createDataFrame([(1, "take 4 from it then add 4 to it then halve 4 of it then keep 4 for it")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "take 9 from it then add 9 to it then halve 9 of it then keep 9 for it"), (2, "take 1 from it then add 2 to it then halve 3 of it then keep 8 for it")], "doc_id long, text string")
    assert flagged(docs, items) == {(1, 1)}


def test_passages_of_the_benchmark(docs, doc_rows, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = flagged(docs, bench)
    assert got == {(d, i) for d, t in doc_rows for i, x in texts if x in t}


def test_empty(none, items, odd):
    assert flagged(none, items) == set() and flagged(odd, items.where("item_id = 6")) == set()
    assert decontam.drop_contaminated(odd, items.limit(0)).count() == odd.count()


def kinds(words):
    named = {common.mixed(np.array([h]))[0]: k for h, k in ((decontam._NUMBER, "n"), (decontam._UNIT, "u"), (decontam._NAME, "N"))}
    return "".join(named.get(t, ".") for t in words.token)


def parsed(*texts):
    data = [t.encode() for t in texts]
    return decontam.Parsed(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_template():
    p = parsed("Pay 3,50 dollars to Mary Ann. Then 5km and x2 in 7 or twenty-five")
    assert kinds(p.form(False)) == ".nu.N.nu...n.n"  # Pay 3,50 dollars to Mary-Ann Then 5 km and x2 in 7 or 25
    assert kinds(p.form(True)) == "Nnu.NNnu...n.n"
    for words in (p.form(False), p.form(True)):
        assert ((words.slot == 0) == (np.array(list(kinds(words))) == ".")).all() and words.first.tolist() == [0, 14]
    assert p.form(False).place.tolist() == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14]


def test_values_of_numbers():
    slots = lambda t: [x for x in parsed(t).form(False).slot.tolist() if x]
    assert slots("pay 25 now") == slots("pay twenty-five now") == slots("pay Twenty five now") and slots("pay 25 now") != slots("pay 52 now")
    assert decontam.number_of([2, 100, 25, 1000, 3]) == 225_003
    assert slots("to Mary Ann") != slots("to Ann Mary") and slots("x\nfive\nsix") != slots("x 11")


def test_rows_do_not_touch():
    both = parsed("pay 5", ".5 now").form(False)
    assert both.first.tolist() == [0, 2, 4]
    assert (both.token == np.concatenate([parsed(x).form(False).token for x in ("pay 5", ".5 now")])).all()
    assert parsed("", "").form(True).first.tolist() == [0, 0, 0] and len(parsed("").plain().token) == 0
