from tessera.llm import decontam
from tests.llm.test_decontam import flagged


def test_each_placement_counts_by_itself(spark):
    items = spark.createDataFrame([(1, "a farmer has 12 cows and buys 7 more cows so how many cows are there in the barn now")], "item_id long, text string")
    copy = "a farmer has {} cows and buys {} more cows so how many cows are there in the barn now".format
    rows = [
        (1, copy(31, 5) + ". " + copy(44, 9)),
        (2, copy(31, 5) + " text between them. " + "the farmer has 8 cows and buys 2 more cows so they go home"),
        (3, "they say a farmer has 31 cows and buys 5 more goats"),
        (4, "x " * 5000 + copy(1, 2) + " y" * 5000 + copy(3, 4)),
        (5, copy(31, 5)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert flagged(docs, items) == {(1, 1), (2, 1), (4, 1), (5, 1)}


def test_items_dense_in_values_are_found(spark):
    rows = [(1, "Solve 3x + 4 = 10"), (2, "Compute 12 + 7 - 5 + 9"), (3, "add 5 6 7 8 9 10 to 11 12 13 14 then stop"), (4, "1 2 3 4 5 6 7")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = [(d, f"Homework of today. {t}. Thanks") for d, t in rows]
    docs += [(11, "so solve 3x + 4 = 10 at home"), (12, "Compute 12 + 7 - 5 + 8"), (13, "add 1 2 3 4 5 6 to 7 8 9 20 then stop"), (14, "1 2 3 4 5 6 8"), (15, "add 5 6 then stop")]
    got = flagged(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (11, 1), (13, 3)}
    assert decontam.LITERALS == 3
