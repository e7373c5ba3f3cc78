import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon".split()
PASSAGE = " ".join(f"{WORDS[i % 20]}{i % 7}" for i in range(60))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) with nulls, empty and long texts, repeated rows, a repeated id with another text, ties, shared passages."""
    long_text = " ".join(f"w{i * i % 977}" for i in range(30_000))
    return [
        (1, "one Two three\nfour five six seven eight nine"),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, PASSAGE + " tail of five"),
        (6, "head of six " + PASSAGE),
        (6, "another text under the id six " + PASSAGE),
        (7, long_text),
        (7, long_text),
        (None, PASSAGE),
        (None, "a text without an id"),
        (8, "Ünïcödé wörds — naïve café 12,5 km"),
        (9, "one two three\nfour five six seven eight NINE"),
        (10, "one two three\nfour five six seven eight ten nine"),
        (11, long_text),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names clash with the operators' own."""
    rows = [(d, t, "TEXT", 1, "k", 0.5) for d, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, row_hash string, c0 int, key string, component_id double").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
