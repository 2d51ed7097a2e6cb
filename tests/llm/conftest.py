import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i // 3) % 15] + str(seed * i % 11) for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, equal and near texts."""
    base = sentence(3, 60)
    passage = sentence(9, 40)
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, base + " one more", "en", "b"),
        (3, None, None, None), (4, "", "en", None), (5, " \t\n ", "en", "b"), (6, "word", "en", "c"),
        (7, "word", "de", "c"), (8, sentence(5, 4000), "en", "c"), (9, "x" * 5000, "en", "d"),
        (10, sentence(11, 30) + " " + passage, "en", "d"), (11, passage + " " + sentence(12, 30), "en", "a"),
        (12, "naïve 漢字 😀 café " * 12, "fr", "b"), (13, "naïve 漢字 😀 café " * 12, "fr", "b"),
        (14, "a  b\n\n c\x0b d\x1ce f", "xx", "b"), (50, sentence(20, 25), "en", "a"),
        (100, base, "en", "a"), (100, base, "en", "a"), (None, sentence(21, 30), "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with extra columns whose names operators use inside."""
    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string")
    extra = "size shard ids score gram copy signature set_id n start term found toxic copies weight".split()
    return df.selectExpr("*", "length(text) AS n_chars", *[f"'x' AS `{c}`" for c in extra]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("doc_id < -1")
