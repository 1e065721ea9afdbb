import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, g long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
    base = "the quick brown fox jumps over the lazy dog and then rests by the river until evening comes"
    rows = [(1, base), (2, base), (2, base), (3, ""), (4, None), (5, "  \n\t "), (6, long), (7, long + " tail"), (None, base), (8, "ünïcödé straße " * 30), (9, "a"), (10, "a b"), (11, base + "!")]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None if t is None else len(t), 0.5, "x", 7) for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
