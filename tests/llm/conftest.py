import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and repeated rows, ties, a long text, extra columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    same = " ".join(f"k{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, "   \n\n"), (4, same), (5, same), (5, same), (None, same), (None, None), (6, long), (7, "w1 x \x1c y\n" + same), (8, "!!! ??"), (9, "one"), (10, "one")]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", "x", "y", 1) for i, t in rows], "doc_id long, text string, lang string, source string, id string, word string, n int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
