import pytest

TEXTS = [None, "", "   ", "\n\n", "a", "é ß Ü", "word " * 3000, "same text here", "same text here", "Same Text Here", "x" * 20000]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, a repeated row, and columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "h", 1.5, [1]) for i, t in enumerate(TEXTS)] + [(7, "same text here", None, "h", 1.5, [1]), (None, "no id", "en", "h", 1.5, [1])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, h string, score double, items array<int>")


@pytest.fixture
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
