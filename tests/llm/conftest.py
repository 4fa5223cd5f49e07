import pytest

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated
    rows, and columns whose names clash with the operators' own."""
    long_text = " ".join(f"word{i % 977} stays{i % 13}" for i in range(60_000))
    rows = [(1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 1),
            (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 1),
            (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 1),
            (None, "One two three four five six seven eight nine ten eleven twelve.", "en", None, 2),
            (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n ", None, "b", 3), (7, long_text, "en", "c", 4),
            (8, "a b", None, "c", 5), (9, "a b", "de", "c", 5), (10, "42 7 !!", "en", "", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int").selectExpr(
        "*", "size as id", "size as n", "source as _lang", "size as _copies", "size as h", "text as _kept")
