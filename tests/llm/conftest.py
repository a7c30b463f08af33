import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, more columns with names that operators use inside."""
    rows = [
        (1, "a  B c d e", "en", "x", 1, "p", 5), (2, "a b\tc d e", "en", None, None, "p", 5), (3, None, None, "y", 0, None, None), (3, None, None, "y", 0, None, None),
        (None, "q w", "de", None, 3, "f", 0), (None, None, None, None, None, None, None), (9, "", "en", "z", 0, "p", 5), (10, "...!? 123", "en", "z", 9, "p", 5),
        (11, "x" * 3000 + " é日本 \x1c <|endoftext|> don't", "fr", "z", 0, "p", 5), (12, "und so weiter " * 4000, "de", "z", 0, "p", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, file string, row long")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
