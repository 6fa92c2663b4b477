import pandas as pd
import pytest

CLASHING = "score int, size string, fp string, component string, copies int, row int, bucket int, held_out string, key string, _size int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, extra columns with clashing names."""
    words = "The quick brown fox jumps over the lazy dog near a river bank while it rains."
    long = " ".join(f"word{k % 997}" for k in range(60_000))
    rows = [
        (1, words, "en", "a"), (2, words, "en", "a"), (2, words, "en", "a"), (3, None, None, None), (None, words, "en", "b"), (None, None, None, None), (4, "", "de", "b"), (5, "  \n\t ", "fr", None),
        (6, long, "en", "a"), (7, "x" * 100_000, "en", "c"), (8, "Ä\U0001f600 ß\x00 z", "de", "c"), (9, "one", "en", "d"), (10, words + " Then it stops.", "en", "b"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *([None] * 10)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(sf) -> pd.DataFrame:
    return pd.read_parquet(f"{sf}/documents.parquet")
