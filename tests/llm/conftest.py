import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, an empty and a very long text, repeated rows, and a clashing extra column."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    rows = [
        (None, None, None, None, None), (None, "some words without an identifier here today", "en", "s", 1), (1, "", "en", None, 0), (2, "   \n", None, "s", 3), (3, long, "en", "s", len(long)),
        (4, "the same few words of a text that is here twice in a row", "en", "s", 5), (4, "the same few words of a text that is here twice in a row", "en", "s", 5),
        (5, "the same few words of a text that is here twice in a row", "fr", "t", 5), (-9, "!!! ??? 123", "en", "t", 9), (9_000_000_000, "ñandú été über 日本", None, "t", 9),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.withColumn("score", df["n_chars"] * 2).withColumn("size", df["n_chars"])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
