import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "very long text with words " * 20000
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, None),
        (4, "one", "en", "a", 3),
        (5, "One", "en", "b", 3),
        (6, "a b c d e f g h i j k", "en", "b", 10),
        (7, "a b c d e f g h i j k", "fr", "b", 10),
        (7, "a b c d e f g h i j k", "fr", "b", 10),
        (8, long, "en", "a", len(long)),
        (9, long + "end", "en", "a", len(long)),
        (None, "no id at all", "en", None, 5),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as component", "2 as id", "'x' as line", "3 as n", "4 as pos", "'y' as key", "5 as rep", "6 as _id", "7 as score", "8 as words")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table_dir(tmp_path_factory):
    """Write a frame as the documents table of a folder of its own."""

    def make(df, name="documents"):
        at = tmp_path_factory.mktemp("tables")
        df.write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return make
