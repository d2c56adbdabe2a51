import pytest

COLS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def ugly(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like internal ones."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a", 5),
        (1, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a", 5),  # repeated row
        (2, "the cat sat on the mat and the dog lay by the door of the old house", "en", "b", None),
        (3, "The cat sat on the mat and the dog lay by the door of the old house.", None, None, 5),
        (4, None, "en", "a", 0), (5, "", None, "a", 0), (5, "", None, "a", 0), (6, " \n\t ", "en", "a", 3), (7, "12 34 !!", "en", "a", 8),
        (None, "a row without an id, alone in its text", "en", "a", 1), (None, None, None, None, None),
        (8, long, "en", "a", 1), (9, long, "fr", "a", 1), (10, long + " end", "en", "a", 1),
        (11, "one", "en", "a", 3), (12, "One", "en", "a", 3), (13, "one  two", "de", "a", 8), (14, "élan vital über straße \x85 日本語 😀", "fr", "a", 9),
    ]
    df = spark.createDataFrame(rows, COLS)
    from pyspark.sql import functions as F

    extra = {c: F.lit(c) for c in ("row_key", "key", "h", "n", "filter_word", "filter_bits", "filter_key", "is_hot", "size", "maybe", "lang_pred", "score", "bands", "item_id", "c0")}
    return df.withColumns(extra).withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLS)
