import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_ string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and a column
    whose names could clash."""
    long = " ".join(f"word{k % 977} of{k % 13}" for k in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [
        (1, base, "en", "a", 1, "x"), (2, base, "en", "a", 1, "x"), (2, base, "en", "a", 1, "x"), (3, base + " seventeen", None, None, None, None),
        (4, None, "en", "a", 0, "x"), (5, "", "en", "a", 0, "x"), (6, " \n\t ", "en", "a", 0, "x"), (None, base, None, None, None, None), (None, None, None, None, None, None),
        (7, long, "en", "a", 1, "x"), (8, long + " end", "en", "a", 1, "x"), (9, "Hi", "en", "a", 2, "x"), (10, "hi", "en", "a", 2, "x"), (11, "été\u0000 中文 😀 <|im_end|>", "fr", "b", 3, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
