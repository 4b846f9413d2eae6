import pytest

ODD = [
    (1, "The cat sat on the mat and looked at the moon all night long.\nA second line here.", "en", "a", 80),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (3, "", "en", "a", 0),
    (4, "The cat sat on the mat and looked at the moon all night long.\nA second line here.", "en", "b", 80),
    (None, "no id", "en", "b", 5),
    (5, "ÀÉÎ über straße 123 !!! \x00 tab\tend", "de", "a", 30),
    (6, "%%% --- ...", "en", "b", 11),
    (7, "word " * 5000, "en", "a", 25000),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, and columns with names that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("row", "id", "kept", "node", "key", "score", "n_words", "copy_no", "w", "label")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
