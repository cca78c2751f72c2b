import pytest


@pytest.fixture
def docs(spark):
    """Rows with nulls, empty and very long texts, ties, repeats, and extra columns whose names clash with results."""
    base = "The quick brown fox jumps over the lazy dog while seven wizards mix a potion of bright blue berries and sing old songs"
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, base + " again", "en", None, None), (4, "", "en", "a", 0), (5, None, None, "b", None),
        (6, "word", "de", "b", 4), (None, base, "en", "a", 10), (7, "x" * 200_000, "en", "b", 200_000), (8, " \t\n ", "fr", "c", 4), (1, base, "en", "a", 10),
        (9, ("alpha beta gamma delta " * 3000).strip(), "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from pyspark.sql import functions as F

    return df.withColumns({"score": F.lit("clash"), "kept": F.lit("clash"), "block": F.lit(1), "cls": F.lit("clash"), "part": F.lit(2)})


@pytest.fixture
def empty(docs):
    return docs.where("1 = 0")
