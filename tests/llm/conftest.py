import pytest


@pytest.fixture(scope="module")
def sf_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, a clashing extra column.
HARD_TEXTS = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\n ", None), (4, "One two three four five", "b"), (4, "One two three four five", "b"),
    (4, "another text under the same id", "b"), (None, "a text without an id that is long enough", "b"), (5, "x " * 60_000, ""), (6, "é" * 20_000, "a"), (7, "Word", None),
]


@pytest.fixture(scope="module")
def hard_docs(spark):
    rows = [(i, t, s, "en", 99, "row") for i, t, s in HARD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score string")
