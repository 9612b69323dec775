import pytest
from pyspark.sql import functions as F

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "One two three four five, six seven eight.", "en", "a"),
        (2, "One two three four five, six seven eight.", "en", "a"),
        (3, "", "en", "a"), (4, None, "en", "b"), (5, "   \n\t ", None, "b"), (6, LONG, "en", None),
        (7, "Une phrase très courte avec des accents: été, à, ç.", "fr", "c"), (8, "x", None, None),
        (None, "No id but a text of some words here.", "de", "a"), (None, None, None, None),
        (9, "repeated row with the same id", "en", "c"), (9, "repeated row with the same id", "en", "c"),
        (10, "日本語 のテキスト です。 Ελληνικά", "ja", "b"), (11, "1234 5678 --- !!!", "en", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {n: F.lit(-1) for n in ("size", "target", "Fingerprint", "part", "id", "fp", "times", "_at", "length", "piece")}
    return docs.withColumns(extra).cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
