import pytest
from pyspark.sql import functions as F

LONG = "wort " * 60_000

#: Nulls, empty and very long texts, ties, repeated rows and ids.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "src1"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "src1"),
    (2, "the QUICK brown fox jumps over the lazy dog near the old river bank today", "en", "src2"),
    (2, "another text altogether, with its own words and nothing of the others in it", None, "src2"),
    (3, None, "en", None),
    (4, "", "de", "src1"),
    (None, "a row without an id and without a friend in the world of tables", "fr", "src3"),
    (None, None, None, None),
    (5, " \t\n\r\x0b\x0c ", "de", "src1"),
    (6, LONG, "de", "src1"),
    (7, "x", "en", "src10"),
    (8, "ünïcödé   wörds \U0001f600 here", "xx", "src1"),
]


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents of all odd kinds, with further columns whose names operators use inside."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("key", "h", "n", "score", "label", "fp", "root", "found", "count", "quota", "digest", "added", "chunk", "path", "license", "mix_epoch"):
        docs = docs.withColumn(name, F.lit(name))
    return docs.cache()


@pytest.fixture(scope="session")
def nothing(hostile):
    return hostile.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").cache()
