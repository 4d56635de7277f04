import pytest
from pyspark.sql import functions as F

#: Nulls, empty and blank texts, ties, repeated rows, odd characters, a long text; columns with clashing names.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again in the sun", "en", "a"), (2, "the quick  brown fox jumps over the lazy dog again and again in the sun", "en", "a"),
    (3, None, None, None), (4, "", "en", "b"), (5, " \t\n", "de", "b"), (6, "x", "de", None), (7, "x", "de", None), (7, "x", "de", None), (8, "The quick\nbrown fox jumps over the lazy dog again and again in the sun", "fr", "c"),
    (9, "word " * 5000 + "end", "en", "a"), (10, "é ß ñ 中文 \U0001f600 don't  12345 x <|endoftext|>", "es", "c"), (11, "a" * 9000, "en", "b"), (None, "lost id", "en", "a"), (12, "one\ntwo\none\n\n\none", "en", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).withColumn("key", F.lit(2)).withColumn("node", F.lit("x"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
