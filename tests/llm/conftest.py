import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
#: Names that operators use inside, as columns of the documents.
CLASHING = ["uid", "id", "key", "label", "pos", "line", "content", "tokens", "n", "hash", "path", "host", "kind", "count", "_id", "part", "u", "v", "score", "bucket"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} token: s{i:012d}x" for i in range(30_000))
    rows = [
        (1, None, "en", "src1"), (2, "", None, "src1"), (3, "one two three", "en", None), (4, "one two three", "en", "src2"), (5, long_text, "en", "src2"),
        (6, "same row again and again", "en", "src3"), (6, "same row again and again", "en", "src3"), (7, "an id of two texts, here the first", "en", "src3"), (7, "and here the second of them, quite other words", "en", "src3"),
        (None, "a row without an id", None, None), (8, "tabs\tand\r\nends \x85   und Ümläute 語 \U0001f600 İΣ's <|endoftext|>", "de", "src4"), (9, "   \n\n  ", "en", "src4"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
