import pytest
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("kept", StringType()), StructField("rid", StringType())])


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 977} tail{i * 7 % 1013}." for i in range(9000))
    rows = [(1, "a b c", "x", None), (2, "abc", None, "y"), (3, " a\tb\nc ", "x", "y"), (3, " a\tb\nc ", "x", "y"), (4, "", None, None), (5, None, None, None), (None, "orphan text here", None, None), (6, "  \n ", None, None), (7, long, None, None), (8, long + " x", None, None), (9, long.replace(" ", ""), None, None), (10, "été 😀 <|endoftext|> don't  stop\n\n now", None, None), (None, None, None, None), (11, "aaaa" * 20000, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
