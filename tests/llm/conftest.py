import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from whole rows."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "s", None if r is None else len(r)) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def table(spark):
    def read(name, sf="0.001"):
        return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")

    return read
