import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) tuples; missing ones are NULL."""

    def make(*rows, **extra):
        full = [(*row, *[None] * (4 - len(row)), None) for row in rows]
        names = list(extra)
        schema = T.StructType([*DOCUMENT, *[T.StructField(n, T.StringType()) for n in names]])
        return spark.createDataFrame([row + tuple(extra[n] for n in names) for row in full], schema)

    return make


@pytest.fixture(scope="session")
def given_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(given_docs):
    return {row.doc_id: row.text for row in given_docs.select("doc_id", "text").collect()}
