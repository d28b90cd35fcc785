import uuid

import pytest
from pyspark.sql import types as T
from texts import awkward

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("node", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("k", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("length", T.StringType()),
])


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables to a folder like the driver's and returns its path."""

    def write(**tables) -> str:
        at = tmp_path / uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return write


@pytest.fixture
def documents(spark):
    def make(rows=None):
        return spark.createDataFrame(awkward() if rows is None else rows, DOCS)

    return make
