import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def documents(spark):
    """rows of (doc_id, text) -> a documents table, over three partitions."""

    def make(rows, parts=3):
        return spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in rows], DOCUMENTS).repartition(parts)

    return make


#: A null text, empty and blank texts, a very long one, equal rows, odd white space and letters.
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "word " * 6000), (5, "a b c d e"), (5, "a b c d e"), (None, "no id"), (7, "x\x1fy z  Ünï <|endoftext|> 東京\r\n"), (8, "a")]


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture(scope="session")
def corpus():
    """The texts of the smallest test data, with ids."""
    import pandas as pd

    table = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    return list(zip(table.doc_id.tolist(), table.text.tolist()))
