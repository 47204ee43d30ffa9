import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators might use for columns of their own
    T.StructField("fp", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()),
])


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text[, source]) rows -> a table of documents with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", None, "y", "z") for r in rows], DOCS)

    return make


#: Nulls, empty and white texts, ties, repeated rows, one long text without white space and one with.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "Lone words here and there"), (4, "Lone words HERE and there"), (4, "Lone words HERE and there"),
    (5, "x" * 60_000), (6, "un deux trois " * 5_000), (7, "é ü ß\u0085   x"), (8, "a"), (9, "É"), (10, "é"), (None, None),
]


@pytest.fixture(scope="session")
def awkward():
    return AWKWARD
