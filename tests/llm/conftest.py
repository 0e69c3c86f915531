import pytest
from pyspark.sql import types as T

#: documents with an extra column whose name the operators use themselves
DOCS = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("lang", T.StringType()).add("score", T.StringType()).add("row", T.StringType())


@pytest.fixture
def docs(spark):
    def make(*rows):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a b c"), (None, None), (7, "lorem ipsum " * 20_000), (8, "é" * 5000), (9, "1234 " * 3000), (10, "a@b.c +1 (555) 123-4567")]
