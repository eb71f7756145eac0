import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.StringType()),  # a name that several operators give a column
    ]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "x") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions) if full else spark.createDataFrame([], DOCS)

    return make


LONG = "wörd " * 60_000

#: Null and empty texts, one of 300,000 characters, repeated rows, white space only, astral characters, a null id.
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "A"), (5, LONG), (6, "same text here"), (7, "same text here"), (7, "same text here"),
    (8, "Same Text Here"), (9, "\U0001f600 \U0001f600 é É İ"), (10, "1234 !!! ..."), (None, "no id at all"), (-3, "minus three"),
    (12, "x" * 5000), (13, " " * 9000 + "end"),
]
