import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table of documents from (doc_id, text[, lang, source]) rows, with extra columns that bear the operators' own names."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None) for r in rows]
        df = spark.createDataFrame(full, T._parse_datatype_string(DOCUMENTS)).repartition(partitions)
        return df.select("*", *(F.lit("extra").alias(c) for c in ("size", "key", "id", "a", "b", "src", "score", "n_tokens", "hash", "spans")))

    return build


# Null, empty, blank, one word, ties, repeated rows, no letters, a long text.
ODD_ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (5, "word"), (None, "no id at all"), (7, "12 34 !!"),
    (8, "many words again and again " * 4000), (9, "x" * 20_000), (10, "é ß 漢字 \U0001f600 end"), (11, "null source", None, None),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD_ROWS)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([]).limit(0)
