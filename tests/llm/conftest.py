import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """Documents from texts or (doc_id, text[, lang]) tuples, over 3 partitions."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((*r, *(["en"] if len(r) == 2 else []), "s", 1))
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture
def odd(make_docs):
    """Null and empty texts, a null id, a repeated row, a long text, and columns
    whose names an operator might use itself."""
    docs = make_docs([(0, None), (1, ""), (None, "word one two three"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "tick tock " * 30_000), (5, " \n\t ")])
    extra = {c: F.lit("x") for c in ("fp", "half", "task", "score", "language", "toxicity", "licence", "rank", "code", "leaks", "a", "b", "start")}
    return docs.withColumns(extra)
