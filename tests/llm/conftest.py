import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("_row", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("rank", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes (doc_id, text) rows as a table of documents with clashing extra columns; gives the frame that reads it."""

    def write(rows):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        full = [(i, t, "en", "src0", None if t is None else len(t), "x", None, "y", "z") for i, t in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture(scope="session")
def prose():
    """Random sentences of invented words."""

    def make(seed, words, lines=1):
        r = random.Random(seed)
        vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(300)]
        return "\n".join(" ".join(r.choices(vocabulary, k=words // lines)) for _ in range(lines))

    return make
