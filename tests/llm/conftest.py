import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark, tmp_path):
    """Makes a Parquet-backed documents table of (doc_id, text) pairs."""

    def make(rows, parts=2):
        path = str(tmp_path / f"d{len(list(tmp_path.iterdir()))}")
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        spark.createDataFrame(full, SCHEMA).repartition(parts, "doc_id").write.parquet(path)
        return spark.read.parquet(path)

    return make


#: Nulls, empties, blanks, ties, repeated rows, signs, and a very long text.
ODD = [(None, "null id text"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "tie tie"), (5, "tie tie"), (6, "*** !!! <|endoftext|>"), (7, "word " * 60_000), (8, "é ü 漢字\x1f\x00 Ḱ")]
