"""Columns of the input that are called like an operator's own."""

from pyspark.sql import functions as F

from skein.llm import ngramjoin

WORDS = [f"w{i}" for i in range(40)]


def test_ngram_join_keeps_all_columns_of_the_input(docs):
    rows = [(1, " ".join(WORDS)), (2, " ".join(WORDS[:-1])), (3, "Quite ANOTHER text of some more words"), (4, None), (5, ""), (3, "quite another TEXT of some more words")]
    own = ["__rid", "rid", "row", "c", "tok", "comp", "key", "n", "reach", "post"]
    df = docs(rows, 1)
    for name in own:
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    got = ngramjoin.dedup_documents(df)
    kept = {r["doc_id"]: r for r in got.collect()}
    assert got.columns == df.columns and sorted(kept) == [1, 3, 4, 5]
    assert all(kept[i][name] == f"{name}{i}" for i in kept for name in own)
    found = {(r["doc_id"], r["component_id"]) for r in ngramjoin.jaccard_components(df).collect()}
    assert found == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
