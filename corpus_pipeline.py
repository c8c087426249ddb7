"""A corpus pipeline over ``documents``: quality rules, line dedup, n-gram Jaccard join, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's result
as Parquet in the shared folder and rereads it as the next one's input. All but the last return the columns of
``documents``. Defined results: a document that line dedup leaves without words goes (all of it is a copy);
``n_chars`` follows a changed text; nulls, repeated rows and empty tables are as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontam, linededup, ngramjoin, quality
from skein.llm.common import WS_CHARS, Scratch, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later copies of repeated runs go, and with them documents that consist of nothing else."""
    out = linededup.dedup_lines(docs)
    changed = F.size("removed") > 0
    blank = F.btrim(F.coalesce("row.text", F.lit("")), F.lit(WS_CHARS)) == ""
    out = out.where(~(changed & blank))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("row", F.when(changed, F.col("row").withField("n_chars", F.length("row.text").cast(kind))).otherwise(F.col("row")))
    return out.select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return ngramjoin.dedup_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and the digest of their decoding."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_tokens),
]

#: BPE has no SQL form; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.keep(docs)
    return docs
