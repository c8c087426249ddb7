"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole; the byte spans of its tokens follow from the tokens' byte lengths (a token can
cut a character, so spans are in bytes; sections begin at characters, and their spans are given in both). The spans
are joined with the sections' intervals by binary search on the sorted bounds. A token that crosses a bound goes to
one section by an explicit rule: ``first`` (where its first byte is), ``last`` (where its last byte is) or
``most`` (where most of its bytes are; the earlier of equals). So the sections' counts add up to the document's.

A section is a line with the newline that ends it. Defined results: null or empty text is one empty section without
tokens; repeated rows and doc_ids are counted each for itself; invalid UTF-8
is read with replacement characters; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_columns, read, small_batches

RANKS = "byte_bpe_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder and the byte length of every token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def line_bounds(data: bytes) -> np.ndarray:
    """Byte offsets where sections begin, and the end of the text."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    inner = cuts[cuts < len(data)]
    return np.concatenate(([0], inner, [len(data)])).astype(np.int64)


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a bound."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inner = bounds[1:-1]
    first = np.searchsorted(inner, starts, "right")
    last = np.searchsorted(inner, ends - 1, "right")
    home = first
    if rule == "last":
        home = last
    elif rule == "most":
        home = first.copy()
        for t in np.flatnonzero(first != last):
            edges = np.clip(bounds[first[t] : last[t] + 2], starts[t], ends[t])
            home[t] = first[t] + int(np.argmax(np.diff(edges)))
    n = len(bounds) - 1
    return np.bincount(home, minlength=n), np.bincount(home[first != last], minlength=n)


def token_counts(docs: DataFrame, path: str | None = None, rule: str = "first") -> DataFrame:
    """``doc_id, section, start_byte, n_bytes, start_char, n_chars, n_tokens, n_crossing``, a row for each section of
    each document."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"no such rule: {rule}")
    small_batches(docs.sparkSession)
    where = path or default_path()

    def run(batches):
        import pyarrow as pa

        enc, size_of = encoding(where)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            take, sections, starts, lengths, first_chars, chars, counts, crossing = [], [], [], [], [], [], [], []
            for i, data in enumerate(texts):
                text = (data or b"").decode("utf-8", "replace")
                data = text.encode("utf-8")
                bounds = line_bounds(data)
                got, cross = attribute(size_of[np.array(enc.encode_ordinary(text), np.int64)], bounds, rule)
                n = len(bounds) - 1
                take.append(np.full(n, i))
                sections.append(np.arange(n))
                starts.append(bounds[:-1])
                lengths.append(np.diff(bounds))
                # Bytes that begin a character, before each bound.
                before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))[bounds]
                first_chars.append(before[:-1])
                chars.append(np.diff(before))
                counts.append(got)
                crossing.append(cross)
            if texts:
                cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in (sections, starts, lengths, first_chars, chars, counts, crossing)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate(take).astype(np.int64))).cast(pa.int64()), *cols],
                    names=["doc_id", "section", "start_byte", "n_bytes", "start_char", "n_chars", "n_tokens", "n_crossing"],
                )

    src = clean_columns(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id bigint, section bigint, start_byte bigint, n_bytes bigint, start_char bigint, n_chars bigint, n_tokens bigint, n_crossing bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
