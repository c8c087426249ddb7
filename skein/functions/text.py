"""Text expressions: tokens, n-grams, Jaccard, key terms, anchors, tags, caps, enrichment and blacklist predicates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
STOP_WORDS = "the and for with from this that into after about news update 一个 最新 突发 视频 详情 回应 发生 报道 消息 相关".split()
ANCHOR_STOP_WORDS = "the and for with from this that into after about news update over under between".split()
INCOMPLETE_WORDS = "详情 来了 突发 更新中 最新 快讯 发生了什么 怎么回事 一图看懂".split()
WEAK_TAGS = "http https www com news the and with from".split()
CJK = "一-鿿㐀-䶿぀-ヿ가-힯"
SUBJECT = r"[\x{4E00}-\x{9FFF}]{2,}|[A-Z][A-Za-z0-9_-]{2,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def tokenize(text, stop_words: list[str] = STOP_WORDS) -> Column:
    """The set of lower-cased letter/digit runs of two characters or more that aren't stop words."""
    parts = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.isin(stop_words)))


def letters_and_digits(text) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^\p{L}\p{Nd}]+", "")


def char_ngrams(text, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """The set of character n-grams of the letters and digits; the text is cut into characters once."""

    def grams(chars: Column, n: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.when(F.size(chars) >= n, F.transform(at, lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))).otherwise(strings([]))

    s = letters_and_digits(text)
    cut = F.when(s == "", strings([])).otherwise(F.split(s, ""))
    return F.get(F.transform(F.array(cut), lambda c: F.array_distinct(F.concat(*[grams(c, n) for n in sizes]))), F.lit(0))


def with_ngram_count(df: DataFrame, letters: str, name: str) -> DataFrame:
    """``df`` and the number of distinct 2- and 3-grams (``char_ngrams``) of a column of letters and digits, by their
    code points as numbers: no n-gram is made as a string. Other sizes need ``char_ngrams``."""
    at = df.columns.index(letters)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            counts = []
            for t in batch.column(at):
                u = np.frombuffer((t.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                two = u[:-1] << 21 | u[1:]
                three = two[:-1] << 21 | u[2:]
                counts.append(distinct(two) + distinct(three))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], names=[*batch.schema.names, name])

    def distinct(x):
        x.sort()
        return int((x[1:] != x[:-1]).sum()) + 1 if len(x) else 0

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(name, T.IntegerType())]))


def jaccard(a, b) -> Column:
    """Of two sets; 0 if either is empty."""
    a, b = _col(a), _col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def key_terms(text, limit: int = 12) -> Column:
    """Tokens, longest first, then alphabetically."""
    longer = F.transform(tokenize(text), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))
    return F.slice(F.transform(F.sort_array(longer), lambda x: x["w"]), 1, limit)


def first_text(*cols) -> Column:
    """The first of the columns that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in cols])


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def truncate(text, limit: int = 360, mark: str = "...") -> Column:
    t = collapse(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit))), F.lit(mark))).otherwise(t)


def cap_text(*parts, limit: int) -> Column:
    """Parts that aren't blank, one a line, lines trimmed, blank ones dropped, cut at ``limit`` characters."""
    text = F.concat_ws("\n", *[F.nullif(F.trim(_col(p)), F.lit("")) for p in parts])
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.regexp_replace(F.left(F.array_join(lines, "\n"), F.lit(limit)), r"\s+$", "")


def distinct_ci(values) -> Column:
    """Distinct without regard to case; the first spelling stays, in order."""
    start = strings([])
    return F.aggregate(
        _col(values), start,
        lambda acc, x: F.when(x.isNull() | (F.trim(x) == "") | F.exists(acc, lambda y: F.lower(y) == F.lower(F.trim(x))), acc).otherwise(F.array_append(acc, F.trim(x))),
    )


def prepend_unique(old, new, cap: int) -> Column:
    """New values go to the front one by one, those that are there stay where they are, the oldest beyond ``cap`` are
    forgotten (an update by a matched item)."""

    def add(acc: Column, x: Column) -> Column:
        there = x.isNull() | (F.trim(x) == "") | F.exists(acc, lambda y: F.lower(y) == F.lower(F.trim(x)))
        return F.when(there, acc).otherwise(F.slice(F.concat(F.array(F.trim(x)), acc), 1, cap))

    return F.aggregate(F.coalesce(_col(new), strings([])), F.coalesce(_col(old), strings([])), add)


def append_unique(old, new, cap: int) -> Column:
    """Old values first (a merge of two events)."""
    return F.slice(distinct_ci(F.concat(_col(old), _col(new))), 1, cap)


def disjoint_ci(a, b) -> Column:
    """Both lists have values and share none, without regard to case."""
    low = lambda c: F.transform(F.filter(F.coalesce(_col(c), strings([])), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x)))
    return (F.size(low(a)) > 0) & (F.size(low(b)) > 0) & ~F.arrays_overlap(low(a), low(b))


def need_enrichment(source, title, summary, enabled: list[str] = [], disabled: list[str] = [], min_title: int = 14) -> Column:  # noqa: B006
    """Whether an item's text should be fetched: sources decide first, then completeness, length and stock phrases."""
    t, s = collapse(F.coalesce(_col(title), F.lit(""))), collapse(F.coalesce(_col(summary), F.lit("")))
    low = F.lower(_col(source))
    subject = lambda x: F.rlike(x, F.lit(SUBJECT))
    complete = (F.char_length(s) >= 40) & subject(s)
    stock = F.exists(strings(INCOMPLETE_WORDS), lambda w: F.contains(F.lower(F.concat_ws(" ", t, s)), F.lower(w)))
    return (
        F.when(low.isin([x.lower() for x in disabled]), False)
        .when(low.isin([x.lower() for x in enabled]), True)
        .when(complete, False)
        .when(F.char_length(t) < min_title, True)
        .when(stock, True)
        .otherwise(~subject(t))
    )


def blacklist_keyword(title, summary, keywords: list[str]) -> Column:
    """The first keyword in title or summary, without regard to case, else null."""
    text = F.lower(F.concat_ws(" ", F.coalesce(_col(title), F.lit("")), F.coalesce(_col(summary), F.lit(""))))
    return F.get(F.filter(strings(keywords), lambda k: F.contains(text, F.lower(k))), F.lit(0))


def blacklist_reason(keyword) -> Column:
    return F.when(_col(keyword).isNotNull(), F.concat(F.lit("匹配到黑名单关键词: "), _col(keyword)))


def tag_display(tag) -> Column:
    return F.btrim(collapse(F.btrim(collapse(tag), F.lit("#＃，,。.：:"))), F.lit("#＃，,。.：: "))


def tag_name(tag) -> Column:
    low = F.regexp_replace(F.lower(tag_display(tag)), r"[\s\-_.]+", "-")
    kept = F.regexp_replace(low, rf"[^\p{{L}}\p{{Nd}}{CJK}-]", "")
    return F.btrim(F.regexp_replace(kept, "-+", "-"), F.lit("-"))


def weak_tag(name) -> Column:
    n = _col(name)
    return n.isNull() | (F.length(n) < 2) | (F.length(n) > 32) | n.isin(WEAK_TAGS)


def safe_id_part(text) -> Column:
    """Lower-cased, every other character than a letter or digit a dash, dashes trimmed; ``unknown`` if nothing is left."""
    kept = F.btrim(F.regexp_replace(F.lower(F.btrim(F.coalesce(_col(text), F.lit("")))), r"[^\p{L}\p{Nd}]", "-"), F.lit("-"))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("unknown"))


def anchors_of(*texts: str | None, cap: int = 8) -> list[str]:
    """Stable anchors: names, numbers and mixed-case or CJK terms, each when it is met, and runs of neighbours joined by
    a space when they end. A new one goes to the front and the oldest beyond ``cap`` is forgotten, so a text's last
    anchors stay, newest first."""
    import regex

    word = regex.compile(r"\b[\p{L}\p{N}][\p{L}\p{N}'&.-]*\b")
    cjk = regex.compile(f"[{CJK}]")

    def stable(t: str) -> bool:
        if len(t) < 2 or t.lower() in ANCHOR_STOP_WORDS:
            return False
        n = len(cjk.findall(t))
        if n:
            return n >= 2 or (len(t) <= 4 and any(c.isascii() and c.isalnum() for c in t))
        kinds = [unicodedata.category(c) for c in t]
        return "Nd" in kinds or kinds.count("Lu") >= 2 or ("Lu" in kinds and "Ll" in kinds)

    out: list[str] = []

    def add(x: str) -> None:
        if all(x.lower() != y.lower() for y in out):
            out.insert(0, x)
            del out[cap:]

    for text in texts:
        run: list[str] = []
        for m in [*word.finditer(text or ""), None]:
            if m and stable(m[0]):
                run.append(m[0])
                add(m[0])
                continue
            if len(run) >= 2:
                add(" ".join(run))
            run = []
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def anchors(text: pd.Series) -> pd.Series:
    """``anchors_of`` for a column; runs of neighbours can't be told with built-in functions."""
    return text.map(lambda t: anchors_of(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def anchors_all(texts: pd.Series) -> pd.Series:
    """``anchors_of`` over the texts of an array, in order."""
    return texts.map(lambda ts: anchors_of(*([] if ts is None else ts)))
