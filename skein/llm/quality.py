"""Quality rules as a short-circuit cascade (native).

A rule is a predicate over features of the text. On a bounded sample the cascade estimates what each rule costs and
how many rows it rejects, and orders the rules by rejections per cost: greedily, each among the rows that the ones
before it leave, at the cost of the features that those haven't computed yet. The cost of a feature on a row is its
work in characters and words, not a clock's reading, so equal input gives equal order.

The cascade is one expression: features are bound inside nested CASE branches, each where the first rule needs it,
so a row that a cheap rule rejects never pays for a dear one. It stands in the plan once, whether it is projected or
becomes a filter's condition. The order changes only the time: the verdict is "no rule rejects".

Defined results: null text has no words; a text without words fails ``few_words``; repeated rows are judged
each for itself; extra columns pass through untouched in ``quality_filter``, whatever their names, and are dropped by
``op8``; an empty table gives no rows. Texts of any length are judged whole: windows are arrays inside the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, clean_columns, read

WINDOW = 5
Env = dict[str, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with a name for ``value``, which is evaluated once, and only where ``body`` is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_space(text: Column) -> Column:
    for c in WS_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeats(f: Env) -> Column:
    """Words in 5-word windows that occur twice or more in the text.

    Windows are 64-bit hashes. A text whose windows are all different is done after one hash set. Else, sorting
    (hash, position) pairs puts equal windows side by side; the union of the repeated windows' words is the sum over
    their sorted starts of min(5, distance to the next start).
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def starts(s: Column) -> Column:
        same = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k), F.lit(False)))
        return F.sort_array(F.transform(hits, lambda k: F.get(s, k)["i"]))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Walks the sorted starts with (last start, words covered so far).
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(let(pairs, starts), zero, step, lambda a: a["n"])

    found = let(F.transform(f["words"], lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)))
    return F.when(f["n_words"] >= WINDOW, found).otherwise(0).cast("long")


@dataclass(frozen=True)
class Feature:
    """``make`` computes it from the features that it ``needs``; ``work`` is its cost on a text of so many characters
    and words, in nanoseconds of one core as once measured (only the ratios matter)."""

    make: Callable[[Env], Column]
    needs: tuple[str, ...]
    work: Callable[[int, int], float]


FEATURES = {
    "body": Feature(lambda f: F.btrim(F.coalesce(f["text"], F.lit("")), F.lit(WS_CHARS)), (), lambda c, w: 1.0 * c),
    "words": Feature(lambda f: F.split(f["body"], f"[{WS_CLASS}]+"), ("body",), lambda c, w: 20.0 * c),
    "n_words": Feature(lambda f: F.when(f["body"] == "", 0).otherwise(F.size(f["words"])).cast("long"), ("body", "words"), lambda c, w: 50.0),
    "word_chars": Feature(lambda f: F.length(_without_space(f["body"])).cast("long"), ("body",), lambda c, w: 10.0 * c),
    "n_symbols": Feature(lambda f: F.regexp_count(f["body"], F.lit("[#*$%&|<>]")).cast("long"), ("body",), lambda c, w: 10.0 * c),
    "n_bangs": Feature(lambda f: (F.length(f["body"]) - F.length(F.replace(f["body"], F.lit("!"), F.lit("")))).cast("long"), ("body",), lambda c, w: 3.0 * c),
    "lines": Feature(lambda f: F.filter(F.split(f["body"], "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""), ("body",), lambda c, w: 6.0 * c),
    "n_lines": Feature(lambda f: F.size(f["lines"]).cast("long"), ("lines",), lambda c, w: 50.0),
    "n_dup_lines": Feature(lambda f: (F.size(f["lines"]) - F.size(F.array_distinct(f["lines"]))).cast("long"), ("lines",), lambda c, w: 2.0 * c),
    "n_repeat_words": Feature(_repeats, ("words", "n_words"), lambda c, w: 600.0 * w),
}
#: Features that are reported.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A row is rejected where ``reject`` of its features (those it ``needs``) holds."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[Env], Column]


RULES = (
    Rule("few_words", ("n_words",), lambda f: f["n_words"] < 10),
    Rule("symbols", ("n_symbols", "n_words"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("shouting", ("n_bangs", "n_words"), lambda f: 10 * f["n_bangs"] > f["n_words"]),
    Rule("word_length", ("word_chars", "n_words"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 12 * f["n_words"])),
    Rule("line_repeats", ("n_lines", "n_dup_lines"), lambda f: (f["n_lines"] >= 4) & (10 * f["n_dup_lines"] > 5 * f["n_lines"])),
    Rule("word_repeats", ("n_repeat_words", "n_words"), lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
)


def closure(names: tuple[str, ...]) -> list[str]:
    """The features with all that they need, in an order of computation."""
    out: list[str] = []
    for name in names:
        out += [x for x in [*closure(FEATURES[name].needs), name] if x not in out]
    return out


def bind(names: tuple[str, ...], env: Env, then: Callable[[Env], Column]) -> Column:
    """``then`` with the named features, of which those that ``env`` lacks are computed here."""
    missing = [x for x in closure(names) if x not in env]
    if not missing:
        return then(env)
    return let(FEATURES[missing[0]].make(env), lambda v: bind(names, env | {missing[0]: v}, then))


def feature(name: str, text: Column) -> Column:
    return bind((name,), {"text": text}, lambda env: env[name])


def cascade(rules: list[Rule], text: Column) -> Column:
    """A struct of ``rejected_by`` (the first rule in order that rejects, else null) and the features, which are null
    where no rule up to that one asks for them."""

    def verdict(name: str | None, env: Env) -> Column:
        return F.struct(F.lit(name).cast("string").alias("rejected_by"), *[env.get(x, F.lit(None).cast("long")).alias(x) for x in REPORTED])

    def step(i: int, env: Env) -> Column:
        if i == len(rules):
            return verdict(None, env)
        return bind(rules[i].needs, env, lambda env: F.when(rules[i].reject(env), verdict(rules[i].name, env)).otherwise(step(i + 1, env)))

    return step(0, {"text": text})


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 1000) -> list[Rule]:
    """Rules by rejections per cost, as estimated on ``sample_rows`` rows (a bound, whatever the input).

    Only two numbers and one flag a rule of each sampled row reach the driver, not its text. The sample decides the
    order of evaluation, never a verdict.
    """
    src = F.col(f"`{text}`")
    flags = [bind(r.needs, {"text": src}, r.reject).alias(f"r{i}") for i, r in enumerate(rules)]
    rows = docs.select(F.length(F.coalesce(src, F.lit(""))).alias("chars"), feature("n_words", src).alias("words"), *flags).limit(sample_rows).collect()
    left, order, done = list(enumerate(rules)), [], set()
    while left and rows:

        def value(x: tuple[int, Rule]):
            fresh = [FEATURES[f] for f in closure(x[1].needs) if f not in done]
            cost = 1.0 + sum(f.work(r["chars"], r["words"]) for r in rows for f in fresh)
            return sum(r[f"r{x[0]}"] for r in rows) / cost, -cost, x[1].name

        best = max(left, key=value)
        left.remove(best)
        order.append(best[1])
        done |= set(closure(best[1].needs))
        rows = [r for r in rows if not r[f"r{best[0]}"]]
    return order + [r for _, r in left]


def quality_cascade(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``row`` (a struct of the input's columns) and ``judged`` (what ``cascade`` gives)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), cascade(rules, F.col(f"`{text}`")).alias("judged"))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return quality_cascade(docs, order_rules(docs, rules, text), text).where("judged.rejected_by is null").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict is the cascade's. The contract asks for some features of every row; those that the cascade didn't
    come to are computed after it."""
    docs = clean_columns(read(spark, sf_dir, "documents"), "doc_id", "text")
    out = quality_cascade(docs, order_rules(docs))
    whole = [F.coalesce(f"judged.{x}", feature(x, F.col("row.text"))).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = out.select("row.doc_id", *whole, F.isnull("judged.rejected_by").alias("kept"))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


OP8_SQL = r"""
with w as (
  select rowid_, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws
  from (select row_number() over () rowid_, doc_id, coalesce(text, '') t from documents)),
win as (
  select rowid_, i, count(*) over (partition by rowid_, g) c from (
    select rowid_, unnest(range(1, len(ws) - 3)) i, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' '))) g
    from w where len(ws) >= 5)),
rep as (select rowid_, count(distinct i + j) n from win, range(5) r(j) where c > 1 group by rowid_),
ln as (
  select rowid_, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from w),
f as (
  select doc_id, len(ws)::bigint n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (length(t) - length(replace(t, '!', '')))::bigint n_bangs,
    len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words
  from w join ln using (rowid_) left join rep using (rowid_))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
  not (n_words < 10 or 10 * n_symbols > n_words or 10 * n_bangs > n_words or word_chars < 2 * n_words or word_chars > 12 * n_words
    or (n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines) or 100 * n_repeat_words > 20 * n_words) kept
from f
"""
