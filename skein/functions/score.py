"""Ranks, freshness, heat series, trend, total score, costs and vectors as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, char_ngrams, jaccard, strings, tokenize

# The order of push reasons.
REASON_PRIORITY = (
    "flash_multi_source flash_repeated flash_follow_up flash_trusted_source coverage_rank rising_trend "
    "judge_high_importance reactivation source_increase rank_improvement score_improvement first_push"
).split()
ELIGIBLE = "coverage_rank rising_trend flash_multi_source flash_repeated flash_follow_up flash_trusted_source judge_high_importance reactivation".split()


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(x)))


def hours_between(later, earlier) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(earlier), _col(later)) / F.lit(3_600_000_000.0)


def normalized_rank(rank, size) -> Column:
    """1 for the first place down to 0 for the last; null if either is."""
    r, n = _col(rank), _col(size)
    return F.when(r.isNull() | n.isNull(), None).when(n <= 1, 1.0).otherwise(clamp(1.0 - (r - 1) / (n - 1)))


def freshness(kind, published_at, at) -> Column:
    """1 / (1 + age in days) of a flash item; other kinds and items without a time have 0."""
    age = F.greatest(F.lit(0.0), hours_between(at, published_at))
    return F.when((_col(kind) == "flash_feed") & _col(published_at).isNotNull(), clamp(1.0 / (1.0 + age / 24.0))).otherwise(0.0)


def recency(status, last_seen, at) -> Column:
    h = F.greatest(F.lit(0.0), hours_between(at, last_seen))
    return F.when(_col(status) == "Active", clamp(1.0 - h / 168.0)).otherwise(0.8 * clamp(1.0 - h / 720.0))


def recall_score(tok, gram, rep, key, rec) -> Column:
    total = 0.35 * _col(tok) + 0.35 * _col(gram) + 0.15 * _col(rep) + 0.10 * _col(key) + 0.05 * _col(rec)
    return F.bround(total, 4)


def recall_features(tok, gram, rep, key, rec) -> Column:
    return F.array_compact(
        F.array(
            F.when(_col(tok) >= 0.12, "token_overlap"), F.when(_col(gram) >= 0.18, "char_ngram_jaccard"), F.when(_col(rep) >= 0.18, "representative_title"),
            F.when(_col(key) > 0, "key_terms"), F.when(_col(rec) >= 0.5, "recent_event"),
        )
    )


def text_similarity(a, b) -> tuple[Column, Column]:
    """Token and n-gram Jaccard of two texts."""
    return jaccard(tokenize(a), tokenize(b)), jaccard(char_ngrams(a), char_ngrams(b))


def ewma(series) -> Column:
    """The smoothed series: s1 = x1, s = (x + s before) / 2."""
    s = _col(series)
    return F.aggregate(
        s, F.array().cast("array<double>"),
        lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(0.5 * x + 0.5 * F.element_at(acc, -1))),
    )


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def trend(smoothed) -> Column:
    """Relative rise of the later half's mean over the earlier half's, from 0 to 1; 0 with fewer than three values."""
    s = _col(smoothed)
    m = F.floor(F.size(s) / 2).cast("int")
    past, recent = mean(F.slice(s, F.lit(1), F.greatest(m, F.lit(1)))), mean(F.slice(s, m + 1, F.size(s) - m))
    return F.when(F.size(s) < 3, 0.0).otherwise(clamp((recent - past) / F.greatest(past, F.lit(0.2))))


def flash_score(n_flash, fresh, sources, need: int) -> Column:
    n = _col(n_flash)
    repeat = F.when(n <= 1, 0.0).otherwise(clamp((n - 1) / F.lit(float(max(1, need - 1)))))
    cover = clamp(_col(sources) / F.lit(float(max(1, need))))
    return F.when(n == 0, 0.0).otherwise(clamp(0.55 * _col(fresh) + 0.30 * cover + 0.15 * repeat))


def total_score(coverage, rank, trend_, persistence, llm, flash, bonus) -> Column:
    base = 0.35 * _col(coverage) + 0.25 * _col(rank) + 0.20 * _col(trend_) + 0.10 * _col(persistence) + 0.10 * _col(llm)
    return 100.0 * base + 15.0 * _col(flash) + _col(bonus)


def pick_reason(reasons) -> Column:
    """The reason of highest priority; else the last one; else ``eligible``."""
    r = _col(reasons)
    best = F.get(F.filter(strings(REASON_PRIORITY), lambda p: F.array_contains(r, p)), F.lit(0))
    return F.coalesce(best, F.get(r, F.size(r) - 1), F.lit("eligible"))


def estimated_cost(prompt, completion, cached, price_in: str, price_out: str, price_cached: str) -> Column:
    """Decimal cost; cached tokens are charged besides the whole prompt."""
    part = lambda n, p: F.coalesce(_col(n), F.lit(0)).cast("decimal(18,0)") * F.lit(p).cast("decimal(12,6)") / F.lit(1_000_000).cast("decimal(18,0)")
    return F.round(part(prompt, price_in) + part(completion, price_out) + part(cached, price_cached), 8).cast("decimal(18,8)")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """The vector over its length, in doubles (null for a zero vector)."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(_col(v), lambda x: x.cast("double") / n))


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hex_id(prefix: str, length: int, *parts) -> Column:
    """``prefix:`` and the head of the SHA-256 of the trimmed parts, joined by a bar."""
    return F.concat(F.lit(prefix + ":"), F.left(F.sha2(F.trim(F.concat_ws("|", *[_col(p).cast("string") for p in parts])), 256), F.lit(length)))


def content_id(category, source_id, item_id) -> Column:
    """``ci:`` with the safe category, the safe source and a hash of the item's own id."""
    from .text import safe_id_part

    return F.concat(F.lit("ci:"), safe_id_part(category), F.lit(":"), safe_id_part(source_id), F.lit(":"), F.left(F.sha2(F.trim(_col(item_id)), 256), F.lit(16)))


def snapshot_id(run_id, order, category, source_id, rank) -> Column:
    """A run's snapshot by its place in the display order."""
    from .text import safe_id_part

    place = F.lpad(_col(order).cast("string"), F.greatest(F.length(_col(order).cast("string")), F.lit(5)), F.lit("0"))
    r = F.coalesce(_col(rank), F.lit(0)).cast("string")
    return F.concat(_col(run_id), F.lit(":snap:"), place, F.lit(":"), safe_id_part(category), F.lit(":"), safe_id_part(source_id), F.lit(":r"), F.lpad(r, F.greatest(F.length(r), F.lit(4)), F.lit("0")))


def parse_time(value) -> Column:
    """Seconds, milliseconds (above 10^10) or ISO text; null if it is none of them."""
    text = F.trim(_col(value).cast("string"))
    number = F.when(F.rlike(text, F.lit(r"^\d{1,18}$")), text.cast("bigint"))
    return F.coalesce(F.when(number > 10_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number)), F.when(number.isNull(), F.try_to_timestamp(text)))
