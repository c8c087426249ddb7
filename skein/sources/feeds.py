"""Feed bodies to items: ranked lists and flash feeds of two shapes, web extracts and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import parse_time
from ..functions.text import first_text

_ITEM = "id string, title string, name string, url string, mobileUrl string, link string, `desc` string, description string, summary string, pubDate string, publishedAt string, date string, extra struct<hover:string,date:string>"
_FIELDS = ",".join(p.strip().replace(" ", ":", 1) for p in _ITEM.split(", "))
#: Entries are read as text first: one that is no object must not cost the whole list.
LIST_ONE = "struct<status:string,items:array<string>>"
LIST_TWO = "struct<code:int,data:array<string>>"


def list_items(bodies: DataFrame, shape: int = 1) -> DataFrame:
    """``bodies(source_id, external_id, content_kind, body)`` to one row an item.

    Skipped entries (neither title nor url; no object) still count for rank and list size. Rank and size are for
    ranked lists only, the publication time for flash feeds only. An item without an id gets the hash of its place.
    """
    if shape == 1:
        body, ok, items = F.from_json("body", LIST_ONE), F.lower("b.status").isin("success", "cache"), F.col("b.items")
    else:
        body, ok, items = F.from_json("body", LIST_TWO), F.col("b.code").isNull() | (F.col("b.code") == 200), F.col("b.data")
    rows = bodies.withColumn("b", body).where(ok).select("source_id", "external_id", "content_kind", F.size(items).alias("size"), F.posexplode(items).alias("pos", "raw")).withColumn("x", F.from_json("raw", f"struct<{_FIELDS}>"))
    title = first_text("x.title", "x.name")
    url = first_text("x.url", "x.mobileUrl", "x.link")
    summary = first_text("x.extra.hover") if shape == 1 else first_text("x.desc", "x.description", "x.summary", "x.extra.hover")
    ranked, flash = F.col("content_kind") == "ranked_news", F.col("content_kind") == "flash_feed"
    at = F.coalesce(parse_time("x.pubDate"), parse_time("x.publishedAt"), parse_time("x.date"), parse_time("x.extra.date"))
    rows = rows.select(
        "*", title.alias("title"), url.alias("url"), summary.alias("summary"), first_text("x.mobileUrl").alias("mobile_url"),
        F.when(ranked, F.col("pos") + 1).alias("rank"), F.when(ranked, F.col("size")).alias("source_list_size"), F.when(flash, at).alias("published_at"),
    )
    blank = F.col("title").isNull() & F.col("url").isNull()
    if shape == 2:
        blank = blank & F.col("summary").isNull()
        place = F.coalesce("url", F.concat(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    else:
        place = F.coalesce("url", "title")
    own = F.coalesce(first_text("x.id"), F.sha2(F.concat_ws("|", "external_id", place), 256))
    return rows.where(~blank).select("source_id", "content_kind", own.alias("source_item_id"), F.coalesce("title", F.lit("")).alias("title"), "url", "mobile_url", "summary", "rank", "source_list_size", "published_at")


def web_extract(bodies: DataFrame) -> DataFrame:
    """Adds ``ok, summary, insights``: a body that isn't JSON is the summary itself; nested data comes second."""
    from ..functions.text import distinct_ci, truncate

    inner = "success:boolean,summary:string,title:string,url:string,insights:array<string>"
    b = bodies.withColumn("b", F.from_json("body", f"struct<{inner},data:struct<{inner}>>"))
    json = F.rlike(F.trim("body"), F.lit(r"^\{"))
    insights = F.coalesce("b.insights", "b.data.insights", F.array().cast("array<string>"))
    summary = F.when(~json, F.col("body")).otherwise(F.coalesce(first_text("b.summary", "b.data.summary"), first_text(F.array_join(insights, "\n"))))
    return b.select(
        *bodies.columns, F.coalesce("b.success", "b.data.success", F.lit(True)).alias("ok"), truncate(summary).alias("summary"), F.slice(distinct_ci(insights), 1, 8).alias("insights")
    )


def unfence(text) -> Column:
    """The inside of a ``` block, else the trimmed text."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    inner = F.regexp_extract(t, r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(t)


def token_usage(body) -> dict[str, Column]:
    get = lambda *paths: F.coalesce(*[F.get_json_object(body, p).cast("bigint") for p in paths], F.lit(0))
    return {
        "prompt": get("$.usage.prompt_tokens", "$.usage.input_tokens"),
        "completion": get("$.usage.completion_tokens", "$.usage.output_tokens"),
        "cached": get("$.usage.prompt_tokens_details.cached_tokens", "$.usage.cache_read_input_tokens"),
    }


def clamped(number) -> Column:
    """From 0 to 1; a missing number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))


def cluster_reply(content, known_ids) -> Column:
    """``decision, event_id, confidence, title, summary, reason`` of a clustering reply; unknown decisions or ids mean a
    new event."""
    r = F.from_json(unfence(content), "struct<decision:string,eventId:string,confidence:double,canonicalTitle:string,summary:string,reason:string>")
    fine = r["decision"].isin("same_event", "follow_up", "related_but_distinct", "unrelated")
    link = r["decision"].isin("same_event", "follow_up")
    good = fine & (~link | F.array_contains(known_ids, r["eventId"]))
    return F.struct(
        F.when(good, r["decision"]).otherwise(F.lit("unrelated")).alias("decision"), F.when(good & link, r["eventId"]).alias("event_id"),
        clamped(r["confidence"]).alias("confidence"), first_text(r["canonicalTitle"]).alias("title"), first_text(r["summary"]).alias("summary"), first_text(r["reason"]).alias("reason"),
    )
