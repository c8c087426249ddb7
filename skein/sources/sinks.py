"""Sinks and lines out: a static HTML report of a few events, the push webhook, HTTP fetching, diagnostic tables."""

from __future__ import annotations

import html
import json
import logging
from collections.abc import Callable
from datetime import datetime
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame


def safe_link(url: str | None) -> str | None:
    return html.escape(url) if url and url.strip().lower().startswith(("http://", "https://")) else None


def write_report(events: list[dict], folder: str, at: datetime) -> Path:
    """Writes ``digest-yyyyMMdd-HHmmss.html``; ``events`` is a digest (a top-k, so it is small)."""
    parts = ["<!doctype html><meta charset=utf-8><title>Digest</title>"]
    for e in events:
        parts.append(f"<h2>{html.escape(e['title'])}</h2><p>{html.escape(e.get('summary') or '')}</p><ul>")
        for item in e.get("content_items") or []:
            title, link = html.escape(item["title"]), safe_link(item.get("url"))
            parts.append(f'<li><a href="{link}">{title}</a></li>' if link else f"<li>{title}</li>")
        parts.append("</ul>")
    path = Path(folder) / f"digest-{at:%Y%m%d-%H%M%S}.html"
    path.write_text("".join(parts), encoding="utf-8")
    return path


def push_all(messages: DataFrame, pusher: Callable[[dict], bool]) -> list[tuple[str, bool]]:
    """Sends each message of a digest once; the push log's key makes that at most once over runs."""
    return [(r["dedup_key"], bool(pusher(r.asDict(True)))) for r in messages.orderBy("dedup_key").toLocalIterator()]


def webhook_request(message: dict, url: str, key: str, channels: str = "", category: str = "default") -> tuple[str, dict[str, str], bytes]:
    """(address, headers, body) of a push: channels are part of the query, the key is a header."""
    at = url.strip() + ("&" if "?" in url else "?") + "channels=" + quote(channels, safe="")
    body = {"cate": category.strip() or "default", "title": message.get("title"), "msg": message.get("content"), "link": message.get("link")}
    return at, {"Push-Key": key.strip(), "Content-Type": "application/json; charset=utf-8"}, json.dumps(body, ensure_ascii=False).encode()


def http_send(url: str, headers: dict[str, str] | None = None, body: bytes | None = None, timeout: float = 30) -> str:
    """One HTTP exchange; a status that isn't success raises ``BadStatus``, a broken line ``OSError``."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from ..operators.models import BadStatus

    try:
        with urlopen(Request(url, data=body, headers=headers or {}), timeout=timeout) as reply:  # noqa: S310  configured address
            return reply.read().decode("utf-8", "replace")
    except HTTPError as e:
        raise BadStatus(f"HTTP {e.code}: {e.read(300).decode('utf-8', 'replace')}") from e


def webhook(url: str, key: str, channels: str = "", category: str = "default", send: Callable[..., str] = http_send) -> Callable[[dict], bool]:
    """A pusher for ``Models.push``; without an address or a key nothing is sent."""

    def push(message: dict) -> bool:
        if not url.strip() or not key.strip():
            return False
        try:
            send(*webhook_request(message, url, key, channels, category))
        except Exception as e:  # noqa: BLE001  a failed push is a row of the log, not the end of the run
            logging.getLogger(__name__).warning("push of %s failed: %s", message.get("dedup_key"), e)
            return False
        return True

    return push


def feed_address(base: str, external_id: str, shape: int = 1) -> str:
    """Where a source's list is: a query of one endpoint, or a path of its own."""
    root = base.rstrip("/")
    return f"{root}/api/s?id={quote(external_id, safe='')}" if shape == 1 else f"{root}/{quote(external_id, safe='')}"


def fetcher(base: str, shape: int = 1, timeout: float = 30) -> Callable[[dict], str]:
    """A fetcher for ``Models.fetch``."""
    return lambda row: http_send(feed_address(base, row["external_id"], shape), timeout=timeout)


def source_health(bodies: DataFrame) -> DataFrame:
    """``source_id, name, total, status, error`` of fetched bodies (a diagnostic table)."""
    from pyspark.sql import functions as F

    b = F.from_json("body", "struct<title:string,name:string,total:string,data:array<string>,items:array<string>>")
    rows = bodies.withColumn("b", b)
    listed = F.coalesce(F.size("b.items"), F.size("b.data"))
    total = F.coalesce(F.expr("try_cast(b.total as bigint)"), F.when(listed >= 0, listed.cast("bigint")))
    status = F.when(total.isNull(), "Unknown").when(total > 0, "OK").otherwise("Empty")
    return rows.select("source_id", F.coalesce(F.nullif(F.trim("b.title"), F.lit("")), F.trim("b.name")).alias("name"), total.alias("total"), status.alias("status"), "error")


def markdown(rows: list[dict], columns: list[str], width: int = 100) -> str:
    """A Markdown table; cells are one line, bars escaped, long ones cut."""

    def cell(value) -> str:
        text = " ".join(str("" if value is None else value).split()).replace("|", "\\|")
        return text if len(text) <= width else text[: width - 3].rstrip() + "..."

    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([cell(r.get(c)) for c in columns]) for r in rows]])
