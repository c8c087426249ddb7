"""Feeds as a Spark data source: ``spark.read.format("skein_feeds")`` and ``spark.readStream.format("skein_feeds")``.

Options: ``sources``, JSON text of a list of objects with ``id, external_id`` and, if wanted, ``content_kind``; ``root``,
where the bodies are. In a batch, ``root`` is an address (one exchange a source, with ``shape`` and ``timeout``) or a folder
that all executors see, with ``{external_id}.json``, or, if a source has a folder of its own, the newest of its numbered
bodies. A stream reads folders ``{external_id}/{n}.json`` only, because an offset must give the same bodies when it is read
again: offset n has the bodies up to n of every source.

Each source is a partition, so sources are asked in parallel and one that fails costs nothing but its own row, which has
``status = 'failed'`` and the error. A source without a body in a stream's range has no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_id string, external_id string, content_kind string, status string, body string, error string, poll long"


class SourcePartition(InputPartition):
    """One source and, of a stream, the range of bodies after ``start`` up to ``end``."""

    def __init__(self, source: dict, start: int = 0, end: int = 0):
        self.source, self.start, self.end = source, start, end


class Bodies:
    """What both readers share: the sources, and how a body is had."""

    def __init__(self, options: dict):
        self.root = options.get("root", "").rstrip("/")
        if not self.root:
            raise ValueError("root must name an address or a folder")
        self.sources = json.loads(options.get("sources", "[]"))
        self.shape, self.timeout = int(options.get("shape", "1")), float(options.get("timeout", "30"))

    def folder(self, source: dict) -> Path:
        return Path(self.root) / quote(source["external_id"], safe="")

    def numbers(self, source: dict) -> list[int]:
        """Numbers of a source's bodies, in order."""
        at = self.folder(source)
        return sorted(int(p.stem) for p in at.glob("*.json") if p.stem.isdigit()) if at.is_dir() else []

    def fetch(self, source: dict) -> tuple[str, int]:
        """(the body as it is now, its number)"""
        if self.root.startswith(("http://", "https://")):
            from .sinks import feed_address, http_send

            return http_send(feed_address(self.root, source["external_id"], self.shape), timeout=self.timeout), 0
        if n := self.numbers(source):
            return (self.folder(source) / f"{n[-1]}.json").read_text(encoding="utf-8"), n[-1]
        return self.folder(source).with_suffix(".json").read_text(encoding="utf-8"), 0

    @staticmethod
    def row(source: dict, body: str | None, poll: int, error: Exception | None = None) -> tuple:
        told = f"{type(error).__name__}: {error}" if error else None
        return source["id"], source["external_id"], source.get("content_kind", "ranked_news"), "failed" if error else "succeeded", body, told, poll


class FeedReader(DataSourceReader, Bodies):
    def __init__(self, options: dict):
        Bodies.__init__(self, options)

    def partitions(self) -> list[SourcePartition]:
        return [SourcePartition(s) for s in self.sources]

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        try:
            body, poll = self.fetch(partition.source)
        except Exception as e:  # noqa: BLE001  a failed source is a row
            yield self.row(partition.source, None, 0, e)
        else:
            yield self.row(partition.source, body, poll)


class FeedStreamReader(DataSourceStreamReader, Bodies):
    def __init__(self, options: dict):
        Bodies.__init__(self, options)
        if self.root.startswith(("http://", "https://")):
            raise ValueError("a stream needs a folder: an address can't give the same bodies again")

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": max((n[-1] for s in self.sources if (n := self.numbers(s))), default=0)}

    def partitions(self, start: dict, end: dict) -> list[SourcePartition]:
        return [SourcePartition(s, start["poll"], end["poll"]) for s in self.sources] if start["poll"] < end["poll"] else []

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        for n in self.numbers(partition.source):
            if partition.start < n <= partition.end:
                try:
                    yield self.row(partition.source, (self.folder(partition.source) / f"{n}.json").read_text(encoding="utf-8"), n)
                except Exception as e:  # noqa: BLE001  a failed source is a row
                    yield self.row(partition.source, None, n, e)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)
