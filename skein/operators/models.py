"""Model calls with retries, as stages over small frames: results, failures and usage are rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

#: Extra attempts after the first.
EXTRA = 3


class BadStatus(Exception):
    """A reply with a status that isn't success."""


def with_retries(send: Callable[[], str], parse: Callable[[str], Any], default: Any, extra: int = EXTRA) -> tuple[Any, bool, str | None, int, str | None]:
    """(result, success, error, retries, body). A failed call or a reply that can't be parsed is tried again, ``extra``
    times at most; then the default stands. Errors that aren't of the network or the reply pass through."""
    error, body = None, None
    for attempt in range(extra + 1):
        try:
            body = send()
        except (OSError, TimeoutError, BadStatus) as e:
            error = str(e) or type(e).__name__
            continue
        try:
            return parse(body), True, None, attempt, body
        except (ValueError, KeyError, TypeError) as e:
            error = str(e) or type(e).__name__
    return default, False, error, extra, body


def call_all(requests: DataFrame, key: str, send: Callable[[dict], str], parallel: int = 2, extra: int = EXTRA) -> DataFrame:
    """``key, body, success, error, retry_count, duration_ms``: one request a row, ``parallel`` tasks at a time. Replies
    stay text, so the parsing of replies is built-in expressions."""
    kind = dict(requests.dtypes)[key]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                start = time.monotonic()
                _, ok, error, retries, body = with_retries(lambda: send(row), lambda b: b if b.strip() else int("blank reply"), None, extra)  # noqa: B023
                out.append((row[key], body if ok else None, ok, error, retries, int((time.monotonic() - start) * 1000)))
            yield pd.DataFrame(out, columns=[key, "body", "success", "error", "retry_count", "duration_ms"])

    return requests.repartition(max(1, parallel)).mapInPandas(run, f"{key} {kind}, body string, success boolean, error string, retry_count int, duration_ms bigint")
