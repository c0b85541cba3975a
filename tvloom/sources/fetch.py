"""Downloads as a table of responses, so that everything after is deterministic.

`fetch` runs an injected opener over the rows of a URL table, in parallel by partition, with retries and limits;
a table of recorded responses can stand in for it.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import RETRYABLE
from ..schemas import RESPONSE

MOST_BYTES = 50_000_000
_ATTEMPT = pa.struct([("attempt", pa.int32()), ("status", pa.string()), ("http_status", pa.int32()), ("elapsed_ms", pa.int32()), ("error_type", pa.string())])
#: RESPONSE in Arrow.
ARROW = pa.schema([("url", pa.string()), ("http_status", pa.int32()), ("content_type", pa.string()), ("final_url", pa.string()), ("body", pa.binary()), ("error_type", pa.string()), ("error", pa.string()), ("elapsed_ms", pa.int32()), ("attempts", pa.list_(_ATTEMPT))])


@dataclass
class Reply:
    """What an opener returns."""

    status: int
    body: bytes
    content_type: str = ""
    final_url: str = ""
    headers: dict[str, str] = field(default_factory=dict)


class Refused(Exception):
    """A reply that another try wouldn't mend."""


def open_url(url: str, timeout: float, most: int) -> Reply:
    """The default opener. Redirects must stay on http(s); the body is read up to the limit."""
    if urlsplit(url).scheme not in ("http", "https"):
        raise Refused("not an http(s) URL")
    request = urllib.request.Request(url, headers={"User-Agent": "tvloom"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
            if urlsplit(reply.geturl()).scheme not in ("http", "https"):
                raise Refused("redirected off http(s)")
            if int(reply.headers.get("Content-Length") or 0) > most:
                raise Refused(f"over {most} bytes")
            return Reply(reply.status, reply.read(most + 1), reply.headers.get("Content-Type", ""), reply.geturl(), dict(reply.headers))
    except urllib.error.HTTPError as e:
        return Reply(e.code, b"", e.headers.get("Content-Type", ""), url, dict(e.headers))


def waiting(attempt: int, headers: dict[str, str], step: float, most: float) -> float:
    """Seconds before the next try: as the server asks, else a step more each time; bounded."""
    asked = next((v for k, v in headers.items() if k.lower() == "retry-after"), "")
    seconds = float(asked) if asked.strip().isdigit() else step * attempt
    return max(0.0, min(most, seconds))


def fetch_one(url: str, opener: Callable[[str, float, int], Reply] = open_url, *, retries: int = 3, timeout: float = 30, step: float = 1.0, most_wait: float = 3.0, most_bytes: int = MOST_BYTES, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A response row. Statuses that may pass and network errors are tried again; others and empty bodies aren't."""
    attempts: list[dict] = []
    row = {"url": url, "http_status": None, "content_type": "", "final_url": url, "body": None, "error_type": "", "error": ""}
    for attempt in range(1, retries + 2):
        began, headers, again = time.monotonic(), {}, False
        status, error_type, error = None, "", ""
        try:
            reply = opener(url, timeout, most_bytes)
            status, headers = reply.status, reply.headers
            if not 200 <= status < 300:
                error_type, error, again = "http_error", f"status {status}", status in RETRYABLE
            elif len(reply.body) > most_bytes:
                error_type, error = "too_large", f"over {most_bytes} bytes"
            elif not reply.body.strip():
                error_type, error = "empty", "empty body"
            else:
                row |= {"body": reply.body, "content_type": reply.content_type, "final_url": reply.final_url or url}
        except Refused as e:
            error_type, error = "refused", str(e)
        except OSError as e:
            error_type, error, again = "network", str(e), True
        elapsed = int((time.monotonic() - began) * 1000)
        attempts.append({"attempt": attempt, "status": "error" if error_type else "ok", "http_status": status, "elapsed_ms": elapsed, "error_type": error_type})
        row |= {"http_status": status, "error_type": error_type, "error": error}
        if not again or attempt > retries:
            break
        sleep(waiting(attempt, headers, step, most_wait))
    return row | {"elapsed_ms": sum(a["elapsed_ms"] for a in attempts), "attempts": attempts}


def fetch(urls: DataFrame, opener: Callable[[str, float, int], Reply] = open_url, *, workers: int = 8, **options) -> DataFrame:
    """Responses to urls (url), each URL once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([fetch_one(url, opener, **options)], ARROW)

    return urls.select("url").distinct().repartition(workers).mapInArrow(run, RESPONSE)


def local_path(url: str, root: str) -> str:
    """Path of a local source: file URLs, absolute paths, and paths relative to root."""
    parts = urlsplit(url)
    if parts.scheme == "file":
        return unquote(parts.path) if not parts.netloc or parts.netloc == "localhost" else f"//{parts.netloc}{unquote(parts.path)}"
    if len(parts.scheme) == 1:  # a drive letter
        return url
    return str(Path(url) if Path(url).is_absolute() else Path(root) / url)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files as path and body, by Spark's own reader."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("body"))


def decode_body(body: bytes | None, content_type: str = "") -> str:
    """Text in the charset that the type names, else UTF-8; a byte-order mark goes, bad bytes are replaced."""
    _, _, charset = (content_type or "").lower().partition("charset=")
    try:
        return (body or b"").decode(charset.split(";")[0].strip(" \"'") or "utf-8-sig", "replace")
    except LookupError:
        return (body or b"").decode("utf-8-sig", "replace")


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_body(b, t) for b, t in zip(body, content_type)], dtype="object")


def download_summary(responses: DataFrame) -> DataFrame:
    """One row: attempted, ok, failed, attempts, retries, bytes and milliseconds."""
    tries = F.size("attempts")
    return responses.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("error_type") == "").alias("successful"),
        F.count_if(F.col("error_type") != "").alias("failed"),
        F.coalesce(F.sum(tries), F.lit(0)).cast("long").alias("attempts"),
        F.coalesce(F.sum(F.greatest(tries - 1, F.lit(0))), F.lit(0)).cast("long").alias("retries"),
        F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("long").alias("bytes_downloaded"),
        F.coalesce(F.sum("elapsed_ms"), F.lit(0)).cast("long").alias("elapsed_ms"),
    )
