"""Requests and their responses as a data source.

    responses(requests)                      # a DataFrame of requests
    spark.read.format("http_responses").option("requests", path).load()   # a written table of them

A request is url, headers (a map), accept and read_limit; a response has the columns of RESPONSE and header_key, which
tells apart requests of one URL with other headers. The table of requests is planned as slices of so many rows; a task
takes a slice, with several requests on their way at once, as servers are slow rather than large.

With a read_limit a request is a probe: it asks for that range, reads no further whatever the server sends, and isn't
tried again. Without, it is a download: read in chunks, refused as soon as it is over the limit, and tried again where
`fetch.fetch_one` does. Both stay on http and https, at each redirect too, and end at a deadline however slowly a server
sends. A request that fails in any way is a row with its error.
"""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls
from ..operators.cluster import fresh
from ..schemas import RESPONSE
from ..sinks.ordered_file import filesystem
from .fetch import ARROW, MOST_BYTES, Refused, Reply, fetch_one

SCHEMA = f"{RESPONSE}, header_key string"
_ARROW = ARROW.append(pa.field("header_key", pa.string()))
REQUEST = {"url": "string", "headers": "map<string,string>", "accept": "string", "read_limit": "int"}
CHUNK = 1 << 16
#: Requests of a slice, and how many of them are on their way at once.
SLICE, WORKERS = 64, 8
SCHEMES = ("http", "https")
#: Fixed value: what a probe accepts.
ACCEPT = "application/vnd.apple.mpegurl,application/x-mpegURL,video/*,audio/*,application/octet-stream,*/*"


class _Redirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, request, file, code, message, headers, url):
        if urlsplit(url).scheme not in SCHEMES:
            raise Refused("redirected off http(s)")
        new = super().redirect_request(request, file, code, message, headers, url)
        if new is not None and urlsplit(url).netloc != urlsplit(request.full_url).netloc:
            new.remove_header("Authorization")  # meant for the first host alone
        return new


def _read(reply, most: int, until: float) -> bytes:
    """Up to `most` bytes, in chunks."""
    parts, size = [], 0
    while size < most:
        if time.monotonic() > until:
            raise TimeoutError("the body took too long")
        part = reply.read1(min(CHUNK, most - size))
        if not part:
            break
        parts.append(part)
        size += len(part)
    return b"".join(parts)


def open_request(url: str, timeout: float, most: int, *, headers: dict[str, str] | None = None, accept: str | None = None, probe: bool = False, deadline: float = 120, agent: str = "tvloom") -> Reply:
    """A reply with up to `most` bytes; of a download one more, which shows that it is too large. Bodies of refusals are read too."""
    if urlsplit(url).scheme not in SCHEMES:
        raise Refused("not an http(s) URL")
    own = {"User-Agent": agent}
    if probe:
        own |= {"Accept": accept or ACCEPT, "Range": f"bytes=0-{most - 1}", "Cache-Control": "no-cache"}
    elif accept:
        own["Accept"] = accept
    for name, value in (headers or {}).items():
        own["User-Agent" if name.casefold() == "user-agent" else name] = value
    until = time.monotonic() + deadline
    opener = urllib.request.build_opener(_Redirects())
    try:
        with opener.open(urllib.request.Request(url, headers=own), timeout=timeout) as reply:
            length = reply.headers.get("Content-Length") or ""
            if not probe and length.isdigit() and int(length) > most:
                return Reply(reply.status, b" " * 0, reply.headers.get("Content-Type", ""), reply.geturl(), dict(reply.headers) | {"x-too-large": length})
            return Reply(reply.status, _read(reply, most if probe else most + 1, until), reply.headers.get("Content-Type", ""), reply.geturl(), dict(reply.headers))
    except urllib.error.HTTPError as e:
        with e:
            if e.code in (301, 302, 303, 307, 308) and urlsplit(e.headers.get("Location", "")).scheme not in ("", *SCHEMES):
                raise Refused("redirected off http(s)") from e
            return Reply(e.code, _read(e, min(most, CHUNK), until), e.headers.get("Content-Type", ""), e.geturl() or url, dict(e.headers))
    except http.client.HTTPException as e:
        raise OSError(f"broken reply: {e!r}") from e



class Slice(InputPartition):
    """Rows of one file of the table of requests."""

    def __init__(self, path: str, group: int, begin: int, end: int):
        self.path, self.group, self.begin, self.end = path, group, begin, end


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["requests"]
        self.slice, self.workers = int(options.get("slice", SLICE)), int(options.get("workers", WORKERS))
        self.retries, self.most = int(options.get("retries", 3)), int(options.get("most_bytes", MOST_BYTES))
        self.timeout, self.deadline, self.wait = (float(options.get(k, v)) for k, v in (("timeout", 30), ("deadline", 120), ("most_wait", 3)))
        self.agent = options.get("agent", "tvloom")

    def partitions(self) -> list[Slice]:
        """Slices of the table's row groups, from the files' footers."""
        system, place = filesystem(self.path)
        found = []
        for info in sorted(system.get_file_info(fs.FileSelector(place, recursive=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as file:
                    meta = pq.ParquetFile(file).metadata
                    for group in range(meta.num_row_groups):
                        n = meta.row_group(group).num_rows
                        found += [Slice(info.path, group, k, min(k + self.slice, n)) for k in range(0, n, self.slice)]
        return found or [Slice("", 0, 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        system, _ = filesystem(self.path)
        with system.open_input_file(part.path) as file:
            rows = pq.ParquetFile(file).read_row_group(part.group).slice(part.begin, part.end - part.begin).to_pylist(maps_as_pydicts="strict")
        with ThreadPoolExecutor(self.workers) as pool:
            # replies in the order of the requests, each handed on by itself
            for row in pool.map(self._answer, rows):
                yield pa.RecordBatch.from_pylist([row], _ARROW)

    def _answer(self, request: dict) -> dict:
        url, headers, limit = request["url"] or "", request.get("headers") or {}, request.get("read_limit")
        try:
            if limit:
                row = _probed(url, self._opener(headers, request.get("accept"), True), self.timeout, limit)
            else:
                row = fetch_one(url, self._opener(headers, request.get("accept"), False), retries=self.retries, timeout=self.timeout, most_wait=self.wait, most_bytes=self.most)
        except Exception as e:  # one bad request must not cost the others
            row = {"url": url, "http_status": None, "content_type": "", "final_url": url, "body": None, "error_type": "failed", "error": repr(e), "elapsed_ms": 0, "attempts": []}
        return row | {"header_key": key_of(headers)}

    def _opener(self, headers: dict[str, str], accept: str | None, probe: bool):
        def opener(url: str, timeout: float, most: int) -> Reply:
            reply = open_request(url, timeout, most, headers=headers, accept=accept, probe=probe, deadline=self.deadline, agent=self.agent)
            if "x-too-large" in reply.headers:
                raise TooLarge(f"{reply.headers['x-too-large']} of {most} bytes")
            return reply

        return opener


class TooLarge(Refused):
    """A body that is announced over the limit; none of it is read."""


def _probed(url: str, opener, timeout: float, limit: int) -> dict:
    """The one reply to a probe, whatever its status."""
    began = time.monotonic()
    row = {"url": url, "http_status": None, "content_type": "", "final_url": url, "body": None, "error_type": "", "error": ""}
    try:
        reply = opener(url, timeout, limit)
        ok = 200 <= reply.status < 300
        row |= {"http_status": reply.status, "content_type": reply.content_type, "final_url": reply.final_url or url, "body": reply.body}
        row |= {"error_type": "" if ok else "http_error", "error": "" if ok else f"status {reply.status}"}
    except Refused as e:
        row |= {"error_type": "refused", "error": str(e)}
    except TimeoutError as e:
        row |= {"error_type": "timeout", "error": str(e) or "timeout"}
    except OSError as e:
        timed = isinstance(getattr(e, "reason", None), TimeoutError)
        row |= {"error_type": "timeout" if timed else "network", "error": str(e)}
    elapsed = int((time.monotonic() - began) * 1000)
    attempt = {"attempt": 1, "status": "error" if row["error_type"] else "ok", "http_status": row["http_status"], "elapsed_ms": elapsed, "error_type": row["error_type"]}
    return row | {"elapsed_ms": elapsed, "attempts": [attempt]}


class HttpResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpResponses)


def key_of(headers: dict[str, str]) -> str:
    return "&".join(f"{k}={headers[k]}" for k in sorted(headers))


def requests(channels: DataFrame, *, read_limit: int | None = None, accept: str | None = None) -> DataFrame:
    """The different requests for channels (stream_url, which may carry headers after a bar)."""
    url, headers = urls.split_headers(F.col("stream_url"))
    rows = channels.select(url.alias("url"), headers.alias("headers")).where("url <> ''")
    one = rows.groupBy("url", urls.header_key(F.col("headers")).alias("k")).agg(F.any_value("headers").alias("headers"))
    return one.select("url", "headers", F.lit(accept).cast("string").alias("accept"), F.lit(read_limit).cast("int").alias("read_limit"))


def responses(requests: DataFrame, **options) -> DataFrame:
    """Responses to requests. Each evaluation asks anew: write them down to keep them."""
    spark = requests.sparkSession
    register(spark)
    path = fresh(spark, "requests")
    columns = [F.col(c) if c in requests.columns else F.lit(None).cast(kind).alias(c) for c, kind in REQUEST.items()]
    requests.select(*columns).write.parquet(path)
    return spark.read.format("http_responses").options(requests=path, **{k: str(v) for k, v in options.items()}).load()
