"""A code search as a data source: the pages of each query, and the file that each item of a page points at.

    rows = search_source.search(spark, queries, token=token, pages=3)
    sources, errors, stats = search_source.results(curated, rows)

The first page of a query is asked for when the plan is made, as its count says how many follow; each page is a partition.
What a server refuses for its rate (403, 429) or may mend (5xx) is tried again after the time it names. A page or an item that
fails costs no other: it is a row with its error. Items are followed on the search's own host only, so that the token goes nowhere else.

`fetch(url, headers)`, which returns the decoded answer or raises SearchError, can stand in for the network.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.constants import RETRYABLE
from . import catalog
from .fetch import Refused, waiting
from .http_source import open_request

SCHEMA = "query string, ord long, path string, repository string, download_url string, error string, status int"
ERROR = "provider string, query string, message string, status int"
MOST_BYTES = 5_000_000
#: The service's address, version, answer type and bound of results, and what is asked by default.
ENDPOINT = "https://api.github.com/search/code"
VERSION = "2022-11-28"
ACCEPT = "application/vnd.github+json"
MOST_RESULTS = 1000
QUERIES = [
    '"tvg-country=\\"IT\\"" extension:m3u',
    '"tvg-language=\\"Italian\\"" extension:m3u',
    '"group-title=\\"Italy\\"" extension:m3u',
    '"Rai 1" extension:m3u',
    '"Canale 5" extension:m3u',
]
#: Fixed value: tags of found sources.
TAGS = ["it", "italia", "italian", "rai", "mediaset", "dmax", "focus", "nove"]


class SearchError(RuntimeError):
    """An answer that can't be used."""

    def __init__(self, message: str, status: int | None = None, headers: dict[str, str] | None = None):
        super().__init__(message)
        self.status, self.headers = status, headers or {}


def fetch_json(url: str, headers: dict[str, str], timeout: float = 20):
    """The decoded answer of an address."""
    try:
        reply = open_request(url, timeout, MOST_BYTES, headers=headers, deadline=6 * timeout)
    except Refused as e:
        raise SearchError(str(e)) from e
    except TimeoutError as e:
        raise SearchError("timeout") from e
    except OSError as e:
        raise SearchError(f"network error: {getattr(e, 'reason', e)}") from e
    if not 200 <= reply.status < 300:
        try:
            detail = json.loads(reply.body.decode("utf-8", "replace"))
        except json.JSONDecodeError:
            detail = None
        detail = str(detail.get("message") or "").strip() if isinstance(detail, dict) else ""
        raise SearchError(f"status {reply.status}" + (f": {detail}" if detail else ""), reply.status, reply.headers)
    if len(reply.body) > MOST_BYTES or "x-too-large" in reply.headers:
        raise SearchError(f"over {MOST_BYTES} bytes", reply.status)
    try:
        return json.loads(reply.body.decode("utf-8"))
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise SearchError("not JSON", reply.status) from e


class Page(InputPartition):
    """A page of a query: to ask for, or as answered, or why it wasn't."""

    def __init__(self, query: int, page: int, answer: dict | None = None, error: SearchError | None = None):
        self.query, self.page, self.answer = query, page, answer
        self.error, self.status = (str(error), error.status) if error else ("", None)


class Reader(DataSourceReader):
    def __init__(self, queries: list[str], fetch: Callable, token: str, endpoint: str, agent: str, per_page: int, pages: int, retries: int, most_wait: float):
        self.queries, self.fetch, self.endpoint, self.per_page, self.pages = queries, fetch, endpoint, per_page, pages
        self.retries, self.most_wait = retries, most_wait
        self.headers = {"Accept": ACCEPT, "User-Agent": agent, "X-GitHub-Api-Version": VERSION, "Authorization": f"Bearer {token}"}

    def _ask(self, url: str):
        for attempt in range(1, self.retries + 2):
            try:
                return self.fetch(url, dict(self.headers))
            except SearchError as e:
                if attempt > self.retries or (e.status != 403 and e.status not in RETRYABLE):
                    raise
                time.sleep(waiting(attempt, e.headers, 1.0, self.most_wait))

    def _page(self, query: int, page: int) -> dict:
        answer = self._ask(f"{self.endpoint}?{urlencode({'q': self.queries[query], 'per_page': self.per_page, 'page': page})}")
        if not isinstance(answer, dict):
            raise SearchError("the answer isn't an object")
        if not isinstance(answer.get("items", []), list):
            raise SearchError("items isn't a list")
        return answer

    def partitions(self) -> list[Page]:
        planned = []
        for query in range(len(self.queries)):
            try:
                answer = self._page(query, 1)
            except SearchError as e:
                planned.append(Page(query, 1, error=e))
                continue
            planned.append(Page(query, 1, answer))
            total = answer.get("total_count")
            last = math.ceil(min(total if isinstance(total, int) else 0, MOST_RESULTS) / self.per_page)
            planned += [Page(query, page) for page in range(2, min(last, self.pages) + 1)]
        return planned or [Page(0, 1, {})]

    def read(self, part: Page) -> Iterator[tuple]:
        query = self.queries[part.query] if self.queries else ""
        place = ((part.query << 20) + part.page << 20) + 1
        if part.error:
            yield query, place, None, None, None, part.error, part.status
            return
        try:
            answer = part.answer if part.answer is not None else self._page(part.query, part.page)
        except SearchError as e:
            yield query, place, None, None, None, str(e), e.status
            return
        for at, item in enumerate(i for i in answer.get("items", []) if isinstance(i, dict)):
            path, url, repository = (item.get(k) for k in ("path", "url", "repository"))
            path, url = str(path or "").strip(), str(url or "").strip()
            name = str(repository.get("full_name") or "").strip() if isinstance(repository, dict) else ""
            try:
                yield query, place + at, path, name, self._address(path, url), None, None
            except SearchError as e:
                yield query, place + at, path, name, "", str(e), e.status

    def _address(self, path: str, url: str) -> str:
        """Where an item's file is; empty: it isn't a playlist, or nowhere."""
        if not url or not urlsplit(path).path.casefold().endswith(tuple(catalog.SEARCH_SUFFIXES)):
            return ""
        own, other = urlsplit(self.endpoint), urlsplit(url)
        if (own.scheme, own.netloc) != (other.scheme, other.netloc):
            return ""
        answer = self._ask(url)
        return str(answer.get("download_url") or "").strip() if isinstance(answer, dict) else ""


def search(
    spark: SparkSession, queries: list[str] = QUERIES, *, token: str, fetch: Callable = fetch_json, endpoint: str = ENDPOINT, agent: str = "tvloom",
    per_page: int = 5, pages: int = 1, retries: int = 3, most_wait: float = 60,
) -> DataFrame:
    """Items of queries, up to `pages` pages of `per_page` each. Without a token nothing is asked: one row says so. Each evaluation asks anew."""
    if not 1 <= per_page <= 30 or pages < 1 or retries < 0:
        raise ValueError("per_page must be 1 to 30, pages at least 1, retries at least 0")
    token, asked = (token or "").strip(), [q.strip() for q in queries if q and q.strip()]
    if not token:
        return spark.createDataFrame([("", 0, None, None, None, "no token: the search is left out", None)], SCHEMA)

    # the token and the fetcher travel in the class: options are shown with plans
    class CodeSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "code_search"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> Reader:
            return Reader(asked, fetch, token, endpoint, agent, per_page, pages, retries, most_wait)

    spark.dataSource.register(CodeSearch)
    return spark.read.format("code_search").load()


def results(curated: DataFrame, rows: DataFrame, tags: list[str] = TAGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources (curated first, the first of a URL), errors, and one row of counts, of a search's written rows."""
    items = rows.where("error is null")
    made, _ = catalog.search_results(items, tags)
    sources = catalog.discover(curated, made, strict=False)
    errors = rows.where("error is not null").select(F.lit("github").alias("provider"), "query", F.col("error").alias("message"), "status")
    seen = F.col("query") != ""
    kinds = [
        rows.select(F.lit("row").alias("kind"), F.when(seen, F.col("query")).alias("query"), F.col("path").isNotNull().alias("item"), F.col("error").isNotNull().alias("bad"), (F.col("error").isNull() & catalog.is_playlist_item()).alias("good")),
        *[df.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("query"), *[F.lit(False).alias(c) for c in ("item", "bad", "good")]) for kind, df in (("curated", curated), ("source", sources))],
    ]
    flags = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    count = lambda condition: F.count_if(condition)
    is_row, good = F.col("kind") == "row", count(F.col("good"))
    stats = flags.agg(
        count(F.col("kind") == "curated").alias("curated_sources"),
        F.count_distinct("query").alias("queries"),
        count(F.col("item")).alias("items"),
        count(F.col("kind") == "source").alias("accepted_sources"),
        (count(F.col("kind") == "curated") + good - count(F.col("kind") == "source")).alias("duplicates_skipped"),
        (count(is_row & ~F.col("bad")) - good).alias("rejected_items"),
        count(F.col("bad")).alias("errors"),
    )
    return sources, errors, stats


def results_or_none(spark: SparkSession, curated: DataFrame, make: Callable[[], DataFrame], tags: list[str] = TAGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `results` of the written rows that make() returns; whatever it raises, no sources and that error: discovery never ends a run."""
    try:
        return results(curated, make(), tags)
    except Exception as e:  # any failure at all
        errors = spark.createDataFrame([("application", "", f"discovery isn't available: {e}", None)], ERROR)
        stats = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 1)], "curated_sources long, queries long, items long, accepted_sources long, duplicates_skipped long, rejected_items long, errors long")
        return curated.limit(0), errors, stats
