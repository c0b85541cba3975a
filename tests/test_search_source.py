"""Code searches against a server of this machine, and with a fetcher in its place."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from tvloom.operators.cluster import written
from tvloom.schemas import SOURCE
from tvloom.sources import catalog, search_source

RAW = f"https://{catalog.SEARCH_HOST}"


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def log_message(self, *args):
        pass

    def answer(self, status, value, **headers):
        body = json.dumps(value).encode() if not isinstance(value, bytes) else value
        self.send_response(status)
        for k, v in {"Content-Length": str(len(body)), **headers}.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        parts = urlsplit(self.path)
        asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
        Handler.seen.append((self.path, self.headers.get("Authorization"), self.headers.get("X-GitHub-Api-Version")))
        times = sum(s[0] == self.path for s in Handler.seen)
        here = f"http://{self.headers['Host']}"
        if parts.path.startswith("/file/"):
            n = int(parts.path.rsplit("/", 1)[1])
            self.answer(*((500, {"message": "lost"}) if n == 3 else (200, {"download_url": f"{RAW}/r/{n}.m3u" if n != 4 else "https://evil/4.m3u"})))
        elif asked["q"] == "broken":
            self.answer(200, b"<html>")
        elif asked["q"] == "forbidden":
            self.answer(403, {"message": "no more"}, Retry_After="0")
        elif times == 1 and asked["page"] == "2":
            self.answer(429, {"message": "slower"}, Retry_After="0")
        elif asked["page"] == "3":
            self.answer(422, {"message": "too far"})
        else:
            size, page = int(asked["per_page"]), int(asked["page"])
            numbers = range((page - 1) * size, page * size)
            items = [{"path": f"p/{n}.m3u" if n != 1 else "p/1.md", "url": f"{here}/file/{n}" if n != 2 else "http://other.example/file/2", "repository": {"full_name": "a/b"} if n else None} for n in numbers]
            self.answer(200, {"total_count": 1_000_000, "items": [*items, "no item"]})


@pytest.fixture(scope="module")
def server():
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def curated(spark):
    return spark.createDataFrame([(0, "own", "Own", f"{RAW}/r/5.m3u", True, 20, "playlist", "IT", "it", [], True, "country", 90, 6, "x")], SOURCE)


def test_pages_of_a_search(spark, server):
    rows = written(search_source.search(spark, ["lists", " ", "broken", "forbidden"], token="t", endpoint=f"{server}/search", per_page=4, pages=3, retries=1, most_wait=0), "search")
    sources, errors, stats = search_source.results(curated(spark), rows)
    # 0 and 6 are found, 5 is known, 1 is no playlist, 2 is on another host, 3 fails, 4 points elsewhere, 7 is found
    found = [r.url.rsplit("/", 1)[1] for r in sources.collect()]
    assert found[0] == "5.m3u" and sorted(found[1:]) == ["0.m3u", "6.m3u", "7.m3u"]
    assert {r.origin for r in sources.collect()} == {"x", "github", "a/b"} and all(r.tags[:2] == ["it", "italia"] for r in sources.where("origin <> 'x'").collect())
    assert sorted((r.query, r.message, r.status) for r in errors.collect()) == [("broken", "not JSON", 200), ("forbidden", "status 403: no more", 403), ("lists", "status 422: too far", 422), ("lists", "status 500: lost", 500)]
    assert stats.first().asDict() == {"curated_sources": 1, "queries": 3, "items": 8, "accepted_sources": 4, "duplicates_skipped": 1, "rejected_items": 3, "errors": 4}
    assert {s[1:] for s in Handler.seen} == {("Bearer t", search_source.VERSION)}
    assert [r.path for r in rows.where("error is null").orderBy("ord").collect()] == [f"p/{n}.m3u" if n != 1 else "p/1.md" for n in (0, 1, 2, 4, 5, 6, 7)]


def test_a_fetcher_in_place_of_the_network(spark):
    def fetch(url, headers):
        if "?" not in url:
            return {"download_url": f"{RAW}/x.m3u"} if url.endswith("1") else ["no object"]
        if "q=list" in url:
            return {"items": {}}
        return {"items": [{"path": "a.m3u", "url": "https://h/1"}, {"path": "b.m3u", "url": "https://h/2"}, {"path": None, "url": None}]}

    rows = search_source.search(spark, ["some", "list"], token=" t ", fetch=fetch, endpoint="https://h/s").collect()
    assert [(r.path, r.download_url, r.error) for r in rows] == [("a.m3u", f"{RAW}/x.m3u", None), ("b.m3u", "", None), ("", "", None), (None, None, "items isn't a list")]


def test_without_token_or_queries(spark):
    sources, errors, stats = search_source.results(curated(spark), search_source.search(spark, ["x"], token=" "))
    assert sources.count() == 1 and "no token" in errors.first().message and stats.first().errors == 1 and stats.first().queries == 0
    assert search_source.search(spark, [], token="t").count() == 0
    with pytest.raises(ValueError):
        search_source.search(spark, ["x"], token="t", per_page=31)


def test_discovery_never_ends_a_run(spark):
    def fetch(url, headers):
        raise KeyError("gone")

    sources, errors, stats = search_source.results_or_none(spark, curated(spark), lambda: written(search_source.search(spark, ["x"], token="t", fetch=fetch, endpoint="https://h/s"), "search"))
    assert sources.count() == 0 and errors.first().provider == "application" and "discovery isn't available" in errors.first().message and stats.first().errors == 1
    assert sources.schema == curated(spark).schema
