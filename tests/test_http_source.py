"""The HTTP data source against a server of this machine."""

import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tvloom.operators import health
from tvloom.sources import http_source

BODY = bytes(range(1, 251)) * 40  # 10,000 bytes


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.0"
    seen: list = []

    def log_message(self, *args):
        pass

    def answer(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        try:
            self.wfile.write(body)
        except OSError:
            pass

    def do_GET(self):
        path, wanted = self.path.split("?")[0], self.headers.get("Range")
        Handler.seen.append((self.path, wanted, self.headers.get("Referer"), self.headers.get("User-Agent"), self.headers.get("Accept")))
        if path == "/ranged" and wanted:
            first, last = map(int, wanted.removeprefix("bytes=").split("-"))
            self.answer(206, BODY[first : last + 1], Content_Type="video/mp2t")
        elif path in ("/ranged", "/plain"):
            self.answer(200, BODY, Content_Type="video/mp2t")
        elif path == "/416":
            self.answer(416, b"no such range")
        elif path == "/announced":
            self.answer(200, b"x", Content_Length="999999999")
        elif path == "/slow":
            self.send_response(200)
            self.end_headers()
            try:
                for _ in range(100):
                    self.wfile.write(b"x")
                    self.wfile.flush()
                    time.sleep(0.1)
            except OSError:
                pass
        elif path == "/off":
            self.answer(302, Location="ftp://elsewhere/x")
        elif path == "/file":
            self.answer(302, Location="file:///etc/passwd")
        elif path == "/moved":
            self.answer(302, Location="/plain")
        elif path == "/later":
            times = sum(s[0] == self.path for s in Handler.seen)
            self.answer(*((503, b"later") if times < 3 else (200, b"at last")))
        elif path == "/private":
            own = self.headers.get("Referer") == "http://me/"
            self.answer(200 if own else 403, b"#EXTM3U" if own else b"no", Content_Type="application/x-mpegURL")
        else:
            self.answer(404, b"not here")


@pytest.fixture(scope="module")
def server():
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def asked(spark, rows, **options):
    df = spark.createDataFrame(rows, ", ".join(map(" ".join, http_source.REQUEST.items())))
    return {r.url.rsplit("/", 1)[1]: r for r in http_source.responses(df, most_wait=0, **options).collect()}


def test_probes(spark, server):
    got = asked(spark, [(f"{server}/{p}", None, None, 100) for p in ("ranged", "plain", "416", "off", "file", "moved", "none", "announced")] + [("http://127.0.0.1:1/closed", None, None, 100), ("ftp://h/ftp", None, None, 100)])
    assert (got["ranged"].http_status, bytes(got["ranged"].body), got["ranged"].content_type) == (206, BODY[:100], "video/mp2t")
    assert (got["plain"].http_status, bytes(got["plain"].body)) == (200, BODY[:100])  # the server ignored the range
    assert (got["416"].http_status, got["416"].error_type, bytes(got["416"].body)) == (416, "http_error", b"no such range")
    assert got["off"].error_type == got["file"].error_type == got["ftp"].error_type == "refused" and got["file"].body is None
    assert got["moved"].final_url == f"{server}/plain" and got["none"].http_status == 404
    assert got["closed"].error_type == "network" and bytes(got["announced"].body) == b"x"
    assert next(s for s in Handler.seen if s[0] == "/ranged")[1:] == ("bytes=0-99", None, "tvloom", http_source.ACCEPT)


def test_downloads(spark, server):
    got = asked(spark, [(f"{server}/{p}", None, None, None) for p in ("plain", "later", "announced", "none", "off")], most_bytes=20_000)
    assert bytes(got["plain"].body) == BODY and got["plain"].error_type == ""
    assert (bytes(got["later"].body), [a.http_status for a in got["later"].attempts]) == (b"at last", [503, 503, 200])
    assert got["announced"].error_type == "refused" and got["none"].error_type == "http_error" and got["off"].error_type == "refused"
    assert asked(spark, [(f"{server}/plain", None, None, None)], most_bytes=9_999)["plain"].error_type == "too_large"
    assert asked(spark, [(f"{server}/plain", None, None, None)], most_bytes=10_000)["plain"].error_type == ""


def test_a_slow_body_ends_at_the_deadline(spark, server):
    began = time.monotonic()
    got = asked(spark, [(f"{server}/slow", None, None, 1000)], deadline=0.5, timeout=2)
    assert got["slow"].error_type == "timeout" and time.monotonic() - began < 9


def test_headers_of_channels(spark, server):
    """Two channels of one URL, one with the headers that it needs."""
    channels = spark.createDataFrame([(0, f"{server}/private|Referer=http%3A%2F%2Fme%2F&User-Agent=me"), (1, f"{server}/private"), (2, f"{server}/private|referer=http://me/&user-agent=me&other=x")], "ord long, stream_url string")
    channels = channels.withColumns({"name": F.lit("n"), "source_id": F.lit("s"), "attributes": F.expr("cast(map() as map<string,string>)")})
    wanted = http_source.requests(channels, read_limit=200)
    assert wanted.count() == 2
    told = spark.createDataFrame(http_source.responses(wanted).collect(), http_source.SCHEMA)
    assert {r.ord: (r.status != "offline", r.http_status) for r in health.probe(channels, told, now=1).collect()} == {0: (True, 200), 1: (False, 403), 2: (True, 200)}
    assert ("me", "http://me/") in {(s[3], s[2]) for s in Handler.seen if s[0] == "/private"}


def test_slices(spark, server, tmp_path):
    rows = [(f"{server}/plain?{i}", {"Referer": str(i)}, None, 10) for i in range(50)] + [(None, None, None, 5)]
    path = f"file://{tmp_path}/requests"
    spark.createDataFrame(rows, ", ".join(map(" ".join, http_source.REQUEST.items()))).coalesce(2).write.parquet(path)
    http_source.register(spark)
    reader = http_source.Reader({"requests": path, "slice": "7"})
    assert sum(p.end - p.begin for p in reader.partitions()) == 51 and all(p.end - p.begin <= 7 for p in reader.partitions())
    got = spark.read.format("http_responses").option("requests", path).option("slice", 7).load().collect()
    assert len(got) == 51 and sum(r.error_type == "refused" for r in got) == 1 and {r.header_key for r in got if r.http_status} == {f"Referer={i}" for i in range(50)}
    spark.createDataFrame([], ", ".join(map(" ".join, http_source.REQUEST.items()))).write.parquet(f"{path}-none")
    assert spark.read.format("http_responses").option("requests", f"{path}-none").load().collect() == []


def test_credentials_stay_with_their_host():
    request = urllib.request.Request("http://a/x", headers={"Authorization": "t", "Referer": "r"})
    kept, moved = (http_source._Redirects().redirect_request(request, None, 302, "", {}, url) for url in ("http://a/y", "http://b/x"))
    assert kept.has_header("Authorization") and moved.has_header("Referer") and not moved.has_header("Authorization")
    with pytest.raises(http_source.Refused):
        http_source._Redirects().redirect_request(request, None, 302, "", {}, "file:///x")
