import json

import pytest

from tvloom.operators import source_registry as sr
from tvloom.sources import catalog, fetch


@pytest.fixture
def sources(spark, tmp_path):
    rows = [
        {"id": "a", "name": "A", "url": "https://H.test:443/x", "country": "Italia", "tags": ["Rai ", "rai", "x y"], "trust_score": 80},
        {"id": "A", "name": "again", "url": "https://other/"}, {"id": "b", "name": "B", "url": "https://h.test/x#f"}, {"id": "c", "name": "C", "url": "/local/file", "enabled": False, "priority": 5, "kind": "API"},
        {"id": "bad id", "name": "D", "url": "https://d"}, {"id": "e", "name": "E", "url": "ftp://e"}, {"id": "f", "name": "F", "url": "https://f", "discovery_enabled": True},
    ]
    (tmp_path / "one.json").write_text(json.dumps({"sources": rows}))
    (tmp_path / "two.json").write_text(json.dumps({"sources": [{"id": "z", "name": "Z", "url": "https://z", "language": "ITA", "tags": ["it"]}]}))
    return catalog.read_catalogs(spark, str(tmp_path))


def test_catalog(sources, spark, tmp_path):
    rows = sources.orderBy("ord").collect()
    assert [r.id for r in rows] == ["a", "A", "b", "c", "bad id", "e", "f", "z"] and rows[0].tags == ["rai", "x_y"] and rows[0].country == "IT" and rows[3].kind == "api" and rows[-1].language == "it"
    assert rows[1].priority == 100 and rows[1].trust_score == 50
    (tmp_path / "none").mkdir()
    assert catalog.read_catalogs(spark, str(tmp_path / "none")).count() == 0


def test_registering(sources):
    kept, bad, counts = sr.add(sources)
    assert sorted(r.id for r in kept.collect()) == ["a", "c", "z"]
    assert {r.id: r.error for r in bad.collect()} == {"bad id": "bad id", "e": "unsupported scheme", "f": "discovery with a static mode"}
    c = counts.first()
    assert (c.inserted, c.skipped, c.invalid) == (3, 2, 3)
    actions = {r.ord: (r.action, r.place) for r in sr.upsert(sources).collect()}
    assert actions[1] == ("replaced", 0) and actions[0] == ("inserted", None) and actions[2] == ("inserted", 2)


def test_search(sources):
    kept, _, _ = sr.add(sources)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(sr.search(kept)) == ["c", "a", "z"] and ids(sr.search(kept, country="it")) == ["a"] and ids(sr.search(kept, country="it", match_unclassified=True, enabled_only=True)) == ["a", "z"]
    assert ids(sr.search(kept, tags=["RAI", "none"])) == ["a"] and ids(sr.search(kept, kinds=["api"])) == ["c"] and ids(sr.search(kept, remote_only=False)) == ["c"]
    assert ids(sr.search(kept, min_trust_score=60)) == ["a"] and ids(sr.italian_sources(kept)) == ["a"] and ids(sr.snapshot(kept, enabled=True)) == ["a", "z"]
    with pytest.raises(ValueError):
        sr.search(kept, min_trust_score=101)
    assert sr.set_value(kept, "A", enabled=False).where("enabled").count() == 1 and sr.remove(kept, "z").count() == 2
    s = sr.stats(kept).first()
    assert (s.total, s.enabled, s.remote, s.discovery, s.trusted, s.kinds) == (3, 2, 2, 1, 1, {"api": 1, "playlist": 2})


def test_code_search(spark):
    host = f"https://{catalog.SEARCH_HOST}"
    items = spark.createDataFrame([(0, "a.m3u", "r", f"{host}/1.m3u"), (1, "b.M3U8", "r", f"{host}/1.m3u#x"), (2, "c.md", "r", f"{host}/2.m3u"), (3, "d.m3u", "r", "https://evil/3.m3u"), (4, "e.txt", "r", f"{host}/4.TXT?raw=1"), (5, "f.m3u", "r", f"{host}/5")], "ord long, path string, repository string, download_url string")
    made, counts = catalog.search_results(items)
    assert sorted(r.ord for r in made.collect()) == [0, 4] and all(len(r.id) == 33 for r in made.collect())
    assert counts.first().asDict() == {"seen": 6, "accepted": 2, "duplicates": 1, "rejected": 3}


class Server:
    def __init__(self, *replies):
        self.replies, self.slept = list(replies), []

    def __call__(self, url, timeout, most):
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def get(*replies, **options):
    server = Server(*replies)
    return fetch.fetch_one("http://x", server, sleep=server.slept.append, **options), server


def test_retries():
    row, server = get(fetch.Reply(503, b"", headers={"Retry-After": "99"}), OSError("down"), fetch.Reply(200, b"ok", "text/plain", "http://y"))
    assert (row["error_type"], row["body"], row["final_url"], [a["attempt"] for a in row["attempts"]], server.slept) == ("", b"ok", "http://y", [1, 2, 3], [3.0, 2.0])
    assert get(fetch.Reply(404, b""))[0]["error_type"] == "http_error" and get(fetch.Reply(200, b" "))[0]["error_type"] == "empty"
    assert get(fetch.Reply(200, b"12345"), most_bytes=4)[0]["error_type"] == "too_large"
    row, server = get(*[fetch.Reply(500, b"")] * 4)
    assert len(row["attempts"]) == 4 and server.slept == [1.0, 2.0, 3.0]


def test_fetch_table(spark):
    def answer(url, timeout, most):
        return fetch.Reply(200, url.encode()) if "good" in url else fetch.Reply(404, b"")

    rows = fetch.fetch(spark.createDataFrame([("http://good",), ("http://bad",), ("http://good",)], "url string"), answer, workers=2)
    s = fetch.download_summary(rows).first()
    assert (s.attempted, s.successful, s.failed, s.attempts, s.retries) == (2, 1, 1, 2, 0)


def test_bodies_and_paths():
    assert fetch.decode_body("﻿é".encode()) == "é" and fetch.decode_body("é".encode("latin-1"), "text/x; charset=ISO-8859-1") == "é" and fetch.decode_body(b"\xff", "a; charset=none") == "�"
    assert fetch.local_path("file:///a%20b", "/r") == "/a b" and fetch.local_path("x/y", "/r") == "/r/x/y" and fetch.local_path("/z", "/r") == "/z"


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"health_enabled": "sì", "retries": "2", "epg_sources": [" a ", "a", "", "b"], "unknown": 1}))
    s = catalog.Settings.load(str(path))
    assert (s.health_enabled, s.retries, s.epg_sources) == (True, 2, ("a", "b"))
    for bad in ({"health_enabled": "maybe"}, {"retries": -1}, {"health_workers": 0}, {"epg_sources": "x"}, []):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            catalog.Settings.load(str(path))


def test_settings_by_the_names_of_files(tmp_path):
    path = tmp_path / "s.json"
    names = {"output_file": " a/p.m3u ", "request_timeout_seconds": 30, "retry_count": "3", "user_agent": "TV", "health_timeout_seconds": 15, "health_max_workers": 8, "pluto_minimum_score": 70.5, "pluto_max_workers": 16, "pluto_timeout_seconds": 8, "pluto_playback_enabled": "no", "samsung_output_file": "d.m3u", "epg_public_url": "http://g", "epg_timeout_seconds": 9, "strange": 1}
    path.write_text(json.dumps(names))
    s = catalog.Settings.load(str(path))
    assert (s.output_file, s.request_timeout, s.retries, s.user_agent, s.health_timeout, s.health_workers) == ("a/p.m3u", 30, 3, "TV", 15, 8)
    assert (s.device_min_score, s.device_workers, s.device_timeout, s.device_enabled, s.device_output_file, s.epg_public_url, s.epg_timeout) == (70.5, 16, 8, False, "d.m3u", "http://g", 9)
    assert catalog.Settings.unknown(str(path)) == ["strange"]
    for bad in ({"output_file": " "}, {"user_agent": 5}, {"epg_timeout_seconds": 0}, {"retry_count": True}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            catalog.Settings.load(str(path))
