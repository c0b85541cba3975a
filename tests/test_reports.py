import json

from pyspark.sql import functions as F

from tvloom.operators import numbering, reports


def test_numbers_in_a_global_order(spark):
    """As a sort of all rows numbers them, many ties included."""
    rows = spark.range(100_000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v"), F.lit(-1).alias("ord")).repartition(9)
    got = numbering.numbered(rows, [F.desc("k"), "v"], start=1).collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.ord)] == sorted(((i * 7919 % 1000, i) for i in range(100_000)), key=lambda x: (-x[0], x[1]))
    assert sorted(r.ord for r in numbering.numbered(rows, ["k"]).collect()) == list(range(100_000))
    assert numbering.numbered(rows.where("false"), ["k"]).collect() == []


HEALTH = "ord long, name string, stream_url string, source_id string, status string, http_status int, health_score double"


def test_health_and_device_reports(spark, tmp_path):
    health = spark.createDataFrame([(2, "b", "http://pluto.tv/b", "s", "offline", None, 0.0), (0, "é", "http://pluto.tv/a", "s", "online", 200, 96.0), (1, "c", "http://c", "s", "reachable", 200, 65.0)], HEALTH).repartition(3)
    counts = reports.health_report(health, f"file://{tmp_path}/h.json", recovery={"recovered": 1}, version="1")
    got = json.loads((tmp_path / "h.json").read_text())
    assert counts == {"checked": 3, "online": 1, "reachable": 1, "offline": 1} and got["checked"] == 3 and got["alternative_recovery"] == {"recovered": 1} and got["version"] == "1"
    assert [c["name"] for c in got["channels"]] == ["é", "c", "b"] and got["channels"][2]["http_status"] is None
    channels = spark.createDataFrame([(0, "Pluto A", "http://pluto.tv/a", "s", "g"), (1, "Pluto B", " http://pluto.tv/b", "s", "g"), (2, "again", "http://pluto.tv/a ", "s", "g"), (3, "other", "http://c", "s", "g"), (4, "Pluto C", "http://pluto.tv/unknown", "s", "g")], "ord long, name string, stream_url string, source_id string, group string")
    counts = reports.device_report(channels, health, f"{tmp_path}/d.json")
    got = json.loads((tmp_path / "d.json").read_text())
    assert counts == {"checked": 3, "accepted": 1, "rejected": 2} and got["minimum_score"] == 70
    assert [(c["name"], c["accepted"], (c["health"] or {}).get("status")) for c in got["channels"]] == [("Pluto A", True, "online"), ("Pluto B", False, "offline"), ("Pluto C", False, None)]
    assert reports.health_report(health.where("false"), f"{tmp_path}/e.json", enabled=False) == {"checked": 0, "online": 0, "reachable": 0, "offline": 0}
    assert json.loads((tmp_path / "e.json").read_text())["channels"] == []


def test_source_diagnostics(spark):
    sources = spark.createDataFrame([(0, "a", "http://a", True), (1, "b", "http://b", True), (2, "c", "/local", True), (3, "d", "http://d", False), (4, "e", "http://e", True)], "ord long, id string, url string, enabled boolean")
    attempt = lambda n, s, e: (n, "error" if e else "ok", s, 5, e)
    rows = [("http://a", 200, "text/plain", "http://a2", bytearray(b"12345"), "", "", 9, [attempt(1, 503, "http_error"), attempt(2, 200, "")]), ("http://b", 503, "", "http://b", None, "http_error", "status 503", 5, [attempt(1, 503, "http_error")]), ("http://d", 200, "", "http://d", bytearray(b"1"), "", "", 5, [attempt(1, 200, "")])]
    responses = spark.createDataFrame(rows, f"url string, http_status int, content_type string, final_url string, body binary, error_type string, error string, elapsed_ms int, attempts {reports.ATTEMPTS}")
    parsed = spark.createDataFrame([("a", 3), ("c", 2)], "source_id string, channels_created long")
    got = {r.source_id: r for r in reports.source_diagnostics(sources, responses, parsed).collect()}
    assert {k: (r.status, r.attempt_count, r.bytes_downloaded, r.retryable, r.channels_created) for k, r in got.items()} == {"a": ("success", 2, 5, False, 3), "b": ("error", 1, 0, True, 0), "c": ("success", 0, 0, False, 2), "d": ("disabled", 0, 0, False, 0), "e": ("error", 0, 0, False, 0)}
    assert got["a"].final_url == "http://a2" and got["b"].error == "status 503" and got["e"].error == "no response" and got["d"].final_url == ""


def test_run_metrics():
    got = reports.run_metrics(10, 12, 7, 6, 6)
    assert got["merger_duplicates_removed"] == 5 and got["channels_filtered_unavailable"] == 1 and got["post_merge_duplicates_removed"] == 0 and got["duplicates_removed"] == 4
    assert reports.run_metrics(1, 1, 2, 3, 4)["duplicates_removed"] == 0
