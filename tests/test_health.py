from pyspark.sql import functions as F

from tvloom.functions import scores
from tvloom.operators import alternates, health, policy
from tvloom.plans.catalogue import NO_ATTRIBUTES, NO_DIRECTIVES

MASTER = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=3840x2160,CODECS=\"avc1\"\nbig.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=500,CODECS=\"av01\"\nbad.m3u8\n#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH=300,BANDWIDTH=9\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=400\nmid.m3u8"
MEDIA = "#EXTM3U\n#EXTINF:4,\nseg.ts\n"
NOW = 1_700_000_000


def probe(spark, urls, responses, deep=True, country=""):
    channels = spark.createDataFrame([(i, "n", u, "s") for i, u in enumerate(urls)], "ord long, name string, stream_url string, source_id string").withColumn("attributes", F.expr(NO_ATTRIBUTES))
    r = spark.createDataFrame([(u, s, t, u, bytearray(b), 100) for u, s, t, b in responses], "url string, http_status int, content_type string, final_url string, body binary, elapsed_ms int")
    return [(x.status, x.classification_reason, x.health_score) for x in health.probe(channels, r, now=NOW, deep=deep, expected_country=country).orderBy("ord").collect()]


def test_parts():
    found = health.parse_variants(MASTER, "http://h/d/m.m3u8")
    assert [(v["url"], v["bandwidth"]) for v in found] == [("http://h/d/big.m3u8", 900), ("http://h/d/bad.m3u8", 500), ("http://h/d/low.m3u8", 300), ("http://h/d/mid.m3u8", 400)]
    assert health.first_segment(MEDIA, "http://h/d/m") == "http://h/d/seg.ts" and health.first_segment("#EXTM3U\nx", "http://h") == ""
    assert health.first_segment('#EXT-X-PART:DURATION=1,URI="p.mp4"', "http://h/") == "http://h/p.mp4"
    assert health.detect_drm("#EXT-X-KEY:METHOD=SAMPLE-AES") and not health.detect_drm('#EXT-X-KEY:METHOD=AES-128,KEYFORMAT="identity"')


def test_media_bytes(spark):
    cases = [("", "", b"G123", True), ("", "", b"....ftypmp42", True), ("", "", b"....ftyp", False), ("", "video/mp4", b" <html>", False), ("http://x/a.ts?q", "", b"." * 64, True), ("http://x/a.ts", "", b"." * 63, False)]
    cases += [("http://x/?a.ts", "", b"." * 64, False), ("", "", b"\xff\xf1", True), ("", "", b"\xff\xe1", False), ("", "", b"." * 188 + b"G", True), ("", "Video/MP2T", b"x", True), ("", "video/mp2t", b"x#extm3u", False), (None, None, None, False), ("", None, b"\x1aE\xdf\xa3", True)]
    df = spark.createDataFrame([(u, t, None if b is None else bytearray(b), w) for u, t, b, w in cases], "url string, type string, body binary, wanted boolean")
    assert all(r.got == r.wanted for r in df.select("*", health.looks_like_media(df["url"], df["type"], df["body"]).alias("got")).collect())


def test_shallow(spark):
    got = probe(spark, ["a", "b", "c", "d", "e"], [("a", 200, "", b"x #extm3u"), ("b", 200, "Video/mp4", b"x"), ("c", 200, "text/html", b"x"), ("d", 200, "", b""), ("e", 404, "", b"")], deep=False)
    assert got == [("online", "hls_signature", 100), ("online", "media_content_type", 90), ("reachable", "payload_reachable", 50), ("offline", "empty_payload", 0), ("offline", "http_error", 0)]


def test_deep(spark):
    media = ("video/mp2t", b"G" * 200)
    urls = ["http://h/m", "http://h/gone", "http://h/drm", "http://h/none", "http://h/direct", "http://h/html", f"http://h/x?exp={NOW - 99}", "http://h/c?country=US", "http://h/only-av1", "http://h/plain"]
    responses = [
        ("http://h/m", 200, "", MASTER.encode()), ("http://h/mid.m3u8", 500, "", b""), ("http://h/low.m3u8", 200, "", MEDIA.encode()), ("http://h/seg.ts", 200, *media),
        ("http://h/drm", 200, "", b"#EXTM3U\n#EXT-X-KEY:METHOD=SAMPLE-AES"), ("http://h/none", 200, "", b"#EXTM3U\n"), ("http://h/direct", 200, *media), ("http://h/html", 200, "text/html", b"<html>"),
        (f"http://h/x?exp={NOW - 99}", 200, *media), ("http://h/c?country=US", 200, *media), ("http://h/only-av1", 200, "", b'#EXTM3U\n#EXT-X-STREAM-INF:CODECS="av01"\na'), ("http://h/plain", 200, "", MEDIA.encode()),
    ]
    got = probe(spark, urls, responses, country="IT")
    assert [r for _, r, _ in got] == ["hls_segment_verified", "network_error", "hls_drm_detected", "hls_no_media_segment", "direct_media_verified", "non_media_payload", "token_expired", "country_mismatch", "hls_unsupported_codec", "hls_segment_verified"]
    assert got[0][2] == 100 and got[4][2] == 92


def test_score(spark):
    df = spark.createDataFrame([("online", 100, 800, True), ("online", 10, 9000, True), ("offline", 100, 1, False)], "s string, b int, ms int, r boolean")
    assert [x.h for x in df.select(scores.health_score(F.col("s"), F.col("b"), F.col("ms"), F.col("r")).alias("h")).collect()] == [91, 1, 0]


def test_stats(spark):
    df = spark.createDataFrame([("online", 96, 100, False), ("reachable", 45, 300, True), ("offline", 0, 500, False)], "status string, health_score int, response_ms int, redirected boolean")
    s = health.stats(df).first()
    assert (s.average_score, s.average_response_ms, s.minimum_score, s.maximum_score, s.redirects, s.errors) == (47.0, 300.0, 0, 96, 1, 1)
    none = health.stats(df.where("false")).first()
    assert (none.checked_channels, none.average_score, none.maximum_score) == (0, 0.0, 0)


def test_policy(spark):
    entries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "unknown")], "ord long, url string")
    known = spark.createDataFrame([(1, "a", "online", "hls_signature", 200), (2, "b ", "offline", "http_error", 403), (3, "c", "offline", "http_error", 404), (4, "d", "offline", "hls_drm_detected", None)], "ord long, stream_url string, status string, classification_reason string, http_status int").withColumn("segment_http_status", F.lit(None).cast("int"))
    s = policy.policy_stats(policy.apply(entries, known)).first()
    assert (s.entries_seen, s.entries_published, s.hard_failures_removed, s.uncertain_kept) == (5, 3, 2, 1)


def test_recovery(spark):
    health_rows = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate([("p1", "offline"), ("b1", "online"), ("p2", "online"), ("b2", "online"), ("p3", "offline"), ("p4", "reachable")])], "ord long, stream_url string, status string")
    members = spark.createDataFrame([("1", "p1"), ("1", "b1"), ("2", "p2"), ("2", "b2"), ("3", "p3"), ("4", "p4")], "group_id string, stream_url string")
    initial = spark.createDataFrame([("1", "p1"), ("2", "p2"), ("3", "p3"), ("4", "p4")], "group_id string, stream_url string")
    final = spark.createDataFrame([("1", "b1"), ("2", "b2"), ("3", "p3"), ("4", "p4")], "group_id string, stream_url string")
    rows = policy.recovery(initial, final, members, health_rows)
    assert {r.group_id: r.outcome for r in rows.collect()} == {"1": "recovered_from_alternative", "2": "upgraded_to_better_alternative", "3": "all_candidates_failed", "4": "selected_primary"}
    assert policy.recovery_stats(rows).first().asDict() == {"selected_primary": 1, "recovered": 1, "upgraded": 1, "all_failed": 1}


def test_alternates(spark):
    id = "0123456789abcdef01234567"
    urls = [f"https://x.pluto.tv/v2/stitch/hls/channel/{id}/m.m3u8|a=b", f"http://pluto.tv/stitch/hls/channel/{id.upper()}/n", "https://pluto.tv/other", "http://z/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "ord long, stream_url string").selectExpr("'s' as source_id", "ord", "'n' as name", "stream_url", "'' as group", "'' as tvg_id", "'' as tvg_name", "'' as logo", f"{NO_ATTRIBUTES} as attributes", f"{NO_DIRECTIVES} as extra_directives")
    (made,) = alternates.generated(df).collect()
    assert made.stream_url == f"https://jmp2.uk/plu-{id}.m3u8" and made.attributes["original-source-id"] == "s" and made.source_id == "pluto_jmp2"
    s = alternates.stats(df).first()
    assert (s.generated_alternatives, s.skipped_duplicate_urls, s.direct_pluto_channels, s.missing_channel_id) == (1, 1, 2, 0)
    assert alternates.generated(alternates.expand(df)).count() == 0


def test_of_several_responses_the_least_status_counts(spark):
    got = probe(spark, ["a", "b"], [("a", 404, "", b""), ("a", 200, "", b"x"), ("b", None, "", b""), ("b", 503, "", b"")], deep=False)
    assert [r for _, r, _ in got] == ["payload_reachable", "http_error"]
