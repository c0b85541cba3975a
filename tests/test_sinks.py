import json

import pytest
from pyspark.sql import functions as F

from tvloom.operators import export
from tvloom.sinks import ordered_file, rewrite
from tvloom.sources import xmltv


def test_many_parts_in_order(spark, tmp_path):
    """Rows of several sections from several tasks, empty sections and parts included."""
    rows = spark.range(1000).selectExpr("cast(id % 4 as int) as section", "id").where("section <> 2").repartition(7)
    ordered = rows.orderBy("section", F.desc("id")).select("section", F.col("id").cast("string").alias("line"))
    ordered_file.write(ordered, f"file://{tmp_path}/deep/x.txt", heads=["[", "|", "!", "?", "."], separator=",", tail="]")
    by = [",".join(str(i) for i in range(999, -1, -1) if i % 4 == k) for k in range(4)]
    assert (tmp_path / "deep/x.txt").read_text() == f"[{by[0]}|{by[1]}!?{by[3]}.]"
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["x.txt"]


def test_no_rows(spark, tmp_path):
    ordered_file.write(spark.createDataFrame([], "section int, line string"), f"{tmp_path}/x", heads=["a", "b"], tail="c")
    assert (tmp_path / "x").read_text() == "abc"


def test_a_failure_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "x"
    path.write_text("old")
    bad = spark.range(100, numPartitions=4).select(F.lit(0).alias("section"), F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="no"):
        ordered_file.write(bad, str(path))
    with pytest.raises(Exception, match="ordered"):
        ordered_file.write(spark.createDataFrame([(1, "a"), (0, "b")], "section int, line string").coalesce(1), str(path), heads=["", ""])
    assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["x"]


PLAYLIST = """﻿#EXTM3U x
# note

#EXTINF:-1 tvg-id="Rai1.it@SD",Rai 1 (720p)
#EXTVLCOPT:a
http://one

#EXTINF:-1 tvg-id="Rai1.it",Rai 1 G
http://two
#EXTINF:-1,DMAX
http://three
#EXTINF:-1,La7
http://four


"""


def test_policy_in_place(spark, tmp_path):
    path, report = tmp_path / "p.m3u", tmp_path / "policy.json"
    path.write_text(PLAYLIST, encoding="utf-8")
    health = spark.createDataFrame([(0, "http://one", "online", "", None, None), (1, " http://two", "offline", "http_error", "404", None), (2, "http://three", "offline", "http_error", "503", None)], "ord long, stream_url string, status string, classification_reason string, http_status string, segment_http_status string")
    got = rewrite.apply_policy(spark, [str(path), f"{tmp_path}/none"], health, report=str(report))
    assert got["files"][0] == {"file": str(path), "entries_seen": 4, "entries_published": 3, "hard_failures_removed": 1, "uncertain_kept": 1}
    assert got["files"][1]["entries_seen"] == 0 and got["policy"] == rewrite.POLICY and 404 in got["hard_http_statuses"]
    assert json.loads(report.read_text()) == got
    lines = PLAYLIST.removeprefix("﻿").split("\n")
    assert path.read_text() == "\n".join(lines[:7] + lines[9:13]) + "\n"
    # once more changes nothing
    before = path.read_text()
    assert rewrite.apply_policy_to(spark, str(path), health)["hard_failures_removed"] == 0 and path.read_text() == before
    assert rewrite.apply_policy(spark, [str(path)], None)["reason"] == "health_report_missing"
    assert rewrite.apply_policy(spark, [str(path)], health, enabled=False, report=str(report))["reason"] == "health_disabled" and json.loads(report.read_text())["files"] == []


def test_dedupe_in_place(spark, tmp_path):
    path = tmp_path / "p.m3u"
    path.write_text(PLAYLIST.removeprefix("﻿"), encoding="utf-8")
    assert rewrite.dedupe_outputs(spark, [str(path), f"{tmp_path}/none"]) == {str(path): 1}
    lines = PLAYLIST.removeprefix("﻿").split("\n")
    assert path.read_text() == "\n".join(lines[:7] + lines[9:13]) + "\n"
    assert rewrite.dedupe_file(spark, str(path)) == 0
    path.write_text("")
    assert rewrite.dedupe_file(spark, str(path)) == 0 and path.read_text() == "\n"


def test_unified_xmltv(spark, tmp_path):
    channels = spark.createDataFrame([("b", "B & C", ""), ("a", "A", "http://i?x=\"1\"")], "channel_id string, name string, logo string")
    programmes = spark.createDataFrame([("a", "20240101200000 +0000", "20240101210000 +0000", "T<1>", "d", "", None)], "channel_id string, start string, stop string, title string, description string, category string, icon string")
    export.write_unified_xmltv(channels, programmes, f"{tmp_path}/g.xml")
    documents = spark.createDataFrame([(0, "u", "g.xml", bytearray((tmp_path / "g.xml").read_bytes()))], "doc_ord long, source_url string, filename string, body binary")
    items = xmltv.read_items(documents)
    assert [(r.channel_id, r.display_names) for r in xmltv.channels(items).orderBy("channel_id").collect()] == [("a", ["A"]), ("b", ["B & C"])]
    assert [(r.title, r.description, r.categories) for r in xmltv.programmes(items).collect()] == [("T<1>", "d", [])]
