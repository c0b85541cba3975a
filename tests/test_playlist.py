from tvloom.sources import playlist


def parse(spark, text):
    return [df.collect() for df in playlist.parse(spark.createDataFrame([("s", text)], "source_id string, text string"))]


def test_quoted_comma_and_attributes(spark):
    channels, issues, stats = parse(spark, "﻿#EXTM3U\r\n#EXTINF:-1 TVG-ID=\"news-1\" group-title=\"News, Italia\" tvg-id='x\\'y' bare=z, Rai  News 24\r\n#KODI:a\r\nhttp://x/1\r\n".lstrip("﻿"))
    (c,) = channels
    assert (c.name, c.group, c.tvg_id, c.stream_url, c.extra_directives) == ("Rai News 24", "News, Italia", "x'y", "http://x/1", ["#KODI:a"])
    assert c.attributes == {"tvg-id": "x'y", "group-title": "News, Italia", "bare": "z"} and not issues and stats[0].channels_created == 1


def test_group_and_name_fall_back(spark):
    channels, _, _ = parse(spark, '#EXTINF:-1 tvg-name="N",\n#EXTGRP:Generali  Italia\n"http://x"\n')
    assert (channels[0].name, channels[0].group, channels[0].attributes["group-title"], channels[0].stream_url) == ("N", "Generali Italia", "Generali Italia", "http://x")


def test_issues(spark):
    text = "orphan\n#EXTINF:-1,A\n#EXTINF:-1,B\nhttp://b\nhttp://lost\n#EXTINF:-1 no comma\nhttp://c\n#EXTINF:-1,\nhttp://d\n#EXTINF:-1,E\n#only"
    channels, issues, stats = parse(spark, text)
    assert [c.name for c in channels] == ["B"]
    assert sorted((i.line_number, i.code) for i in issues) == [(1, "orphan_line"), (2, "abandoned_record"), (5, "orphan_line"), (6, "malformed_extinf"), (8, "missing_name"), (10, "missing_url")]
    s = stats[0]
    assert (s.extinf_records, s.channels_created, s.skipped_records, s.orphan_lines, s.abandoned_records, s.missing_url) == (5, 1, 4, 2, 1, 1)


def test_sources_are_apart(spark):
    df = spark.createDataFrame([("a", "#EXTINF:-1,A"), ("b", "http://x"), ("c", None)], "source_id string, text string")
    channels, issues, stats = playlist.parse(df)
    assert channels.count() == 0 and {(i.source_id, i.code) for i in issues.collect()} == {("a", "missing_url"), ("b", "orphan_line")} and stats.count() == 3


def test_look_ahead_dialects(spark):
    df = spark.createDataFrame([("s", '#EXTINF:-1 tvg-id="a" group-title="G",x, A\n#EXTINF:-1,B\nhttp://1\n#EXTINF:-1 tvg-name="T"\nhttp://2\n#EXTINF:-1,C\n#EXTINF:-1,D')], "source_id string, text string")
    v2 = [(r.name, r.url, r.group) for r in playlist.parse_ahead(df, swallow=True).orderBy("ord").collect()]
    assert v2 == [("A", "http://1", "G"), ("T", "http://2", ""), ("C", "", "")]
    web = [(r.name, r.url, r.group) for r in playlist.parse_ahead(df, swallow=False, default_group="Altro").orderBy("ord").collect()]
    assert web == [("A", "http://1", "G"), ("B", "http://1", "Altro"), ("T", "http://2", "Altro"), ("C", "", "Altro"), ("D", "", "Altro")]


def test_entries(spark):
    df = spark.createDataFrame([("s", "#EXTM3U\n#EXTINF:-1,A\nhttp://1\nhttp://2\n#x\n#extinf:b\n#EXTINF:-1,B")], "source_id string, text string")
    rows = playlist.entries(df).orderBy("ord").collect()
    assert [(r.ord, r.info, r.url, len(r.lines)) for r in rows] == [(0, None, "", 1), (1, "#EXTINF:-1,A", "http://2", 5), (2, "#EXTINF:-1,B", "", 1)]
