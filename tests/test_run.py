import json
from pathlib import Path

from pyspark.sql import functions as F

from tvloom.operators import export, guide
from tvloom.plans import run
from tvloom.plans.catalogue import NO_ATTRIBUTES, NO_DIRECTIVES
from tvloom.sources import probes
from tvloom.sources.catalog import Settings


def channel_rows(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, name string, group string, stream_url string")
    return df.selectExpr("'s' as source_id", "ord", "name", "stream_url", "group", "'' as tvg_id", "'' as tvg_name", "'' as logo", f"{NO_ATTRIBUTES} as attributes", f"{NO_DIRECTIVES} as extra_directives")


def test_category_order(spark):
    df = channel_rows(spark, [("DMAX", "", "u1"), ("Rai 2", "", "u2"), ("Canale 5", "", "u3"), ("Rai 1", "", "u4"), ("Rai Sport", "Sport", "u5"), ("TGR Lazio", "", "u6"), ("Unknown", "Kids", "u7"), ("Plain", "", "u8")])
    lines = [r.entry.split("\n") for r in export.playlist(df).collect()]
    assert [x[0].rsplit(",", 1)[1] for x in lines] == ["Rai 1", "Rai 2", "Rai Sport", "Canale 5", "DMAX", "TGR Lazio", "Unknown", "Plain"]
    assert lines[0] == ['#EXTINF:-1 group-title="RAI",Rai 1', "u4"]


def test_attributes_and_escapes(spark):
    df = channel_rows(spark, [("N", "", "u")]).withColumn("attributes", F.expr("map('z', 'a\"b', 'b', '1', 'tvg-id', 'old', 'group-title', 'x')")).withColumn("tvg_id", F.lit("new")).withColumn("extra_directives", F.array(F.lit(" #D:100 "), F.lit(""), F.lit("#E:21")))
    assert export.playlist(df).first().entry == '#EXTINF:-1 tvg-id="new" group-title="ALTRO" b="1" z="a\'b",N\n#D:100\n#E:21\nu'
    assert export.header('http://g/"x') == "#EXTM3U url-tvg=\"http://g/'x\""


def test_whole_run(spark, tmp_path):
    texts = spark.createDataFrame([("one", "#EXTM3U\n#EXTINF:-1 tvg-id=\"Rai1.it\",Rai 1 SD\nhttp://a\n#EXTINF:-1,DMAX\nhttp://gone\n#EXTINF:-1,broken"), ("two", "#EXTINF:-1,Rai 1 HD\nhttps://b\n"), ("off", "#EXTINF:-1,No\nhttp://no")], "source_id string, text string")
    sources = spark.createDataFrame([(0, "one", 1, True), (1, "two", 50, True), (2, "off", 1, False)], "ord long, id string, priority int, enabled boolean")
    responses = spark.createDataFrame([("http://a", 503, "", "http://a", bytearray(b""), 10), ("https://b", 200, "", "https://b", bytearray(b"#EXTM3U"), 10), ("http://gone", 404, "", "http://gone", bytearray(b""), 10)], "url string, http_status int, content_type string, final_url string, body binary, elapsed_ms int")
    xml = '<tv><channel id="rai1.it"><display-name>Rai 1</display-name><icon src="http://i"/></channel><channel id="other"/><programme channel="rai1.it" start="20240101200000"><title>A &amp; B</title></programme></tv>'
    documents = spark.createDataFrame([(0, "u", "f", bytearray(xml.encode())), (1, "v", "f", bytearray(b"no"))], "doc_ord long, source_url string, filename string, body binary")
    report = run.run(spark, texts, sources, responses, documents, str(tmp_path), Settings(), now=1, log=f"{tmp_path}/log")
    assert report["history"] == {"known": 3, "never_good": 2, "failing": 0}
    lines = (tmp_path / "playlist.m3u").read_text().splitlines()
    assert lines == ["#EXTM3U", '#EXTINF:-1 tvg-id="rai1.it" tvg-name="Rai 1" tvg-logo="http://i" group-title="RAI",Rai 1 HD', "https://b"]
    guide_text = (tmp_path / "epg.xml").read_text()
    assert "A &amp; B" in guide_text and "other" not in guide_text and guide_text.strip().endswith("</tv>")
    assert report["recovery"]["recovered"] == 1 and report["policy"]["hard_failures_removed"] == 1 and report["parser"]["missing_url"] == 1 and report["guide"] == "written"
    assert json.loads((tmp_path / "report.json").read_text())["groups"]["groups"] == 2
    none = documents.where("doc_ord = 1")
    assert run.run(spark, texts, sources, responses, none, str(tmp_path), Settings(), now=2)["guide"] == "kept_after_failed_fetch" and (tmp_path / "epg.xml").read_text() == guide_text


def test_identities(spark):
    seed = spark.createDataFrame([(0, "it.rai.rai1", "Rai 1", ["Rai1.it", "Rai 1 G"], "RAI"), (1, "it.la7", "LA7", [], "X")], "ord long, channel_id string, name string, aliases array<string>, category string")
    rows = spark.createDataFrame([(0, "Other", "Rai1.it@SD", "", "u1"), (1, "LA7 HD", "", "", "u2"), (2, "New Channel!", "", "", "u3"), (3, "Rai 1 (720p)", "", "", "u1"), (4, "", "", "", "")], "ord long, name string, tvg_id string, tvg_name string, url string")
    found = guide.resolve(rows, seed)
    assert [(r.channel_id, r.matched_by) for r in found.orderBy("ord").collect()] == [("it.rai.rai1", "seed_alias"), ("it.la7", "seed_alias"), ("it.auto.new.channel", "derived"), ("it.rai.rai1", "seed_alias"), ("it.auto.unknown", "derived")]
    one = {r.channel_id: r for r in guide.build_entities(found).collect()}["it.rai.rai1"]
    assert one.aliases == ["Other", "Rai 1 (720p)", "Rai1.it@SD"] and one.streams == ["u1"]


def test_priority_merge(spark):
    df = spark.createDataFrame([(0, "c", "s", "e", " News", 50), (1, "c", "s", "e", "news", 10), (2, "C", "s", "e", "news", 1)], "ord long, channel_id string, start string, stop string, title string, source_priority int")
    assert sorted(r.ord for r in guide.merge_by_priority(df).collect()) == [1, 2]


def test_unified_json(spark, tmp_path):
    channels = spark.createDataFrame([("a", "A")], "channel_id string, name string")
    programmes = spark.createDataFrame([("a", "1", "2", "t")], "channel_id string, start string, stop string, title string")
    export.write_unified(channels, programmes, f"{tmp_path}/g.json", "now")
    found = json.loads(Path(f"{tmp_path}/g.json").read_text())
    assert found["schema_version"] == 2 and found["channels"][0]["name"] == "A" and found["programmes"][0]["title"] == "t"


def test_day_and_progress(spark):
    df = spark.sql("select timestamp'2024-03-30 23:30:00' as a, timestamp'2024-03-31 00:30:00' as b")
    r = df.select(guide.local_day(F.col("a")).cast("string").alias("d"), guide.progress(F.col("a"), F.col("b"), F.lit("2024-03-30 23:45:00").cast("timestamp")).alias("p"), guide.airing(F.col("a"), F.col("b"), F.col("b")).alias("c"), guide.day_label(F.to_date(F.lit("2024-01-02")), F.to_date(F.lit("2024-01-01"))).alias("l")).first()
    assert (r.d, r.p, r.c, r.l) == ("2024-03-31", 25.0, "past", "Domani")


def test_web_filter_and_labels(spark):
    df = spark.createDataFrame([(0, "Café HD", "News", "u"), (1, "Other", "Sport", "u")], "ord long, name string, group string, stream_url string")
    assert [r.ord for r in guide.web_filter(df, "CAFE news").collect()] == [0] and guide.web_filter(df, " hd ").count() == 2
    assert spark.sql("select timestamp'2024-07-01 10:05:00' as t").select(guide.time_label(F.col("t")).alias("l")).first().l == "12:05"
    assert guide.with_guide(df, df.where("ord = 1")).first().asDict() == {"channels": 2, "with_guide": 1}


def test_health_document(spark, tmp_path):
    rows = [{"stream_url": " a ", "status": "online", "http_status": "200", "health_score": 9}, {"stream_url": ""}, {"stream_url": "a", "http_status": "x"}]
    (tmp_path / "h.json").write_text(json.dumps({"enabled": True, "channels": rows}))
    assert [(r.stream_url, r.http_status) for r in probes.read_health(spark, f"{tmp_path}/h.json").orderBy("ord").collect()] == [("a", 200), ("a", None)]
