import pytest
from pyspark.sql import functions as F

from tvloom.functions import text


@pytest.mark.parametrize("name,key", [("Italia 2 (480p) [Geo-blocked]", "italia2"), ("TeleSud [Bari] HD", "telesudbari"), ("Rai Sport + HD", "raisportplus"), ("Caffè & Co", "caffeeco"), ("", ""), (None, "")])
def test_strict_key(name, key):
    assert text.strict_key(name) == key


@pytest.mark.parametrize("id,key", [("PlutoTVAnime.de@IT", "plutotvanime"), ("Rai1.it@SD", "rai1"), ("WaterBear.ch@HD", "waterbear"), ("x.it?y#z", "x")])
def test_identifier_variants(id, key):
    assert key in text.identifier_variants(id)


def test_name_variants():
    assert {"raiuno", "rai1"} <= set(text.name_variants("Rai Uno"))
    assert "canale5" in text.name_variants("Canale 5") and "5" not in text.name_variants("Canale 5")
    assert "focus" in text.name_variants("Focus TV Italia") and text.name_variants("HD") == ()


def test_similarity():
    assert text.similarity("abc", "abc") == 100 and text.similarity("abcd", "ab") == 0 and text.similarity("", "a") == 0
    assert text.similarity("telenorba", "telenorba7") > 95


def test_informative():
    assert text.informative("20") and not text.informative("5") and text.informative("iris") and not text.informative("la5")


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_name_key(spark):
    got = column(spark, lambda c: text.name_key(text.fold(c)), ["Rai 1 FULL HD", "Caffè 4K", "ＲＡＩ １", None, "Straße"])
    assert got == ["rai1", "caffe", "rai1", "", "strasse"]


def test_category_text(spark):
    assert column(spark, lambda c: text.category_text(text.fold(c)), ["Rai 1 (backup) Full HD 4K", "Tom & Jerry", "HD"]) == ["rai 1", "tom e jerry", "hd"]


def test_identity_text(spark):
    assert column(spark, lambda c: text.identity_text(text.fold(c)), ["Rai1.it@SD", "Rai 1 G", "Rai 1 (720p)", "LA7 HD"]) == ["rai1 it", "rai 1", "rai 1", "la7"]


def test_clean(spark):
    assert column(spark, text.clean_text, [" a \x01 b  c ", None]) == ["a b c", ""]
    assert column(spark, text.clean_url, ["' http://x '", "#no", '"a"']) == ["http://x", "", "a"]


def test_playlist_keys(spark):
    lines = ['#EXTINF:-1 tvg-id="Rai1.it@SD",Rai 1 (720p)', '#EXTINF:-1 tvg-id="Rai1.it",Rai 1 G', "#EXTINF:-1 none", '#EXTINF:-1 group-title="a,b",X HD 1080p']
    assert column(spark, text.playlist_id_key, lines) == ["rai1it", "rai1it", "", ""]
    assert column(spark, text.playlist_name_key, lines) == ["rai1", "rai1", "", "bx"]


def test_texts_go_to_python_in_bounded_batches(spark):
    """The first use of a text function in a session bounds its batches."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "10000")
        rows = spark.range(4_000, numPartitions=1).select(F.concat(F.lit("É"), F.col("id").cast("string")).alias("v"))
        assert rows.select(text.fold(F.col("v")).alias("v")).where("v = 'e3999'").count() == 1
        assert int(spark.conf.get(names[0])) <= text.BATCH_ROWS and int(spark.conf.get(names[1])) == text.BATCH_BYTES
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
