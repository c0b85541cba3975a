from pyspark.sql import functions as F

from tvloom.functions import urls


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_keys(spark):
    raw = ["HTTPS://User:pw@EXAMPLE.test:443/Rai1?A=b#x", "http://h:8080/p", "'http://H:80/p'", "no scheme", "rtmp://Host/x"]
    assert column(spark, urls.identity_url, raw) == ["https://example.test/Rai1?A=b", "http://h:8080/p", "http://h/p", "no scheme", "rtmp://host/x"]
    assert column(spark, urls.source_url, raw)[:2] == ["https://User:pw@example.test/Rai1?A=b", "http://h:8080/p"]
    assert column(spark, urls.alternate_url, raw)[1] == "http://h/p"


def test_expiry(spark):
    now = 1_700_000_000
    raw = [f"http://x/?exp={now - 61}", f"http://x/?EXPIRES={now}", f"http://x/?expires={(now - 100) * 1000}", f"http://x/?hdnts=st=1~exp={now - 100}~acl=y", "http://x/?exp=123", "http://x/?id=1600000000", "http://x/"]
    assert column(spark, lambda c: urls.token_expired(c, now), raw) == [True, False, True, True, False, False, False]


def test_country(spark):
    check = lambda a: lambda c: urls.country_check(a, c, "IT")
    none = F.expr("cast(map() as map<string,string>)")
    assert column(spark, check(none), ["http://x/?country=it", "http://x/?Market=US", "http://x/", "http://x/?region=eu"]) == ["match", "mismatch", "unknown", "match"]
    named = F.create_map(F.lit("TVG-Country"), F.lit("FR;IT"))
    assert column(spark, check(named), ["http://x/"]) == ["match"]
    assert column(spark, lambda c: urls.country_check(none, c, ""), ["x"]) == ["not_configured"]


def test_headers(spark):
    df = spark.createDataFrame([("http://x/a|User-Agent=A%20B&Referrer=r&other=z",), ("http://y",)], "u string")
    url, headers = urls.split_headers(F.col("u"))
    assert [(r.a, r.h) for r in df.select(url.alias("a"), headers.alias("h")).collect()] == [("http://x/a", {"User-Agent": "A B", "Referer": "r"}), ("http://y", {})]
