from pyspark.sql import functions as F

from tvloom.operators import cluster, dedupe, keyed, rank
from tvloom.plans.catalogue import NO_ATTRIBUTES, NO_DIRECTIVES


def channels(spark, *rows):
    """Rows of name, URL, guide id, source."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, name string, stream_url string, tvg_id string, source_id string")
    return df.selectExpr("source_id", "ord", "name", "stream_url", "'' as group", "tvg_id", "'' as tvg_name", "'' as logo", f"{NO_ATTRIBUTES} as attributes", f"{NO_DIRECTIVES} as extra_directives")


def test_transitive_clusters(spark):
    rows = cluster.cluster(channels(spark, ("A", "http://u", "", "s"), ("B", "HTTP://U:80", "r", "s"), ("C", "http://c", "R", "s"), ("Live", "http://1", "", "s"), ("live", "http://2", "", "s"), ("", "", "", "s")))
    got = {r.ord: (r.cluster, r.group_id) for r in rows.collect()}
    assert {got[i][0] for i in (0, 1, 2)} == {0} and got[0][1] == "tvg_id:r" and len({got[i][0] for i in (3, 4, 5)}) == 3
    keys = cluster.group_keys(rows).where("cluster = 0").first().identity_keys
    assert [k.type for k in keys] == ["tvg_id", "name", "name", "name", "url", "url"]


def test_long_chain(spark):
    chain = spark.range(60).selectExpr("id as ord", "explode(array(id, id + 1)) as k").selectExpr("ord", "'t' as type", "cast(k as string) as key")
    assert {r.cluster for r in cluster.components(chain).collect()} == {0}


def test_health_before_priority_and_reasons(spark):
    rows = cluster.cluster(channels(spark, ("Rai 1", "http://a", "", "one"), ("Rai 1", "http://b", "", "two"), ("Rai 2 SD", "http://c", "", "one"), ("Rai 2 HD", "https://d", "", "one")))
    priorities = spark.createDataFrame([("One", 1), ("two", 100)], "source_id string, priority int")
    health = spark.createDataFrame([("http://a", 20.0), ("HTTP://B", 95.0), ("http://c", float("nan"))], "stream_url string, health_score double")
    selected, decisions = rank.merge(rows, priorities, health)
    got = {r.selected: (r.reason, r.discarded) for r in decisions.collect()}
    assert got == {"http://b": ("higher_health_score", ["http://a"]), "https://d": ("higher_video_quality", ["http://c"])}
    assert [r.stream_url for r in selected.collect()] == ["http://b", "https://d"]
    first, _ = rank.merge(rows, priorities)
    assert {r.stream_url for r in first.collect()} == {"http://a", "https://d"}
    group = rank.groups(rows).where("size = 2").orderBy("cluster").first()
    assert group.is_duplicate and group.preferred.stream_url == "http://a" and [a.stream_url for a in group.alternatives] == ["http://b"]


def test_greedy_dedupe(spark):
    df = spark.createDataFrame([(1, "i1", "n1"), (2, "i1", "n2"), (3, "i3", "n2"), (4, "", ""), (5, "", ""), (6, "i3", ""), (7, "", "n1"), (8, "i8", "n8"), (9, "i1", "n1")], "ord long, i string, n string")
    once = dedupe.greedy(df, F.col("i"), F.col("n"))
    assert sorted(r.ord for r in once.collect()) == [1, 3, 4, 5, 8]
    assert sorted(r.ord for r in dedupe.greedy(once, F.col("i"), F.col("n")).collect()) == [1, 3, 4, 5, 8]


def test_registry(spark):
    rows = channels(spark, ("A", "http://1", "t", "S"), ("B", " http://1 ", "t2", "S"), ("Café", "http://2", "", "other"), ("", "http://3", "", "S"))
    first = keyed.register(rows)
    assert [(r.ord, r.name) for r in first.orderBy("ord").collect()] == [(0, "A"), (2, "Café")]
    last = keyed.register(rows, replace=True)
    assert [(r.ord, r.name) for r in last.orderBy("ord").collect()] == [(0, "B"), (2, "Café")]
    assert [r.name for r in keyed.find(first, "source_id", " s ").collect()] == ["A"]
    assert [r.name for r in keyed.search(first, "CAFÉ").collect()] == ["Café"] and keyed.search(first, " ").count() == 2
    assert keyed.remove(first, url="http://1").count() == 1 and keyed.remove(first, source_id="s").count() == 1
    counts = keyed.insert_counts(rows.where("name <> ''").withColumn("k", F.trim("stream_url")), None, "k", replace=False).first()
    assert (counts.inserted, counts.replaced, counts.skipped) == (2, 0, 1)
    assert keyed.registry_stats(first).first().asDict() == {"channels": 2, "sources": 2, "groups": 0, "tvg_ids": 1}
    moved = keyed.replace_url(first, "http://1", first.where("ord = 0").withColumn("stream_url", F.lit("http://9")))
    assert {(r.ord, r.stream_url) for r in moved.collect()} == {(0, "http://9"), (2, "http://2")}
