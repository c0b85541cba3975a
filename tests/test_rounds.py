"""Decisions in order, made by rounds, against the same decisions made one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tvloom.operators import dedupe
from tvloom.operators import source_registry as sr


def kept_one_by_one(rows):
    ids, names, kept = set(), set(), []
    for ord, i, n in sorted(rows):
        if (i and i in ids) or (n and n in names):
            continue
        kept.append(ord)
        ids.add(i)
        names.add(n)
    return kept


def kept(spark, rows):
    df = spark.createDataFrame(rows, "ord long, i string, n string")
    return sorted(r.ord for r in dedupe.greedy(df, F.col("i"), F.col("n")).collect())


@pytest.mark.parametrize("seed,ids,names", [(1, 40, 40), (2, 5, 200), (3, 300, 300), (4, 3, 3)])
def test_greedy_on_random_rows(spark, seed, ids, names):
    rng = random.Random(seed)
    pick = lambda letter, n: rng.choice([f"{letter}{rng.randrange(n)}"] * 8 + ["", None])
    rows = [(k, pick("i", ids), pick("n", names)) for k in rng.sample(range(10_000), 400)]
    assert kept(spark, rows) == kept_one_by_one(rows)


def test_a_long_chain_and_a_hot_key(spark):
    """Each row of the chain shares a key with the one before; every other one stays."""
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("i"), F.floor((F.col("id") + 1) / 2)).alias("i"), F.concat(F.lit("n"), F.floor(F.col("id") / 2)).alias("n"))
    got = dedupe.greedy(chain, F.col("i"), F.col("n")).agg(F.count("*"), F.sum(F.col("ord") % 2), F.max("ord")).first()
    assert tuple(got) == (n // 2, 0, n - 2)
    hot = spark.range(n).select(F.col("id").alias("ord"), F.lit("same").alias("i"), F.col("id").cast("string").alias("n"))
    assert [r.ord for r in dedupe.greedy(hot, F.col("i"), F.col("n")).collect()] == [0]


def test_no_rows(spark):
    assert kept(spark, []) == [] and kept(spark, [(1, None, ""), (2, "", None)]) == [1, 2]


def upserted_one_by_one(rows):
    owner, current, out = {}, {}, {}
    for ord, i, u in sorted(rows):
        holder = owner.get(u)
        if i in current:
            if holder not in (None, i):
                out[ord] = "clash"
                continue
            place, _, old = current[i]
            owner.pop(old, None)
            current[i], owner[u] = (place, ord, u), i
            out[ord] = "replaced"
        elif holder is not None:
            out[ord] = "skipped"
        else:
            current[i], owner[u] = (ord, ord, u), i
            out[ord] = "inserted"
    place = {row: first for first, row, _ in current.values()}
    return {ord: (action, place.get(ord)) for ord, action in out.items()}


@pytest.mark.parametrize("seed,ids,urls,n", [(1, 30, 30, 90), (3, 60, 3, 90), (5, 4, 4, 16)])
def test_upsert_on_random_rows(spark, seed, ids, urls, n):
    rng = random.Random(seed)
    rows = [(k, f"s{rng.randrange(ids)}", f"https://h/{rng.randrange(urls)}") for k in range(n)]
    df = spark.createDataFrame(rows, "ord long, id string, url string").withColumns({"name": F.lit("n"), "kind": F.lit("playlist"), "discovery_mode": F.lit("static"), "enabled": F.lit(True), "discovery_enabled": F.lit(False), "priority": F.lit(1), "trust_score": F.lit(1), "refresh_hours": F.lit(1)})
    got = {r.ord: (r.action, r.place) for r in sr.upsert(df).collect()}
    assert got == upserted_one_by_one(rows)


def test_upsert_of_hot_rows(spark):
    """Many rows of one id, and many ids of one URL, are settled in a few rounds."""
    n = 3_000
    one_id = spark.range(n).selectExpr("id as ord", "'hot' as id", "concat('https://own/', id % 7) as url")
    one_url = spark.range(n, 2 * n).selectExpr("id as ord", "concat('s', id) as id", "'https://shared/' as url")
    rows = one_id.union(one_url).selectExpr("*", "'n' as name", "'playlist' as kind", "'static' as discovery_mode", "true as enabled", "false as discovery_enabled", "1 as priority", "1 as trust_score", "1 as refresh_hours")
    got = {r.action: (r.n, r.standing) for r in sr.upsert(rows).groupBy("action").agg(F.count("*").alias("n"), F.count("place").alias("standing")).collect()}
    assert got == {"inserted": (2, 1), "replaced": (n - 1, 1), "skipped": (n - 1, 0)}


REST = "'n' as name", "'playlist' as kind", "'static' as discovery_mode", "true as enabled", "false as discovery_enabled", "1 as priority", "1 as trust_score", "1 as refresh_hours"


@pytest.mark.parametrize("seed,ids,urls,n,block", [(7, 8, 8, 60, 7), (8, 40, 40, 120, 25), (9, 3, 12, 60, 1)])
def test_upsert_by_blocks(spark, seed, ids, urls, n, block):
    """Blocks that depend on the ones before."""
    rng = random.Random(seed)
    rows = [(3 * k, f"s{rng.randrange(ids)}", f"https://h/{rng.randrange(urls)}") for k in range(n)]
    df = spark.createDataFrame(rows, "ord long, id string, url string").selectExpr("*", *REST).repartition(3)
    assert {r.ord: (r.action, r.place) for r in sr.upsert(df, block=block).collect()} == upserted_one_by_one(rows)


def test_rounds_of_an_upsert_do_not_follow_the_rows(spark, monkeypatch):
    """60 ids and 45 URLs in turn, many times over: tables written are as many for more rows."""
    written, names = sr.written, []
    monkeypatch.setattr(sr, "written", lambda df, name, keep=False: names.append(name) or written(df, name, keep))
    rows = spark.range(1, 6_001).selectExpr("id as ord", "concat('s', id % 60) as id", "concat('https://h', id % 45, '/') as url", *REST)
    got = {r.ord: (r.action, r.place) for r in sr.upsert(rows).collect()}
    assert got == upserted_one_by_one([(k, f"s{k % 60}", f"u{k % 45}") for k in range(1, 6_001)]) and len(names) < 20
