"""Registered queries against their SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [shown(v) for v in value]
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    order = sorted(df.columns)
    theirs = sorted([shown(r[found.columns.index(c)]) for c in order] for r in found.fetchall())
    assert sorted([shown(r[c]) for c in order] for r in rows) == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_dedupe_against_brute_force(spark):
    """Order decides; a recursive SQL of the same takes a minute."""
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    ids, names, kept = set(), set(), []
    for r in rows:
        i = f"{r.source}{len(r.text)}" if r.text is not None and r.source is not None else ""
        n = re.sub("[^a-z]+", "", r.text.lower()) if r.text is not None else None
        if (i and i in ids) or (n is not None and n in names):
            continue
        kept.append(r.doc_id)
        ids.add(i)
        if n is not None:
            names.add(n)
    assert sorted(r.doc_id for r in entry.queries()["q24_greedy_dedupe"](spark, sf_dir).collect()) == kept


@pytest.mark.parametrize("name", ["q47_guide_written", "q48_unified_xmltv", "q50_health_report", "q50_health_counts", "q44_playlist_written", "q44_category_places", "q45_policy_rewrite", "q46_dedupe_rewrite"])
def test_written_files_are_read_in_splits(spark, duck, name):
    """A file is dealt to tasks, and lines at the ends of splits are whole and in order."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        test_query(spark, duck, name)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
