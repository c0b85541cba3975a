import collections
import zlib

from pyspark.sql import functions as F

from tvloom.llm import sharding

MASK = (1 << 64) - 1


def jump(key, n):
    key &= MASK
    at, to = -1, 0
    while to < n:
        at, key = to, (key * 2862933555777941757 + 1) & MASK
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash(spark):
    keys = [0, 1, 2, -1, -(1 << 63), (1 << 63) - 1, *range(3, 2000, 7)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100):
        assert all(r.s == jump(r.k, n) for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect())


def test_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    more = spark.range(2000).selectExpr("id % 1500 as doc_id", "concat('t', id) as text").union(spark.range(600).selectExpr("77", "concat('u', id)"))
    docs = odd.select("doc_id", "text").union(more)
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.shard == jump(r.doc_id or 0, 16) and r.grown_shard == jump(r.doc_id or 0, 17) and r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_empty_table(empty):
    assert sharding.shard(empty).collect() == []


def test_ids_of_text_and_null(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, concat('doc-', id)) as doc_id", "concat('t', id) as text")
    got = sharding.shard(docs).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and (r.doc_id is not None or r.shard == 0)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
