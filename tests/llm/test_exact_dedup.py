import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from tvloom.llm import exact_dedup as ed


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("bits", [64, 2])
def test_against_brute_force(spark, odd, bits):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(["É", "é", "a", "A", "", None, "hot", "HOT", "hot"] * 5)]
    got = ed.group(spark.createDataFrame(rows, "doc_id long, text string"), hash_bits=bits, first_depth=1, capacity=2).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = [keep]
        for i in ids:
            kept = i in stays
            if kept:
                stays.remove(i)
            want[(i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_empty_table(empty):
    assert ed.group(empty).collect() == []


def test_directory_splits_only_overfull_buckets():
    found = ed.directory({0: 5, 1: 1, 8: 1, 15: 1}, max_depth=4, capacity=4)
    assert found == [(0, 4), (1, 4), (2, 3), (4, 2), (8, 1)]
    widths = [1 << (4 - d) for _, d in found]
    assert sum(widths) == 16 and all(s + w == t for (s, _), w, (t, _) in zip(found, widths, found[1:]))


def test_index_files_hold_ranges(spark):
    rows = spark.range(500).selectExpr("xxhash64(id) as h")
    index = ed.build_index(rows, capacity=20, first_depth=2)
    sizes = index.entries().withColumn("file", F.input_file_name()).groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()
    assert sum(r.n for r in sizes) == 500 and all(r.n <= 20 and r.files == 1 for r in sizes) and len(sizes) > 25
    assert index.depth > 2  # the directory doubled until no bucket was overfull


def test_rows_find_their_keeper_in_the_index(spark, monkeypatch):
    """Without its entries no row finds its copies."""
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string")
    assert {r.group_size for r in ed.group(docs).collect()} == {7, 8}
    monkeypatch.setattr(ed.Index, "entries", lambda self: self.slots.sparkSession.read.schema("h long, n long, bucket int, local_depth int").parquet(self.path).where("false"))
    assert {r.group_size for r in ed.group(docs).collect()} == {1}
