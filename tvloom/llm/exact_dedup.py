"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. The index has one entry
for each 64-bit hash of a text: hash and rows. Its directory starts with one
bucket and doubles while a bucket holds more than CAPACITY entries: an overfull
bucket splits by one more leading bit of the hash, for as many bits as it takes. A
bucket is therefore a range of hashes; owner tasks take ranges of buckets and write
their entries, sorted by hash, to the shared folder.

The index answers which rows are equal. Its entries of several rows are chains: the
texts under such a hash go to the owner of its bucket, copies summed up beforehand,
and the owner compares the chain's texts byte by byte. Each different text of a chain
gets its keeper and its number of rows, written beside the entries. Every row then finds its
bucket through the directory and its keeper in the bucket by hash and SHA-256.

Copies are summed before each shuffle (before the owner's by PARTS parts of a chain, so
an owner compares PARTS rows of a text at most), and the last join has one row per chain
on its right, which adaptive execution splits if its left is hot; so a group may hold any
share of the rows.

Null counts as an empty text. Of rows equal in id and text, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh, table, written

#: Entries of a bucket before it splits.
CAPACITY = 32_768
#: Leading bits that the directory is counted by first, and how many more at a time where that isn't enough.
FIRST_DEPTH, MORE_DEPTH = 12, 4
PARTS = 8
#: Owner tasks at most; a task owns several buckets if there are more.
OWNERS = 10_000
#: Hashes of chains that are sent to all executors; 12 bytes each.
FEW = 1_000_000


def directory(counts: dict[int, int], max_depth: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Buckets as (first slot, local depth), by slot, from the entries under each prefix of max_depth bits.

    The global depth is the largest local depth; splitting a bucket that already has it doubles the directory.
    """
    totals = [0]
    for slot in range(1 << max_depth):
        totals.append(totals[-1] + counts.get(slot, 0))
    done, splitting = [], [(0, 0)]
    while splitting:
        slot, depth = splitting.pop()
        width = 1 << (max_depth - depth)
        if depth < max_depth and totals[slot + width] - totals[slot] > capacity:
            splitting += [(slot, depth + 1), (slot + width // 2, depth + 1)]
        else:
            done.append((slot, depth))
    return sorted(done)


class Index:
    """slots: slot (the leading `depth` bits of a hash), bucket and local_depth, for slots that have entries; path of the entries."""

    def __init__(self, slots: DataFrame, depth: int, buckets: int, path: str):
        self.slots, self.depth, self.buckets, self.path = slots, depth, buckets, path

    def entries(self) -> DataFrame:
        """h, n, bucket and local_depth."""
        return self.slots.sparkSession.read.schema("h long, n long, bucket int, local_depth int").parquet(self.path)

    def located(self, rows: DataFrame) -> DataFrame:
        """rows (with `h`) and the bucket that the directory names."""
        slot = F.shiftrightunsigned("h", 64 - self.depth)
        return rows.withColumn("slot", slot).join(F.broadcast(self.slots.select("slot", "bucket")), "slot").drop("slot")  # 2 * entries / CAPACITY rows, about

    def owned(self, rows: DataFrame) -> DataFrame:
        """rows (with `bucket`), each range of buckets in the task that owns it."""
        return rows.repartitionByRange(min(self.buckets, OWNERS), "bucket")


def build_index(rows: DataFrame, capacity: int = CAPACITY, first_depth: int = FIRST_DEPTH) -> Index:
    """The index of rows (with a column `h`)."""
    spark = rows.sparkSession
    entries = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "entries")
    depth = first_depth
    while True:
        counts = {r["slot"]: r["count"] for r in entries.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("slot")).count().collect()}  # 2**depth rows at most
        if depth + MORE_DEPTH > 60 or max(counts.values(), default=0) <= capacity:
            break
        depth += MORE_DEPTH
    buckets = directory(counts, depth, capacity)
    slots = [(s, number, local) for number, (first, local) in enumerate(buckets) for s in range(first, first + (1 << (depth - local))) if s in counts]
    index = Index(spark.createDataFrame(slots, "slot long, bucket int, local_depth int"), depth, len(buckets), fresh(spark, "index"))
    depths = F.broadcast(index.slots.select("bucket", "local_depth").distinct())
    index.owned(index.located(entries).join(depths, "bucket")).sortWithinPartitions("bucket", "h").select("h", "n", "bucket", "local_depth").write.parquet(index.path)
    return index


def chains(texts: DataFrame, index: Index) -> DataFrame:
    """bucket, h, sha, keep_id and group_size of each text whose hash several rows have. texts: id, text, h and tag."""
    several = written(index.entries().where("n > 1").select("h", "bucket"), "several")
    if several.limit(FEW + 1).count() <= FEW:  # beyond, the texts move to their hashes
        several = F.broadcast(several)
    # copies are summed before they move; the text itself is a key, so only equal ones are
    parts = (
        texts.join(several, "h")
        .groupBy("bucket", "h", "text", F.pmod("tag", F.lit(PARTS)).alias("part"))
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    # within its range an owner compares what is left of each chain
    found = index.owned(parts).groupBy("bucket", "h", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return written(found.select("bucket", "h", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"), "chains")


def group(docs: DataFrame, *, id: str = "doc_id", text: str = "text", hash_bits: int = 64, capacity: int = CAPACITY, first_depth: int = FIRST_DEPTH) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept and text_sha256.

    hash_bits under 64 makes hashes collide, for tests of the chains.
    """
    normal = ascii_lower(F.coalesce(docs[text], F.lit("")))
    hashed = F.xxhash64("text") if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 64 - hash_bits), 64 - hash_bits)
    texts = docs.select(docs[id].alias("id"), normal.alias("text")).withColumn("h", hashed).withColumn("tag", F.monotonically_increasing_id())

    slim = written(texts.select("id", "h", F.sha2("text", 256).alias("sha"), "tag"), "rows")
    index = build_index(slim, capacity, first_depth)
    keepers = chains(texts, index)

    repeated = slim.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("first_tag")).where("n > 1").select("id", "sha", "first_tag")
    found = (
        index.located(slim)
        .join(keepers, ["bucket", "h", "sha"], "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")))
        .join(written(repeated, "repeated").withColumnsRenamed({"id": "r_id", "sha": "r_sha"}), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")
    )
    return found.select(
        F.col("id").alias(id),
        "keep_id",
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("first_tag").isNull() | (F.col("tag") == F.col("first_tag")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents; one row per document, dropped ones too."""
    return group(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t
"""
