"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, by the jumps
of a linear congruential generator seeded with the key; there is no ring table.
With one more shard, a row stays where it is or goes to the new shard. The
generator's product modulo 2**64 is taken in 32-bit halves, as long columns
don't wrap.

Slots number the rows of a shard from 0 without gaps. Ids are cut at quantiles
into blocks; each (shard, block) is numbered by its own window and begins at
the rows of the shard's earlier blocks. So no window holds a whole shard. An id
that repeats more often than a block is long is one block, and so are null ids; such a block is
cut again by text checksum. Rows equal in id and text are told apart by nothing, and share one window.

The key of an integer id is the id itself, of any other id a hash of it as text. A null id takes
the key 0. A null text has no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

SHARDS = 16
#: Rows of all shards between two cuts of the ids, about, and the most cuts.
BLOCK_ROWS = 1_000
MOST_CUTS = 4_096
#: Bits of the text checksum that cut a block of one id.
PART_BITS = 10

LOW = 0xFFFFFFFF
#: Multiplier of the generator, as published with the jump hash.
MULTIPLIER = 2862933555777941757
_M0, _M1, _MH = MULTIPLIER & 0xFFFF, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER >> 32


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key among 0..shards-1."""

    def step(state: Column, _: Column) -> Column:
        hi, lo, at, to = state["hi"], state["lo"], state["at"], state["to"]
        t0, t1 = lo * _M0, lo * _M1
        low = t0 + F.shiftleft(t1.bitwiseAND(0xFFFF), 16) + 1
        carry = F.shiftright(low, 32) + F.shiftright(t1, 16)
        high = carry + (lo * _MH).bitwiseAND(F.lit(LOW)) + hi * _M0 + F.shiftleft((hi * _M1).bitwiseAND(0xFFFF), 16)
        high = high.bitwiseAND(F.lit(LOW))
        jump = F.floor((to + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        on = to < shards
        return F.struct(
            F.when(on, high).otherwise(hi).alias("hi"),
            F.when(on, low.bitwiseAND(F.lit(LOW))).otherwise(lo).alias("lo"),
            F.when(on, to).otherwise(at).alias("at"),
            F.when(on, jump).otherwise(to).alias("to"),
        )

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(LOW)).alias("lo"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("to"),
    )
    # each jump goes up by one at least, so no key takes more steps than there are shards
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more)."""
    content = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[id].alias("id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        _number(docs, id).alias("number"),
    ).withColumn("key", F.coalesce("number", F.lit(0).cast("long")))
    rows = rows.withColumn("shard", jump_hash(F.col("key"), shards)).withColumn("grown_shard", jump_hash(F.col("key"), shards + 1))

    n = docs.count()
    parts = min(MOST_CUTS, n // BLOCK_ROWS + 1)
    cuts = []
    if parts > 1:
        cuts = docs.agg(F.percentile_approx(_number(docs, id), [i / parts for i in range(1, parts)], 10 * MOST_CUTS)).first()[0] or []
    hot = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    block = _cuts_up_to(F.col("number"), sorted(set(cuts))) if cuts else F.lit(0)
    rows = rows.withColumn("block", block)
    rows = rows.withColumn("part", F.when(F.col("number").isNull() | F.col("number").isin(hot), F.shiftright("text_crc32", 32 - PART_BITS) + 1).otherwise(0).cast("int"))
    by = ["shard", "block", "part"]
    before = W.partitionBy("shard").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*by).count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))).drop("count")  # cuts x shards rows at most
    order = W.partitionBy(*by).orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), by)  # (MOST_CUTS + parts of hot ids) x shards rows at most
        .select(F.col("id").alias(id), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), "grown_shard")
    )


def _number(docs: DataFrame, id: str) -> Column:
    """The id as a long; of one that isn't an integer, a hash."""
    if isinstance(docs.schema[id].dataType, T.IntegralType):
        return docs[id].cast("long")
    return F.when(docs[id].isNotNull(), F.xxhash64(docs[id].cast("string")))


def _cuts_up_to(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are <= value; null: none."""
    known = F.lit(cuts)
    steps = len(cuts).bit_length()

    def halve(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        up = (lo < hi) & (F.get(known, mid) <= value)
        return F.struct(F.when(up, mid + 1).otherwise(lo).alias("lo"), F.when((lo < hi) & ~up, mid).otherwise(hi).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, halve, lambda s: s["lo"])
    return F.when(value.isNull(), 0).otherwise(found)


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents; one row per document."""
    return shard(table(spark, sf_dir, "documents"))
