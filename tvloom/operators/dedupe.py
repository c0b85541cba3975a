"""Greedy two-key dedupe of playlist entries, in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .cluster import scratch, written


def greedy(rows: DataFrame, id_key: Column, name_key: Column, *, order: str = "ord") -> DataFrame:
    """rows that stay: one is dropped if a kept one before it has its id or its name; empty and null keys don't count.

    What is kept depends on what was kept before. Rows without keys stay.
    """
    some = lambda key: F.nullif(key, F.lit(""))
    keyed = rows.withColumns({"__id": some(id_key), "__name": some(name_key)})
    has_key = F.coalesce("__id", "__name").isNotNull()
    # of rows equal in both keys only the first can stay, and it alone decides for them
    firsts = keyed.where(has_key).groupBy(F.col("__id").alias("a"), F.col("__name").alias("b")).agg(F.min(order).alias("ord"))
    with scratch(rows.sparkSession):
        stay = written(first_matching(firsts), "stay", keep=True)
    free = keyed.where(~has_key)
    return keyed.join(stay.withColumnRenamed("ord", "__ord"), F.col(order) == F.col("__ord"), "left_semi").unionByName(free).drop("__id", "__name")


def first_matching(open_: DataFrame) -> DataFrame:
    """ord of the rows (ord, a, b) that stay when they are taken in order and each claims its keys a and b if both are free.

    By rounds over tables: a row with no open one before it under either key stays. A row with one only stays if that one
    doesn't, which makes trees of such rows; the places of a tree are followed to its root, in a number of steps that
    grows with the logarithm of its depth. What shares a key with a row that stays goes, and the rest is open in the next
    round. Every round settles at least the first row of each component, and a chain of any length in one.
    """
    open_, stay = written(open_, "open"), []
    while True:
        states = written(_states(open_), "states")
        ways = states.select("ord", "to", "flip")
        while True:
            on = ways.select(F.col("ord").alias("to"), F.col("to").alias("beyond"), F.col("flip").alias("other"))
            moved = written(ways.join(on, "to").select("ord", "to", "beyond", F.col("flip").bitwiseXOR(F.col("other")).alias("flip")), "ways")
            ways = moved.select("ord", F.col("beyond").alias("to"), "flip")
            if not moved.where("to <> beyond").take(1):
                break
        roots = states.where("before = 0").select(F.col("ord").alias("to"))
        settled = written(states.select("ord", "a", "b").join(ways.join(roots, "to", "left_semi"), "ord").select("ord", "a", "b", (F.col("flip") == 0).alias("stays")), "settled")
        kept = settled.where("stays")
        stay.append(kept.select("ord"))
        rest = open_.join(settled, "ord", "left_anti").join(kept.select("a"), "a", "left_anti").join(kept.select("b"), "b", "left_anti")
        open_ = written(rest, "open")
        if not open_.take(1):
            return reduce(DataFrame.union, stay)


def _states(open_: DataFrame) -> DataFrame:
    """Of each row, how many open ones are before it under its keys (2: two or more), and where to look: the one before if
    it is alone (flip 1), else the row itself (flip 0)."""
    out = open_
    for key in ("a", "b"):
        # the first two of a key, which each task looks for before the shuffle
        placed = open_.where(F.col(key).isNotNull()).select(key, "ord", F.row_number().over(W.partitionBy(key).orderBy("ord")).alias("nth")).where("nth <= 2")
        two = placed.groupBy(key).agg(F.min("ord").alias(f"{key}_1"), F.max("ord").alias(f"{key}_2"))
        before = F.when(F.col(key).isNull() | (F.col("ord") == F.col(f"{key}_1")), 0).when(F.col("ord") == F.col(f"{key}_2"), 1).otherwise(2)
        out = out.join(two, key, "left").withColumn(f"{key}_before", before)
    before = F.col("a_before") + F.col("b_before")
    alone = F.when(F.col("a_before") == 1, F.col("a_1")).otherwise(F.col("b_1"))
    return out.select("ord", "a", "b", before.alias("before"), F.when(before == 1, alone).otherwise(F.col("ord")).alias("to"), F.when(before == 1, 1).otherwise(0).alias("flip"))


def dedupe_entries(entries: DataFrame) -> DataFrame:
    """Entries of one playlist (ord from 1, info, lines) that stay."""
    return greedy(entries.where("ord > 0"), text.playlist_id_key(F.col("info")), text.playlist_name_key(F.col("info")))
