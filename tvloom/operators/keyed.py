"""First, last and best row per key; ordered lists; registries keyed by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text_key


def best(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """Of each key, the row that comes first in `order`, which must be total.

    A key may hold any share of the rows: Spark limits each task's groups before the shuffle.
    """
    return rows.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def first_wins(rows: DataFrame, key: Column | str, order: str = "ord") -> DataFrame:
    return best(rows, [key], [F.asc(order)])


def upsert(rows: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """Of each key the last row, in the place of the first."""
    keyed = rows.withColumn("__key", key)
    others = [c for c in rows.columns if c != order]
    return keyed.groupBy("__key").agg(F.max_by(F.struct(*others), order).alias("r"), F.min(order).alias(order)).select(*[F.col(f"r.{c}").alias(c) if c != order else F.col(c) for c in rows.columns])


def insert_counts(rows: DataFrame, known: DataFrame | None, key: str, *, replace: bool) -> DataFrame:
    """One row: inserted, replaced and skipped of a batch against known keys."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    old = counted.withColumn("old", F.lit(0)) if known is None else counted.join(known.select(key).distinct().withColumn("old", F.lit(1)), key, "left").na.fill(0, ["old"])
    again = F.coalesce(F.sum(F.col("n") - 1 + F.col("old")), F.lit(0))
    inserted = F.coalesce(F.sum(1 - F.col("old")), F.lit(0))
    none = F.lit(0).cast("long")
    return old.agg(inserted.cast("long").alias("inserted"), (again.cast("long") if replace else none).alias("replaced"), (none if replace else again.cast("long")).alias("skipped"))


def ordered_distinct(values: Column, order: Column) -> Column:
    """An aggregate: each value once, by its first place."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(values.isNotNull(), F.struct(order.alias("o"), values.alias("v"))))), lambda x: x["v"]))


# --- a registry of channels, keyed by trimmed URL ----------------------------------------


def register(channels: DataFrame, *, replace: bool = False) -> DataFrame:
    """The channels of a registry after all rows were added in order."""
    valid = channels.where((F.trim("name") != "") & (F.trim("stream_url") != ""))
    key = F.trim("stream_url")
    return upsert(valid, key) if replace else first_wins(valid, key)


def find(registry: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose text in `column` (name, source_id, group, tvg_id) has the key of `value`."""
    return registry.where((text_key(column) == text_key(F.lit(value))) & (F.trim(column) != "")).orderBy("ord")


def find_url(registry: DataFrame, url: str) -> DataFrame:
    return registry.where(F.trim("stream_url") == url.strip())


def search(registry: DataFrame, words: str) -> DataFrame:
    """Rows that hold `words` in name, tvg_name, group, tvg_id or source_id; no words: all."""
    if not words.strip():
        return registry.orderBy("ord")
    text = F.concat_ws(" ", *[text_key(c) for c in ("name", "tvg_name", "group", "tvg_id", "source_id")])
    return registry.where(F.contains(text, text_key(F.lit(words)))).orderBy("ord")


def remove(registry: DataFrame, *, url: str | None = None, source_id: str | None = None) -> DataFrame:
    out = registry
    if url is not None:
        out = out.where(F.trim("stream_url") != url.strip())
    if source_id is not None:
        out = out.where(text_key("source_id") != text_key(F.lit(source_id)))
    return out


def replace_url(registry: DataFrame, old: str, new: DataFrame) -> DataFrame:
    """The row at URL `old` becomes the one row of `new`, in its place; another row with the new URL is an error."""
    place = find_url(registry, old).select(F.col("ord").alias("__ord"))
    moved = new.crossJoin(place).drop("ord").withColumnRenamed("__ord", "ord").select(registry.columns)  # one row each
    kept = remove(registry, url=old)
    if moved.join(kept, F.trim(moved["stream_url"]) == F.trim(kept["stream_url"]), "left_semi").take(1):
        raise ValueError("another channel has this URL")
    return kept.unionByName(moved)


def registry_stats(registry: DataFrame) -> DataFrame:
    distinct = lambda c: F.count_distinct(F.nullif(text_key(c), F.lit("")))
    return registry.agg(F.count(F.lit(1)).alias("channels"), distinct("source_id").alias("sources"), distinct("group").alias("groups"), distinct("tvg_id").alias("tvg_ids"))


def clear(registry: DataFrame) -> DataFrame:
    """A registry of no rows."""
    return registry.limit(0)
