"""Merging guides, and questions to a guide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .keyed import best, ordered_distinct

ZONE = "Europe/Rome"


def richness(description: Column, subtitle: Column, categories: Column, icon: Column, episode: Column) -> Column:
    filled = sum((F.when(c != "", 1).otherwise(0) for c in (subtitle, icon, episode)), F.when(description != "", 1).otherwise(0))
    return filled + F.size(categories)


def merge_channels(channels: DataFrame) -> DataFrame:
    """Channels of several documents: of ids that differ in case the first spelling, all names in order, first icon and source."""
    order = F.struct("doc_ord", "ord")
    names = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "ord", "display_names"))), lambda x: x["display_names"])))
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", order)), F.lit(""))
    return channels.withColumn("gid", text.casefold("channel_id")).groupBy("gid").agg(F.min(order).alias("o"), F.min_by("channel_id", order).alias("channel_id"), names.alias("display_names"), first("icon_url").alias("icon_url"), first("source_url").alias("source_url")).select("gid", F.col("o.doc_ord").alias("doc_ord"), F.col("o.ord").alias("ord"), "channel_id", "display_names", "icon_url", "source_url")


def merge_programmes(programmes: DataFrame, channels: DataFrame) -> DataFrame:
    """Programmes of several documents under the merged channels' spelling: of the same programme the richest, then the first."""
    keyed = programmes.withColumn("gid", text.casefold("channel_id")).join(channels.select("gid", F.col("channel_id").alias("canonical")), "gid", "left").withColumn("channel_id", F.coalesce("canonical", "channel_id")).drop("canonical")
    rich = richness(*(F.col(c) for c in ("description", "subtitle", "categories", "icon_url", "episode_num")))
    return best(keyed.withColumn("richness", rich), ["gid", "start", "stop", text.casefold("title")], [F.desc("richness"), "doc_ord", "ord"])


def generate(channels: DataFrame, programmes: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged channels that a playlist channel matched, and their programmes, in output order."""
    merged = merge_channels(channels)
    wanted = matched.where("status = 'matched'").select(text.casefold("guide_id").alias("gid")).distinct()
    shown = merged.join(wanted, "gid", "left_semi")
    return shown.orderBy("gid"), merge_programmes(programmes, merged).join(wanted, "gid", "left_semi").orderBy("gid", "start", "stop", text.casefold("title"))


def generation_stats(channels: DataFrame, programmes: DataFrame, shown: DataFrame, output: DataFrame) -> DataFrame:
    """One row of counts, with channels that have no programme."""
    merged = merge_channels(channels)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [one(channels, "input_epg_channels"), one(programmes, "input_programmes"), one(merged, "merged_epg_channels"), one(merge_programmes(programmes, merged), "merged_programmes"), one(shown, "output_channels"), one(output, "output_programmes"), one(shown.join(output, "gid", "left_anti"), "channels_without_programmes")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("programme_duplicates_removed", F.expr("input_programmes - merged_programmes"))


def by_channel(programmes: DataFrame) -> DataFrame:
    """gid and its programmes by start, stop and title. A channel's programmes are bounded by its broadcast time."""
    fields = F.struct("start", "stop", text.casefold("title").alias("folded"), "title")
    return programmes.withColumn("gid", text.casefold("channel_id")).groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda p: F.struct(p["start"], p["stop"], p["title"])).alias("programmes"))


def merge_by_priority(programmes: DataFrame) -> DataFrame:
    """v2 merge: of the same channel (case counts), start, stop and title, the least source_priority, then the first."""
    return best(programmes, ["channel_id", "start", "stop", F.trim(text.casefold("title"))], ["source_priority", "ord"])


# --- identities of the seeded registry ---------------------------------------------------


def seed_aliases(seed: DataFrame) -> DataFrame:
    """alias and channel_id of a seed (ord, channel_id, name, aliases): of an alias the last entry."""
    named = seed.select("ord", "channel_id", F.explode(F.array_append("aliases", F.col("name"))).alias("a")).withColumn("alias", text.identity_text(text.fold("a"))).where("alias <> ''")
    return named.groupBy("alias").agg(F.max_by("channel_id", "ord").alias("channel_id"))


def resolve(channels: DataFrame, seed: DataFrame) -> DataFrame:
    """channels (name, tvg_id, tvg_name) with channel_id, canonical_name, category and matched_by.

    The seed's alias of the guide id counts before that of tvg_name and name; else the id is made of the best name.
    """
    aliases = seed_aliases(seed)
    out = channels
    for c in ("tvg_id", "tvg_name", "name"):
        out = out.withColumn(f"__{c}", text.identity_text(text.fold(c))).join(aliases.toDF(f"__{c}", f"__{c}_id"), f"__{c}", "left")
    found = F.coalesce("__tvg_id_id", "__tvg_name_id", "__name_id")
    best_name = F.coalesce(F.nullif("__tvg_name", F.lit("")), F.nullif("__name", F.lit("")), F.col("__tvg_id"))
    slug = F.coalesce(F.nullif(F.btrim(F.regexp_replace(best_name, "[^a-z0-9]+", "."), F.lit(".")), F.lit("")), F.lit("unknown"))
    shown = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("name", "tvg_name", "tvg_id")], F.lit("Canale"))
    info = seed.select(F.col("channel_id").alias("__id"), F.col("name").alias("__seed_name"), F.col("category").alias("__category"))
    out = out.withColumn("__id", found).join(info, "__id", "left")
    seeded = F.col("__id").isNotNull()
    return out.select(
        *channels.columns,
        F.when(seeded, F.col("__id")).otherwise(F.concat(F.lit("it.auto."), slug)).alias("channel_id"),
        F.when(seeded, F.col("__seed_name")).otherwise(shown).alias("canonical_name"),
        F.when(seeded, F.coalesce("__category", F.lit("ALTRO"))).otherwise("ALTRO").alias("category"),
        F.when(seeded, "seed_alias").otherwise("derived").alias("matched_by"),
    )


def build_entities(resolved: DataFrame) -> DataFrame:
    """One row per channel_id: first name and category, sorted aliases, streams in order."""
    spoken = F.filter(F.array("name", "tvg_id", "tvg_name"), lambda v: v != "")
    return resolved.groupBy("channel_id").agg(
        F.min_by("canonical_name", "ord").alias("name"),
        F.min_by("category", "ord").alias("category"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(spoken)))).alias("aliases"),
        ordered_distinct(F.nullif("url", F.lit("")), F.col("ord")).alias("streams"),
    )


# --- the guide page ----------------------------------------------------------------------


def web_join(channels: DataFrame, names: DataFrame, programmes: DataFrame) -> DataFrame:
    """Programmes of each channel: by guide id (case counts) and by the first guide with each of its names; the same
    programme once, its last values in the first place. names: channel_id, ord, pos, name."""
    key = lambda c: text.web_text(text.fold(c))
    by_name = names.withColumn("key", key("name")).where("key <> ''").groupBy("key").agg(F.min_by("channel_id", F.struct("ord", "pos")).alias("guide"))
    by_id = channels.select("ord", F.lit(0).alias("nth"), F.col("tvg_id").alias("guide")).join(names.select(F.col("channel_id").alias("guide")).distinct(), "guide", "left_semi")
    asked = channels.select("ord", F.posexplode(F.array("tvg_name", "name")).alias("nth", "n")).withColumn("key", key("n"))
    keys = by_id.select("ord", "nth", "guide").union(asked.join(by_name, "key").select("ord", F.col("nth") + 1, "guide")).groupBy("ord", "guide").agg(F.min("nth").alias("nth"))
    shown = keys.join(programmes.withColumnsRenamed({"ord": "p_ord", "channel_id": "guide"}), "guide")
    return shown.groupBy("ord", "start", "stop", "title").agg(F.max_by(F.struct("guide", "description", "category"), F.struct("nth", "p_ord")).alias("p")).select("ord", "start", "stop", "title", "p.*")


def airing(start: Column, stop: Column, now: Column) -> Column:
    return F.when((start <= now) & (stop > now), "current").when(stop <= now, "past").otherwise("future")


def progress(start: Column, stop: Column, now: Column) -> Column:
    """Percent of a programme that is over, 0 to 100; 0 if it has no length."""
    micros = lambda c: F.unix_micros(c).cast("double")
    length = micros(stop) - micros(start)
    return F.when(length <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (micros(now) - micros(start)) / length * 100)))


def now_playing(programmes: DataFrame, now: Column, key: str = "channel_id") -> DataFrame:
    """Of each channel the first programme with start <= now < stop."""
    return best(programmes.where((F.col("start") <= now) & (F.col("stop") > now)), [key], ["start", "stop", "title"])


def playing_at(programmes: DataFrame, instants: DataFrame, key: str = "channel_id", hours: int = 6) -> DataFrame:
    """For each instant (key, at) the programmes on then. Programmes are cut into buckets of `hours`, so that both sides
    meet by equal keys and not by comparing all pairs."""
    size = hours * 3600
    bucket = lambda c: F.floor(F.unix_seconds(c) / size)
    p = programmes.where("stop > start").withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), F.floor((F.unix_micros("stop") - 1) / (size * 1_000_000)))))
    return instants.withColumn("bucket", bucket(F.col("at"))).join(p, [key, "bucket"]).where((F.col("start") <= F.col("at")) & (F.col("stop") > F.col("at"))).drop("bucket")


def local_day(instant: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def time_label(instant: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, zone), "HH:mm")


def web_filter(channels: DataFrame, words: str) -> DataFrame:
    """Channels that hold the words in name and group; no words: all."""
    wanted = text.web_text(text.fold(F.lit(words)))
    shown = text.web_text(text.fold(F.concat_ws(" ", "name", "group")))
    return channels.where((wanted == "") | F.contains(shown, wanted))


def with_guide(channels: DataFrame, joined: DataFrame) -> DataFrame:
    """One row: channels, and those with a programme. joined: what web_join made."""
    known = joined.select("ord").distinct().withColumn("some", F.lit(True))
    return channels.join(known, "ord", "left").agg(F.count(F.lit(1)).alias("channels"), F.count("some").alias("with_guide"))


def day_label(day: Column, today: Column) -> Column:
    return F.when(day == today, "Oggi").when(day == F.date_add(today, 1), "Domani").otherwise(F.date_format(day, "EEE d MMM"))


def days(programmes: DataFrame, key: str = "channel_id", zone: str = ZONE) -> DataFrame:
    """Days with programmes and how many, of each channel."""
    return programmes.groupBy(key, local_day(F.col("start"), zone).alias("day")).agg(F.count(F.lit(1)).alias("programmes"))


def with_lead_stop(events: DataFrame, key: str, at: str) -> DataFrame:
    """Each event as a programme that lasts until the key's next."""
    return events.withColumn("stop", F.lead(at).over(W.partitionBy(key).orderBy(at, *[c for c in events.columns if c.endswith("_id") and c != key])))


