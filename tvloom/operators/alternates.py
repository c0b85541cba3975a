"""Alternate URLs of stitched channels, through a resolver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .keyed import best

#: Names and patterns of the stitched streams and their resolver.
SOURCE_ID = "pluto_jmp2"
DOMAIN = "pluto.tv"
STITCHED = r"(?i)/(?:v\d+/)?stitch/hls/channel/([a-f0-9]{24})/"
RAW_ID = "(?i)^[a-f0-9]{24}$"
RESOLVER = "https://jmp2.uk/plu-{}.m3u8"
RESOLVED = r"(?i)^https://jmp2\.uk/plu-([a-f0-9]{24})\.m3u8(?:[?#].*)?$"


def request(url: Column) -> Column:
    return F.trim(F.substring_index(url, "|", 1))


def channel_id(url: Column, tvg_id: Column) -> Column:
    """Id in the path, else a guide id that is one; empty if neither."""
    found = F.lower(F.regexp_extract(urls.path(request(url)), STITCHED, 1))
    raw = F.trim(tvg_id)
    return F.when(found != "", found).when(raw.rlike(RAW_ID), F.lower(raw)).otherwise("")


def is_direct(url: Column) -> Column:
    plain = request(url)
    host, path = urls.host(plain), urls.path(plain)
    last = F.trim(F.substring_index(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1), ".", 1))
    return ((host == DOMAIN) | host.endswith(f".{DOMAIN}")) & (path.rlike(STITCHED) | last.rlike(RAW_ID))


def is_resolver(url: Column) -> Column:
    return F.trim(url).rlike(RESOLVED)


def resolver_url(id: Column) -> Column:
    before, after = RESOLVER.split("{}")
    return F.concat(F.lit(before), F.lower(F.trim(id)), F.lit(after))


def _marked(channels: DataFrame) -> DataFrame:
    direct = ~is_resolver(F.col("stream_url")) & is_direct(F.col("stream_url"))
    return channels.withColumn("direct", direct).withColumn("alt_id", F.when(direct, channel_id(F.col("stream_url"), F.col("tvg_id"))).otherwise("")).withColumn("alt_url", F.when(F.col("alt_id") != "", resolver_url(F.col("alt_id"))))


def generated(channels: DataFrame) -> DataFrame:
    """Alternates of channels whose resolver URL isn't known yet, the first of each; they come after all channels."""
    marked = _marked(channels).where("alt_url is not null").withColumn("alt_key", urls.alternate_url(F.col("alt_url")))
    known = channels.select(urls.alternate_url(F.col("stream_url")).alias("alt_key")).distinct()
    first = best(marked.join(known, "alt_key", "left_anti"), ["alt_key"], ["ord"])
    more = F.create_map(F.lit("generated-alternative"), F.lit("jmp2"), F.lit("pluto-channel-id"), F.col("alt_id"), F.lit("original-source-id"), F.col("source_id"))
    kept = F.map_filter("attributes", lambda k, _: ~k.isin("generated-alternative", "pluto-channel-id", "original-source-id"))
    shift = F.lit(1 << 40)
    new = {"ord": F.col("ord") + shift, "stream_url": F.col("alt_url"), "source_id": F.lit(SOURCE_ID), "attributes": F.map_concat(kept, more)}
    return first.select(*[new.get(c, F.col(c)).alias(c) for c in channels.columns])


def expand(channels: DataFrame) -> DataFrame:
    return channels.unionByName(generated(channels))


def stats(channels: DataFrame) -> DataFrame:
    made = generated(channels).agg(F.count(F.lit(1)).alias("generated_alternatives"))
    seen = _marked(channels).agg(
        F.count(F.lit(1)).alias("input_channels"),
        F.count_if("direct").alias("direct_pluto_channels"),
        F.count_if(is_resolver(F.col("stream_url"))).alias("existing_resolver_channels"),
        F.count_if(F.col("direct") & (F.col("alt_id") == "")).alias("missing_channel_id"),
        F.count_if(F.col("alt_url").isNotNull()).alias("with_id"),
    )
    return seen.crossJoin(made).withColumn("skipped_duplicate_urls", F.expr("with_id - generated_alternatives")).drop("with_id")  # one row each
