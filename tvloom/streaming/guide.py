"""Streams of programmes and probes. An extension: the batch engine has no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def fresh_programmes(programmes: DataFrame, at: str = "published", delay: str = "1 day") -> DataFrame:
    """Each programme once within the delay, by channel, start, stop and title."""
    keyed = programmes.withColumn("gid", text.casefold("channel_id")).withColumn("folded", text.casefold("title"))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["gid", "start", "stop", "folded"]).drop("gid", "folded")


def probe_counts(probes: DataFrame, at: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts and mean latency of probes by window and status; late rows beyond the delay don't count."""
    return probes.withWatermark(at, delay).groupBy(F.window(at, window), "status").agg(F.count(F.lit(1)).alias("probes"), F.avg("response_ms").alias("average_ms"))


def outages(probes: DataFrame, at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of offline probes of a URL with no pause longer than the gap."""
    off = probes.where("status = 'offline'").withWatermark(at, delay)
    return off.groupBy(F.session_window(at, gap), "stream_url").agg(F.count(F.lit(1)).alias("probes"))
