"""What is published: by health, by provider and device, and what became of each group of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, urls
from .keyed import best

#: Marks of the provider that devices check.
PROVIDER = "pluto"
PROVIDER_HOSTS = ["pluto.tv", "plutotv.net", "jmp2.uk"]


def last_by_url(health: DataFrame, order: str = "ord") -> DataFrame:
    """Of each trimmed URL the last health row."""
    return best(health.withColumn("url_key", F.trim("stream_url")).where("url_key <> ''"), ["url_key"], [F.desc(order)])


def publishable(channels: DataFrame, health: DataFrame) -> DataFrame:
    """Channels whose URL is known to be online or reachable."""
    good = last_by_url(health).where(scores.publishable(F.col("status"))).select("url_key")
    return channels.join(good, F.trim(channels["stream_url"]) == good["url_key"], "left_semi")


def apply(entries: DataFrame, health: DataFrame) -> DataFrame:
    """entries (ord, url, ...) with hard (its health shows that it won't play) and uncertain (kept, known, and not online)."""
    known = last_by_url(health).select("url_key", "status", "classification_reason", "http_status", "segment_http_status")
    found = entries.join(known, F.trim(entries["url"]) == known["url_key"], "left")
    hard = F.col("url_key").isNotNull() & scores.hard_failure(F.col("classification_reason"), F.col("http_status"), F.col("segment_http_status"))
    return found.withColumn("hard", hard).withColumn("uncertain", ~F.col("hard") & F.col("url_key").isNotNull() & (F.coalesce("status", F.lit("")) != "online")).select(*entries.columns, "hard", "uncertain")


def policy_stats(applied: DataFrame) -> DataFrame:
    return applied.agg(F.count(F.lit(1)).alias("entries_seen"), F.count_if(~F.col("hard")).alias("entries_published"), F.count_if("hard").alias("hard_failures_removed"), F.count_if("uncertain").alias("uncertain_kept"))


def is_provider(source_id: Column, group: Column, name: Column, url: Column) -> Column:
    low = F.lower
    hosted = urls.host(url).rlike("|".join(h.replace(".", r"\.") for h in PROVIDER_HOSTS))
    return F.contains(low(source_id), F.lit(PROVIDER)) | F.contains(low(group), F.lit(PROVIDER)) | F.startswith(low(name), F.lit(f"{PROVIDER} ")) | hosted


def accepted(status: Column, score: Column, minimum: float = 70, reachable: bool = True) -> Column:
    return F.coalesce(status.isin("online", *(["reachable"] if reachable else [])) & (score >= minimum), F.lit(False))


def verify_provider(channels: DataFrame, health: DataFrame, *, minimum: float = 70, reachable: bool = True) -> DataFrame:
    """The provider's channels, the first of each URL, with accepted; a URL without health isn't."""
    own = channels.where(is_provider(*(F.col(c) for c in ("source_id", "group", "name", "stream_url")))).withColumn("url_key", F.trim("stream_url"))
    first = best(own, ["url_key"], ["ord"])
    known = last_by_url(health).select("url_key", "status", "health_score")
    return first.join(known, "url_key", "left").withColumn("accepted", accepted(F.col("status"), F.col("health_score"), minimum, reachable))


def device_channels(channels: DataFrame, verified: DataFrame) -> DataFrame:
    """All channels but those of the provider that weren't accepted."""
    good = verified.where("accepted").select(F.col("url_key").alias("good_url"))
    marked = channels.withColumn("__own", is_provider(*(F.col(c) for c in ("source_id", "group", "name", "stream_url"))))
    own = marked.where("__own").join(good, F.trim("stream_url") == F.col("good_url"), "left_semi")
    return marked.where("not __own").unionByName(own).drop("__own")


def outcome(any_good: Column, changed: Column, initial_good: Column, selected_good: Column) -> Column:
    """What became of a group between the first choice and the last."""
    return (
        F.when(~any_good, "all_candidates_failed")
        .when(changed & ~initial_good & selected_good, "recovered_from_alternative")
        .when(changed & selected_good, "upgraded_to_better_alternative")
        .when(selected_good, "selected_primary")
        .otherwise("selection_not_publishable")
    )


def recovery(initial: DataFrame, final: DataFrame, members: DataFrame, health: DataFrame) -> DataFrame:
    """Outcome of each group. initial and final: group_id, stream_url of the choice; members: group_id, stream_url."""
    good = last_by_url(health).where(scores.publishable(F.col("status"))).select("url_key", F.lit(True).alias("good"))
    some = members.withColumn("url_key", F.trim("stream_url")).join(good, "url_key").select("group_id").distinct().withColumn("any_good", F.lit(True))
    i = initial.select("group_id", F.trim("stream_url").alias("initial_url"))
    f = final.select("group_id", F.trim("stream_url").alias("final_url"))
    rows = f.join(i, "group_id", "left").withColumn("initial_url", F.coalesce("initial_url", "final_url")).join(some, "group_id", "left")
    for c in ("initial", "final"):
        rows = rows.join(good.toDF(f"{c}_url", f"{c}_good"), f"{c}_url", "left")
    rows = rows.na.fill(False, ["any_good", "initial_good", "final_good"]).withColumn("changed", F.col("initial_url") != F.col("final_url"))
    return rows.withColumn("outcome", outcome(*(F.col(c) for c in ("any_good", "changed", "initial_good", "final_good"))))


def recovery_stats(outcomes: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(n("selected_primary").alias("selected_primary"), n("recovered_from_alternative").alias("recovered"), n("upgraded_to_better_alternative").alias("upgraded"), n("all_candidates_failed", "selection_not_publishable").alias("all_failed"))
