"""Ranking the candidates of a cluster and merging them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scores, text, urls


def evaluate(channels: DataFrame, priorities: DataFrame | None = None, health: DataFrame | None = None) -> DataFrame:
    """channels with the rank's components. priorities: source_id, priority; health: stream_url, health_score.

    A source without a priority has 100, a URL without health 0; values that aren't numbers count as missing.
    """
    out = channels
    if priorities is None:
        out = out.withColumn("source_priority", F.lit(C.DEFAULT_PRIORITY))
    else:
        # of a key the last; rows come in their order, or say it in `ord`
        place = F.col("ord") if "ord" in priorities.columns else F.monotonically_increasing_id()
        placed = priorities.select(text.text_key("source_id").alias("__source"), F.col("priority").cast("string").try_cast("int").alias("p"), place.alias("at"))
        known = placed.groupBy("__source").agg(F.max_by("p", "at").alias("source_priority"))
        out = out.withColumn("__source", text.text_key("source_id")).join(known, "__source", "left").drop("__source").withColumn("source_priority", F.coalesce("source_priority", F.lit(C.DEFAULT_PRIORITY)))
    if health is None:
        out = out.withColumn("health_score", F.lit(0.0))
    else:
        number = F.col("health_score").cast("string").try_cast("double")
        good = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
        known = health.withColumn("__url", urls.identity_url(F.col("stream_url"))).groupBy("__url").agg(F.max(good).alias("health_score"))
        out = out.withColumn("__url", urls.identity_url(F.col("stream_url"))).join(known, "__url", "left").drop("__url").withColumn("health_score", F.coalesce("health_score", F.lit(0.0)))
    combined = F.lower(F.concat_ws(" ", "name", "tvg_name", "group", "stream_url"))
    return (
        out.withColumn("quality_score", scores.quality(combined))
        .withColumn("metadata_score", scores.metadata(*(F.col(c) for c in ("tvg_id", "tvg_name", "logo", "group", "attributes", "extra_directives"))))
        .withColumn("transport_score", scores.transport(F.col("stream_url")))
    )


def rank(evaluated: DataFrame, key: str = "cluster", tie: str = "ord") -> DataFrame:
    """evaluated with `rank` within `key`, from 1."""
    return evaluated.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*scores.rank_order(tie))))


def with_reason(ranked: DataFrame, key: str = "cluster", tie: str = "ord") -> DataFrame:
    """The first of each key, with size and reason: what set it before the runner-up (null: it is alone)."""
    by = W.partitionBy(key).orderBy(*scores.rank_order(tie))
    runner = {f"__{c}": F.lead(c).over(by) for c, _, _ in scores.RANK}
    out = ranked.withColumns(runner | {"__more": F.lead(tie).over(by).isNotNull(), "size": F.count(F.lit(1)).over(W.partitionBy(key))})
    reason = F.when(F.col("__more"), scores.selection_reason(lambda c: F.col(c), lambda c: F.col(f"__{c}")))
    return out.withColumn("reason", reason).where("rank = 1").drop("__more", *runner)


def merge(clustered: DataFrame, priorities: DataFrame | None = None, health: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Selected channels, by (group, name, URL), and decisions of groups with several: selected, discarded and reason."""
    ranked = rank(evaluate(clustered, priorities, health))
    selected = with_reason(ranked)
    discarded = ranked.where("rank > 1").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "stream_url"))), lambda x: x["stream_url"]).alias("discarded"))
    decisions = selected.where("size > 1").select("cluster", "group_id", F.col("stream_url").alias("selected"), "reason", "size").join(discarded, "cluster").withColumn("duplicates_removed", F.size("discarded"))
    return output_order(selected), decisions


def output_order(channels: DataFrame) -> DataFrame:
    return channels.orderBy(text.casefold("group"), text.casefold("name"), "stream_url")


def groups(clustered: DataFrame, priorities: DataFrame | None = None, health: DataFrame | None = None) -> DataFrame:
    """One row per cluster: group_id, its candidates by rank, preferred and alternatives, size and is_duplicate."""
    ranked = rank(evaluate(clustered, priorities, health))
    fields = ["rank", "name", "stream_url", "source_id", "group", *[c for c, _, _ in scores.RANK]]
    out = ranked.groupBy("cluster", "group_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))
    return out.withColumn("preferred", F.col("candidates")[0]).withColumn("alternatives", F.slice("candidates", 2, F.greatest(F.size("candidates") - 1, F.lit(0)))).withColumn("size", F.size("candidates")).withColumn("is_duplicate", F.size("candidates") > 1)
