"""The batch run: sources to published playlists, guide and reports, as one plan with actions at the sinks only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.constants import ALTERNATE_PRIORITY
from ..operators import alternates, cluster, export, guide, health, history, keyed, match, policy, rank, reports
from ..sinks import rewrite
from ..sources import playlist, xmltv
from ..sources.catalog import Settings


def parsed(texts: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Channels of all enabled sources in source and record order, issues and stats. texts: source_id, text."""
    enabled = sources.where("enabled").select(F.col("id").alias("source_id"), F.col("ord").alias("s_ord"))
    channels, issues, stats = playlist.parse(texts.join(enabled.select("source_id"), "source_id", "left_semi"))
    placed = channels.join(enabled, "source_id").withColumn("ord", F.col("s_ord") * (1 << 24) + F.col("ord")).drop("s_ord")
    return placed.select(channels.columns), issues, stats


def priorities(sources: DataFrame) -> DataFrame:
    own = sources.select(F.col("id").alias("source_id"), "priority")
    return own.union(own.sparkSession.createDataFrame([(alternates.SOURCE_ID, ALTERNATE_PRIORITY)], "source_id string, priority int"))


def choose(channels: DataFrame, sources: DataFrame, responses: DataFrame, settings: Settings, now: int) -> dict[str, DataFrame]:
    """Candidates, their health, the first choice, the last, decisions and what became of each group."""
    clustered = cluster.cluster(alternates.expand(channels))
    known = priorities(sources)
    first, _ = rank.merge(clustered, known)
    unique = keyed.first_wins(clustered, F.trim("stream_url"))
    probed = health.probe(unique, responses, now=now, deep=settings.deep_check, expected_country=settings.expected_country)
    score = probed.select("stream_url", scores.merge_health(F.col("status"), F.col("health_score")).alias("health_score"))
    selected, decisions = rank.merge(clustered, known, score)
    outcomes = policy.recovery(first.select("group_id", "stream_url"), selected.select("group_id", "stream_url"), clustered.select("group_id", "stream_url"), probed)
    if settings.publish_only_online:
        selected = policy.publishable(selected, probed)
    return {"clustered": clustered, "health": probed, "selected": selected, "decisions": decisions, "outcomes": outcomes}


def run(spark: SparkSession, texts: DataFrame, sources: DataFrame, responses: DataFrame, documents: DataFrame, out: str, settings: Settings, now: int, log: str | None = None) -> dict:
    """Write both playlists, the guide and the report under `out`; the report. `log`: where what runs find is kept, by `now`."""
    channels, issues, parse_stats = parsed(texts, sources)
    chosen = choose(channels, sources, responses, settings, now)
    selected = chosen["selected"].select(channels.columns)

    items = xmltv.read_items(documents)
    guide_channels, programmes = xmltv.channels(items), xmltv.programmes(items)
    merged = guide.merge_channels(guide_channels)
    matched = match.match(selected, merged.withColumn("ord", F.col("doc_ord") * (1 << 24) + F.col("ord")), minimum=settings.similarity_minimum)
    shown, output = guide.generate(guide_channels, programmes, matched)
    filled = match.fill(selected, matched, merged)

    # both playlists are published in full, then rewritten in place: the policy first, duplicates after
    kept = filled.drop("changed")
    files = [f"{out}/playlist.m3u", f"{out}/playlist_device.m3u"]
    export.write_playlist(kept, files[0])
    verified = policy.verify_provider(kept, chosen["health"], minimum=settings.device_min_score)
    export.write_playlist(policy.device_channels(kept, verified), files[1])
    applied = rewrite.apply_policy(spark, files, chosen["health"], report=f"{out}/publish-policy.json")
    removed = rewrite.dedupe_outputs(spark, files)
    fetched = items.where("kind = 'document' and error is null").count()
    guide_state = export.publish_guide(shown, output, matched, f"{out}/epg.xml", fetched=fetched)
    totals = parse_stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parse_stats.columns if c != "source_id"])
    recovery = policy.recovery_stats(chosen["outcomes"])
    reports.health_report(chosen["health"], f"{out}/health.json", recovery=recovery.first().asDict())
    if log:
        history.remember(chosen["health"], f"{log}/health", now)
        history.remember_downloads(responses, f"{log}/downloads", now)
    device = reports.device_report(kept, chosen["health"], f"{out}/device-report.json", minimum=settings.device_min_score)
    document = export.report(
        {"parser": totals, "groups": cluster.cluster_stats(chosen["clustered"]), "health": health.stats(chosen["health"]), "matching": match.stats(matched), "recovery": recovery},
        guide=guide_state,
        policy={k: v for k, v in applied["files"][0].items() if k != "file"},
        device_policy={k: v for k, v in applied["files"][1].items() if k != "file"},
        duplicates_removed=removed[files[0]],
        device_duplicates_removed=removed[files[1]],
        device=device,
        decisions=export.reported(chosen["decisions"], ["cluster"]),
        issues=export.reported(issues, ["source_id", "line_number"]),
    )
    if log:
        document["history"] = history.summary(spark, f"{log}/health").first().asDict()
    published = applied["files"][0]["entries_published"] - removed[files[0]]
    document["channels"] = reports.run_metrics(document["parser"]["channels_created"], document["groups"]["input_channels"], document["groups"]["groups"], applied["files"][0]["entries_seen"], published)
    export.write_json(document, f"{out}/report.json")
    return document

