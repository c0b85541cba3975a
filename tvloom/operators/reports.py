"""Reports of a run. Their lists are written by the tasks that hold the rows; their counts come from the pass that makes these."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.constants import RETRYABLE
from ..sinks import ordered_file
from ..sources import catalog
from . import policy
from .cluster import written

ATTEMPTS = "array<struct<attempt:int,status:string,http_status:int,elapsed_ms:int,error_type:string>>"


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """df as a written table, and counts over its rows, from the same pass. Of no rows sums are null, counts 0."""
    seen = Observation(f"{name}-counts")
    table = written(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name, keep=True)
    return table, seen.get


def write_listed(rows: DataFrame, order: list, path: str, key: str, facts: dict) -> None:
    """A JSON document: facts, and under `key` all rows, in order. Nulls are kept."""
    shown = rows.select(*[F.expr(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)], F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
    head = json.dumps(facts, ensure_ascii=False, default=str)[:-1] + (", " if facts else "") + json.dumps(key) + ": [\n"
    ordered_file.write(shown.orderBy(*[f"o{i}" for i in range(len(order))]).select(F.lit(0).alias("section"), "line"), path, heads=[head], separator=",\n", tail="\n]}\n")


def health_report(health: DataFrame, path: str, *, enabled: bool = True, recovery: dict | None = None, **facts) -> dict:
    """Write all health rows with their counts; the counts."""
    by = {s: F.count_if(F.col("status") == s) for s in ("online", "reachable", "offline")}
    table, counts = counted(health, "health", checked=F.count(F.lit(1)), **by)
    write_listed(table, ["ord"], path, "channels", facts | {"enabled": enabled} | counts | {"alternative_recovery": recovery or {}})
    return counts


def device_report(channels: DataFrame, health: DataFrame, path: str, *, minimum: float = 70, reachable: bool = True, **facts) -> dict:
    """Write what became of the provider's channels, the first of each URL, with their health; the counts."""
    verified = policy.verify_provider(channels, health, minimum=minimum, reachable=reachable)
    own = policy.last_by_url(health)
    known = own.select(F.col("url_key"), F.struct(*[own[c] for c in health.columns]).alias("health"))
    rows = verified.select("ord", "name", "stream_url", "source_id", "url_key", "accepted").join(known, "url_key", "left").drop("url_key")
    table, counts = counted(rows, "device", checked=F.count(F.lit(1)), accepted=F.count_if("accepted"), rejected=F.count_if(~F.col("accepted")))
    write_listed(table, ["ord"], path, "channels", facts | {"minimum_score": minimum, "accept_reachable": reachable} | counts)
    return counts


def source_diagnostics(sources: DataFrame, responses: DataFrame, parsed: DataFrame) -> DataFrame:
    """A row for each source, disabled ones too: status (success, error, disabled), what its download took, and its parser's counts.

    sources: ord, id, url, enabled; responses: by URL, as `fetch` gives them; parsed: a row for each source_id that was read.
    """
    r = responses.groupBy("url").agg(F.min(F.struct("error_type", "http_status", "final_url", "content_type", "error", "elapsed_ms", F.octet_length("body").alias("bytes"), "attempts")).alias("r"))
    rows = sources.select("ord", F.col("id").alias("source_id"), "url", "enabled", catalog.is_remote().alias("is_remote")).join(r, "url", "left").join(parsed, "source_id", "left")
    failed = F.coalesce(F.col("r.error_type"), F.when(F.col("is_remote"), "missing").otherwise("")) != ""
    none, good = F.lit(0).cast("long"), ~failed
    attempts = F.coalesce("r.attempts", F.array().cast(ATTEMPTS))
    again = failed & (F.coalesce(F.col("r.http_status").isin(RETRYABLE), F.lit(False)) | (F.col("r.error_type") == "network"))
    counts = [F.coalesce(F.col(c), none).cast("long").alias(c) for c in parsed.columns if c != "source_id"]
    enabled = F.col("enabled")
    return rows.select(
        "ord", "source_id", "url",
        F.when(~enabled, "disabled").when(failed, "error").otherwise("success").alias("status"),
        F.when(enabled & failed, F.coalesce("r.error", F.lit("no response"))).otherwise("").alias("error"),
        F.when(enabled, F.size(attempts)).otherwise(0).alias("attempt_count"),
        F.when(enabled, F.coalesce(F.col("r.elapsed_ms").cast("long"), none)).otherwise(none).alias("download_ms"),
        F.when(enabled & good, F.coalesce(F.col("r.bytes").cast("long"), none)).otherwise(none).alias("bytes_downloaded"),
        F.when(enabled, F.col("r.http_status")).alias("http_status"),
        F.when(enabled, F.coalesce("r.final_url", "url")).otherwise("").alias("final_url"),
        F.when(enabled & good, F.coalesce("r.content_type", F.lit(""))).otherwise("").alias("content_type"),
        "is_remote", F.coalesce(enabled & again, F.lit(False)).alias("retryable"),
        F.when(enabled, attempts).otherwise(F.array().cast(ATTEMPTS)).alias("download_attempts"),
        *counts,
    )


def run_metrics(parsed: int, before_merge: int, merged: int, selected: int, published: int) -> dict[str, int]:
    """How many channels each step took away, never less than none."""
    less = lambda a, b: max(0, a - b)
    return {
        "channels_parsed": parsed, "channels_before_merge": before_merge, "merger_duplicates_removed": less(before_merge, merged), "channels_filtered_unavailable": less(merged, selected),
        "post_merge_duplicates_removed": less(selected, published), "channels_after_merge": published, "duplicates_removed": less(parsed, published),
    }
