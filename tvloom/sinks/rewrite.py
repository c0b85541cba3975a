"""Published playlists rewritten in place: by the publication policy, and without duplicates.

A rewrite reads the playlist's entries with Spark, keeps some, and writes the others' lines as they were, after the lines
before the first entry. The file changes only when all of it is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import dedupe, policy
from ..operators.cluster import written
from ..sources import playlist
from . import ordered_file

#: Fixed value: the name of the policy in its report.
POLICY = "remove_only_demonstrated_hard_failures"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a playlist file; that with ord 0 holds the lines before the first."""
    return playlist.entries_of(playlist.file_lines(spark, path, ""))


def write_entries(entries: DataFrame, path: str) -> None:
    """The lines of entries in order; white space at the end goes but for one line feed."""
    lines = entries.select("ord", F.posexplode("lines").alias("pos", "line"))
    # the last line that isn't blank: one row
    end = lines.where(F.col("line").rlike(r"(?U)\S")).agg(F.max(F.struct("ord", "pos")).alias("end"))
    place = F.struct("ord", "pos")
    shown = lines.crossJoin(end).where(place <= F.col("end")).withColumn("line", F.when(place == F.col("end"), F.regexp_replace("line", r"(?U)\s+$", "")).otherwise(F.col("line")))
    ordered_file.write(shown.orderBy("ord", "pos").select(F.lit(0).alias("section"), "line"), path, separator="\n", tail="\n")


def rewrite(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Keep of the entries those that `keep` returns: (its rows, with what columns it adds; all entries but ord 0)."""
    entries = written(read_entries(spark, path), "entries", keep=True)
    rows = entries.where("ord > 0")
    kept = written(keep(rows), "kept", keep=True)
    write_entries(entries.where("ord = 0").unionByName(kept.select(entries.columns)), path)
    return kept, rows


def apply_policy_to(spark: SparkSession, path: str, health: DataFrame) -> dict[str, object]:
    """Take entries that were shown not to play out of a playlist file; its counts. A missing file counts nothing."""
    names = ("entries_seen", "entries_published", "hard_failures_removed", "uncertain_kept")
    if not ordered_file.exists(path):
        return {"file": path} | dict.fromkeys(names, 0)
    kept, rows = rewrite(spark, path, lambda rows: policy.apply(rows, health).where("not hard"))
    seen = rows.count()
    counts = kept.agg(F.count(F.lit(1)).alias("published"), F.count_if("uncertain").alias("uncertain")).first()
    return {"file": path} | dict(zip(names, (seen, counts.published, seen - counts.published, counts.uncertain)))


def apply_policy(spark: SparkSession, paths: list[str], health: DataFrame | None, *, enabled: bool = True, report: str | None = None) -> dict[str, object]:
    """Apply the policy to playlist files; its report, which is also written to the path `report`. health: None if there is no
    health document."""
    if health is None or not enabled:
        document = {"enabled": False, "reason": "health_report_missing" if health is None else "health_disabled", "files": []}
    else:
        files = [apply_policy_to(spark, path, health) for path in paths]
        document = {"enabled": True, "policy": POLICY, "hard_failure_reasons": sorted(C.HARD_REASONS), "hard_http_statuses": sorted(C.HARD_STATUSES), "files": files}
    if report:
        ordered_file.replace(report, (json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode())
    return document


def dedupe_file(spark: SparkSession, path: str) -> int:
    """Take later entries with an id or a name seen before out of a playlist file; how many went."""
    kept, rows = rewrite(spark, path, dedupe.dedupe_entries)
    return rows.count() - kept.count()


def dedupe_outputs(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Entries that went from each playlist file that is there."""
    return {path: dedupe_file(spark, path) for path in paths if ordered_file.exists(path)}
