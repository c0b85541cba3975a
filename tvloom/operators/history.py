"""What is known of URLs across runs: their health, and their downloads.

A row stands for a stretch of runs: one run as it is appended, all of them once compacted. Two stretches of a URL that follow one
another make one, so what is known doesn't depend on when the log was compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from ..sinks import run_log
from . import policy

#: good_run: the last run that found the URL online or reachable; trailing: the checks since, all of which failed.
STRETCH = "key string, first_run long, last_run long, checks long, failures long, good_run long, trailing long, last_status string"
DOWNLOAD = "url string, run long, http_status int, final_url string, error_type string, error string, elapsed_ms long, bytes long, attempts array<struct<attempt:int,status:string,http_status:int,elapsed_ms:int,error_type:string>>"


def stretches(health: DataFrame, run: int) -> DataFrame:
    """The stretches of one run: of each trimmed URL its last row."""
    good, n = F.coalesce(scores.publishable(F.col("status")), F.lit(False)), F.lit(run).cast("long")
    failed = F.when(good, 0).otherwise(1).cast("long")
    return policy.last_by_url(health).select(
        F.col("url_key").alias("key"), n.alias("first_run"), n.alias("last_run"), F.lit(1).cast("long").alias("checks"), failed.alias("failures"),
        F.when(good, n).alias("good_run"), failed.alias("trailing"), F.col("status").alias("last_status"),
    )


def joined(rows: DataFrame) -> DataFrame:
    """One stretch a URL. Of the stretches only those that end after the last good run count as failing since."""
    good = F.max("good_run").over(W.partitionBy("key"))
    since = F.when(F.col("good").isNull() | (F.col("last_run") >= F.col("good")), F.col("trailing")).otherwise(0)
    return (
        rows.withColumn("good", good)
        .groupBy("key")
        .agg(
            F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"), F.sum("checks").alias("checks"), F.sum("failures").alias("failures"),
            F.max("good_run").alias("good_run"), F.sum(since).alias("trailing"), F.max_by("last_status", "last_run").alias("last_status"),
        )
    )


def remember(health: DataFrame, path: str, run: int) -> None:
    run_log.append(stretches(health, run), path, run)


def known(spark: SparkSession, path: str) -> DataFrame:
    """A row for each URL that any run has checked."""
    return joined(run_log.read(spark, path, STRETCH))


def compact(spark: SparkSession, path: str, *, since: int | None = None) -> None:
    """One stretch a URL from now on; URLs not checked since that run are forgotten."""
    run_log.compact(spark, path, STRETCH, lambda rows: joined(rows) if since is None else joined(rows).where(F.col("last_run") >= since))


def forget(spark: SparkSession, path: str, keys: DataFrame | None = None) -> None:
    """Nothing is known of these URLs (key) any more; without them, of any."""
    if keys is None:
        run_log.clear(spark, path, STRETCH)
    else:
        run_log.compact(spark, path, STRETCH, lambda rows: joined(rows).join(keys.select("key").distinct(), "key", "left_anti"))


def failing(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """URLs whose last `least` checks or more failed."""
    return known(spark, path).where(F.col("trailing") >= least)


def summary(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """One row: URLs known, never good, and failing for `least` checks or more."""
    return known(spark, path).agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("good_run").isNull()).alias("never_good"), F.count_if(F.col("trailing") >= least).alias("failing"))


def remember_downloads(responses: DataFrame, path: str, run: int) -> None:
    """What downloads took, without their bodies. Columns that responses don't have are null."""
    rows = responses.withColumns({"run": F.lit(run), "bytes": F.octet_length("body")})
    wanted = [(f.name, f.dataType) for f in T._parse_datatype_string(DOWNLOAD)]
    run_log.append(rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted]), path, run)


def downloads(spark: SparkSession, path: str) -> DataFrame:
    """All downloads so far; the last of a URL is the one of its last run."""
    return run_log.read(spark, path, DOWNLOAD)
