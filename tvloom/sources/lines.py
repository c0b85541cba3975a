"""Lines of one published file, read in splits by many tasks, with their number in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.cluster import written


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """pos (from 0) and value of the lines of a file; what follows the last separator counts if it isn't empty.

    separator: what parts lines; by default any line end. A line's place in its split is known to its task; the splits before are
    counted, and their sums, one row a split, are what it is moved by.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    # written, so that a second look at the splits finds them the same
    raw = reader.text(path).select("value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    raw = written(raw, "lines", keep=True)
    counts = raw.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select("start", (before - F.col("first")).alias("by"))
    return raw.join(F.broadcast(moved), "start").select((F.col("at") + F.col("by")).alias("pos"), "value")
