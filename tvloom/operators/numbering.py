"""Row numbers in a global order, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import scratch, written


def numbered(rows: DataFrame, order: list[Column | str], name: str = "ord", start: int = 0) -> DataFrame:
    """rows with their number in `order`, from `start`; rows that are equal in it are numbered one way or the other.

    Sorted rows lie in ranges, which Spark cuts by a sample, one after the other. Within its range a row's place is known
    to its task; the ranges before it are counted, and their sums, one row a range, are what it is moved by.
    """
    with scratch(rows.sparkSession):
        # written, so that a second look at the ranges finds them the same
        ordered = written(rows.orderBy(*order).select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("place")), "ordered", keep=True)
        range_ = F.shiftright("place", 33)
        counts = ordered.groupBy(range_.alias("range")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # one row a range
        moved = written(counts.select("range", before.alias("before")), "ranges", keep=True)
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    found = ordered.join(moved, range_ == moved["range"])
    return found.select(*[F.col("row")[c].alias(c) for c in rows.columns if c != name], (within + F.col("before") + start).cast("long").alias(name))
