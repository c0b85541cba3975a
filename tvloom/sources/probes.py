"""Recorded probes: the health document that a run wrote, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines

CHANNEL = "stream_url string, status string, classification_reason string, http_status string, segment_http_status string, health_score double, response_ms int"


def read_listed(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, DataFrame] | None:
    """The facts of a JSON document (value, one row) and its list under `key` (ord, value), if it is laid out as `write_listed`
    does it: facts in the first line, a row in each other. Such a document of any size is read in splits. None: it isn't.
    """
    lines = read_lines(spark, path)
    facts = F.concat("value", F.lit("]}"))
    n = lines.agg(F.max("pos")).first()[0] or 0
    row = F.when(F.col("pos") < n - 1, F.regexp_extract("value", r"(?s)^(\{.*\}),$", 1)).otherwise(F.col("value"))
    bad = F.when(F.col("pos") == 0, F.get_json_object(facts, f"$.{key}").isNull() | ~F.col("value").endswith("["))
    bad = bad.when(F.col("pos") == n, F.col("value") != "]}").otherwise(~row.startswith("{") | F.get_json_object(row, "$").isNull())
    blank = (F.col("value") == "") & (F.lit(n) == 2)  # a list of no rows
    if n < 2 or lines.where(bad & ~blank).take(1):
        return None
    return lines.where("pos = 0").select(facts.alias("value")), lines.where((F.col("pos") > 0) & (F.col("pos") < n) & ~blank).select((F.col("pos") - 1).alias("ord"), row.alias("value"))


def read_facts(spark: SparkSession, path: str, schema: str, key: str = "channels") -> DataFrame:
    """Facts of a report, by their schema: one row."""
    found = read_listed(spark, path, key)
    return spark.read.schema(schema).json(path, multiLine=True) if found is None else found[0].select(F.from_json("value", schema).alias("f")).select("f.*")


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a health document in its order; of a document without channels, or that isn't enabled, none."""
    listed = read_listed(spark, path, "channels")
    found = None if listed else spark.read.schema(f"enabled boolean, channels array<struct<{CHANNEL.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>").json(path, multiLine=True)
    if listed:
        enabled = listed[0].select(F.from_json("value", "enabled boolean").alias("f")).where(F.coalesce("f.enabled", F.lit(True)))
        rows = listed[1].crossJoin(F.broadcast(enabled)).select("ord", F.from_json("value", CHANNEL).alias("c")).select("ord", "c.*")  # one row or none
    else:
        rows = found.where(F.coalesce("enabled", F.lit(True))).select(F.posexplode("channels").alias("ord", "c")).select(F.col("ord").cast("long"), "c.*")
    whole = lambda c: F.col(c).try_cast("int").alias(c)
    return rows.where(F.trim(F.coalesce("stream_url", F.lit(""))) != "").select("ord", F.trim("stream_url").alias("stream_url"), "status", "classification_reason", whole("http_status"), whole("segment_http_status"), "health_score", "response_ms")
