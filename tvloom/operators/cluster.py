"""Entity resolution: rows that share any identity key form a cluster."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text, urls


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at its end, but for those to keep."""
    own: list[str] = []
    _scratch.append(own)
    try:
        yield
    finally:
        _scratch.pop()
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share.

    A folder of this machine's serves only where none is named and all tasks run in this process, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tvloom-")
        atexit.register(shutil.rmtree, shared.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a written table: a loop's lineage must end somewhere that survives a lost executor."""
    path = fresh(df.sparkSession, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identity_keys(url: Column, tvg_id: Column, name: Column) -> Column:
    """Keys (type, key) of a channel: URL, guide id, and name unless it is generic; empty ones are left out."""
    name_key = text.name_key(text.fold(name))
    keys = [("url", urls.identity_url(url)), ("tvg_id", text.text_key(tvg_id)), ("name", F.when(name_key.isin(C.GENERIC_NAMES), "").otherwise(name_key))]
    return F.filter(F.array(*[F.struct(F.lit(t).alias("type"), k.alias("key")) for t, k in keys]), lambda k: k["key"] != "")


def components(members: DataFrame, node: str = "ord") -> DataFrame:
    """node and cluster (its component's least node) of members (node, type, key): nodes that share a key are connected.

    Labels move over key groups, so a key of n nodes costs n rows and not n * n; then each label takes its own label, so
    long chains shrink by half a round.
    """
    with scratch(members.sparkSession):
        return written(_labels(members, node), "components", keep=True).toDF(node, "cluster")


def _labels(members: DataFrame, node: str) -> DataFrame:
    edges = written(members.select(F.col(node).alias("node"), F.struct("type", "key").alias("k")).distinct(), "edges")
    labels = written(edges.select("node", F.col("node").alias("label")).distinct(), "labels")
    while True:
        least = edges.join(labels, "node").groupBy("k").agg(F.min("label").alias("least"))
        near = edges.join(least, "k").groupBy("node").agg(F.min("least").alias("next"))
        beyond = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = labels.join(near, "node").join(beyond, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), F.col("label").alias("old"))
        moved = written(moved, "labels")
        labels = moved.select("node", "label")
        if not moved.where("label <> old").take(1):
            return labels


def cluster(channels: DataFrame) -> DataFrame:
    """channels with keys, cluster and group_id: the least key by type (guide id, name, URL), then value.

    A channel without keys is a cluster of its own.
    """
    # keys are folded in Python once, and read by the rounds that follow
    keyed = written(channels.withColumn("keys", identity_keys(F.col("stream_url"), F.col("tvg_id"), F.col("name"))), "keyed")
    members = keyed.select("ord", F.explode("keys").alias("k")).select("ord", "k.type", "k.key")
    found = keyed.join(components(members), "ord", "left").withColumn("cluster", F.coalesce("cluster", "ord"))
    order = F.create_map(*[F.lit(x) for pair in C.IDENTITY_ORDER.items() for x in pair])
    ids = found.select("cluster", F.explode("keys").alias("k")).groupBy("cluster").agg(F.min(F.struct(order[F.col("k.type")].alias("o"), F.col("k.type").alias("type"), F.col("k.key").alias("key"))).alias("least"))
    return found.join(ids.select("cluster", F.concat_ws(":", "least.type", "least.key").alias("group_id")), "cluster", "left")


def group_keys(clustered: DataFrame) -> DataFrame:
    """cluster and identity_keys: the keys of its members, each once, by type order and value."""
    order = F.create_map(*[F.lit(x) for pair in C.IDENTITY_ORDER.items() for x in pair])
    keys = clustered.select("cluster", F.explode("keys").alias("k")).groupBy("cluster").agg(F.array_sort(F.collect_set(F.struct(order[F.col("k.type")].alias("o"), F.col("k.type").alias("type"), F.col("k.key").alias("key")))).alias("found"))
    return keys.select("cluster", F.transform("found", lambda k: F.struct(k["type"].alias("type"), k["key"].alias("key"))).alias("identity_keys"))


def collisions(members: DataFrame) -> DataFrame:
    """type and collisions: rows with a key of the type less its different keys."""
    return members.groupBy("type", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("type").agg(F.sum(F.col("n") - 1).alias("collisions"))


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """One row: rows, groups, singletons, groups of several, and members beyond the first."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_channels"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("n") == 1).alias("singleton_groups"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("alternatives"),
    )
