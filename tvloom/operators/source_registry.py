"""The registry of sources: two keys (id and URL), search, updates and counts."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.constants import TRUSTED
from ..sources import catalog
from . import numbering
from .cluster import scratch, written
from .dedupe import greedy

#: Rows of a registry update that a task takes at once.
BLOCK = 20_000


def id_key():
    return F.trim(text.casefold(text.nfkc("id")))


def url_key():
    return urls.source_url(F.col("url"))


def checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and (ord, id, error) of the others."""
    marked = rows.withColumn("error", catalog.error())
    return marked.where("error is null").drop("error"), marked.where("error is not null").select("ord", "id", "error")


def add(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registered rows, errors, and one row of counts. A row is skipped if its id is known or its URL is owned; a skipped
    row doesn't claim its URL."""
    good, bad = checked(rows)
    kept = greedy(good, id_key(), url_key())
    counts = good.agg(F.count(F.lit(1)).alias("valid")).crossJoin(kept.agg(F.count(F.lit(1)).alias("inserted"))).crossJoin(bad.agg(F.count(F.lit(1)).alias("invalid")))  # one row each
    return kept, bad, counts.select("inserted", F.lit(0).cast("long").alias("replaced"), F.expr("valid - inserted").alias("skipped"), "invalid")


def upsert(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """What becomes of each valid row when known ids are replaced: action (inserted, replaced, skipped, clash), and
    place: of the rows that stand at the end, the place of the id's first row (else null).

    A new id is skipped if its URL is owned; a replacement whose URL another id owns is a clash; a replacement gives up
    the URL before it. Rows are taken in order, but by blocks at once (see `_decided`).
    """
    good, _ = checked(rows)
    with scratch(rows.sparkSession):
        open_ = written(good.select("ord", id_key().alias("i"), url_key().alias("u")), "open")
        # ids whose URLs no other id has: the first row is inserted, the others replace it
        shared = open_.groupBy("u").agg(F.min("i").alias("least"), F.max("i").alias("most")).where("least <> most").select("u")
        mixed = open_.join(shared, "u", "left_semi").select("i").distinct()
        own = open_.join(mixed, "i", "left_anti")
        ends = own.groupBy("i").agg(F.min("ord").alias("place"), F.max("ord").alias("row"))
        alone = own.join(ends, "i").select("ord", F.when(F.col("ord") == F.col("place"), "inserted").otherwise("replaced").alias("action"))
        decided = _decided(open_.join(mixed, "i", "left_semi"), block)
        # an id's last row that counts stands, in the place of its first
        current = decided.where("action in ('inserted', 'replaced')").groupBy("i").agg(F.min("ord").alias("place"), F.max("ord").alias("row"))
        standing = ends.select("place", "row").union(current.select("place", "row")).withColumnRenamed("row", "ord")
        done = written(alone.union(decided.select("ord", "action")).join(standing, "ord", "left"), "decided", keep=True)
    return good.join(done, "ord")


def _decided(open_: DataFrame, block: int) -> DataFrame:
    """ord, i and action of rows (ord, i, u) that are taken in order.

    Blocks of rows in order are taken by tasks at once, each from the state (of its ids and URLs) that the blocks before
    leave. At first that is held to be none. A block whose state turns out to be another is taken again, until none is:
    then each follows from the ones before. Every time at least one more block, the first that was wrong, is right for good,
    so there are at most as many times as blocks and one more, where each block depends on the one before. A task holds a block.
    """
    numbered_ = numbering.numbered(open_, ["ord"], "nth")
    placed = written(numbered_.select(F.floor(F.col("nth") / block).alias("block"), "ord", "i", "u"), "blocks")
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("i", "u")])
    needs = written(placed.select("block", F.explode(keys).alias("k")).select("block", "k.*").distinct(), "needs")
    made = written(_taken(placed, needs.limit(0).select("block", "kind", F.col("key").alias("i"), F.col("key").alias("u"))), "made")
    state = None
    while True:
        new = written(_state(needs, made), "state")
        other = new.withColumn("n", F.lit(1)) if state is None else new.withColumn("n", F.lit(1)).union(state.withColumn("n", F.lit(-1)))
        changed = written(other.groupBy(*new.columns).agg(F.sum("n").alias("n")).where("n <> 0").select("block").distinct(), "changed")
        if not changed.take(1):
            return made.where("ord is not null").select("ord", "i", "action")
        again = _taken(placed.join(changed, "block", "left_semi"), new.join(changed, "block", "left_semi"))
        made, state = written(made.join(changed, "block", "left_anti").union(again), "made"), new


def _state(needs: DataFrame, made: DataFrame) -> DataFrame:
    """What the blocks before leave for the keys (block, kind, key) of each: of an id its URL (kind i), of a URL its id (kind u)."""
    ends = made.where("ord is null").select("block", "i", "u", F.lead("block").over(W.partitionBy("i").orderBy("block")).alias("till"))
    left = F.struct("i", "u", "till").alias("left")
    events = reduce(DataFrame.union, [ends.select("block", F.lit(k).alias("kind"), F.col(k).alias("key"), left) for k in ("i", "u")])
    asked = needs.withColumn("left", F.lit(None).cast(events.schema["left"].dataType))
    # a block's own end counts for those after it
    before = W.partitionBy("kind", "key").orderBy("block", F.col("left").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = asked.union(events).withColumn("found", F.last("left", ignorenulls=True).over(before)).where("left is null and found is not null")
    return found.where("kind = 'i' or found.till is null or found.till >= block").select("block", "kind", "found.i", "found.u")


def _taken(placed: DataFrame, state: DataFrame) -> DataFrame:
    """block, ord, i, u and action of each row; and where ord is null, the URL that an id of the block has at its end, if it took one."""

    def take(rows: pa.Table) -> pa.Table:
        current, owner, took, out = {}, {}, {}, []
        rows = rows.to_pydict()
        block, lines = rows["block"][0], list(zip(rows["ord"], rows["i"], rows["u"], rows["kind"]))
        for _, i, u, kind in (x for x in lines if x[0] is None):
            if kind == "i":
                current[i] = u
            else:
                owner[u] = i
        for ord, i, u, _ in sorted((x for x in lines if x[0] is not None), key=lambda x: x[0]):
            known, free = i in current, owner.get(u, i) == i
            out.append((block, ord, i, u, ("replaced" if free else "clash") if known else "inserted" if free else "skipped"))
            if free:
                owner.pop(current.get(i), None)
                current[i] = took[i] = u
                owner[u] = i
        out += [(block, None, i, u, None) for i, u in took.items()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    kinds = {"block": pa.int64(), "ord": pa.int64(), "i": pa.string(), "u": pa.string(), "action": pa.string()}
    schema = pa.schema(list(kinds.items()))
    rows = placed.select("block", F.col("ord").cast("long").alias("ord"), "i", "u", F.lit(None).cast("string").alias("kind"))
    rows = rows.union(state.select("block", F.lit(None).cast("long"), "i", "u", "kind"))
    return rows.groupBy("block").applyInArrow(take, "block long, ord long, i string, u string, action string")


def search(
    sources: DataFrame,
    *,
    country: str = "",
    language: str = "",
    tags: list[str] | None = None,
    kinds: list[str] | None = None,
    discovery_only: bool | None = None,
    enabled_only: bool | None = None,
    remote_only: bool | None = None,
    min_trust_score: int = 0,
    match_unclassified: bool = False,
    sort_by_rank: bool = True,
) -> DataFrame:
    """Sources that meet all criteria; tags are alternatives. match_unclassified: an empty field meets its criterion."""
    if not 0 <= min_trust_score <= 100:
        raise ValueError("min_trust_score must be between 0 and 100")
    out = sources.where(F.col("trust_score") >= min_trust_score)
    for wanted, test in ((enabled_only, F.col("enabled")), (discovery_only, catalog.is_discovery()), (remote_only, catalog.is_remote())):
        if wanted is not None:
            out = out.where(test == wanted)
    if kinds:
        out = out.where(catalog.token(F.col("kind")).isin([k.strip().lower().replace("-", "_").replace(" ", "_") for k in kinds]))
    for value, column, normal in ((country, "country", catalog.country), (language, "language", catalog.language)):
        if value.strip():
            known = F.col(column) == normal(F.lit(value))
            out = out.where(known | (F.col(column) == "") if match_unclassified else known)
    if tags:
        some = F.arrays_overlap("tags", catalog.tags(F.lit(tags)))
        out = out.where(some | (F.size("tags") == 0) if match_unclassified else some)
    return out.orderBy("priority", F.desc("trust_score"), "ord") if sort_by_rank else out.orderBy("ord")


def discovery_sources(sources: DataFrame) -> DataFrame:
    return search(sources, discovery_only=True, enabled_only=True)


def static_sources(sources: DataFrame) -> DataFrame:
    return search(sources, discovery_only=False, enabled_only=True)


def italian_sources(sources: DataFrame) -> DataFrame:
    return search(sources, country="IT", enabled_only=True)


def matches(country: str = "", language: str = "", tags: list[str] | None = None):
    """Whether a source fits; empty on either side fits."""
    test = F.lit(True)
    for value, column, normal in ((country, "country", catalog.country), (language, "language", catalog.language)):
        if value.strip():
            test = test & ((F.col(column) == "") | (F.col(column) == normal(F.lit(value))))
    return test & ((F.size("tags") == 0) | F.arrays_overlap("tags", catalog.tags(F.lit(tags)))) if tags else test


def set_value(sources: DataFrame, id: str, **values) -> DataFrame:
    """The source of that id with other values (enabled, priority, trust_score)."""
    here = id_key() == F.lit(id.strip().casefold())
    return sources.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def remove(sources: DataFrame, id: str) -> DataFrame:
    return sources.where(id_key() != F.lit(id.strip().casefold()))


def snapshot(sources: DataFrame, *, enabled: bool = False) -> DataFrame:
    return (sources.where("enabled") if enabled else sources).orderBy("priority", "ord")


def stats(sources: DataFrame) -> DataFrame:
    """One row: counts, and kinds as a map."""
    kinds = sources.groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("kinds"))
    return sources.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("enabled").alias("enabled"),
        F.count_if(~F.col("enabled")).alias("disabled"),
        F.count_if(catalog.is_remote()).alias("remote"),
        F.count_if(~catalog.is_remote()).alias("local"),
        F.count_if(catalog.is_discovery()).alias("discovery"),
        F.count_if(~catalog.is_discovery()).alias("static"),
        F.count_if(F.col("trust_score") >= TRUSTED).alias("trusted"),
    ).crossJoin(kinds)  # one row each
