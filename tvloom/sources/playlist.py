"""Playlist text to channel records, in the dialects of the main, v2 and web readers, and the entry splitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_line
from .lines import read_lines

ATTRIBUTE = r"""([A-Za-z0-9_-]+)\s*=\s*(?:"((?:\\.|[^"])*+)"|'((?:\\.|[^'])*+)'|([^\s,]+))"""
SIMPLE_ATTRIBUTE = r'([\w-]+)="([^"]*)"'
#: Lines that are numbered in one group.
STRETCH = 10_000
#: Metadata and name around the first comma outside quotes; a backslash escapes.
INFO = r"""(?s)^((?:[^,"'\\]++|\\.|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+')*+),(.*)$"""
TRIM = r"(?U)^\s+|\s+$"


def text_lines(texts: DataFrame) -> DataFrame:
    """source_id, pos (from 1) and raw of each line of texts (source_id, text)."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    return texts.select("source_id", F.posexplode(F.split(plain, "\n")).alias("at", "raw")).select("source_id", (F.col("at") + 1).alias("pos"), "raw")


def file_lines(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """source_id, pos (from 1) and raw of each line of a file, read in splits; a line feed at its end opens no line."""
    value = F.when(F.col("pos") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return read_lines(spark, path).select(F.lit(source_id).alias("source_id"), (F.col("pos") + 1).alias("pos"), value.alias("raw"))


def _collapsed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def _last_wins(entries: Column) -> Column:
    """A map of entries (key, value); of equal keys, the last."""
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"])))


def attributes(metadata: Column) -> Column:
    """Attributes of an info line; keys in lower case, the last of a key counts."""
    groups = [F.regexp_extract_all(metadata, F.lit(ATTRIBUTE), F.lit(g)) for g in (1, 2, 3, 4)]

    def plain(value: Column) -> Column:
        for escaped, sign in ((r"\"", '"'), (r"\'", "'"), (r"\\", "\\")):
            value = F.replace(value, F.lit(escaped), F.lit(sign))
        return _collapsed(value)

    entries = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda z: F.struct(F.lower(z["g0"]).alias("key"), plain(F.concat(z["g1"], z["g2"], z["g3"])).alias("value")))
    return _last_wins(entries)


def simple_attributes(info: Column) -> Column:
    keys, values = (F.regexp_extract_all(info, F.lit(SIMPLE_ATTRIBUTE), F.lit(g)) for g in (1, 2))
    return _last_wins(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: F.struct(z["k"].alias("key"), z["v"].alias("value"))))


def _with_attribute(attrs: Column, key: str, value: Column) -> Column:
    """attrs with the value; an empty one only where the key is known."""
    rest = F.map_filter(attrs, lambda k, _: k != key)
    return F.when((value != "") | F.map_contains_key(attrs, key), F.map_concat(rest, F.create_map(F.lit(key), value))).otherwise(attrs)


def _records(lines: DataFrame) -> DataFrame:
    """Lines with rec: the running number of info lines of their source, summed by stretches of lines, so that a source of
    any length never meets in one task."""
    stretch = F.floor(F.col("pos") / STRETCH)
    counts = lines.groupBy("source_id", stretch.alias("stretch")).agg(F.sum(F.col("is_info").cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select(F.col("source_id").alias("of"), F.col("stretch").alias("at"), before.alias("before"))
    placed = lines.withColumn("stretch", stretch).join(moved, F.col("source_id").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")))
    by = W.partitionBy("source_id", "stretch").orderBy("pos")
    return placed.withColumn("rec", F.col("before") + F.sum(F.col("is_info").cast("long")).over(by.rowsBetween(W.unboundedPreceding, 0))).drop("stretch", "before", "of", "at")


def parse(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """channels, issues and stats of texts (source_id, text)."""
    return parse_lines(text_lines(texts))


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """channels, issues and stats of lines (source_id, pos, raw).

    An info line opens a record and gives up an open one; `#` lines of an open record are directives; the first other
    line closes it as its URL; lines outside records are orphans.
    """
    cleaned = lines.withColumn("source_id", _collapsed(clean_line(F.col("source_id")))).withColumn("line", clean_line(F.col("raw")))
    upper = F.upper("line")
    used = cleaned.where((F.col("line") != "") & ~upper.startswith("#EXTM3U")).withColumn("is_info", F.upper("line").startswith("#EXTINF:"))
    used = _records(used).withColumn("is_url", ~F.col("line").startswith("#"))
    inside = W.partitionBy("source_id", "rec").orderBy("pos")
    used = used.withColumn("urls", F.sum(F.col("is_url").cast("int")).over(inside.rowsBetween(W.unboundedPreceding, 0)))

    opened = used.where("rec > 0")
    records = opened.groupBy("source_id", "rec").agg(
        F.min("pos").alias("line_number"),
        F.min_by("line", "pos").alias("info"),
        F.min_by("line", F.when(F.col("is_url"), F.col("pos"))).alias("url_line"),
        F.array_sort(F.collect_list(F.when(~F.col("is_info") & (F.col("urls") == 0), F.struct("pos", "line")))).alias("found"),
    )
    last = F.col("rec") == F.col("last_rec")
    payload = F.substring("info", F.lit(len("#EXTINF:") + 1), F.length("info"))
    records = (
        records.join(opened.groupBy("source_id").agg(F.max("rec").alias("last_rec")), "source_id")
        .withColumn("closed", F.col("url_line").isNotNull())
        .withColumn("last", last)
        .withColumn("directives", F.transform("found", lambda d: d["line"]))
        .withColumn("whole", payload.rlike(INFO))
        .withColumn("attrs", attributes(F.regexp_extract(payload, INFO, 1)))
        .withColumn("raw_name", _collapsed(F.regexp_extract(payload, INFO, 2)))
        .withColumn("url", _unquoted(F.coalesce("url_line", F.lit(""))))
    )
    got = lambda key: F.coalesce(F.try_element_at("attrs", F.lit(key)), F.lit(""))
    group_line = F.get(F.filter("directives", lambda d: F.upper(d).startswith("#EXTGRP:")), 0)
    records = (
        records.withColumn("tvg_name", got("tvg-name"))
        .withColumn("tvg_id", got("tvg-id"))
        .withColumn("logo", _unquoted(got("tvg-logo")))
        .withColumn("group", F.coalesce(F.nullif(got("group-title"), F.lit("")), _collapsed(F.regexp_replace(group_line, "^[^:]*:", "")), F.lit("")))
        .withColumn("name", F.coalesce(F.nullif("raw_name", F.lit("")), F.col("tvg_name")))
    )
    code = (
        F.when(~F.col("closed") & ~F.col("last"), "abandoned_record")
        .when(~F.col("closed"), "missing_url")
        .when(~F.col("whole"), "malformed_extinf")
        .when(F.col("url") == "", "missing_url")
        .when(F.col("name") == "", "missing_name")
    )
    records = records.withColumn("code", code)
    attrs = F.col("attrs")
    for key, column in (("tvg-id", "tvg_id"), ("tvg-name", "tvg_name"), ("group-title", "group"), ("tvg-logo", "logo")):
        attrs = _with_attribute(attrs, key, F.col(column))
    channels = records.where("code is null").select("source_id", F.col("rec").alias("ord"), "name", F.col("url").alias("stream_url"), "group", "tvg_id", "tvg_name", "logo", attrs.alias("attributes"), F.col("directives").alias("extra_directives"))

    # an info line has no URL before it, so lines after the first URL of a record are outside it
    orphans = used.where(F.col("is_url") & ((F.col("rec") == 0) | (F.col("urls") > 1)))
    issues = records.where("code is not null").select("source_id", "line_number", "code", F.col("info").alias("raw_line")).unionByName(orphans.select("source_id", F.col("pos").alias("line_number"), F.lit("orphan_line").alias("code"), F.col("line").alias("raw_line")))

    totals = cleaned.groupBy("source_id").agg(F.count(F.lit(1)).alias("lines_total"), F.count_if(F.col("line") != "").alias("non_empty_lines"))
    counted = records.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("extinf_records"),
        F.count_if(F.col("code").isNull()).alias("channels_created"),
        *[F.count_if(F.col("code") == c).alias(n) for n, c in (("malformed_extinf", "malformed_extinf"), ("missing_name", "missing_name"), ("missing_url", "missing_url"), ("abandoned_records", "abandoned_record"))],
        F.sum(F.size("directives")).alias("directives_collected"),
    )
    lost = orphans.groupBy("source_id").agg(F.count(F.lit(1)).alias("orphan_lines"))
    stats = totals.join(counted, "source_id", "left").join(lost, "source_id", "left").na.fill(0).withColumn("skipped_records", F.expr("malformed_extinf + missing_name + missing_url + abandoned_records")).withColumn("invalid_channel", F.lit(0).cast("long"))
    return channels, issues, stats


def _unquoted(line: Column) -> Column:
    """A cleaned line as a URL: without quotes; comments are empty."""
    inner = F.regexp_replace(F.substring(line, F.lit(2), F.length(line) - 2), TRIM, "")
    url = F.when((F.length(line) >= 2) & line.rlike(r"""(?s)^(['"]).*\1$"""), inner).otherwise(line)
    return F.when(url.startswith("#"), "").otherwise(url)


def parse_ahead(texts: DataFrame, *, swallow: bool, default_group: str = "") -> DataFrame:
    """Records whose URL is the next line that isn't a comment, even past another info line.

    swallow: records of info lines passed on the way aren't emitted (v2); else they share the URL (web).
    """
    lines = text_lines(texts).withColumn("line", F.regexp_replace("raw", TRIM, ""))
    lines = lines.withColumn("is_info", F.col("line").startswith("#EXTINF:"))
    by = W.partitionBy("source_id").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    is_url = (F.col("line") != "") & ~F.col("line").startswith("#")
    ahead = F.first(F.when(is_url, F.struct("pos", "line")), ignorenulls=True).over(by)
    infos = lines.withColumn("ahead", ahead).where("is_info")
    if swallow:
        # of the info lines that run to one URL, or to the end, the first
        infos = infos.withColumn("nth", F.row_number().over(W.partitionBy("source_id", F.col("ahead.pos")).orderBy("pos"))).where("nth = 1")
    has_comma = F.col("line").contains(",")
    before = F.regexp_extract(F.regexp_replace("line", "^[^:]*:", ""), r"^(.*),[^,]*$", 1)
    infos = infos.withColumn("attrs", simple_attributes(F.col("line") if swallow else F.when(has_comma, before).otherwise(F.col("line"))))
    got = lambda key, default="": F.coalesce(F.try_element_at("attrs", F.lit(key)), F.lit(default))
    name = F.when(has_comma, F.regexp_replace(F.regexp_extract("line", "([^,]*)$", 1), TRIM, "")).otherwise(F.coalesce(F.try_element_at("attrs", F.lit("tvg-name")), F.lit("Canale")))
    group = F.coalesce(F.nullif(got("group-title"), F.lit("")), F.lit(default_group))
    return infos.select("source_id", F.col("pos").alias("ord"), name.alias("name"), got("tvg-id").alias("tvg_id"), got("tvg-name").alias("tvg_name"), got("tvg-logo").alias("logo"), group.alias("group"), F.coalesce("ahead.line", F.lit("")).alias("url"))


def entries(texts: DataFrame) -> DataFrame:
    """Entries of playlists: source_id, ord (0: the lines before the first), info, lines, and url, the last line that isn't a comment."""
    return entries_of(text_lines(texts))


def entries_of(lines: DataFrame) -> DataFrame:
    """Entries of lines (source_id, pos, raw)."""
    lines = _records(lines.withColumn("is_info", F.col("raw").startswith("#EXTINF:")))
    plain = F.regexp_replace("raw", TRIM, "")
    is_url = (F.col("rec") > 0) & (plain != "") & ~plain.startswith("#")
    return lines.groupBy("source_id", F.col("rec").alias("ord")).agg(
        F.min_by("raw", F.when(F.col("is_info"), F.col("pos"))).alias("info"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]).alias("lines"),
        F.coalesce(F.max_by(plain, F.when(is_url, F.col("pos"))), F.lit("")).alias("url"),
    )
