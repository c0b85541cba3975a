"""Playlists, guides and reports as text and files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sinks import ordered_file

#: Attributes that come first, in this order; the rest by name.
FIRST = ["tvg-id", "tvg-name", "tvg-logo", "group-title"]
MOST_REPORTED = 100


def _escaped(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(value, F.lit('"'), F.lit("'")), r"[\r\n]+", " "))


def with_category(channels: DataFrame) -> DataFrame:
    """channels with category and its place, and the name's category text."""
    forms = {c: text.category_text(text.fold(c)) for c in ("name", "group", "source_id")}
    out = channels.withColumns({f"__{c}": f for c, f in forms.items()})
    out = out.withColumn("category", scores.category(F.col("__name"), F.col("__group"), F.col("__source_id"))).withColumn("category_rank", scores.category_rank(F.col("category")))
    return out.withColumnRenamed("__name", "category_name").drop("__group", "__source_id")


def entry_text(channels: DataFrame) -> DataFrame:
    """channels (with category) with `entry`: info line, directives and URL."""
    own = F.map_filter(F.create_map(*[x for k, c in zip(FIRST, ("tvg_id", "tvg_name", "logo")) for x in (F.lit(k), F.trim(c))]), lambda _, v: v != "")
    attrs = F.map_concat(F.map_filter("attributes", lambda k, _: (k != "group-title") & ~F.map_contains_key(own, k)), own, F.create_map(F.lit("group-title"), F.col("category")))
    held = F.filter(F.lit(FIRST), lambda k: F.map_contains_key(F.col("__attrs"), k))
    keys = F.concat(held, F.array_sort(F.array_except(F.map_keys("__attrs"), F.lit(FIRST))))
    shown = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit('="'), _escaped(F.try_element_at(F.col("__attrs"), k)), F.lit('"'))), " ")
    info = F.concat(F.lit("#EXTINF:-1 "), shown, F.lit(","), F.trim("name"))
    directives = F.filter(F.transform("extra_directives", lambda d: F.trim(d)), lambda d: d != "")
    return channels.withColumn("__attrs", attrs).withColumn("entry", F.array_join(F.concat(F.array(info), directives, F.array(F.trim("stream_url"))), "\n")).drop("__attrs")


def header(guide_url: str = "") -> str:
    return f'#EXTM3U url-tvg="{guide_url.replace(chr(34), chr(39))}"' if guide_url else "#EXTM3U"


def playlist(channels: DataFrame) -> DataFrame:
    """entry lines of a playlist, by category, name and URL."""
    return entry_text(with_category(channels)).orderBy("category_rank", "category_name", F.trim("stream_url")).select("entry")


def write_text(lines: DataFrame, path: str, before: str = "", after: str = "") -> None:
    """An ordered one-column DataFrame as one file, written by the executors in parts and swapped in at once."""
    rows = lines.select(F.lit(0).alias("section"), F.col(lines.columns[0]).alias("line"))
    ordered_file.write(rows, path, heads=[f"{before}\n" if before else ""], terminator="\n", tail=f"{after}\n" if after else "")


def write_playlist(channels: DataFrame, path: str, guide_url: str = "") -> None:
    write_text(playlist(channels), path, header(guide_url))


def _xml(value: Column) -> Column:
    out = value
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), F.replace(_xml(value), F.lit('"'), F.lit("&quot;")), F.lit('"'))


def _element(tag: str, value: Column) -> Column:
    """An element line; null if empty."""
    return F.when(value != "", F.concat(F.lit(f"    <{tag}>"), _xml(value), F.lit(f"</{tag}>")))


def _icon(url: Column) -> Column:
    return F.when(url != "", F.concat(F.lit("    <icon"), _attribute("src", url), F.lit(" />")))


def guide_lines(channels: DataFrame, programmes: DataFrame) -> DataFrame:
    """Elements of a guide, channels first, in order; empty parts are left out."""
    names = F.transform("display_names", lambda n: F.concat(F.lit("    <display-name>"), _xml(n), F.lit("</display-name>")))
    channel = F.array_join(F.concat(F.array(F.concat(F.lit("  <channel"), _attribute("id", F.col("channel_id")), F.lit(">"))), names, F.array_compact(F.array(_icon(F.col("icon_url")))), F.array(F.lit("  </channel>"))), "\n")
    stop = F.when(F.col("stop") != "", _attribute("stop", F.col("stop"))).otherwise("")
    opening = F.concat(F.lit("  <programme"), _attribute("channel", F.col("channel_id")), _attribute("start", F.col("start")), stop, F.lit(">"))
    categories = F.transform("categories", lambda c: F.concat(F.lit("    <category>"), _xml(c), F.lit("</category>")))
    parts = F.concat(
        F.array(opening),
        F.array_compact(F.array(_element("title", F.col("title")), _element("sub-title", F.col("subtitle")), _element("desc", F.col("description")))),
        categories,
        F.array_compact(F.array(_icon(F.col("icon_url")), _element("episode-num", F.col("episode_num")))),
        F.array(F.lit("  </programme>")),
    )
    a = channels.select(F.lit(0).alias("o"), text.casefold("channel_id").alias("gid"), F.lit("").alias("start"), F.lit("").alias("stop"), F.lit("").alias("t"), channel.alias("line"))
    b = programmes.select(F.lit(1).alias("o"), text.casefold("channel_id").alias("gid"), "start", "stop", text.casefold("title").alias("t"), F.array_join(parts, "\n").alias("line"))
    return a.unionByName(b).orderBy("o", "gid", "start", "stop", "t").select("line")


def write_guide(channels: DataFrame, programmes: DataFrame, path: str, generator: str = "tvloom") -> None:
    write_text(guide_lines(channels, programmes), path, f'<?xml version="1.0" encoding="UTF-8"?>\n<tv generator-info-name="{generator}">', "</tv>")


def publish_guide(channels: DataFrame, programmes: DataFrame, matched: DataFrame, path: str, *, fetched: int) -> str:
    """Write the guide, unless there is an older one that is better than nothing: no source was read, or nothing matched.

    A first run writes an empty guide.
    """
    if ordered_file.exists(path):
        if not fetched:
            return "kept_after_failed_fetch"
        if not matched.where("status = 'matched'").take(1):
            return "kept_without_matches"
    write_guide(channels, programmes, path)
    return "written"


def write_unified(channels: DataFrame, programmes: DataFrame, path: str, generated_at: str) -> None:
    """v2 guide as one JSON document: channels, then programmes."""
    none = F.lit("")
    body = channels.select(F.lit(0).alias("section"), F.col("channel_id").alias("c"), none.alias("a"), none.alias("b"), none.alias("t"), F.to_json(F.struct(*channels.columns)).alias("line"))
    rows = programmes.select(F.lit(1).alias("section"), F.col("channel_id").alias("c"), F.col("start").alias("a"), F.col("stop").alias("b"), text.casefold("title").alias("t"), F.to_json(F.struct(*programmes.columns)).alias("line"))
    heads = ['{"schema_version":2,"generated_at":' + json.dumps(generated_at) + ',"channels":[', '],"programmes":[']
    ordered_file.write(body.unionByName(rows).orderBy("section", "c", "a", "b", "t").select("section", "line"), path, heads=heads, separator=",", tail="]}\n")


def write_unified_xmltv(channels: DataFrame, programmes: DataFrame, path: str, generator: str = "tvloom v2", language: str = "it") -> None:
    """v2 guide (channels: channel_id, name, logo; programmes) as XMLTV, with a language on its texts."""

    def named(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f'<{tag} lang="{language}">'), _xml(value), F.lit(f"</{tag}>"))

    def some(tag: str, column: str) -> Column:
        value = F.coalesce(F.col(column), F.lit(""))
        return F.when(value == "", "").otherwise(F.concat(F.lit("<icon"), _attribute("src", value), F.lit(" />")) if tag == "icon" else named(tag, value))

    none = F.lit("")
    channel = F.concat(F.lit("<channel"), _attribute("id", F.col("channel_id")), F.lit(">"), named("display-name", F.col("name")), some("icon", "logo") if "logo" in channels.columns else none, F.lit("</channel>"))
    opening = F.concat(F.lit("<programme"), *[_attribute(k, F.col(c)) for k, c in (("channel", "channel_id"), ("start", "start"), ("stop", "stop"))], F.lit(">"))
    programme = F.concat(opening, named("title", F.col("title")), some("desc", "description"), some("category", "category"), some("icon", "icon"), F.lit("</programme>"))
    a = channels.select(F.lit(0).alias("o"), "channel_id", none.alias("a"), none.alias("b"), none.alias("t"), channel.alias("line"))
    b = programmes.select(F.lit(1).alias("o"), "channel_id", F.col("start").alias("a"), F.col("stop").alias("b"), text.casefold("title").alias("t"), programme.alias("line"))
    write_text(a.unionByName(b).orderBy("o", "channel_id", "a", "b", "t").select("line"), path, f'<?xml version="1.0" encoding="utf-8"?>\n<tv generator-info-name="{generator}">', "</tv>")


def report(parts: dict[str, DataFrame], **facts) -> dict:
    """A report: each one-row DataFrame by name, and facts."""
    return facts | {name: json.loads(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).first()["j"]) for name, df in parts.items()}


def reported(rows: DataFrame, order: list, most: int = MOST_REPORTED) -> dict:
    """The first rows of a list, with how many there are and how many are left out."""
    total = rows.count()
    shown = [json.loads(r["j"]) for r in rows.orderBy(*order).limit(most).select(F.to_json(F.struct(*rows.columns)).alias("j")).collect()]
    return {"total": total, "truncated": total - len(shown), "items": shown}


def write_json(document: dict, path: str) -> None:
    ordered_file.replace(path, (json.dumps(document, ensure_ascii=False, indent=2, default=str) + "\n").encode())
