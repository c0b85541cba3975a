"""Source catalogs: JSON scan, normalisation, validation, code-search discovery and settings."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.constants import SCHEMES
from ..operators.numbering import numbered

#: Kinds and modes of sources.
KINDS = ["playlist", "api", "catalog", "repository", "generated"]
MODES = ["static", "country", "language", "tags", "search", "api"]
#: What a code search is asked for and may return.
SEARCH_SUFFIXES = [".m3u", ".m3u8", ".txt"]
SEARCH_HOST = "raw.githubusercontent.com"
#: Ids, names and tags of found sources.
FOUND_ID, FOUND_NAME, FOUND_TAGS = "discovery_github_", "GitHub ", ["github", "discovered"]
DEFAULTS = {"id": "", "name": "", "url": "", "enabled": True, "priority": 100, "kind": "playlist", "country": "", "language": "", "discovery_enabled": False, "discovery_mode": "static", "trust_score": 50, "refresh_hours": 24, "origin": ""}
_TYPES = {bool: "boolean", int: "int", str: "string"}


def read_catalogs(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of all `*.json` catalogs of a directory, by file name and place. Bad JSON fails."""
    item = T.StructType([T.StructField(k, T._parse_datatype_string(_TYPES[type(v)])) for k, v in DEFAULTS.items()] + [T.StructField("tags", T.ArrayType(T.StringType()))])
    if not any(Path(directory).glob("*.json")):
        return build(spark.createDataFrame([], T.StructType([T.StructField("ord", T.LongType()), *item.fields])))
    schema = T.StructType([T.StructField("sources", T.ArrayType(item))])
    found = spark.read.schema(schema).json(f"{directory}/*.json", multiLine=True, mode="FAILFAST")
    rows = found.select(F.col("_metadata.file_name").alias("file"), F.posexplode("sources").alias("pos", "s")).select("file", "pos", "s.*")
    return build(numbered(rows, ["file", "pos"]).drop("file", "pos"))


def token(value: Column) -> Column:
    return F.translate(F.lower(F.trim(value)), "- ", "__")


def country(value: Column) -> Column:
    up = F.upper(F.trim(value))
    return F.when(up.isin("ITALIA", "ITALY", "ITA"), "IT").otherwise(up)


def language(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("italian", "italiano", "ita"), "it").otherwise(low)


def tags(value: Column) -> Column:
    """Tags in normal form, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(value, F.array().cast("array<string>")), token), lambda t: t != ""))


def build(rows: DataFrame) -> DataFrame:
    """Rows with defaults filled and fields in normal form."""
    got = {k: F.coalesce(F.trim(k) if isinstance(v, str) else F.col(k), F.lit(v)) for k, v in DEFAULTS.items()}
    got |= {"kind": F.coalesce(F.nullif(token(got["kind"]), F.lit("")), F.lit("playlist")), "discovery_mode": F.coalesce(F.nullif(token(got["discovery_mode"]), F.lit("")), F.lit("static"))}
    got |= {"country": country(got["country"]), "language": language(got["language"])}
    return rows.select("ord", *[c.alias(k) for k, c in got.items()], tags(F.col("tags")).alias("tags"))


def error(url_key: str = "url") -> Column:
    """The first rule that a source breaks; null: none."""
    url = F.col(url_key)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(F.col("id") == "", "missing id")
        .when(~F.col("id").rlike("^[a-zA-Z0-9][a-zA-Z0-9._-]*$"), "bad id")
        .when(F.col("name") == "", "missing name")
        .when(url == "", "missing url")
        .when(~scheme.isin(SCHEMES), "unsupported scheme")
        .when(scheme.isin("http", "https") & ~url.rlike("^[A-Za-z]+://[^/?#]"), "bad remote url")
        .when(F.col("enabled").isNull(), "enabled isn't boolean")
        .when(F.col("priority").isNull(), "priority isn't a number")
        .when(~F.col("kind").isin(KINDS), "unsupported kind")
        .when(~F.col("discovery_mode").isin(MODES), "unsupported mode")
        .when(F.col("discovery_enabled").isNull(), "discovery_enabled isn't boolean")
        .when(~F.coalesce(F.col("trust_score").between(0, 100), F.lit(False)), "trust_score not in 0..100")
        .when(~F.coalesce(F.col("refresh_hours") > 0, F.lit(False)), "refresh_hours not positive")
        .when(F.col("discovery_enabled") & (F.col("discovery_mode") == "static"), "discovery with a static mode")
    )


def is_remote() -> Column:
    return urls.scheme(F.col("url")).isin("http", "https")


def is_discovery() -> Column:
    return F.col("discovery_enabled") | F.col("kind").isin([k for k in KINDS if k != "playlist"])


def is_repository_host() -> Column:
    return urls.host(F.col("url")).isin("github.com", "api.github.com", SEARCH_HOST)


def is_playlist_item() -> Column:
    """Whether a code-search item (path, download_url) is a playlist on the raw host over https."""
    ends = rf"(?i)^[^?#]*({'|'.join(re.escape(x) for x in SEARCH_SUFFIXES)})(?:[?#]|$)"
    url = F.col("download_url")
    return F.coalesce(F.col("path").rlike(ends) & url.rlike(ends) & (urls.scheme(url) == "https") & (urls.host(url) == SEARCH_HOST), F.lit(False))


def search_results(items: DataFrame, labels: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Sources of code-search items (ord, path, repository, download_url), and one row of counts.

    The id is made of a digest of the URL; the first of a URL counts. labels: tags that all of them get.
    """
    good = items.where(is_playlist_item()).withColumn("key", urls.discovery_url(F.col("download_url")))
    first = good.groupBy("key").agg(F.min_by(F.struct("ord", "path", "repository", "download_url"), "ord").alias("r"), F.count(F.lit(1)).alias("n"))
    digest = F.substring(F.sha2("r.download_url", 256), 1, 16)
    repository = F.nullif(F.trim("r.repository"), F.lit(""))
    made = first.select(
        F.col("r.ord").alias("ord"),
        F.concat(F.lit(FOUND_ID), digest).alias("id"),
        F.concat(F.lit(FOUND_NAME), F.coalesce(repository, F.lit("repository")), F.lit("/"), F.trim("r.path")).alias("name"),
        F.col("r.download_url").alias("url"),
        F.lit(True).alias("enabled"),
        F.lit(200).alias("priority"),
        F.lit("playlist").alias("kind"),
        F.lit("IT").alias("country"),
        F.lit("it").alias("language"),
        F.lit(True).alias("discovery_enabled"),
        F.lit("search").alias("discovery_mode"),
        F.lit(35).alias("trust_score"),
        F.lit(24).alias("refresh_hours"),
        F.coalesce(repository, F.lit("github")).alias("origin"),
        tags(F.array(*[F.lit(x) for x in (*labels, *FOUND_TAGS)])).alias("tags"),
    )
    counts = items.agg(F.count(F.lit(1)).alias("seen")).crossJoin(first.agg(F.count(F.lit(1)).alias("accepted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")))  # one row each
    return made, counts.withColumn("rejected", F.expr("seen - accepted - duplicates"))


def discover(curated: DataFrame, found: DataFrame | None = None, *, tags_any: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Curated sources, then found ones, ranked by priority, trust and id; strict: curated ones only. The first of a URL counts."""
    rows = curated if strict or found is None else curated.unionByName(found.withColumn("ord", F.col("ord") + (1 << 32)))
    if tags_any:
        rows = rows.where((F.size("tags") > 0) & F.arrays_overlap("tags", F.lit(tags_any)))
    first = rows.withColumn("key", urls.discovery_url(F.col("url"))).groupBy("key").agg(F.min_by(F.struct(*rows.columns), "ord").alias("r")).select("r.*")
    return first.orderBy("priority", F.desc("trust_score"), "id")


TRUE = {"1", "true", "yes", "on", "si", "sì"}
FALSE = {"0", "false", "no", "off", ""}


@dataclass(frozen=True)
class Settings:
    """Run settings."""

    sources_dir: str = "config/sources"
    output_file: str = "output/playlist.m3u"
    report_file: str = "output/report.json"
    health_file: str = "output/health.json"
    request_timeout: int = 20
    retries: int = 2
    user_agent: str = "tvloom"
    health_enabled: bool = False
    health_workers: int = 12
    health_timeout: int = 10
    publish_only_online: bool = False
    deep_check: bool = False
    expected_country: str = ""
    device_enabled: bool = True
    device_workers: int = 16
    device_timeout: int = 8
    device_min_score: float = 70.0
    device_output_file: str = "output/playlist_device.m3u"
    device_report_file: str = "output/device-report.json"
    similarity_minimum: float = 86.0
    epg_enabled: bool = False
    epg_file: str = "output/epg.xml"
    epg_report_file: str = "output/epg-report.json"
    epg_public_url: str = ""
    epg_timeout: int = 30
    epg_sources: tuple[str, ...] = field(default=())

    @classmethod
    def load(cls, path: str) -> "Settings":
        """Settings of a JSON file, by the file's names or those here; unknown names are left alone (see `unknown`), values
        take the types of the defaults."""
        named = _read(path)
        made = {f.name: _typed(f.name, named[f.name], getattr(cls, f.name, ())) for f in fields(cls) if f.name in named}
        settings = cls(**made)
        for name in ("output_file", "report_file", "health_file", "epg_file", "epg_report_file", "device_output_file", "device_report_file"):
            if not getattr(settings, name):
                raise ValueError(f"{name} must not be empty")
        for name in ("request_timeout", "health_workers", "health_timeout", "device_workers", "device_timeout", "epg_timeout"):
            if getattr(settings, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if settings.retries < 0 or not 0 <= settings.device_min_score <= 100:
            raise ValueError("retries or device_min_score out of range")
        return settings

    @classmethod
    def unknown(cls, path: str) -> list[str]:
        """Names in a settings file that mean nothing here."""
        return sorted(_read(path).keys() - {f.name for f in fields(cls)})


#: What settings files call some of them.
SETTING_NAMES = {
    "request_timeout_seconds": "request_timeout", "retry_count": "retries", "health_timeout_seconds": "health_timeout", "health_max_workers": "health_workers", "epg_timeout_seconds": "epg_timeout",
    "pluto_playback_enabled": "device_enabled", "pluto_minimum_score": "device_min_score", "pluto_timeout_seconds": "device_timeout", "pluto_max_workers": "device_workers",
    "samsung_output_file": "device_output_file", "pluto_report_file": "device_report_file",
}


def _read(path: str) -> dict:
    data = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(data, dict):
        raise ValueError("settings must be an object")
    return {SETTING_NAMES.get(name, name): value for name, value in data.items()}


def _typed(name: str, value, default):
    if isinstance(default, bool):
        word = str(value).strip().lower()
        if word not in TRUE | FALSE:
            raise ValueError(f"{name} must be boolean")
        return word in TRUE
    if isinstance(default, tuple):
        if not isinstance(value, list):
            raise ValueError(f"{name} must be a list")
        return tuple(dict.fromkeys(x for v in value if (x := str(v).strip())))
    if isinstance(default, str):
        return str(value).strip() if isinstance(value, str) else _refuse(name, "a text")
    return type(default)(value) if not isinstance(value, bool) else _refuse(name, "a number")


def _refuse(name: str, kind: str):
    raise ValueError(f"{name} must be {kind}")
