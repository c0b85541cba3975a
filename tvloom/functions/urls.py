"""URL keys, parts and tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import nfkc, unquote

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def host(url: Column) -> Column:
    """Host without user and port, in lower case."""
    return F.lower(F.regexp_replace(_after_user(url), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def port(url: Column) -> Column:
    """The port as text; empty if none is named."""
    return F.regexp_extract(_after_user(url), r":([0-9]+)$", 1)


def _after_user(url: Column) -> Column:
    return F.substring_index(F.regexp_extract(url, PARTS, 2), "@", -1)


def _joined(url: Column, authority: Column) -> Column:
    tail = F.concat(path(url), F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url))))
    return F.concat(scheme(url), F.lit(":"), F.when(F.regexp_extract(url, PARTS, 2) == "", "").otherwise(F.concat(F.lit("//"), authority)), tail)


def _port_shown(url: Column) -> Column:
    default = ((scheme(url) == "http") & (port(url) == "80")) | ((scheme(url) == "https") & (port(url) == "443"))
    return F.when((port(url) == "") | default, "").otherwise(F.concat(F.lit(":"), F.regexp_replace(port(url), "^0+(?=.)", "")))


def identity_url(url: Column) -> Column:
    """Key that joins the same stream: scheme and host in lower case, no user, default port or fragment; path and query stay."""
    plain = unquote(F.trim(url))
    return F.when(scheme(plain) == "", plain).otherwise(_joined(plain, F.concat(host(plain), _port_shown(plain))))


def discovery_url(url: Column) -> Column:
    """identity_url of a URL that is never quoted."""
    plain = F.trim(url)
    return F.when(scheme(plain) == "", plain).otherwise(_joined(plain, F.concat(host(plain), _port_shown(plain))))


def source_url(url: Column) -> Column:
    """Key of a source: http(s) only is rewritten; users stay."""
    plain = F.trim(nfkc(url))
    authority = F.regexp_extract(plain, PARTS, 2)
    user = F.when(authority.contains("@"), F.concat(F.regexp_extract(authority, "^(.*)@", 1), F.lit("@"))).otherwise("")
    return F.when(scheme(plain).isin("http", "https") & (host(plain) != ""), _joined(plain, F.concat(user, host(plain), _port_shown(plain)))).otherwise(plain)


def alternate_url(url: Column) -> Column:
    """Key among alternates: ports go too."""
    plain = F.trim(url)
    return F.when(scheme(plain) == "", F.lower(plain)).otherwise(_joined(plain, host(plain)))


def parameters(url: Column) -> Column:
    """Query parameters as structs (key in lower case, value), decoded; empty values are left out."""
    pairs = F.transform(F.split(query(url), "&"), lambda p: F.struct(F.lower(_decoded(F.substring_index(p, "=", 1))).alias("key"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def split_headers(url: Column) -> tuple[Column, Column]:
    """`url|Name=value&...` as URL and a map of the known headers."""
    plain = F.trim(url)
    names = F.create_map(*[F.lit(x) for pair in C.HEADER_NAMES.items() for x in pair])
    raw = F.when(plain.contains("|"), F.regexp_replace(plain, r"^[^|]*\|", "")).otherwise("")
    pairs = F.transform(F.split(raw, "&"), lambda p: F.struct(F.try_element_at(names, F.lower(F.trim(_decoded(F.substring_index(p, "=", 1))))).alias("key"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))
    known = F.filter(pairs, lambda p: p["key"].isNotNull() & (p["value"] != ""))
    last = F.filter(known, lambda p, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda q: q["key"] == p["key"]))
    return F.trim(F.substring_index(plain, "|", 1)), F.map_from_entries(last)


def header_key(headers: Column) -> Column:
    """Headers as one text, by name; null headers are none."""
    pairs = F.array_sort(F.map_entries(headers))
    return F.coalesce(F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&"), F.lit(""))


def _moment(value: Column) -> Column:
    """Epoch seconds in a value: 9 to 13 digits, milliseconds over 1e10, 2000 to 2100; else null."""
    digits = F.regexp_extract(value, r"[0-9]{9,13}", 0)
    number = digits.try_cast("long")
    seconds = F.when(number > 10_000_000_000, F.floor(number / 1000)).otherwise(number)
    return F.when(seconds.between(946_684_800, 4_102_444_800), seconds)


def token_expired(url: Column, now: int) -> Column:
    """Whether a token in the query ran out over a minute before `now`."""
    own = lambda p: p["key"].isin(C.EXPIRY_PARAMETERS) & (F.coalesce(_moment(p["value"]), F.lit(now)) < now - 60)
    inner = lambda p: F.regexp_extract(p["value"], r"(?i)(?:^|[~|])exp=([0-9]{9,13})", 1)
    held = lambda p: p["key"].isin(C.TOKEN_PARAMETERS) & (F.coalesce(_moment(inner(p)), F.lit(now)) < now - 60)
    return F.exists(parameters(url), lambda p: own(p) | held(p))


def country_check(attributes: Column, url: Column, expected: str) -> Column:
    """match, mismatch, unknown or not_configured, from attributes and query parameters that name a country."""
    if not expected:
        return F.lit("not_configured")
    accepted = C.COUNTRY_ALIASES.get(expected, [expected])
    named = F.map_values(F.map_filter(attributes, lambda k, v: F.lower(F.trim(k)).isin(C.COUNTRY_ATTRIBUTES)))
    asked = F.transform(F.filter(parameters(split_headers(url)[0]), lambda p: p["key"].isin(C.COUNTRY_PARAMETERS)), lambda p: p["value"])
    words = F.transform(F.regexp_extract_all(F.array_join(F.concat(named, asked), " "), F.lit("[A-Za-z]{2,15}"), F.lit(0)), F.upper)
    return F.when(F.size(words) == 0, "unknown").when(F.arrays_overlap(words, F.lit(accepted)), "match").otherwise("mismatch")
