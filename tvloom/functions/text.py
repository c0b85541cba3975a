"""Text keys. Unicode folding has no Spark built-in, so one Arrow-batched function does it; what follows is SQL."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C


def fold_text(value: str | None) -> str:
    """Compatibility decomposition without combining marks, case-folded."""
    if value is None:
        return ""
    if value.isascii():
        return value.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).casefold()


def _by_batches(change: Callable[[str | None], str]) -> Callable[[Column | str], Column]:
    """change as a column function. Whole texts go to Python in batches of bounded rows and bytes, from its first use in a
    session on, so that a worker's memory doesn't follow the length of texts."""

    @F.pandas_udf(T.StringType())
    def made(values: pd.Series) -> pd.Series:
        return values.map(change)

    def apply(values: Column | str) -> Column:
        if spark := SparkSession.getActiveSession():
            rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
            if not 0 < rows <= BATCH_ROWS:
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return made(values)

    return apply


#: Texts that go to Python at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 16_000_000

fold = _by_batches(fold_text)
nfkc = _by_batches(lambda v: "" if v is None else unicodedata.normalize("NFKC", v))
casefold = _by_batches(lambda v: "" if v is None else v.casefold())
#: Composed, white space collapsed, case-folded: the key of names, ids, groups and sources in indexes.
text_key = _by_batches(lambda v: "" if v is None else " ".join(unicodedata.normalize("NFKC", v).split()).casefold())


def clean_text(value: Column) -> Column:
    """Composed, without control characters, white space collapsed."""
    return F.trim(F.regexp_replace(clean_line(value), r"(?U)\s+", " "))


def clean_line(value: Column) -> Column:
    """Composed, without control characters, trimmed; inner spaces stay."""
    return F.regexp_replace(F.regexp_replace(nfkc(value), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"(?U)^\s+|\s+$", "")


def unquote(value: Column) -> Column:
    """Without one pair of equal quotes around it."""
    inner = F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"(?U)^\s+|\s+$", "")
    return F.when((F.length(value) >= 2) & value.rlike(r"""(?s)^(['"]).*\1$"""), inner).otherwise(value)


def clean_url(value: Column) -> Column:
    """A cleaned line without quotes; comments are empty."""
    url = unquote(clean_line(value))
    return F.when(url.startswith("#"), "").otherwise(url)


def name_key(folded: Column) -> Column:
    """Identity key of a folded name: quality words and all but a-z and 0-9 go."""
    return F.regexp_replace(F.regexp_replace(folded, C.QUALITY, " "), "[^a-z0-9]+", "")


def category_text(folded: Column) -> Column:
    """A folded name for the category cascade: brackets and trailing quality words go."""
    text = F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" e ")), r"[\(\[].*?[\)\]]", " ")
    text = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    return F.regexp_replace(text, f"( ({'|'.join(C.QUALITY_SUFFIXES)}))+$", "")


def identity_text(folded: Column) -> Column:
    """Key of the seeded identity registry."""
    quality = r"(?:4k|uhd|fhd|full\s*hd|hd|sd|1080p|1080i|720p|576p|480p)"
    text = F.regexp_replace(folded, r"@(?:sd|hd|fhd|uhd|4k)$", "")
    text = F.regexp_replace(F.regexp_replace(text, rf"\(\s*{quality}\s*\)", " "), rf"\b{quality}\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+g\s*$", ""), "[^a-z0-9]+", " "))


def web_text(folded: Column) -> Column:
    """Key of the guide page's search."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded, C.QUALITY, ""), "[^a-z0-9]+", " "))


def playlist_id_key(extinf: Column) -> Column:
    """Dedupe key of an entry's tvg-id: without a quality tag, alphanumeric."""
    raw = F.trim(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(extinf, F.lit(r'(?<![A-Za-z0-9_-])tvg-id="([^"]*)"'), F.lit(1))), -1))
    return F.regexp_replace(F.lower(F.regexp_replace(raw, "(?i)@(sd|hd|fhd|uhd|4k)$", "")), "[^a-z0-9]+", "")


def playlist_name_key(extinf: Column) -> Column:
    """Dedupe key of an entry's name: after the first comma, without trailing qualities and a trailing G."""
    name = F.trim(F.when(extinf.contains(","), F.regexp_replace(extinf, "^[^,]*,", "")).otherwise(""))
    one = r"\s*(?:\((?:\d{3,4}[pi]|sd|hd|fhd|uhd|4k)\)|\b(?:sd|hd|fhd|uhd|4k|\d{3,4}[pi])\b)"
    name = F.trim(F.regexp_replace(name, f"(?i)(?:{one})+\\s*$", ""))
    name = F.when(name.endswith(" G") & (F.length(name) > 2), F.rtrim(F.substring(name, F.lit(1), F.length(name) - 2))).otherwise(name)
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


# --- keys of the guide matcher -------------------------------------------------------------

_NUMBER = {word: str(n) for n, words in enumerate(C.NUMBERS) for word in words.split()}
_BRACKETS = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]|\{([^{}]*)\}")
_ALNUM = re.compile("[a-z0-9]+")
_TAG = re.compile(rf"@(?:{'|'.join(sorted(C.IDENTIFIER_TAGS, key=len, reverse=True))})$")
_ID_QUALITY = re.compile(rf"[._|:/-](?:{'|'.join(sorted(C.QUALITY_WORDS, key=len, reverse=True))})$")
_EDGES = "._-|:/ "


def _unbracketed(text: str) -> str:
    """Brackets of technical words only go; others lose their signs."""

    def inner(m: re.Match) -> str:
        content = next(g for g in m.groups() if g is not None)
        words = _ALNUM.findall(content)
        technical = words and all(w in C.BRACKET_WORDS or re.fullmatch(r"\d{3,4}p", w) for w in words)
        return " " if technical else f" {content} "

    while (changed := _BRACKETS.sub(inner, text)) != text:
        text = changed
    return text


@lru_cache(100_000)
def tokens(value: str, numbers: bool) -> tuple[str, ...]:
    """Words of a name without technical ones; numbers: number words become digits."""
    text = re.sub(r"\bpiu\b", " plus ", fold_text(value).replace("&", " e ").replace("+", " plus "))
    words = [_NUMBER.get(w, w) if numbers else w for w in _ALNUM.findall(_unbracketed(text))]
    return tuple(w for w in words if w not in C.TECHNICAL_WORDS)


def strict_key(value: str | None) -> str:
    return "".join(tokens(value or "", False))


def _without(words: tuple[str, ...], dropped: frozenset[str], too_little) -> tuple[str, ...]:
    rest = tuple(w for w in words if w not in dropped)
    if len(words) <= 1 or not rest or all(w.isdigit() for w in rest) or too_little(rest):
        return words
    return rest


def _without_media(words: tuple[str, ...]) -> tuple[str, ...]:
    return _without(words, C.MEDIA_WORDS, lambda rest: sum(map(len, rest)) < 3)


def _without_locale(words: tuple[str, ...]) -> tuple[str, ...]:
    return _without(words, C.LOCALE_WORDS, lambda rest: set(rest) <= C.MEDIA_WORDS | {"radio"})


@lru_cache(1)
def static_aliases() -> dict[str, str]:
    """Strict key of each listed name -> canonical strict key; the first entry that lists a name has it."""
    found: dict[str, str] = {}
    for canonical, others in C.ALIASES.items():
        for name in [canonical, *others.split()]:
            found.setdefault(strict_key(name), strict_key(canonical))
    return found


@lru_cache(100_000)
def name_variants(value: str) -> tuple[str, ...]:
    """Keys of a name: as is and with digits, without media words, locale words, or both, each with its alias."""
    found: dict[str, None] = {}
    for words in dict.fromkeys((tokens(value, False), tokens(value, True))):
        if not tokens(value, False):
            return ()
        local = _without_locale(words)
        for variant in (words, _without_media(words), local, _without_media(local)):
            key = "".join(variant)
            if key and key not in found:
                found[key] = None
                alias = static_aliases().get(key)
                if alias:
                    found.setdefault(alias)
    return tuple(found)


@lru_cache(1)
def alias_index() -> dict[str, str]:
    """Any variant of a listed name -> canonical strict key; the last entry that lists it has it."""
    return {variant: strict_key(canonical) for canonical, others in C.ALIASES.items() for name in [canonical, *others.split()] for variant in name_variants(name)}


@lru_cache(100_000)
def identifier_variants(value: str) -> tuple[str, ...]:
    """Keys of a guide id: as is, without tags and a trailing quality, and without its namespace."""
    text = re.split("[?#]", fold_text(value).strip())[0].strip()
    if not text:
        return ()
    stripped = text
    while (shorter := _TAG.sub("", stripped)) != stripped:
        stripped = shorter.rstrip(_EDGES)
    stripped = _ID_QUALITY.sub("", stripped).rstrip(_EDGES)
    found: dict[str, None] = {}
    for candidate in (text, stripped, re.sub(r"\.[a-z]{2,3}$", "", stripped)):
        for key in (strict_key(candidate), *name_variants(candidate)):
            if key:
                found.setdefault(key)
    return tuple(found)


def informative(key: str) -> bool:
    return len(key) >= (2 if key.isdigit() else 4)


def similarity(left: str, right: str) -> float:
    """0 to 100: matching blocks, a little more for a common beginning; 0 if one is under three quarters as long."""
    if not left or not right:
        return 0.0
    if left == right:
        return 100.0
    if min(len(left), len(right)) / max(len(left), len(right)) < 0.75:
        return 0.0
    bonus = 0.02 if left.startswith(right) or right.startswith(left) else 0.0
    return round(min(1.0, SequenceMatcher(None, left, right).ratio() + bonus) * 100, 2)


@F.pandas_udf(T.DoubleType())
def similarity_score(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.StringType())
def strict_name(values: pd.Series) -> pd.Series:
    return values.map(strict_key)


@F.pandas_udf(T.ArrayType(T.StringType()))
def variants_of_name(values: pd.Series) -> pd.Series:
    return values.map(lambda v: list(name_variants(v or "")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def variants_of_id(values: pd.Series) -> pd.Series:
    return values.map(lambda v: list(identifier_variants(v or "")))
