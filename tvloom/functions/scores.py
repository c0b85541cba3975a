"""Scores and predicates of channels and probes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from . import urls


def quality(combined: Column) -> Column:
    """Score of the picture quality that a folded text names, best first."""
    found = F.lit(None)
    for score, pattern in reversed(C.QUALITY_SCORES):
        found = F.when(combined.rlike(pattern), score).otherwise(found)
    return F.coalesce(found, F.lit(0)).cast("int")


def metadata(tvg_id: Column, tvg_name: Column, logo: Column, group: Column, attributes: Column, directives: Column) -> Column:
    """How much is known: fields, then up to 10 attributes and 5 directives."""
    score = sum((F.when(F.trim(c) != "", points).otherwise(0) for c, points in ((tvg_name, 20), (logo, 20), (group, 15))), F.when(F.trim(tvg_id) != "", 30).otherwise(0))
    filled = F.size(F.map_filter(attributes, lambda _, v: F.trim(v) != ""))
    return (score + F.least(F.lit(10), filled) + F.least(F.lit(5), F.size(directives))).cast("int")


def transport(url: Column) -> Column:
    plain = F.trim(url)
    scheme = F.when(urls.scheme(plain) == "https", 20).when(urls.scheme(plain) == "http", 10).otherwise(0)
    return (scheme + F.when(F.lower(urls.path(plain)).endswith(".m3u8"), 5).otherwise(0)).cast("int")


#: Components of a rank: column, whether more is better, and what it is called when it decides.
RANK = [
    ("health_score", True, "higher_health_score"),
    ("source_priority", False, "better_source_priority"),
    ("quality_score", True, "higher_video_quality"),
    ("metadata_score", True, "richer_metadata"),
    ("transport_score", True, "better_transport"),
]


def rank_order(tie: str = "ord") -> list[Column]:
    return [F.desc(c) if more else F.asc(c) for c, more, _ in RANK] + [F.asc(tie)]


def selection_reason(selected, runner_up) -> Column:
    """The first component in which two candidates differ; selected and runner_up give a column by name."""
    reason = F.lit("earlier_insertion_order")
    for c, _, name in reversed(RANK):
        reason = F.when(selected(c) != runner_up(c), name).otherwise(reason)
    return reason


def health_score(status: Column, base: Column, response_ms: Column, redirected: Column) -> Column:
    """Base less latency and redirection, 1 to 100; offline 0."""
    penalty = F.lit(0)
    for above, points in reversed(C.LATENCY_PENALTIES):
        penalty = F.when(response_ms > above, points).otherwise(penalty)
    score = base - penalty - F.when(redirected, C.REDIRECT_PENALTY).otherwise(0)
    return F.when((status == "offline") | (base <= 0), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), score))).cast("int")


def publishable(status: Column) -> Column:
    return F.coalesce(status.isin("online", "reachable"), F.lit(False))


def merge_health(status: Column, score: Column) -> Column:
    """Health as the ranking sees it: 0 if not publishable, else 1 at least."""
    number = F.coalesce(F.when(~F.isnan(score.cast("double")), score.cast("double")), F.lit(0.0))
    return F.when(publishable(status), F.when(number <= 0, 1.0).otherwise(number)).otherwise(0.0)


def hard_failure(reason: Column, http_status: Column, segment_status: Column) -> Column:
    """Whether a probe shows that a stream won't play."""
    gone = lambda status: F.coalesce(status.cast("string").try_cast("int").isin(C.HARD_STATUSES), F.lit(False))
    plain = F.coalesce(F.trim(reason), F.lit(""))
    return plain.isin(C.HARD_REASONS) | ((plain == "http_error") & gone(http_status)) | ((plain == "hls_segment_http_error") & gone(segment_status))


def category(name: Column, group: Column, source_id: Column) -> Column:
    """Category of a channel from its texts in category form: brand, provider, keyword, else ALTRO."""
    found = F.when(name.rlike(r"^rai(?:\s|[0-9]|$)"), "RAI")
    for brand, names in C.BRANDS.items():
        found = found.when(name.rlike(f"^(?:{names})(?: |$)"), brand)
    found = found.when((source_id == "pluto it") | source_id.startswith("pluto ") | name.startswith("pluto tv"), "PLUTO TV")
    text = F.concat(F.lit(" "), name, F.lit(" "), group, F.lit(" "))
    for kind, words in C.KEYWORDS:
        found = found.when(text.rlike(words), kind)
    return found.otherwise("ALTRO")


def category_rank(kind: Column) -> Column:
    order = F.create_map(*[F.lit(x) for pair in C.CATEGORY_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(order, kind), F.lit(C.CATEGORY_ORDER["ALTRO"]))
