"""Matching playlist channels to guide channels: tiers of equal keys, then similarity for rows that no tier reached."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import text
from .cluster import scratch, written

KEYS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("tier", "key", "shown")]))


def _playlist_keys(tvg_id: str, tvg_name: str, name: str) -> list[tuple[str, str, str]]:
    """Keys to look up in the guide, in the order in which they are tried."""
    tvg_id = (tvg_id or "").strip()
    found = []
    if tvg_id:
        found = [("exact_tvg_id", tvg_id.casefold(), "")] + [("normalized_tvg_id", k, "") for k in text.identifier_variants(tvg_id)]
    found += [("exact_name", k, "") for k in dict.fromkeys(map(text.strict_key, (tvg_name, name))) if k]
    for variant in universal_keys(tvg_id, tvg_name, name):
        canonical = text.alias_index().get(variant, "")
        found += [("alias", k, canonical or variant) for k in dict.fromkeys((variant, canonical)) if k]
    return [(tier, key, shown or key) for tier, key, shown in found]


def universal_keys(tvg_id: str, tvg_name: str, name: str) -> list[str]:
    """Variants of both names and of the id, each once."""
    keys = [*text.name_variants(tvg_name or ""), *text.name_variants(name or ""), *(text.identifier_variants(tvg_id) if tvg_id else ())]
    return list(dict.fromkeys(keys))


def _guide_keys(channel_id: str, names: list[str]) -> list[tuple[str, str, str]]:
    """Keys under which a guide channel is found; `search`: those that similarity compares."""
    found = [("exact_tvg_id", channel_id.strip().casefold())] + [("normalized_tvg_id", k) for k in text.identifier_variants(channel_id)]
    for name in dict.fromkeys([*names, channel_id]):
        found += [("exact_name", text.strict_key(name))]
        found += [(tier, k) for k in text.name_variants(name) for tier in ("alias", "search")]
        found += [("search", k) for k in text.identifier_variants(name)]
    return [(tier, key, key) for tier, key in dict.fromkeys(found) if key]


@F.pandas_udf(KEYS)
def playlist_keys(tvg_id: pd.Series, tvg_name: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([[{"tier": a, "key": b, "shown": c} for a, b, c in _playlist_keys(*row)] for row in zip(tvg_id, tvg_name, name)], dtype="object")


@F.pandas_udf(KEYS)
def guide_keys(channel_id: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([[{"tier": a, "key": b, "shown": c} for a, b, c in _guide_keys(i, list(n))] for i, n in zip(channel_id, names)], dtype="object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def informative_keys(tvg_id: pd.Series, tvg_name: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([[k for k in universal_keys((i or "").strip(), t, n) if text.informative(k)] for i, t, n in zip(tvg_id, tvg_name, name)], dtype="object")


def tier_scores():
    return F.create_map(*[F.lit(x) for pair in C.TIERS.items() for x in pair])


#: What a row is matched by, and how many different texts a task looks up.
TEXT, TEXTS_A_TASK = ("tvg_id", "tvg_name", "name"), 20_000


def match(playlist: DataFrame, guide: DataFrame, *, minimum: float = C.LEAST_SIMILARITY) -> DataFrame:
    """playlist (ord, name, tvg_id, tvg_name) with status (matched, ambiguous, unmatched), guide_id, score, method and keys.

    guide: ord, channel_id, display_names. Guide ids that differ only in case are one, the first. Rows of equal texts are
    matched alike, so each different text is looked up once.
    """
    one = guide.withColumn("gid", text.casefold("channel_id"))
    known = one.groupBy("gid").agg(F.min("ord").alias("g_ord"), F.min_by("channel_id", "ord").alias("guide_id"))
    g_keys = one.withColumn("names", F.when(F.size("display_names") == 0, F.array("channel_id")).otherwise(F.col("display_names"))).select("gid", F.explode(guide_keys("channel_id", "names")).alias("k")).select("gid", "k.tier", "k.key").distinct()
    # read several times, and Python made them
    g_keys = written(g_keys, "guide_keys", keep=True)

    # a text goes by the least number of its rows
    own = [F.coalesce(playlist[c], F.lit("")) for c in TEXT]
    texts = written(playlist.groupBy(*[c.alias(name) for c, name in zip(own, TEXT)]).agg(F.min("ord").alias("text")), "texts", keep=True)
    # a few bytes of input may hold any number of texts, so tasks are dealt by number
    tasks = max(1, -(-texts.count() // TEXTS_A_TASK))
    dealt = texts.repartition(tasks, "text")
    p_keys = dealt.select("text", F.posexplode(playlist_keys(*TEXT)).alias("nth", "k")).select("text", "nth", "k.*")
    hits = p_keys.join(g_keys, ["tier", "key"]).select("text", "gid", tier_scores()[F.col("tier")].alias("score"), F.col("tier").alias("method"), F.col("shown").alias("playlist_key"), F.col("shown").alias("guide_key"), "nth")
    by_tier = written(best(hits, tasks), "tiers", keep=True)
    # only texts that no tier reached; no table of texts is broadcast, for files say little of how many they are
    missed = dealt.join(by_tier.select("text").hint("merge"), "text", "left_anti")
    top = by_tier.unionByName(best(similar(missed, g_keys, minimum), tasks))

    of = texts.hint("merge").join(top, "text").select(*[F.col(c).alias(f"of_{c}") for c in TEXT], "n", "m")
    same = [c == of[f"of_{name}"] for c, name in zip(own, TEXT)]
    out = playlist.join(of, same, "left").join(known, F.col("m.gid") == known["gid"], "left")
    alone = F.col("n") == 1
    return out.select(
        *[playlist[c] for c in playlist.columns],
        F.when(F.col("n").isNull(), "unmatched").when(alone, "matched").otherwise("ambiguous").alias("status"),
        F.when(alone, F.col("guide_id")).alias("guide_id"),
        F.when(F.col("n").isNotNull(), F.col("m.score")).alias("score"),
        F.when(alone, F.col("m.method")).alias("method"),
        F.when(alone, F.col("m.playlist_key")).alias("playlist_key"),
        F.when(alone, F.col("m.guide_key")).alias("guide_key"),
        F.coalesce("n", F.lit(0).cast("long")).alias("candidates"),
    )


def best(hits: DataFrame, tasks: int) -> DataFrame:
    """text, n (guide channels with its best score) and m (the first of them, and how it was found)."""
    # dealt as they are: the first of texts can't be hashed, and to take it before would sort all that a task has
    each = hits.repartition(tasks, "text").groupBy("text", "gid").agg(F.max(F.struct("score", (-F.col("nth")).alias("early"), "method", "playlist_key", "guide_key")).alias("m")).select("text", "gid", "m.*")
    ranked = each.withColumn("place", F.rank().over(W.partitionBy("text").orderBy(F.desc("score"))))
    return ranked.where("place = 1").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("gid", "score", "method", "playlist_key", "guide_key"), "gid").alias("m"))


def similar(texts: DataFrame, g_keys: DataFrame, minimum: float) -> DataFrame:
    """Pairs whose informative keys are alike. Each different key is compared once, whatever texts have it."""
    p = texts.select("text", F.posexplode(informative_keys(*TEXT)).alias("nth", "p_key"))
    digits = F.col("key").rlike("^[0-9]+$")
    g = g_keys.where("tier = 'search'").where(F.length("key") >= F.when(digits, 2).otherwise(4)).select("gid", F.col("key").alias("g_key"))
    with scratch(texts.sparkSession):
        # read several times, and Python made them
        p = written(p, "playlist_keys", keep=True)
        pairs = alike(p.select(F.col("p_key").alias("key")).distinct(), g.select(F.col("g_key").alias("key")).distinct(), minimum)
        pairs = written(pairs.toDF("p_key", "g_key", "score"), "alike", keep=True)
    return p.join(pairs, "p_key").join(g, "g_key").select("text", "gid", "score", F.lit("similarity").alias("method"), F.col("p_key").alias("playlist_key"), F.col("g_key").alias("guide_key"), "nth")


#: What a common beginning adds to the score, and the least ratio of lengths.
BONUS, SHORTEST = 2.0, 0.75
#: Letters of the pieces by which keys meet.
PIECES = (3, 2, 1)


def alike(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """left_key, right_key and score of the pairs of keys (key, each once in a table) with a similarity of `minimum` or more."""
    pairs = candidates(left, right, minimum)
    # letters of one that the other lacks can't be part of a matching block
    lacking = F.length(F.call_function("translate", "left_key", "right_key", F.lit(""))) + F.length(F.call_function("translate", "right_key", "left_key", F.lit("")))
    total = F.length("left_key") + F.length("right_key")
    near = pairs.where(100.0 * (total - lacking) / total + BONUS + 0.01 >= minimum)
    return near.withColumn("score", text.similarity_score("left_key", "right_key")).where(F.col("score") >= minimum)


def candidates(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """Pairs of keys, each once, among which are all with a similarity of `minimum` or more.

    Keys of a and b letters that score so high have m letters in matching blocks, at least s (a + b) / 2. Blocks follow
    one another in both keys, so a + b - 2 m insertions and deletions lead from one to the other, and each of them parts at
    most q - 1 neighbourhoods: m - (q - 1) (1 + a + b - 2 m) pieces of q letters are in both. So of each key's pieces, put
    in one order for all keys, the rarest first, the two keys share one among the first, as many as the key has less what
    they have to share, and one more. Only keys with such a piece in common meet. The longest pieces serve of which some
    have to be shared; single letters always do. Repeated pieces are told apart by their number.
    """
    if not 0 < minimum <= 100:
        raise ValueError("minimum must be over 0 and at most 100")
    s = (minimum - BONUS - 0.01) / 200
    keys = left.select("key").union(right.select("key")).where("key <> ''").distinct()

    def numbered(q: int):
        """The pieces of q letters, with their place among equal ones."""
        pieces = F.filter(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring("key", i, F.lit(q))), lambda x: F.length(x) == q)
        return F.transform(F.array_distinct(F.transform(pieces, lambda x: x)), lambda x: F.struct(F.lit(q).alias("q"), x.alias("piece"), F.size(F.filter(pieces, lambda y: y == x)).alias("times")))

    pieces = keys.select("key", F.explode(F.concat(*map(numbered, PIECES))).alias("p")).select("key", "p.q", "p.piece", F.explode(F.sequence(F.lit(1), F.col("p.times"))).alias("nth"))
    counts = pieces.groupBy("q", "piece", "nth").agg(F.count(F.lit(1)).alias("n"))
    # as many as a key has letters
    ordered = pieces.join(counts, ["q", "piece", "nth"]).groupBy("key").agg(*[F.array_sort(F.collect_list(F.when(F.col("q") == q, F.struct("n", "piece", "nth")))).alias(f"first_{q}") for q in PIECES])
    ordered = written(ordered, "ordered")

    a = F.length("key")
    total = a + F.col("other")
    m = F.greatest(F.lit(1), F.ceil(total * s - 1e-9).cast("int"))
    shared = [m - (q - 1) * (1 + total - 2 * m) for q in PIECES]

    def by_size(values: list):
        """That of the longest pieces of which some have to be shared."""
        found = F.when(shared[0] >= 1, values[0])
        for test, value in zip(shared[1:], values[1:]):
            found = found.when(test >= 1, value)
        return found

    take = by_size([a - q + 1 - n + 1 for q, n in zip(PIECES, shared)])

    def first(side: DataFrame, own: str, partner: str) -> DataFrame:
        """A row for each piece by which a key may meet keys of each length."""
        lengths = F.sequence(F.ceil(a * SHORTEST - 1e-9).cast("int"), F.floor(a / SHORTEST + 1e-9).cast("int"))
        rows = side.join(ordered, "key").withColumn("other", F.explode(lengths)).where((m <= F.least(a, F.col("other"))) & (take > 0))
        piece = F.explode(F.slice(by_size([F.col(f"first_{q}") for q in PIECES]), F.lit(1), take))
        return rows.select(F.col("key").alias(f"{own}_key"), a.alias(own), F.col("other").alias(partner), piece.alias("p")).select(f"{own}_key", own, partner, "p.piece", "p.nth")

    l, r = first(left.select("key"), "left", "right"), first(right.select("key"), "right", "left")
    return l.join(r, ["left", "right", "piece", "nth"]).select("left_key", "right_key").distinct()


def stats(matched: DataFrame) -> DataFrame:
    """One row: counts by status and method, and the share matched in percent, rounded half to even."""
    n, hit = F.count(F.lit(1)), F.count_if(F.col("status") == "matched")
    methods = [F.count_if((F.col("status") == "matched") & (F.col("method") == m)).alias(m) for m in (*C.TIERS, "similarity")]
    coverage = F.when(n == 0, 0.0).otherwise(F.bround(100.0 * hit / n, 2))
    return matched.agg(n.alias("playlist_channels"), hit.alias("matched"), F.count_if(F.col("status") == "unmatched").alias("unmatched"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), *methods, coverage.alias("coverage_percent"))


def by_url(matched: DataFrame) -> DataFrame:
    """stream_url and its match; of a URL the last."""
    own = F.struct(*[c for c in ("ord", "guide_id", "score", "method") if c in matched.columns])
    return matched.where("status = 'matched'").groupBy("stream_url").agg(F.max_by(own, "ord").alias("match"))


def fill(channels: DataFrame, matched: DataFrame, guide: DataFrame) -> DataFrame:
    """channels with the matched guide id, with name and icon only where they were empty, and `changed`."""
    one = guide.groupBy(F.col("channel_id").alias("guide_id")).agg(F.min_by(F.struct("display_names", "icon_url"), "ord").alias("g"))
    found = channels.join(matched.where("status = 'matched'").select("ord", "guide_id"), "ord", "left").join(one, "guide_id", "left")
    known = F.col("guide_id").isNotNull()
    name, icon = F.coalesce(F.get("g.display_names", 0), F.lit("")), F.coalesce("g.icon_url", F.lit(""))
    new = {
        "tvg_id": F.when(known, F.col("guide_id")).otherwise(F.col("tvg_id")),
        "tvg_name": F.when(known & (F.col("tvg_name") == ""), name).otherwise(F.col("tvg_name")),
        "logo": F.when(known & (F.col("logo") == ""), icon).otherwise(F.col("logo")),
    }
    changed = reduce_or([c != F.col(k) for k, c in new.items()])
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in channels.columns], changed.alias("changed"))


def reduce_or(tests):
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
