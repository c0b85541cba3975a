"""Personal data and the terms that give it away.

Base spans are found by fixed patterns: email, ip, card and phone. Each pattern
is written so that a start that fails is never tried again inside the same run,
which makes the search linear in the text without changing a match.

Around them, information-theoretic sanitisation: a base span's value is a
protected entity e; a term t discloses it as far as seeing t makes e likely. By
counts over the whole corpus, with N different texts, e in c(e) contexts, t in d(t)
texts and both in c(t, e) contexts, p(e) = c(e) / N, and the disclosure is

    log2(p(e | t) / p(e)) / log2(1 / p(e)), p(e | t) = (c(t, e) + PRIOR p(e)) / (d(t) + PRIOR),

the share of the entity's information content that t gives, near 1 for a term
that stands nowhere else. The estimate is smoothed: PRIOR documents in which t
says nothing of e are added, so few contexts count for less and none is left
out. A context is the CONTEXT characters before and after a mention; equal
contexts, as in copies, count once. From REMOVE on, a term's occurrences in the documents
that hold the entity become spans `term` (removed); from GENERALISE on, spans
`class` (replaced by what kind of word it is). Words are looked for outside base spans,
which stay as they are.

Counts are summed before they move, so an entity or term may hold any share of
the rows. Null text is empty. Rows equal in id and text are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table, written

CONTEXT = 60
#: Documents without information that each term's counts begin with.
PRIOR = 2.5
GENERALISE = 0.7
REMOVE = 0.9

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans, after the base ones.
ADDED = ("term", "class")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # a local part begins where its run does, or where the match before ended in it
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # shorter matches fail the test of length in any case
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match, cheaper to find than the match.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{N}]+"
BLOCK = 128
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as spans, in code points: each begins after the pieces and matches before it."""

    none = F.array().cast(f"array<{SPAN}>")

    def placed(x: Column) -> Column:
        count = F.size(x["found"])

        def add(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(x["pieces"], i))
            end = start + F.length(F.get(x["found"], i))
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.get(x["found"], i).alias("value"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

        # an array is copied when it grows, so spans gather in blocks first
        def add_block(s: Column, b: Column) -> Column:
            block = F.aggregate(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, count) - 1), F.struct(s["at"].alias("at"), none.alias("out")), add)
            return F.transform(F.array(block), lambda v: F.struct(v["at"].alias("at"), F.concat(s["out"], v["out"]).alias("out")))[0]

        blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
        return F.when(count == 0, none).otherwise(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), add_block, lambda s: s["out"]))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return F.transform(F.array(both), placed)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by kind as listed, then start."""

    def of(kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind], kind), lambda s: _valid(kind, s["value"]))
        return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.concat(*map(of, KINDS))


def entity(span: Column) -> Column:
    """A protected entity: kind and normal form of a span's value."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def disclosing(docs: DataFrame, found: DataFrame, *, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame | None:
    """entity, term and kind of the terms that disclose. docs: text; found: text and spans of those with spans. None if no entity stands beside a term."""

    def context(s: Column) -> Column:
        # a word that the window cuts isn't one of the context
        from_far = F.regexp_replace(F.substring("text", s["start"] - CONTEXT + 1, F.lit(CONTEXT)), r"^[\p{L}\p{N}]+", "")
        before = F.when(s["start"] > CONTEXT, from_far).otherwise(F.substring("text", F.lit(1), s["start"]))
        after = F.regexp_replace(F.substring("text", s["end"] + 1, F.lit(CONTEXT)), r"[\p{L}\p{N}]+$", "")
        return F.struct(entity(s).alias("entity"), before.alias("before"), after.alias("after"))

    mentions = found.select(F.explode(F.transform("spans", context)).alias("c")).select("c.*")
    contexts = mentions.groupBy("entity", "before", "after").agg(F.lit(1).alias("one"))
    contexts = written(contexts.select("entity", _terms(F.concat_ws(" ", "before", "after")).alias("terms")), "contexts")
    entities = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"))
    pairs = contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c_te")).join(entities, "entity")
    pairs = written(pairs, "pairs")
    if not pairs.take(1):
        return None
    # copies of a text count once here too
    texts = docs.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")).agg(F.any_value("text").alias("text"))
    n = docs.select(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).distinct().count()
    wanted = pairs.select("term").distinct()
    counts = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("d_t")).join(wanted, "term")
    p_e = F.col("c_e") / F.lit(n)
    p_te = (F.col("c_te") + F.lit(prior) * p_e) / (F.greatest("d_t", "c_te") + F.lit(prior))
    share = F.log2(p_te / p_e) / F.log2(1 / p_e)
    found = pairs.where(F.col("c_e") < n).join(counts, "term").withColumn("share", share).where(F.col("share") >= generalise)
    return written(found.select("entity", "term", F.when(F.col("share") >= remove, ADDED[0]).otherwise(ADDED[1]).alias("kind")), "terms")


def find(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: list[str], **thresholds) -> DataFrame:
    """The columns `keep` of docs, __text (null: empty) and spans: base ones by kind and start, then added ones likewise.

    A name in keep that the operator uses itself (__id, __t, __text, spans, clean_text) is refused.
    """
    clash = {"__id", "__t", "__text", "spans", "clean_text"} & set(keep)
    if clash:
        raise ValueError(f"columns in keep and in the result: {sorted(clash)}")
    rows = docs.select(*[docs[c] for c in keep], docs[id].alias("__id"), F.coalesce(docs[text], F.lit("")).alias("__text")).withColumn("__t", F.xxhash64("__text"))
    by = ["__id", "__t"]
    # base spans are matched once; what follows reads the texts that have some
    matched = rows.select(*by, "__text", base_spans(F.col("__text")).alias("spans")).where(F.size("spans") > 0)
    held = written(matched.dropDuplicates(by), "spans")
    added = _added(held, disclosing(rows.select(F.col("__text").alias("text")), held.select(F.col("__text").alias("text"), "spans"), **thresholds))
    spans = held.select(*by, "spans")
    if added is not None:
        joined = spans.join(added.toDF("a_id", "a_t", "added"), F.col("__id").eqNullSafe(F.col("a_id")) & (F.col("__t") == F.col("a_t")), "left")
        spans = written(joined.select(*by, F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.concat("spans", "added")).alias("spans")), "all_spans")
    known = spans.toDF("s_id", "s_t", "spans")
    result = rows.join(known, F.col("__id").eqNullSafe(F.col("s_id")) & (F.col("__t") == F.col("s_t")), "left")
    return result.select(*keep, "__text", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def _added(held: DataFrame, terms: DataFrame | None) -> DataFrame | None:
    """__id, __t and the added spans of texts (with their base spans), by kind and start."""
    if terms is None:
        return None
    by = ["__id", "__t"]
    mentions = held.select(*by, F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    # of the kinds that several entities give a term, removal counts
    by_term = written(mentions.join(terms, "entity").groupBy(*by, "term").agg(F.when(F.max(F.col("kind") == ADDED[0]), ADDED[0]).otherwise(ADDED[1]).alias("kind")), "disclosed")
    same = held["__id"].eqNullSafe(by_term["__id"]) & (held["__t"] == by_term["__t"])
    held = held.join(by_term, same, "left_semi")
    # words outside base spans, with their places: each begins after the pieces and words before it
    blank = _rebuilt(F.col("__text"), F.col("spans"), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))
    split = held.withColumn("blank", blank).select(*by, F.posexplode(F.arrays_zip(F.split("blank", WORD, -1).alias("piece"), F.regexp_extract_all("blank", F.lit(WORD), F.lit(0)).alias("word"))).alias("pos", "z"))
    end = F.sum(F.length("z.piece") + F.coalesce(F.length("z.word"), F.lit(0))).over(W.partitionBy(*by).orderBy("pos")).cast("int")
    words = split.withColumn("end", end).where("z.word is not null").select(*by, F.lower("z.word").alias("term"), (F.col("end") - F.length("z.word")).alias("start"), "end", F.col("z.word").alias("value"))
    hit = words.alias("w").join(by_term.alias("d"), F.col("w.__id").eqNullSafe(F.col("d.__id")) & (F.col("w.__t") == F.col("d.__t")) & (F.col("w.term") == F.col("d.term"))).select("w.__id", "w.__t", "d.kind", "w.start", "w.end", "w.value")
    place = F.when(F.col("kind") == ADDED[0], 0).otherwise(1)
    listed = F.array_sort(F.collect_list(F.struct(place.alias("o"), "start", "end", "kind", "value")))
    added = hit.groupBy(*by).agg(F.transform(listed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("added"))
    return written(added, "added")


def _rebuilt(text: Column, spans: Column, label) -> Column:
    """The text with label(span) for each span. Where spans overlap, the first counts, and the next for what is left of it."""

    def add(state: Column, s: Column) -> Column:
        rest = F.struct(s["kind"].alias("kind"), F.greatest(s["start"], state["at"]).alias("start"), s["end"].alias("end"), s["value"].alias("value"))
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, rest["start"] - state["at"]), label(rest))
        return F.when(s["end"] <= state["at"], state).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of a `class` span by NAME, NUMBER or WORD."""

    def label(s: Column) -> Column:
        kind = F.when(s["kind"] != ADDED[1], F.upper(s["kind"])).when(s["value"].rlike("^[0-9]+$"), "NUMBER").when(s["value"].rlike(r"^\p{Lu}"), "NAME").otherwise("WORD")
        return F.concat(F.lit("["), kind, F.lit("]"))

    return _rebuilt(text, spans, label)


def sanitize(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: list[str], **thresholds) -> DataFrame:
    """The columns `keep` of docs, spans and clean_text."""
    return find(docs, id=id, text=text, keep=keep, **thresholds).select(*keep, "spans", redacted(F.col("__text"), F.col("spans")).alias("clean_text"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents; one row per document."""
    found = find(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
