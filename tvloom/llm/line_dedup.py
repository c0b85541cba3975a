"""Line deduplication across documents by a segment-partition edit join.

A line (between line feeds; lines of white space don't count) is dropped if it
stands elsewhere before: its place is (document id, line number), and it goes if
the same line, or one within so many edits of it, has an earlier place. The edits
follow from the shorter line's length: one for each STEP characters, MOST at most,
so shorter lines than STEP have to be equal.

By length, lines fall into classes. In a class of t edits a line has t + 1 segments
whose places depend on the class only, the first half counted from its begin, the
others from its end: of two lines within t edits, one segment i of the shorter
stands in the longer with at most i edits before it and t - i after it, so moved by
m = min(i, t - i) places at most. A line is indexed under two substrings of each of its
segments, and probes with those at few places, each of which one or the other finds, so
that 2 m + 1 shifts cost about m + 1 keys (see `cover`). A line also probes in the class
below if its length is near the edge. First the keys that lines share are counted;
only lines with such keys meet, by key and hash, and only pairs get their text. A pair is verified on what is left of it without its
common begin and end, by the band of 2 t + 1 diagonals of the edit matrix, held as
bits and advanced one character at a time until the distance is out of reach.

Before its text, a pair has to pass on signatures: SIGNED longs of bits, each the
parity of the line's pairs of neighbouring characters that hash to it. COUNTED longs more
hold, for each of their PARTS, how many characters hash to it, modulo eight, as four bits in a code
whose neighbours differ in one bit: where counts differ by d, the codes differ in d bits at most.
A substitution changes four bits
at most, two counts by one, and no length; an insertion or deletion three bits, one count and
the length by one. So with the difference of lengths, lines within t edits differ by 4 t in bits
and by 2 t in counts at most; no pair within its edits is lost.

A key of more than HOT lines is boilerplate. Its lines are first compared with its
earliest one, which settles those within the edits; the others meet in cells of about
CELL by CELL lines, where the signatures decide, so that no key is cut short and none
is one task's.

Rows equal in id and text are one document. Null text stays null. Null ids come first.
Columns in `keep` may have any names but those of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch, table, written

#: Characters of a line for each edit, and most edits.
STEP = 20
MOST = 6
HOT = 100
CELL = 512
SIGNED, COUNTED, PARTS = 8, 2, 16
#: The lowest bit of each of the four counts that a sum holds.
LOWEST = 0x0001000100010001
#: Shared keys, or hashes of lines, that are sent to all executors; 16 bytes each.
FEW_KEYS = 1_000_000
#: Characters after which the band looks whether the distance is out of reach.
STRETCH = 16


def cover(moved: int) -> tuple[set[int], list[int]]:
    """Two places in a segment, 0 and the other, and places that hold them: each move of up to `moved` takes one of the two to a place."""
    if moved in (0, 2):
        return {0, moved}, list(range(moved + 1))
    return {0, 1}, [*range(-(moved // 2) * 2, 0, 2), 0, 1, *range(3, moved + 2, 2)]


class Rule:
    """Edits by length, and the classes by their least lengths."""

    def __init__(self, step: int = STEP, most: int = MOST):
        self.step, self.most = step, most
        self.classes = [step * t for t in range(1, most + 1)]
        while self.classes[-1] < 100 * step:
            self.classes.append(self.classes[-1] * 3 // 2)
        self.highest = [*[x - 1 for x in self.classes[1:]], (1 << 31) - 1]

    def allowed(self, length: int) -> int:
        """Edits for a shorter line of this length."""
        return min(self.most, length // self.step)

    def edits(self, c: Column) -> Column:
        """Edits of a class."""
        return F.element_at(F.array(*[F.lit(self.allowed(x)) for x in self.classes]), c + 1)

    def substrings(self, c: int) -> list[tuple[int, int, int, int, bool]]:
        """Those of the segments of class c: c, segment, place (negative: from the end), size, and whether lines are indexed under it."""
        edits = self.allowed(self.classes[c])
        size, out = self.classes[c] // (edits + 1), []
        for i in range(edits + 1):
            begin, moved = (i * size, i) if i <= edits - i else (-(edits + 1 - i) * size, edits - i)
            own, places = cover(moved)
            out += [(c, i, begin + place, max(size - max(own), 0), place in own) for place in places]
        return out

    def probes(self, c: int) -> Column:
        """The substrings of class c as an array."""
        names = ("c", "i", "begin", "size", "own")
        structs = ["named_struct(" + ", ".join(f"'{k}', {str(v).lower()}" for k, v in zip(names, row)) + ")" for row in self.substrings(c)]
        return F.expr(f"array({', '.join(structs)})")


_PROBES = "array<struct<c:int,i:int,begin:int,size:int,own:boolean>>"
_LINE = ("h", "g", "n", "place")
_SIGNATURE = (*[f"s{w}" for w in range(SIGNED)], *[f"c{w}" for w in range(COUNTED)])
_SIDE = (*_LINE, *_SIGNATURE)
#: Characters of a line up to which no count can run over 16 bits.
COUNTABLE = 1 << 15


def _keyed(lines: DataFrame, rule: Rule) -> DataFrame:
    """Lines for each probe, with `key`, and whether it is `own`, without the text."""
    probes = []
    for c, (low, high) in enumerate(zip(rule.classes, rule.highest)):
        # a line of the next class may have a shorter partner in this one
        probes.append(F.when(F.col("n").between(low, min(high + rule.allowed(low), (1 << 31) - 1)), rule.probes(c)).otherwise(F.array().cast(_PROBES)))
    # four bytes for each character, so that a substring is found at once
    wide = lines.select("h", "g", "n", F.encode("line", "UTF-32").alias("wide")).withColumn("p", F.explode(F.concat(*probes)))
    at = F.when(F.col("p.begin") >= 0, F.col("p.begin")).otherwise(F.col("n") + F.col("p.begin"))
    key = F.xxhash64("p.c", "p.i", F.substring(F.col("wide"), at * 4 + 1, F.col("p.size") * 4))
    top = F.element_at(F.array(*map(F.lit, rule.highest)), F.col("p.c") + 1)
    return wide.select(key.alias("key"), "h", "g", F.col("p.c").alias("c"), (F.col("p.own") & (F.col("n") <= top)).alias("own"))


def _signatures(lines: DataFrame) -> DataFrame:
    """h, g, and the bits s0, s1 ... and counts c0, c1 ... of lines."""
    wide = lines.select("h", "g", F.length("line").alias("n"), F.encode("line", "UTF-32").alias("wide"))
    places = wide.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))))
    two, one = (F.xxhash64(F.substring(F.col("wide"), F.col("i") * 4 - 3, F.lit(size))) for size in (8, 4))
    hashed = places.select("h", "g", (F.col("i") < F.col("n")).alias("pair"), (F.col("n") < COUNTABLE).alias("countable"), two.alias("x"), one.alias("y"))

    def bit(by: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), by.cast("int"))

    bits = [F.bit_xor(F.when(F.col("pair") & (F.shiftrightunsigned("x", 6) % SIGNED == w), bit(F.col("x").bitwiseAND(63))).otherwise(0)).alias(f"s{w}") for w in range(SIGNED)]
    # four counts of 16 bits in a sum; longer lines, whose counts might not fit, go without
    sums = [F.sum(F.when(F.col("countable") & (F.shiftrightunsigned("y", 6) % (COUNTED * PARTS // 4) == w), bit(F.col("y").bitwiseAND(3) * 16)).otherwise(0)).alias(f"n{w}") for w in range(COUNTED * PARTS // 4)]

    def coded(w: int) -> Column:
        """The codes of four counts at once: bit 2 of the count, and of the count and one, two and three more."""
        count = F.coalesce(f"n{w}", F.lit(0)).bitwiseAND(F.lit(7 * LOWEST))
        bits = [F.shiftleft(F.shiftrightunsigned(count + k * LOWEST, 2).bitwiseAND(F.lit(LOWEST)), 3 - k) for k in range(4)]
        return F.shiftleft(reduce(Column.bitwiseOR, bits), w % 4 * 4)

    counts = [reduce(Column.bitwiseOR, map(coded, range(w * PARTS // 4, (w + 1) * PARTS // 4))).alias(f"c{w}") for w in range(COUNTED)]
    return hashed.groupBy("h", "g").agg(*bits, *sums).select("h", "g", *[f"s{w}" for w in range(SIGNED)], *counts)


def _joined(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """rows joined with a table that is sent to all executors if it is small."""
    return rows.join(F.broadcast(few) if few.limit(FEW_KEYS + 1).count() <= FEW_KEYS else few, by)


def near_lines(lines: DataFrame, rule: Rule, *, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """h and g of the lines with an earlier line within the edits. lines: distinct ones, with line, n (its length), h, g, place."""
    keyed = _keyed(lines.where(F.col("n") >= rule.step), rule)
    keys = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.max("own").alias("own")).where("count > 1 and own").select("key", "count"), "keys")
    rows = written(_joined(keyed, keys, ["key"]), "rows")
    texts = written(_joined(lines.select("h", "g", "n", "place", "line"), rows.select("h", "g").distinct(), ["h", "g"]), "texts")
    rows = written(rows.join(texts.select(*_LINE).join(_signatures(texts), ["h", "g"]), ["h", "g"]).withColumn("open", F.lit(True)), "signed")
    texts = texts.select("h", "g", "line")

    verdict = within(F.col("long"), F.col("short"), rule.most, F.col("edits"))

    def near(pairs: DataFrame) -> DataFrame:
        return written(_near(written(pairs, "pairs"), texts, verdict), "near")

    found = near(_pairs(rows.where(F.col("count") <= hot), rule))
    crowded = rows.where(F.col("count") > hot)
    if crowded.take(1):
        # the earliest line settles those near it
        heads = crowded.where("own").groupBy("key").agg(F.min(F.struct("place", *[c for c in _SIDE if c != "place"])).alias("head"))
        star = crowded.join(heads, "key").where(F.col("head.place") < F.col("place"))
        settled = near(_once(star.select("c", *[F.col(f"head.{x}").alias(f"a_{x}") for x in _SIDE], *[F.col(x).alias(f"b_{x}") for x in _SIDE]).where(_alike(rule)), rule))
        settled = written(settled.distinct(), "settled")
        # a pair meets under the least key that both have
        keys = crowded.groupBy("h", "g").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("own"), F.col("key"))).alias("owned"))
        open_ = crowded.drop("open").join(keys, ["h", "g"]).join(settled.withColumn("settled", F.lit(True)), ["h", "g"], "left").withColumn("open", F.col("settled").isNull())
        found = found.union(settled).union(near(_pairs(written(open_.drop("settled"), "open"), rule, cell)))
    return found.distinct()


def _alike(rule: Rule) -> Column:
    """Whether lengths and signatures of a and b allow the edits of class c."""
    def differing(names: list[str]) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in names])

    edits, longer = rule.edits(F.col("c")), F.abs(F.col("a_n") - F.col("b_n"))
    bits, counts = differing([f"s{w}" for w in range(SIGNED)]), differing([f"c{w}" for w in range(COUNTED)])
    countable = F.greatest("a_n", "b_n") < COUNTABLE
    return (longer <= edits) & (bits + longer <= 4 * edits) & (~countable | (counts + longer <= 2 * edits))


def _pairs(rows: DataFrame, rule: Rule, cell: int = 0) -> DataFrame:
    """Pairs of lines that share a key, the later of which isn't settled: a, the shorter, by its own segment. cell: lines on a side of a cell (0: one cell)."""
    cells = F.ceil(F.col("count") / cell).cast("int") if cell else F.lit(1)
    part, every = F.pmod("h", cells).cast("int"), F.explode(F.sequence(F.lit(0), cells - 1))
    names = (*_SIDE, "open", *(["keys", "owned"] if cell else []))
    a = rows.where("own").select(F.col("key").alias("a_key"), part.alias("a_row"), every.alias("a_column"), "c", *[F.col(x).alias(f"a_{x}") for x in names])
    b = rows.select(F.col("key").alias("b_key"), every.alias("b_row"), part.alias("b_column"), *[F.col(x).alias(f"b_{x}") for x in names])
    order = F.struct("a_n", "a_h", "a_g") < F.struct("b_n", "b_h", "b_g")
    later_open = F.when(F.col("a_place") < F.col("b_place"), F.col("b_open")).otherwise(F.col("a_open"))
    # the keys that a shares by a segment of its own: of a pair that shares several, one
    least = F.array_min(F.array_intersect("a_owned", "b_keys")) == F.col("a_key") if cell else F.lit(True)
    met = a.join(b, (a["a_key"] == b["b_key"]) & (a["a_row"] == b["b_row"]) & (a["a_column"] == b["b_column"]) & _alike(rule) & order & later_open & least)
    return _once(met, rule)


def _once(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that met under many keys, once each."""
    pairs = pairs.withColumn("edits", rule.edits(F.col("c")))
    return pairs.groupBy("a_h", "a_g", "b_h", "b_g", "edits").agg(F.min("a_place").alias("a_place"), F.min("b_place").alias("b_place"))


def _near(pairs: DataFrame, texts: DataFrame, near: Column) -> DataFrame:
    """Of each pair of lines for which `near` holds of `long`, `short` and `edits`, the one with the later place."""
    pairs = pairs.join(texts.toDF("b_h", "b_g", "b_line"), ["b_h", "b_g"]).join(texts.toDF("a_h", "a_g", "a_line"), ["a_h", "a_g"])
    longer = F.length("a_line") >= F.length("b_line")
    pairs = pairs.withColumn("long", F.when(longer, F.col("a_line")).otherwise(F.col("b_line"))).withColumn("short", F.when(longer, F.col("b_line")).otherwise(F.col("a_line")))
    first = F.col("a_place") < F.col("b_place")
    return pairs.where(near).select(F.when(first, F.col("b_h")).otherwise(F.col("a_h")).alias("h"), F.when(first, F.col("b_g")).otherwise(F.col("a_g")).alias("g"))


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _common(a: Column, b: Column, most: Column) -> Column:
    """How many characters a and b have in common at their begin, up to `most`, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.substring(a, s["low"] + 1, middle - s["low"]) == F.substring(b, s["low"] + 1, middle - s["low"])
        return F.when(s["low"] >= s["high"], s).when(same, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (middle - 1).alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), most.alias("high")), halve, lambda s: s["low"])


def within(a: Column, b: Column, edits: int, limit: Column | None = None) -> Column:
    """Whether strings a and b, a as long or longer by up to `limit`, are within that many edits; `edits` is the most it can be."""
    limit = F.lit(edits) if limit is None else limit

    def cut(x: Column) -> Column:
        begin = _common(x["a"], x["b"], F.length(x["b"]))
        rest = lambda k: F.struct(*[F.substring(x[c], k + 1, F.length(x[c])).alias(c) for c in "ab"])
        return _bound(begin, lambda k: _bound(F.struct(x.alias("whole"), rest(k).alias("rest")), cut_end))

    def cut_end(x: Column) -> Column:
        end = _common(F.reverse(x["rest"]["a"]), F.reverse(x["rest"]["b"]), F.length(x["rest"]["b"]))
        middle = lambda k: F.struct(*[F.substring(x["rest"][c], F.lit(1), F.length(x["rest"][c]) - k).alias(c) for c in "ab"])
        return _bound(end, lambda k: _bound(F.struct(x["whole"].alias("whole"), middle(k).alias("middle")), decide))

    def decide(x: Column) -> Column:
        m, n, limit = F.length(x["middle"]["a"]), F.length(x["middle"]["b"]), x["whole"]["limit"]
        # the band needs as many characters as it is wide on a side
        sides = F.when(m > edits, x["middle"]).otherwise(F.struct(x["whole"]["a"].alias("a"), x["whole"]["b"].alias("b")))
        return F.when(m <= limit, True).when(n == 0, False).otherwise(_bound(F.struct(sides.alias("s"), limit.alias("limit")), lambda y: banded(y["s"]["a"], y["s"]["b"], edits, y["limit"])))

    return _bound(F.struct(a.alias("a"), b.alias("b"), limit.alias("limit")), cut)


def banded(a: Column, b: Column, edits: int, limit: Column | None = None) -> Column:
    """The same by the band alone; a has `edits` characters at least, b one."""
    limit = F.lit(edits) if limit is None else limit
    width = 2 * edits + 1
    full = (1 << width) - 1

    def no(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(full))

    def advance(s: Column, j: Column, x: Column) -> Column:
        """The band one character on: vp and vn, the places where the column rises and falls, and the distance d."""
        char = F.get(x["short"], j)
        match = F.lit(0)
        for k in range(width):
            match = match + F.when(F.get(x["long"], j - edits + k) == char, F.lit(1 << k)).otherwise(F.lit(0))
        last = F.lit(width - 2) - (j - (x["m"] - edits))

        def on(value: Column) -> Column:
            return F.call_function("shiftright", value, last).bitwiseAND(F.lit(1))

        def diagonal(hit: Column) -> Column:
            d0 = (hit.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(hit).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full))
            return F.struct(d0.alias("d0"), s["vn"].bitwiseOR(no(d0.bitwiseOR(s["vp"]))).alias("hp"), d0.bitwiseAND(s["vp"]).alias("hn"))

        def shifted(v: Column) -> Column:
            down = F.shiftright(v["d0"], 1)
            step = F.when(j < x["m"] - edits, F.when(v["d0"] >= (1 << (width - 1)), 0).otherwise(1)).otherwise(on(v["hp"]) - on(v["hn"]))
            return F.struct(v["hn"].bitwiseOR(no(down.bitwiseOR(v["hp"]))).alias("vp"), down.bitwiseAND(v["hp"]).alias("vn"), (s["d"] + step).cast("int").alias("d"))

        return _bound(_bound(match, diagonal), shifted)

    def near(x: Column) -> Column:
        start = F.struct(F.lit((full << edits) & full).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))

        def stretch(s: Column, k: Column) -> Column:
            begin = k * STRETCH
            # on its diagonal the distance never falls, and along the last row by one a step
            lost = (begin <= x["m"] - edits) & (s["d"] > x["limit"] + edits - (x["m"] - x["n"]))
            # if the column falls by one down to a row and rises by one from there on, what follows that row's
            # diagonal at no cost leaves it so: no way over another diagonal is shorter
            turns = (s["vp"].bitwiseOR(s["vn"]) == full) & (s["vn"].bitwiseAND(s["vn"] + 1) == 0)
            place = begin + F.bit_count(s["vn"]) - edits
            same = (begin + STRETCH <= F.least(x["m"] - edits, x["n"])) & (place >= 0) & (F.substring(x["a"], place + 1, F.lit(STRETCH)) == F.substring(x["b"], begin + 1, F.lit(STRETCH)))
            steps = F.sequence(begin, F.least(begin + STRETCH, x["n"]) - 1)
            return F.when(lost | (turns & same), s).otherwise(F.aggregate(steps, s, lambda t, j: advance(t, j, x)))

        return F.aggregate(F.sequence(F.lit(0), F.floor((x["n"] - 1) / STRETCH).cast("int")), start, stretch, lambda s: s["d"] <= x["limit"])

    return _bound(F.struct(a.alias("a"), b.alias("b"), F.split(a, "").alias("long"), F.split(b, "").alias("short"), F.length(a).alias("m"), F.length(b).alias("n"), limit.alias("limit")), near)


def _without(lines: Column, dropped: Column) -> Column:
    """The lines joined again, without those at the places `dropped`."""
    # a byte for each line up to the last dropped one

    def runs(places: Column) -> Column:
        return F.transform(places, lambda d, i: F.concat(F.repeat(F.lit("+"), d - F.when(i > 0, F.get(places, i - 1)).otherwise(-1) - 1), F.lit("-")))

    both = F.struct(lines.alias("lines"), F.encode(F.array_join(_bound(F.array_sort(dropped), runs), ""), "UTF-8").alias("mask"))
    return _bound(both, lambda x: F.array_join(F.filter(x["lines"], lambda _, i: F.substring(x["mask"], i + 1, F.lit(1)) != F.lit(b"-")), "\n"))


def _place(kind: T.DataType) -> Column:
    """The order of columns id, line_no and t. Of integer ids it is one number, which is summed up without sorting; t counts by its last digits."""
    if not isinstance(kind, T.IntegralType):
        return F.struct("id", "line_no", "t")
    whole = "decimal(38,0)"
    number = F.coalesce(F.col("id").cast(whole) + F.lit(str(1 + (1 << 63))).cast(whole), F.lit(0).cast(whole))
    rest = F.col("line_no").cast("decimal(10,0)") * F.lit(10**8).cast("decimal(9,0)") + F.pmod("t", F.lit(10**8)).cast("decimal(9,0)")
    return (number * F.lit(10**18).cast("decimal(19,0)")).cast(whole) + rest.cast(whole)


def dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: list[str], step: int = STEP, most: int = MOST, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """The columns `keep` of docs, text without dropped lines, n_lines (not of white space) and n_dropped."""
    clash = {"n_lines", "n_dropped"} & set(keep)
    if clash:
        raise ValueError(f"columns in keep and in the result: {sorted(clash)}")
    others = [c for c in keep if c != text]
    named = docs.select(F.struct(F.lit(0).alias("none"), *[docs[c].alias(f"k_{c}") for c in others]).alias("kept"), docs[id].alias("id"), docs[text].alias("text")).withColumn("t", F.xxhash64("text"))
    split = named.select("id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"\S"))
    lines = split.withColumn("place", _place(docs.schema[id].dataType))
    hashes = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")]

    with scratch(docs.sparkSession):
        distinct = lines.groupBy("line").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"))
        distinct = written(distinct.select("line", "place", "times", F.length("line").alias("n"), *hashes), "distinct")
        near = near_lines(distinct, Rule(step, most), hot=hot, cell=cell).withColumn("near", F.lit(True))
        marks = distinct.where("times > 1").select("h", "g", "place").join(near, ["h", "g"], "full_outer")
        marks = written(marks.select("h", "g", F.when(F.col("near").isNull(), F.col("place")).alias("kept_place")), "marks", keep=True)
    drops = (
        lines.select("id", "t", "line_no", "place", *hashes).join(marks, ["h", "g"])
        .where(F.col("kept_place").isNull() | (F.col("kept_place") != F.col("place")))
        .groupBy(F.col("id").alias("d_id"), F.col("t").alias("d_t"))
        .agg(F.collect_set("line_no").alias("dropped"))
    )
    found = named.join(written(drops, "drops"), F.col("id").eqNullSafe(F.col("d_id")) & (F.col("t") == F.col("d_t")), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))))
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    new_text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_without(F.split("text", "\n"), F.col("dropped")))
    found = found.select("kept", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.when((n_dropped > 0) & (n_dropped == n_lines), "").otherwise(new_text).alias("new"))
    columns = [F.col("new").alias(text) if c == text else F.col("kept")[f"k_{c}"].alias(c) for c in keep]
    return found.select(*columns, *([] if text in keep else [F.col("new").alias(text)]), "n_lines", "n_dropped")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents; one row per document, with digest and size of the text that stays."""
    found = dedup(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    return found.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
