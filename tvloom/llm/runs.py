"""Runs: stretches of a text in which words repeat at a period.

A suffix automaton over the words of a text has a state for each class of factors with the same end positions. States
give their end positions to the state they link to, from the longest to the shortest; the smaller of two ordered sets
goes into the larger, so n words cost O(n log n) insertions. Neighbours in the set of a state that weren't neighbours
before are a period apart: if their distance q isn't over the length of the state's longest factor, that factor and the
one q words on meet or overlap, and both together are a square of period q, the smallest that they have (a smaller one
would put an end position between the two). A pair that the word before it doesn't extend begins a run, and extended to
the right it is the run.

A run of 12 words or more and of twice its period has each of its words in some six words that stand in it twice. Words
that no repeated six words of their text cover can't be part of a run, and split the text: the automaton takes each
stretch between them. That leaves out no run (repeats are found by hashes; equal hashes of different words only keep
more words), and most texts have no stretch at all.

A null text has no words and no runs. Words keep their letters' case. A text is worked on whole, in one task, in some
0.5 KB of memory for each word of its repeating stretches; nothing is shuffled and rows never meet, so neither repeated
rows nor any hot key matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped, table

#: A run has this many words at least.
LEAST = 12
#: Words that stand twice in any run: the longer part of it that its period moves onto the run itself.
GRAM = LEAST // 2
#: End positions of one block of an ordered set.
BLOCK = 1_024

U = np.uint64
_FACTORS = [U(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1) for k in range(GRAM)]


class Ends:
    """An ordered set of end positions, in blocks, so that an insertion moves one block at most."""

    __slots__ = ("blocks", "lasts", "size")

    def __init__(self, one: int):
        self.blocks, self.lasts, self.size = [[one]], [one], 1

    def add(self, x: int) -> None:
        at = 0 if len(self.blocks) == 1 else min(bisect_left(self.lasts, x), len(self.blocks) - 1)
        block = self.blocks[at]
        insort(block, x)
        self.size += 1
        if len(block) > BLOCK:
            self.blocks[at : at + 1] = block[: BLOCK // 2], block[BLOCK // 2 :]
            self.lasts[at : at + 1] = self.blocks[at][-1], block[-1]
        elif x > self.lasts[at]:
            self.lasts[at] = x

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours of a member."""
        at = 0 if len(self.blocks) == 1 else bisect_left(self.lasts, x)
        block = self.blocks[at]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.lasts[at - 1] if at else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[at + 1][0] if at + 1 < len(self.blocks) else None
        return before, after

    def members(self) -> list[int]:
        return self.blocks[0] if len(self.blocks) == 1 else [x for block in self.blocks for x in block]


def _automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each state the length of its longest factor, the state it links to, and the place of its prefix (-1: none)."""
    length, link, own, then = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(word):
        new = len(length)
        length.append(i + 1)
        own.append(i)
        then.append({})
        link.append(0)
        p = last
        while p >= 0 and w not in then[p]:
            then[p][w] = new
            p = link[p]
        if p >= 0:
            q = then[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                own.append(-1)
                then.append(dict(then[q]))
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and then[p].get(w) == q:
                    then[p][w] = twin
                    p = link[p]
        last = new
    return length, link, own


def _stretch(word: list[int]) -> list[tuple[int, int, int]]:
    """Runs of one stretch: start, length, period."""
    length, link, own = _automaton(word)
    ends: list[Ends | None] = [Ends(i) if i >= 0 else None for i in own]
    fresh: list[list[int]] = [[] for _ in length]  # members that came into a state's set, or all of a set that went into a larger one
    furthest: dict[tuple[int, int], int] = {}
    for v in sorted(range(len(length)), key=length.__getitem__, reverse=True):
        n = length[v]
        if n < GRAM:
            break
        held, came = ends[v], fresh[v]
        ends[v] = fresh[v] = None
        for x in came:
            before, after = held.around(x)
            for x, y in ((before, x), (x, after)):
                if x is None or y is None or y - x > n or (x >= n and word[x - n] == word[y - n]):
                    continue
                key = (x - n + 1, y - x)
                if furthest.get(key, -1) < y:
                    furthest[key] = y
        p = link[v]
        if length[p] < GRAM:
            continue
        if ends[p] is None:
            ends[p] = held
            continue
        small, large = ends[p], held
        if small.size > large.size:
            small, large = large, small
            came = fresh[p]
        else:
            came = []
        for x in small.members():
            large.add(x)
            came.append(x)
        ends[p], fresh[p] = large, came
    found = []
    for (start, period), end in furthest.items():
        end += 1
        while end < len(word) and word[end] == word[end - period]:
            end += 1
        if end - start >= max(LEAST, 2 * period):
            found.append((start, end - start, period))
    return found


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """First and last (exclusive) word of the stretches that repeated grams cover."""
    n = len(ids) - GRAM + 1
    if len(ids) < LEAST:
        return []
    grams = np.zeros(n, U)
    for k, factor in enumerate(_FACTORS):
        grams += (ids[k : k + n] + U(1)) * factor
        grams ^= grams >> U(29)
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    steps = np.zeros(len(ids) + 1, np.int64)
    steps[:n] += repeated
    steps[GRAM:] -= repeated
    covered = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= LEAST]


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a list of words, by start, then period."""
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), U, len(words))
    found = []
    for a, b in _stretches(ids):
        found += [(a + start, length, period) for start, length, period in _stretch(ids[a:b].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def find(docs: DataFrame, *, text: str = "text", id: str = "doc_id", keep: list[str], rewrite: Callable[[int | str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The columns `keep` of docs, `runs` (start, length, period in words, by start, then period) and `collapsed`, the
    text's words without the repeats, joined by spaces. Words are divided by ASCII white space.

    rewrite: from an id and the words of its text, the words that count. Null texts give no runs and an empty text.
    """

    def begin():
        def made(ids: pa.Array, texts: pa.Array) -> list[list]:
            runs, collapsed = [], []
            for key, value in zip(ids, texts):
                words = (value.as_py() or "").encode().split()
                if rewrite:
                    words = rewrite(key.as_py(), words)
                found = find_runs(words)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                collapsed.append(b" ".join(collapse(words, found) if found else words).decode())
            return [runs, collapsed]

        return made

    return mapped(docs, [docs[id], docs[text]], keep, [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())], begin)


def periodic_tail(id: int | str | None, words: list[bytes]) -> list[bytes]:
    """The words of op13: of one document in ten, by checksum of the id (null: of no characters), the tail repeats its first words."""
    h = zlib.crc32(b"" if id is None else str(id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents; one row per document, and of its runs the number, the longest (ties: the first, then the
    shortest period) and a digest."""
    found = find(table(spark, sf_dir, "documents"), keep=["doc_id"], rewrite=periodic_tail)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.n div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
