"""Benchmark decontamination by winnowed fingerprints.

A text's words are runs of digits, ASCII letters (lower-cased) and characters
beyond ASCII. For spans of t words, every k-gram of k = min(5, t) words is
hashed and of each t - k + 1 neighbouring k-grams the least hash is kept, the
rightmost on ties. A span of t words that a document shares with an item keeps
the same k-gram on both sides, so joining the two sets of fingerprints misses
no such span. Each joined fingerprint is then extended: the windows of t words
around it are compared word by word with the item's windows.

Windows have 10 words; an item of fewer words, but not none, is one window of
its own length, so t takes 10 and the lengths of the short items.

The benchmark goes to the workers in blocks of bounded size (BLOCK_BYTES of
text); a larger benchmark takes one more pass over the documents for each
block. Documents are never shuffled or grouped, so no key is hot.

Null texts have no words. An item without an id hits words but isn't listed.
Rows that repeat, also with one doc_id, each get their own row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, table, written
from .words import STEP, U, Words, chunks, mixed

WINDOW = 10
GRAM = 5
#: Most benchmark text sent to a worker at once.
BLOCK_BYTES = 8_000_000
def winnow(words: Words, size: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept for spans of `size` words."""
    k = min(GRAM, size)
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    grams = np.zeros(n + size - k, U)
    for j in range(k):
        grams = grams * STEP + words.hash[j : j + n + size - k]
    grams = mixed(grams)
    least, at = grams[:n].copy(), np.zeros(n, np.int8)
    for shift in range(1, size - k + 1):
        later = grams[shift : shift + n]
        better = later <= least
        np.copyto(least, later, where=better)
        at[better] = shift
    whole = np.flatnonzero(left[:n] >= size)
    kept = np.zeros(len(grams), bool)
    kept[whole + at[whole]] = True
    positions = np.flatnonzero(kept)
    return positions, grams[positions]


def _joined(texts: list[bytes]) -> Words:
    return Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str]]):
        words = _joined([text.encode() for _, text in items])
        counts = np.diff(words.first)
        self.windows: dict[int, dict[bytes, set[str]]] = {}
        for (name, _), first, n in zip(items, words.first, counts):
            size = min(WINDOW, int(n))
            for at in range(first, first + n - size + 1 if size else first):
                names = self.windows.setdefault(size, {}).setdefault(words.window(at, size), set())
                if name is not None:
                    names.add(name)
        left = words.left()
        lengths = np.repeat(counts, counts)
        self.prints = {}
        for size in self.windows:
            positions, hashes = winnow(words, size, left)
            # an item takes part in one size only
            self.prints[size] = np.unique(hashes[np.minimum(lengths[positions], WINDOW) == size])


#: The block that a Python worker had last, by the pass's key.
_INDEXES: dict[str, Index] = {}


def hits(words: Words, index: Index) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """Text -> the shared windows as ranges of word positions in it, and the items they are from."""
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    left = words.left()
    for size, prints in index.prints.items():
        positions, hashes = winnow(words, size, left)
        if not len(positions) or not len(prints):
            continue
        same = prints[np.minimum(np.searchsorted(prints, hashes), len(prints) - 1)] == hashes
        shared, windows, reach = positions[same], index.windows[size], size - min(GRAM, size)
        texts = np.searchsorted(words.first, shared, "right") - 1
        done = -1  # windows that start here or earlier are compared already
        for at, text in zip(shared.tolist(), texts.tolist()):
            first, last = int(words.first[text]), int(words.first[text + 1])
            for start in range(max(at - reach, first, done + 1), min(at, last - size) + 1):
                names = windows.get(words.window(start, size))
                if names is not None:
                    ranges, items = found.setdefault(text, ([], set()))
                    ranges.append((start - first, start - first + size))
                    items |= names
                done = start
    return found


def _merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Disjoint ranges that cover the same positions, as begin, end, begin, end ..."""
    out: list[int] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def _pass(docs: DataFrame, items: list[tuple[str | None, str]]) -> DataFrame:
    """docs with `__text`, `n_words`, `spans` and `items`, once more against a block of items."""
    bounded_batches(docs.sparkSession)
    shipped, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    schema = docs.schema
    at = {f.name: i for i, f in enumerate(schema.fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = Index(shipped.value)
        index = _INDEXES[key]
        for batch in batches:
            n_words, spans, named = [], batch.column(at["spans"]).to_pylist(), batch.column(at["items"]).to_pylist()
            for row, stop, data, offsets in chunks(batch.column(at["__text"])):
                words = Words(data, offsets)
                n_words += np.diff(words.first).tolist()
                for text, (ranges, items) in hits(words, index).items():
                    old = spans[row + text]
                    spans[row + text] = _merged([*ranges, *zip(old[::2], old[1::2])])
                    named[row + text] = sorted({*items, *named[row + text]})
            columns = list(batch.columns)
            columns[at["n_words"]] = pa.array(n_words, pa.int64())
            columns[at["spans"]] = pa.array(spans, pa.list_(pa.int64()))
            columns[at["items"]] = pa.array(named, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str], item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns `keep` of docs, n_words, spans (hit words as begin, end, begin, end ... positions) and items (sorted ids)."""
    clash = {"n_words", "spans", "items", "__text"} & set(keep)
    if clash:
        raise ValueError(f"columns in keep and in the result: {sorted(clash)}")
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    found = docs.select(
        *[docs[c] for c in keep],
        docs[text].alias("__text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(T.ArrayType(T.LongType())).alias("spans"),
        F.array().cast(T.ArrayType(T.StringType())).alias("items"),
    )
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        found = _pass(found, [(r["name"], r["text"]) for r in part.collect()])
        if block + 1 < blocks:
            found = written(found, "decontam")
    return found.drop("__text")


def n_hit():
    """Words in spans."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("spans") - 1, F.lit(0))), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.get("spans", i), F.lit(0)) * F.when(i % 2 == 0, -1).otherwise(1))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents against all benchmark items; one row per document."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM di),
h AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, win)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
