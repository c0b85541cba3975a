"""Near-duplicate documents by order MinHash and banded alignment.

A text's shingles are its runs of five words; a text of fewer words is one
shingle. Each shingle is labelled with its occurrence number in the text, so
repeats count. A sketch orders the labelled shingles by a random function, takes
the least few and keeps them in text order; texts with a sketch in common are
candidates. Texts of MIDDLE[0] shingles or more have LONG sketches of four, those of
up to MIDDLE[1] have SHORT sketches of two, which suit few shingles better; those
between have both, so any two texts whose sizes allow the similarity have a kind in common.

A candidate pair is a link if an alignment of its two shingle sequences matches
m shingles with m / (n1 + n2 - m) >= 0.8. The alignment is the longest common
subsequence inside the band that any such alignment stays in, computed on the
bits of an integer that slides along the diagonal. A class is a connected
component of links.

Texts equal in all words are one node, so copies never meet in pairs. Pairs come
about in two steps:

1. In each bucket (nodes with a sketch in common) every node is compared with the
   most central one, which shares most sketches with others: one pair a member.
   Nodes that link to a common one, over up to JUMPS steps, get a common label.
2. Buckets that still hold several labels are split into cells of about CELL by CELL
   members, so that one of any size is spread over many tasks and none is cut short.
   Nodes of different labels in a cell are a pair, in the least bucket that they share, if
   their sizes and signatures allow the similarity. A signature has BITS bits, each the parity of the
   labelled shingles that hash to it, so two differ in no more bits than there are shingles that
   only one of the texts has; no pair within the threshold is ruled out.

At similarity 0.8 two texts share a sketch of four with probability 0.41 (of two:
0.64), so they share none with 0.59 ** LONG (0.36 ** SHORT).

Texts without words are each a class of their own. class_id is the least id of the
class that isn't null; rows that repeat count each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches_of, bounded_batches, scratch, table, written
from .words import STEP, U, Words, chunks, mixed

SHINGLE = 5
SIMILAR = 0.8
#: Sketches of four and of two shingles, and the sizes of texts that have both.
LONG, SHORT = 24, 10
MIDDLE = (16, 20)
BITS = 1024
SIGNED = BITS // 64
SIGNATURE = "struct<" + ",".join(f"s{i}:long" for i in range(SIGNED)) + ">"
#: Members of a bucket on each side of a cell.
CELL = 512
JUMPS = 2
#: Pairs of texts that a Python worker gets at once.
PAIRS = 500
#: About so many of a text's values are looked at for its least four: fewer than four has probability 1e-9, and then all are.
NEAR_LEAST = 32
_SEEDS = mixed(np.arange(1, 65, dtype=U) * U(0x9E3779B97F4A7C15))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, and where those of each text begin (one more than there are texts)."""
    counts = np.diff(words.first)
    n = len(words.hash)
    padded = np.concatenate([words.hash, np.zeros(SHINGLE, U)])
    hashed = np.zeros(n, U)
    left = words.left()
    for j in range(SHINGLE):
        hashed = np.where(left > j, hashed * STEP + padded[j : j + n] + U(1), hashed)
    begins = np.ones(n, bool)
    begins[left < SHINGLE] = False
    begins[words.first[:-1][counts > 0]] = True
    first = np.concatenate([[0], np.cumsum(np.minimum(counts, np.maximum(counts - SHINGLE + 1, 1)))])
    return mixed(hashed[begins]), first


def labelled(hashed: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with their occurrence number in their text."""
    same = mixed(hashed ^ (owner.astype(U) * STEP))
    order = np.argsort(same, kind="stable")
    ordered = same[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    number = np.empty(len(same), U)
    number[order] = (np.arange(len(same)) - np.repeat(starts, np.diff(np.append(starts, len(same))))).astype(U)
    return mixed(hashed + number * U(0xA0761D6478BD642F))


def _least(values: np.ndarray, counts: np.ndarray, size: int, seeds: np.ndarray, kind: int) -> np.ndarray:
    """For each text and seed, the hash of its `size` least shingles (all, if it has fewer) in text order. No text is empty."""
    owner = np.repeat(np.arange(len(counts)), counts)
    share = np.minimum(NEAR_LEAST / counts, 1)
    # 64 bits of which a float holds the upper ones
    limit = np.repeat(np.where(share < 1, share * 2.0**64, 0).astype(U) - U(1), counts)  # 0 - 1: all
    take = np.minimum(counts, size)
    out = np.zeros((len(counts), len(seeds)), np.int64)
    for s, seed in enumerate(seeds):
        value = mixed(values ^ seed)
        near = np.flatnonzero(value <= limit)
        if (np.bincount(owner[near], minlength=len(counts)) < take).any():
            near = np.arange(len(value))
        near = near[np.lexsort((value[near], owner[near]))]
        begin = np.searchsorted(owner[near], np.arange(len(counts)))
        at = begin[:, None] + np.arange(size)
        places = np.where(np.arange(size) < take[:, None], near[np.minimum(at, len(near) - 1)], len(values))
        places.sort(axis=1)
        hashed = np.full(len(counts), seed + U(kind), U)
        for k in range(size):
            used = places[:, k] < len(values)
            hashed = np.where(used, hashed * STEP + values[np.minimum(places[:, k], len(values) - 1)], hashed)
        out[:, s] = mixed(hashed).view(np.int64)
    return out


def sketches(hashed: np.ndarray, first: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """The sketches of each text, and its signature as 64-bit integers."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    values = labelled(hashed, owner)
    bits = np.zeros(len(counts) * SIGNED, U)
    np.bitwise_xor.at(bits, owner * SIGNED + (values >> U(60)).astype(np.int64), U(1) << (values >> U(54) & U(63)))
    bits = bits.view(np.int64).reshape(len(counts), SIGNED)
    out: list[list[int]] = [[] for _ in counts]
    for size, n, wanted in ((2, SHORT, (counts > 0) & (counts <= MIDDLE[1])), (4, LONG, counts >= MIDDLE[0])):
        texts = np.flatnonzero(wanted)
        if len(texts):
            found = _least(values[wanted[owner]], counts[texts], size, _SEEDS[:n], size)
            for i, row in zip(texts.tolist(), found.tolist()):
                out[i] += row
    return out, bits


def aligned(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> bool:
    """Whether an alignment of a and b matches m places with m / (len(a) + len(b) - m) >= similar."""
    total = len(a) + len(b)
    needed = int(np.ceil(similar * total / (1 + similar) - 1e-9))
    if min(len(a), len(b)) < needed:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    rest = short - head
    differ = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1]) if rest else differ
    tail = int(differ[0]) if len(differ) and rest else rest
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    matched = head + tail
    if matched >= needed:
        return True
    band = max(len(a), len(b)) - (needed - matched)
    if band < 0 or min(len(a), len(b)) < needed - matched:
        return False
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * band + 1
    full = (1 << width) - 1
    row, low = full, 0  # bit i: place low + i of a; zeros are matched places
    wanted = needed - matched
    for j, x in enumerate(b.tolist()):
        if j & 31 == 31 and matched - head - tail + width - row.bit_count() + len(b) - j < wanted:
            return False
        if j - band > low:
            matched += not row & 1
            row = row >> 1 | 1 << (width - 1)
            low += 1
        here = places.get(x)
        if here is not None:
            hit = row & (here >> low) & full
            row = ((row + hit) | (row - hit)) & full
    return matched + width - row.bit_count() >= needed


def sketch(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, t (hash of the text), node (digest of the words), size (shingles), bands (sketches) and bits (signature) of each row."""
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *T._parse_datatype_string("t long, node binary, size long, bands array<long>, bits " + SIGNATURE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bands, signed = [], [], [], [np.zeros((0, SIGNED), np.int64)]
            for _, _, data, offsets in chunks(batch.column(2)):
                words = Words(data, offsets)
                hashed, first = shingles(words)
                sizes += np.diff(first).tolist()
                content = words.hash.tobytes()
                nodes += [hashlib.md5(content[8 * a : 8 * b]).digest() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
                found, bits = sketches(hashed, first)
                bands += found
                signed.append(bits)
            arrays = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(signed).T], [f"s{i}" for i in range(SIGNED)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=schema.names)

    return docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("t"), docs[text].alias("text")).mapInArrow(run, schema)


def _verified(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (a_text, b_text) align."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            # both texts of a pair go in side by side, so a chunk may end between them
            both = pa.array([x.as_py() for row in zip(batch.column(2), batch.column(3)) for x in row], pa.large_string())
            done, pending = 0, None
            for _, _, data, offsets in chunks(both):
                hashed, first = shingles(Words(data, offsets))
                for k in range(len(first) - 1):
                    own = hashed[first[k] : first[k + 1]]
                    if done % 2:
                        good[done // 2] = aligned(pending, own)
                    pending = own
                    done += 1
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """node and label (least node of its connected component) of the nodes of links (a, b)."""
    both = written(links.union(links.select("b", "a")).toDF("src", "dst"), "links")
    labels = written(both.groupBy("src").agg(F.least("src", F.min("dst")).alias("label")).withColumnRenamed("src", "node"), "labels")
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        lower = near.join(labels, near["src"] == labels["node"]).select("node", F.least("near", "label").alias("next"), "label")
        # the label of the label: paths halve in each round
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = written(lower.join(jump, "next", "left").select("node", F.least("next", "beyond").alias("label"), F.col("label").alias("old")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("label <> old").take(1):
            return labels


def _sizes_allow() -> Column:
    """Whether the sizes of a and b do: a common subsequence is no longer than the shorter text."""
    return F.least("a_size", "b_size") >= F.ceil(F.lit(SIMILAR) * (F.col("a_size") + F.col("b_size")) / (1 + SIMILAR) - 1e-9)


def _signatures_allow() -> Column:
    """Whether the signatures of a and b do."""
    differing = sum((F.bit_count(F.col(f"a_bits.s{i}").bitwiseXOR(F.col(f"b_bits.s{i}"))) for i in range(SIGNED)), F.lit(0))
    return differing <= (F.col("a_size") + F.col("b_size")) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-9


def _pairs(members: DataFrame, cell: int) -> DataFrame:
    """Pairs of nodes of a bucket with different labels, met cell by cell; n is the bucket's size."""
    cells = F.ceil(F.col("n") / cell).cast("int")
    own, every = F.pmod(F.xxhash64("node"), cells).cast("int"), F.explode(F.sequence(F.lit(0), cells - 1))
    names = ("node", "size", "label", "bits", "bands")
    a = members.select("band", own.alias("row"), every.alias("column"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = members.select("band", every.alias("row"), own.alias("column"), *[F.col(c).alias(f"b_{c}") for c in names])
    met = a.join(b, (a["band"] == b["band"]) & (a["row"] == b["row"]) & (a["column"] == b["column"]) & (F.col("a_label") < F.col("b_label")) & _sizes_allow() & _signatures_allow() & (F.array_min(F.array_intersect("a_bands", "b_bands")) == a["band"]))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def _known(docs: DataFrame, rows: DataFrame, id: str, text: str, cell: int) -> DataFrame:
    """node, class_id and class_size of classes of several rows. rows: the sketches of docs."""
    spark = docs.sparkSession
    nodes = rows.where("size > 0").groupBy("node").agg(F.min(F.struct("id", "t")).alias("row"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n_rows"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = written(nodes, "nodes")
    bands = nodes.select("node", "size", F.explode("bands").alias("band"))
    shared = written(bands.join(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"), "buckets")
    members = written(shared.drop("n").join(shared.groupBy("node").agg(F.sum("n").alias("central")), "node"), "members")

    # texts of the nodes that share a bucket, by id and hash of the text
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("row.id").alias("w_id"), F.col("row.t").alias("w_t"))
    source = docs.select(docs[id].alias("id"), F.xxhash64(docs[text]).alias("t"), docs[text].alias("text"))
    texts = written(source.join(wanted, source["id"].eqNullSafe(wanted["w_id"]) & (source["t"] == wanted["w_t"])).select("node", "text").dropDuplicates(["node"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        with batches_of(spark, PAIRS):
            return written(_verified(pairs.join(texts.toDF("b", "b_text"), "b").join(texts.toDF("a", "a_text"), "a")), "links")

    # step 1: each member against its bucket's most central node, a
    heads = members.groupBy("band").agg(F.max(F.struct("central", "node", "size")).alias("head")).select("band", F.col("head.node").alias("a"), F.col("head.size").alias("a_size"), F.col("head.central").alias("a_central"))
    star = members.select("band", F.col("node").alias("b"), F.col("size").alias("b_size"), "central").join(heads, "band").where("a <> b")
    star = written(star.where(_sizes_allow()).groupBy("a", "b").agg(F.max("a_central").alias("a_central"), F.max("central").alias("central")), "pairs")
    links = verified(star)
    # a node's label: the most central one that it links to, if that is more central than itself
    best = star.join(links, ["a", "b"], "left_semi").groupBy(F.col("b").alias("node")).agg(F.max(F.struct(F.col("a_central").alias("central"), F.col("a").alias("node"))).alias("best"), F.max("central").alias("central"))
    labels = written(best.where(F.col("best") > F.struct("central", "node")).select("node", F.col("best.node").alias("label")), "labels")
    for _ in range(JUMPS):
        labels = written(labels.join(labels.toDF("label", "beyond"), "label", "left").select("node", F.coalesce("beyond", "label").alias("label")), "labels")

    # step 2: what different labels are left in a bucket
    left = written(members.join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label")), "members")
    kinds = left.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most").select("band", "n")
    left = written(left.join(kinds, "band").join(nodes.select("node", "bits", "bands"), "node"), "mixed")
    links = links.union(verified(written(_pairs(left, cell), "pairs")))

    # links between labels, and what they join
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("a_label"))
    ends = links.join(known, "a", "left").join(known.toDF("b", "b_label"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b")
    ends = written(ends.distinct(), "ends")
    joined = components(ends).toDF("label", "joined")
    labels = nodes.select("node", "least_id", "n_rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(joined, "label", "left").select("node", "least_id", "n_rows", F.coalesce("joined", "label").alias("label"))
    labels = written(labels, "labels")
    totals = labels.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("n_rows").alias("class_size")).where("class_size > 1")
    return written(labels.join(totals, "label").select("node", "class_id", "class_size"), "classes", keep=True)


def classes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """One row per row of docs: id, class_id (least id of its class) and class_size (its rows)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = written(sketch(docs, id, text), "sketches")
    with scratch(spark):
        known = _known(docs, rows, id, text, cell)
    # a text that stands alone is its own class
    alone = F.col("class_size").isNull()
    found = rows.join(known, "node", "left")
    return found.select(F.col("id").alias(id), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents; one row per document."""
    return classes(table(spark, sf_dir, "documents"))
