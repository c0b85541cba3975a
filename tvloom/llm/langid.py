"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the n-grams of
one to three characters that both hold, over the square root of the numbers
each holds. Characters are lower-cased and everything but letters counts as one
kind of space; n-grams are hashed to FEATURES places. Nystroem landmarks span
the kernel's space, and one ridge regression per language against the rest is
fitted on it.

The kernel is linear in a text's presence row, so scores, presence x landmarks
x projection x regression, are products whose last three factors are multiplied
once, at the fit; scoring is one product of a batch's presence matrix with a
FEATURES x languages matrix.

The fit sees a bounded sample of rows: SAMPLE of each label at most, and SAMPLES in all, chosen
by a hash of id and text among labelled texts of any length; LANDMARKS of each and MOST_LANDMARKS in
all are landmarks. Executors turn the sampled texts, whole, into presence rows of FEATURES bits, so the
driver holds so many bits for a row however long its text is. Scoring reads every whole text. A null
text, or one without a letter, is `und` at score 0; so is every text if no row is labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, packed_up, table
from .words import STEP, U, mixed

FEATURES = 1 << 15
SHIFT = U(64 - 15)
ORDERS = 3
SAMPLE, SAMPLES = 400, 4_000
LANDMARKS, MOST_LANDMARKS = 60, 600
RIDGE = 0.1
UNKNOWN = "und"
#: Texts and characters of one presence matrix; a longer text is still taken whole.
ROWS, CHARS = 64, 100_000

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The presence matrix of texts, and whether each has a letter."""
    lowered = [f" {x.lower()} " for x in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    letter = _is_letter()[codes]
    ends = np.cumsum(lengths)
    lettered = np.logical_or.reduceat(letter, ends - lengths)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of a run of spaces, the first
    kept[ends - lengths] = True
    owner = np.repeat(np.arange(len(lowered)), lengths)[kept]
    codes = np.where(letter, codes, 32)[kept].astype(U)
    out = np.zeros((len(lowered), FEATURES), np.float32)
    gram = np.zeros(len(codes), U)
    for n in range(ORDERS):
        size = len(codes) - n
        if size <= 0:
            break
        gram = gram[:size] * STEP + codes[n:] + U(1)
        inside = owner[:size] == owner[n:]
        place = (mixed(gram ^ U(n << 60)) >> SHIFT).astype(np.int64)
        out[owner[:size][inside], place[inside]] = 1
    return out, lettered


def _presences(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    begin = chars = 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin >= ROWS or chars + len(text) > CHARS):
            yield presence(texts[begin:i])
            begin, chars = i, 0
        chars += len(text)
    if begin < len(texts):
        yield presence(texts[begin:])


class Model:
    """languages and, for each feature, a weight for each language."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> "Model":
        """rows: text and label."""
        packed = [np.packbits(p.astype(bool), axis=1) for p, _ in _presences([text for text, _ in rows])]
        return cls.fit_presence([(bits.tobytes(), label) for bits, (_, label) in zip((x for p in packed for x in p), rows)])

    @classmethod
    def fit_presence(cls, rows: list[tuple[bytes, str]]) -> "Model":
        """rows: presence row in bits, and label."""
        languages = sorted({label for _, label in rows})
        if not languages:
            return cls([], np.zeros((FEATURES, 0), np.float32))
        by: dict[str, int] = {}
        chosen = []  # the first rows of each label are the landmarks
        for i, (_, label) in enumerate(rows):
            by[label] = by.get(label, 0) + 1
            if by[label] <= max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages))):
                chosen.append(i)

        def normal(part: list[bytes]) -> np.ndarray:
            x = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1), axis=1).astype(np.float32)
            return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

        marks = normal([rows[i][0] for i in chosen])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        gram, sums = np.zeros((len(chosen), len(chosen))), np.zeros((len(chosen), len(languages)))
        number = {label: i for i, label in enumerate(languages)}
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            features = (normal([bits for bits, _ in part]) @ marks.T).astype(float) @ root
            sign = np.full((len(part), len(languages)), -1.0)
            sign[np.arange(len(part)), [number[label] for _, label in part]] = 1
            gram += features.T @ features
            sums += features.T @ sign
        regression = np.linalg.solve(gram + RIDGE * np.eye(len(chosen)), sums)
        return cls(languages, (marks.T @ (root @ regression)).astype(np.float32))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for x, lettered in _presences(texts):
            if not self.languages:
                names += [UNKNOWN] * len(x)
                scores += [0.0] * len(x)
                continue
            value = (x @ self.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
            best = value.argmax(1)
            score = np.clip((value[np.arange(len(x)), best] + 1) / 2, 0, 1)
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            scores += [float(s) if ok else 0.0 for s, ok in zip(score, lettered)]
        return names, scores


def fit(docs: DataFrame, learnt: Column, *, id: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the rows of docs for which `learnt` holds and the label isn't null."""
    bounded_batches(docs.sparkSession)
    picked = F.shiftrightunsigned(F.xxhash64(docs[id].cast("string"), docs[text]), 1)
    rows = docs.where(learnt & docs[label].isNotNull() & docs[text].rlike(r"\p{L}")).select(docs[text].alias("text"), docs[label].cast("string").alias("label"), picked.alias("picked"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return Model.fit([])
    sample = max(1, min(sample, SAMPLES // len(counts)))
    limits = F.create_map(*[F.lit(x) for label, n in sorted(counts.items()) for x in (label, min((1 << 63) - 1, int(1.25 * sample / n * (1 << 63))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [bits.tobytes() for p, _ in _presences(batch.column(2).to_pylist()) for bits in np.packbits(p.astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["picked", "label", "bits"])

    taken = rows.where(F.col("picked") <= limits[F.col("label")]).select("picked", "label", "text")
    found = taken.mapInArrow(run, "picked long, label string, bits binary").groupBy("picked", "label").agg(F.min("bits").alias("bits")).collect()
    ordered: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["label"], r["picked"])):
        ordered.setdefault(r["label"], []).append(bytes(r["bits"]))
    return Model.fit_presence([(bits, label) for label, own in ordered.items() for bits in list(dict.fromkeys(own))[:sample]])


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, lang_pred and score."""
    clash = {"lang_pred", "score"} & set(keep)
    if clash:
        raise ValueError(f"columns in keep and in the result: {sorted(clash)}")
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats a language

    @F.arrow_udf("lang_pred string, score double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = shipped.value.predict([x.as_py() or "" for x in batch])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    # only the text goes to Python, and only what was found comes back; called nondeterministic, it isn't run once more in a filter on that
    found = docs.select(packed_up(docs, keep), scored.asNondeterministic()(docs[text]).alias("found"))
    return found.select(*[F.col("kept")[c].alias(c) for c in keep], *[F.col("found")[c].alias(c) for c in ("lang_pred", "score")])


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents, learnt from those not held out; one row per document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(docs["doc_id"]))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
