"""The operators as stages of a corpus pipeline: documents in, documents out, the last one tokens out.

A stage keeps the columns of its input, whatever they are named; it needs doc_id and text, and the first one lang.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, line_dedup, near_dedup
from .shared import table, written

#: A document whose best language scores less is in none. A text unlike all that was learnt scores about 0.5.
LEAST_SCORE = 0.55


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator works on, and each whole row in `__doc`, where no name can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), *[docs[c] for c in columns])


def _rows(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("__doc")[c].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, which fills a missing lang. Null texts and those without a letter go."""
    model = langid.fit(docs, ~langid.held_out(docs["doc_id"]))
    found = langid.predict(_whole(docs, "text"), model, keep=["__doc"])
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _rows(kept.withColumn("__doc", F.col("__doc").withField("lang", F.coalesce(F.col("__doc")["lang"], F.col("lang_pred")))), docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere before; a document whose lines all do goes."""
    found = line_dedup.dedup(_whole(docs, "doc_id", "text"), keep=["__doc"]).where((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    doc = F.col("__doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _rows(found.withColumn("__doc", doc), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the first document."""
    # a written number tells rows apart that are equal in all columns
    rows = written(_whole(docs, "text").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = near_dedup.classes(rows, id="__row").where("__row <> class_id").select("__row")
    return _rows(rows.join(written(gone, "copies"), "__row", "left_anti"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    found = decontam.find(_whole(docs, "text"), table(spark, sf_dir, "benchmark"), keep=["__doc"])
    return _rows(found.where(F.size("spans") == 0), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and the digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"], outputs=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])
