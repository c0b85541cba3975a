"""Spelling variants: words one edit apart, each assigned to a much more frequent one.

A word has a mask of parities: a bit tells whether its letters are in it an odd number of times. An inserted or deleted
letter flips one bit and a replaced one two at most, so of three bands of the mask one is equal in any two words that are
one edit apart. Letters are dealt to bands and bits by their frequency among the words, so that bands weigh alike.

Words meet in a join on an equal band, and verification by edit distance follows. Parities of a large vocabulary repeat
often, so the join also has a length filter: with the length of the shorter word goes a piece of both that the edit left
alone. Cut in thirds, two of the shorter word's are found in the longer one, at the beginning, the end, or one at each.
Of all keys that two words share only the first counts, so a pair is made once.

Each word has a bounded number of keys, and a key's words agree in two thirds, a band and the length; a group of n words
that are all alike has its pairs, which are the result, and no others. Counting is summed in each task before it is
shuffled. Nulls have no words; documents of equal ids and equal rows count each; an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LETTERS, bounded_batches, scratch, table, written

BANDS = 3
#: Bits of a band, and of a mask.
WIDE = 21
BITS = BANDS * WIDE
#: Letters that are dealt by frequency; the rest (none here) by their number.
DEALT = 4_096
#: Words of one task that are counted in Python before they go on.
HELD = 200_000

_LOWER = bytes.maketrans(LETTERS.encode(), LETTERS.lower().encode())


def occurrences(docs: DataFrame, *, text: str = "text", id: str = "doc_id", pattern: str = "[A-Za-zÀ-ÿ]+", rewrite: Callable[[int | str | None], Callable[[str], str]] | None = None) -> DataFrame:
    """word and n: the matches of `pattern` in all texts with A-Z lower-cased, counted.

    rewrite: for an id, what becomes of a match in its text; it may become empty, which is no word.
    """
    bounded_batches(docs.sparkSession)
    find = pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, held = re.compile(find).findall, Counter()
        for batch in batches:
            for key, value in zip(*batch.columns):
                found = Counter(matches((value.as_py() or "").encode().translate(_LOWER).decode()))
                if rewrite:
                    change = rewrite(key.as_py())
                    for word, n in found.items():
                        held[change(word)] += n
                else:
                    held.update(found)
                if len(held) > HELD:
                    yield _counted(held)
                    held.clear()
        if held:
            yield _counted(held)

    counted = docs.select(docs[id], docs[text]).mapInArrow(run, "word string, n long")
    return counted.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def _mask(words: DataFrame) -> Column:
    """The parities of each word's letters. A letter's bit is its number, or that of the letter it is translated to, modulo BITS."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    common = [r.letter for r in letters.orderBy(F.desc("n"), "letter").limit(DEALT).collect()]
    dealt = "".join(chr(4 * BITS + i % BANDS * WIDE + i // BANDS % WIDE) for i in range(len(common)))
    return F.aggregate(
        F.transform(F.split(F.translate("word", "".join(common), dealt), ""), F.ascii),
        F.lit(0).cast("long"),
        lambda mask, letter: F.when(letter == 0, mask).otherwise(mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(letter, F.lit(BITS))))),
    )


def _left_alone(word: Column, n: Column) -> list[Column]:
    """Pieces of a word, one of which an edit leaves alone in it and in the other word; n: the shorter one's length."""
    a, b = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    return [F.left(word, b), F.right(word, n - a), F.concat(F.left(word, a), F.lit("\x00"), F.right(word, n - b))]


def _band(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(((1 << WIDE) - 1) << i * WIDE))


def _keyed(words: DataFrame, lengths: list[Column]) -> DataFrame:
    """A row for each key of each word: the shorter word's length, a piece left alone, and a band."""
    rows = words.withColumn("least", F.explode(F.array(*lengths)))
    keys = [F.struct(F.lit(c).cast("byte").alias("piece"), F.lit(i).cast("byte").alias("band"), F.xxhash64("least", F.lit(c), piece, F.lit(i), _band(F.col("mask"), i)).alias("key")) for c, piece in enumerate(_left_alone(F.col("word"), F.col("least"))) for i in range(BANDS)]
    return rows.select("word", "n", "mask", F.explode(F.array(*keys)).alias("k")).select("k.*", "word", "n", "mask")


def _shuffled(rows: DataFrame) -> DataFrame:
    """rows for a join in which neither side is broadcast. Spark takes a written table to be as small as its compressed file, and
    a vocabulary's keys, several for each word, would pass through the driver."""
    return rows.hint("merge")


def _first(tests: list[Column]) -> Column:
    """The number of the first test that holds."""
    found = F.when(tests[0], 0)
    for i, test in enumerate(tests[1:], 1):
        found = found.when(test, i)
    return found


def near(words: DataFrame) -> DataFrame:
    """Pairs of words (word, n, other, other_n) one edit apart, each once, of different words with their n.

    The shorter word is `word`, or the one that comes first.
    """
    masked = written(words.where("word is not null").select("word", "n").withColumn("mask", _mask(words)), "masked")
    short = _keyed(masked, [F.length("word")])
    long = _keyed(masked, [F.length("word"), F.length("word") - 1]).select("key", *[F.col(c).alias(f"other_{c}") for c in ("word", "n", "mask")])
    word, other, n = F.col("word"), F.col("other_word"), F.length("word")
    differing = F.col("mask").bitwiseXOR(F.col("other_mask"))
    meet = (
        (short["key"] == long["key"])
        & (F.bit_count(differing) <= 2)
        & (n <= F.length(other))
        & ((n < F.length(other)) | (word < other))
        & (_first([_band(differing, i) == 0 for i in range(BANDS)]) == F.col("band"))
        & (_first([a == b for a, b in zip(_left_alone(word, n), _left_alone(other, n))]) == F.col("piece"))
        & (F.levenshtein(word, other, 1) == 1)
    )
    return short.join(_shuffled(long), meet).select("word", "n", F.col("other_word").alias("other"), "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): forms followed to the last. There is no ring, as a form is more frequent.

    A root takes its own root in each round, so a chain of n words takes log n rounds.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        moved = written(found.join(_shuffled(found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond"), "roots")
        found = moved.select("word", "root")
        if not moved.where("beyond is not null").take(1):
            return found


def group(words: DataFrame, *, times: int = 2) -> DataFrame:
    """words (word, n, each word once) with n_near, the words one edit apart; form, the most frequent of them (ties: the
    first) if it is so many times as frequent, and form_n; root, the last of the forms that follow from a word.

    Null words go.
    """
    spark = words.sparkSession
    words = written(words.where("word is not null").select("word", "n"), "words")
    with scratch(spark):
        pairs = near(words)
        both = pairs.select(F.explode(F.array(F.struct("word", F.col("other").alias("of"), F.col("other_n").alias("of_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("of"), F.col("n").alias("of_n")))).alias("p")).select("p.*")
        best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("of_n")).alias("n"), F.col("of").alias("word"))).alias("best"))
        enough = -F.col("best.n") >= times * F.col("n")
        found = words.join(_shuffled(best), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
        found = written(found, "forms", keep=True)
        last = written(roots(found.where("form is not null")), "last", keep=True)
    return found.join(_shuffled(last), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The words of op11: of so many letters, so often; of one match in so many a letter goes.
LEAST_LETTERS, LEAST_OCCURRENCES, MANGLED = 5, 3, 97


def mangled(id: int | str | None) -> Callable[[str], str]:
    """op11's misspellings: by checksum of the id (null: of no characters) and the word, one letter is left out."""
    base = zlib.crc32(b":" if id is None else f"{id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), base)
        if h % MANGLED:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the words of all documents; one row per word."""
    words = occurrences(table(spark, sf_dir, "documents"), rewrite=mangled)
    return group(words.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_OCCURRENCES)))
