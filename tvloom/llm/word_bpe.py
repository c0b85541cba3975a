"""Byte-pair encoding of words with an end mark, by backtracking, and decoding by an offset table.

Merging decides a word's ids, but its result can be had from left to right. Ids are the result of merging exactly if
each neighbouring two of them are compatible: merged alone they stay as they are. So an Aho-Corasick automaton over the
tokens gives the longest token that begins at each place of a word, and the encoder takes it if it is compatible with the
one before; else it takes the longest token that begins the refused one, and with none left it gives the one before up and
marks its end, where no encoding has a boundary. A place is given up once at most, so n symbols cost O(n) steps.

Whether two tokens are compatible follows from the merges that made them: undone from the last to the first, no two
pieces at the seam may merge before one of them grows away from it. The answers are kept in a table. Tokens that merging
their own text doesn't give are never used.

A symbol is a byte, or the last byte of a word, which the end mark follows: 512 in all. Text is made NFC, then lower case
letter by letter, and split by the vocabulary's pattern; white space is dropped. Special tokens stand for themselves in the
text as it is. Letters newer than Python's Unicode tables are lower-cased and split by the tokenizers library.

Nulls and empty texts encode to no ids. A text is encoded whole, in one task; rows never meet, so nothing is shuffled and
neither repeated rows nor hot keys matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import mapped, table

#: Words whose ids a Python worker remembers, and pairs of tokens whose compatibility it does, in each of two generations.
REMEMBERED, PAIRS = 500_000, 400_000
#: Longer words are encoded anew each time.
LONGEST_REMEMBERED = 64
#: Ids decoded at once.
DECODED = 1 << 18

#: The one kind of normaliser and splitter that this module reads, as vocabulary files spell it. Fixed values.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The same pattern for lower-cased ASCII.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"

#: Vocabularies write a byte as a letter: printable ones as themselves, the others from here on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTER = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_LAST = 256


@lru_cache(4096)
def _unknown(letter: str) -> bool:
    return unicodedata.category(letter) == "Cn"


class _Remembered(dict):
    """What `make` gives for a key, made on demand. Of two generations the older is forgotten when the younger is full;
    what is asked for moves to the younger."""

    def __init__(self, most: int, make: Callable):
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > LONGEST_REMEMBERED:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON of the tokenizers library)."""

    def __init__(self, file: bytes, remembered: int = REMEMBERED, pairs: int = PAIRS):
        told = json.loads(file)
        model = told["model"]
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        if any(model.get(k) != v for k, v in plain.items()) or told["normalizer"] != {"type": "Sequence", "normalizers": NORMALIZER} or told["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [split, BYTES]} or told["decoder"]:
            raise ValueError("not a vocabulary of lower-cased words in bytes with an end mark")
        mark, vocabulary = model["end_of_word_suffix"], model["vocab"]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"]):
            raise ValueError("special tokens must stand for themselves alone")
        self.special = special
        self.divide = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda text: [text]

        size = 1 + max([*vocabulary.values(), *special.values()])
        self.rank, self.left, self.right, self.size = [-1] * size, [-1] * size, [-1] * size, [0] * size
        self.merged: dict[int, int] = {}
        symbols: dict[int, str] = {}
        for b, letter in _LETTER.items():
            symbols[vocabulary[letter]], symbols[vocabulary[letter + mark]] = chr(b), chr(b + _LAST)
        usable = set(symbols)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.rank[made] >= 0 or left not in symbols or right not in symbols:
                raise ValueError("merges must make each token once, from earlier ones")
            self.rank[made], self.left[made], self.right[made] = rank, left, right
            self.merged[left << 32 | right] = made
            symbols[made] = symbols[left] + symbols[right]
        for made, rank in sorted(((t, r) for t, r in enumerate(self.rank) if r >= 0), key=lambda x: x[1]):
            if self.left[made] in usable and self.right[made] in usable and self._stay(self.left[made], self.right[made], rank):
                usable.add(made)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.whole = {symbols[t]: t for t in usable}
        self.shorter = [-1] * size
        for word, t in self.whole.items():
            self.size[t] = len(word)
            self.automaton.add_word(word, t)
            self.shorter[t] = next((s for n in range(len(word) - 1, 0, -1) if (s := self.whole.get(word[:n])) is not None), -1)
        self.automaton.make_automaton()

        names = [""] * size
        for name, t in [*vocabulary.items(), *special.items()]:
            names[t] = name
        shown = [n.encode() + b" " for n in names]
        self.offsets = np.cumsum([0, *map(len, shown)])
        self.blob = np.frombuffer(b"".join(shown), np.uint8)

        self.compatible = _Remembered(pairs, lambda pair: self._stay(pair >> 32, pair & 0xFFFFFFFF))
        self.packed = _Remembered(remembered, self._packed)
        self._ascii, self._any = re.compile(ASCII_PATTERN, re.ASCII).findall, regex.compile(PATTERN).findall
        self._library = None

    def _stay(self, a: int, b: int, before: int = 1 << 62) -> bool:
        """Whether no merge of a rank under `before` joins the neighbours a and b or pieces of theirs."""
        rank, merged = self.rank, self.merged
        a_gone = b_gone = before
        while True:
            made = merged.get(a << 32 | b)
            # of equal merges the left one comes first: a's to its left before this one, this one before b's to its right
            if made is not None and rank[made] < a_gone and rank[made] <= b_gone and rank[made] < before:
                return False
            if rank[a] > rank[b]:
                a_gone, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_gone, b = rank[b], self.left[b]
            else:
                return True

    def merge(self, word: str) -> list[int]:
        """Ids of one word in symbols, which is not empty."""
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        n, size, shorter, compatible = len(word), self.size, self.shorter, self.compatible.__getitem__
        longest = [-1] * n
        for end, t in self.automaton.iter(word):
            longest[end + 1 - size[t]] = t
        ids: list[int] = []
        refused = bytearray(n + 1)
        at, t = 0, longest[0]
        while at < n:
            if not refused[at + size[t]] and (not ids or compatible(ids[-1] << 32 | t)):
                ids.append(t)
                at += size[t]
                if at < n:
                    t = longest[at]
                continue
            t = shorter[t]
            while t < 0:
                refused[at] = 1
                t = ids.pop()
                at -= size[t]
                t = shorter[t]
        return ids

    def _packed(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        data = word.encode()
        ids = self.merge(data[:-1].decode("latin-1") + chr(data[-1] + _LAST))
        return struct.pack(f"<{len(ids)}I", *ids)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii(text.lower())
        if any(map(_unknown, set(text))):
            return self._newer(text)
        return self._any(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _newer(self, text: str) -> list[str]:
        from tokenizers import Regex, normalizers, pre_tokenizers

        if self._library is None:
            self._library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
        normal, split = self._library
        return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def encode_packed(self, text: str | None) -> bytes:
        out = []
        for part in self.divide(text or ""):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.packed.__getitem__, self.words(part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of ids with spaces between, in UTF-8."""
        out = []
        for i in range(0, len(ids), DECODED):
            some = ids[i : i + DECODED]
            begin = self.offsets[some]
            length = self.offsets[some + np.int64(1)] - begin
            last = np.cumsum(length)
            out.append(self.blob[np.arange(last[-1]) + np.repeat(begin - last + length, length)].tobytes())
        return b"".join(out)[:-1]


_CODECS: dict[bytes, Codec] = {}


def _codec(file: bytes) -> Codec:
    """One codec for each vocabulary in a Python worker, kept from task to task."""
    key = hashlib.sha256(file).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(file)
    return _CODECS[key]


#: The columns that encode() can add.
OUTPUTS = {
    "ids": T.ArrayType(T.LongType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def _shipped(docs: DataFrame, path: str):
    """A vocabulary's file, read once on the driver; its size (here under 2 MB) doesn't depend on the data."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary_path: str, *, text: str = "text", keep: list[str], outputs: list[str]) -> DataFrame:
    """The columns `keep` of docs and, for each text, the chosen `outputs`.

    ids: token ids, without special tokens around them; decoded: what they decode to; n_tokens: their number; ids_sha256:
    hex digest of the ids as little-endian unsigned 32-bit integers; decoded_sha256: hex digest of the decoded text.
    """
    shipped = _shipped(docs, vocabulary_path)

    def begin():
        codec = _codec(shipped.value)

        def one(text: str | None) -> list:
            packed = codec.encode_packed(text)
            ids = np.frombuffer(packed, "<u4")
            decoded = codec.decode(ids) if "decoded" in outputs or "decoded_sha256" in outputs else b""
            of = {"ids": lambda: ids.astype("i8"), "decoded": decoded.decode, "n_tokens": lambda: len(ids), "ids_sha256": lambda: hashlib.sha256(packed).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest()}
            return [of[c]() for c in outputs]

        return lambda texts: list(map(list, zip(*[one(t.as_py()) for t in texts]))) or [[] for _ in outputs]

    return mapped(docs, [docs[text]], keep, [T.StructField(c, OUTPUTS[c]) for c in outputs], begin)


def decode(tokens: DataFrame, vocabulary_path: str, *, ids: str = "ids", keep: list[str]) -> DataFrame:
    """The columns `keep` of tokens and `decoded`, the text of each row's ids (null: an empty one)."""
    shipped = _shipped(tokens, vocabulary_path)

    def begin():
        codec = _codec(shipped.value)
        return lambda rows: [[codec.decode(np.array(r.as_py() or (), "i8")).decode() for r in rows]]

    return mapped(tokens, [tokens[ids]], keep, [T.StructField("decoded", T.StringType())], begin)


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents; one row per document."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], outputs=["n_tokens", "ids_sha256", "decoded_sha256"])
