"""Byte-level BPE encoding and decoding.

Every pre-token is merged over a segment tree on its byte positions. A leaf
holds the rank of the pair that starts there together with the position, so
the root is the leftmost pair of least rank; a merge updates the leaves of the
merged piece, its right half and its left neighbour, each in O(log n). A
pre-token of n bytes costs O(n log n), whatever its length.

Nulls and empty texts encode to no ids. A text is encoded whole, in one task;
rows never meet, so nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import bounded_batches, packed_up, unpacked

NEVER = 1 << 62
SPAN = 32
#: Pre-tokens in each of two generations that a Python worker remembers; 100,000 take about 45 MB.
REMEMBERED = 120_000
#: Bits that tell which pre-tokens came before.
SEEN_BITS = 1 << 23
#: Longer pre-tokens are merged anew each time.
LONGEST_REMEMBERED = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << SPAN | i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        at >>= 1
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left < right else right
            if tree[at] == least:
                return
            tree[at] = least
            at >>= 1

    while tree[1] < NEVER:
        i = tree[1] & ((1 << SPAN) - 1)
        j = after[i]
        k = after[j]
        after[i] = k
        put(j, NEVER)
        rank = None
        if k < n:
            before[k] = i
            rank = ranks.get(piece[i : after[k]])
        put(i, NEVER if rank is None else rank << SPAN | i)
        p = before[i]
        if p >= 0:
            rank = ranks.get(piece[p:k])
            put(p, NEVER if rank is None else rank << SPAN | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Packed(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, filled on demand.

    A pre-token is remembered when it comes again, as most of the different ones come once. Of two generations the older
    is forgotten when the younger is full; what is asked for moves to the younger.
    """

    def __init__(self, ranks: dict[bytes, int], remembered: int):
        self.ranks, self.remembered, self.older = ranks, remembered, {}
        self.seen, self.marked = bytearray(SEEN_BITS // 8), 0

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = np.array(merge(word.encode(), self.ranks), "<u4").tobytes()
            at = hash(word) & (SEEN_BITS - 1)
            bit = 1 << (at & 7)
            if not self.seen[at >> 3] & bit:
                self.seen[at >> 3] |= bit
                self.marked += 1
                if self.marked > SEEN_BITS // 4:
                    self.seen, self.marked = bytearray(SEEN_BITS // 8), 0
                return packed
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.split = regex.compile(pattern).findall
        self.packed = _Packed(ranks, remembered)
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode_packed(self, text: str | None) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.split(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def _codec(vocabulary: bytes, pattern: str, remembered: int = REMEMBERED) -> Codec:
    """One codec for each vocabulary in a Python worker, kept from task to task."""
    key = hashlib.sha256(vocabulary + f"{remembered} {pattern}".encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(vocabulary), pattern, remembered)
    return _CODECS[key]


#: The columns that encode() can add.
OUTPUTS = {
    "ids": T.ArrayType(T.LongType()),
    "decoded": T.BinaryType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, *, text: str = "text", keep: list[str], outputs: list[str], remembered: int = REMEMBERED) -> DataFrame:
    """The columns `keep` of docs and, for each text, the chosen `outputs`. remembered: pre-tokens of a generation; memory for time.

    ids: token ids; decoded: bytes of the decoded ids; n_tokens: their number; ids_sha256: hex digest of the ids as
    little-endian unsigned 32-bit integers; decoded_sha256: hex digest of the decoded bytes. The vocabulary is read
    once on the driver and broadcast; a vocabulary's size doesn't depend on the data (here under 1 MB).
    """
    clash = set(keep) & set(outputs)
    if clash:
        raise ValueError(f"columns in both keep and outputs: {sorted(clash)}")
    bounded_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, OUTPUTS[c]) for c in outputs])
    decoding = any(c.startswith("decoded") for c in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, pattern, remembered)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in outputs}
            for value in batch.column(1):
                packed = codec.encode_packed(value.as_py())
                ids = np.frombuffer(packed, "<u4")
                decoded = codec.decode(ids.tolist()) if decoding else b""
                for c, out in rows.items():
                    if c == "ids":
                        out.append(ids.astype("i8"))
                    elif c == "n_tokens":
                        out.append(len(ids))
                    elif c == "ids_sha256":
                        out.append(hashlib.sha256(packed).hexdigest())
                    elif c == "decoded":
                        out.append(decoded)
                    else:
                        out.append(hashlib.sha256(decoded).hexdigest())
            arrays = [pa.array(rows[c], pa.list_(pa.int64()) if c == "ids" else pa.binary() if c == "decoded" else pa.int64() if c == "n_tokens" else pa.string()) for c in outputs]
            yield pa.RecordBatch.from_arrays(unpacked(batch, len(keep)) + arrays, names=schema.names)

    return docs.select(packed_up(docs, keep), docs[text].alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary_path: str, pattern: str, *, ids: str = "ids", keep: list[str]) -> DataFrame:
    """The columns `keep` of tokens and `decoded`, the bytes of each row's ids (null: none)."""
    with open(vocabulary_path, "rb") as file:
        shipped = tokens.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, pattern)
        for batch in batches:
            decoded = pa.array([codec.decode(value.as_py() or ()) for value in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*unpacked(batch, len(keep)), decoded], names=schema.names)

    return tokens.select(packed_up(tokens, keep), tokens[ids].alias("ids")).mapInArrow(run, schema)


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents, multilingual vocabulary; one row per document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], outputs=["n_tokens", "ids_sha256", "decoded_sha256"], remembered=300_000)
