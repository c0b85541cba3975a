import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from tvloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
CODEC = bpe.Codec(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ranks_are_read():
    line = next(open(PATH, "rb"))
    assert RANKS[base64.b64decode(line.split()[0])] == int(line.split()[1])


def test_agrees_with_tiktoken_on_random_text():
    random.seed(1)
    signs = "ab \n\t\x1c\x85​ é1२Ⅷ'’s'll!中<|endoftext|>"
    for _ in range(1500):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 30)))
        assert CODEC.encode(text) == THEIRS.encode_ordinary(text)


def test_long_pretokens_are_merged_whole():
    for text in ("a" * 30_000, "ab" * 9_000, " " * 5_000, "é" * 5_000):
        assert CODEC.encode(text) == THEIRS.encode_ordinary(text)


def test_forgetting_changes_nothing():
    codec = bpe.Codec(RANKS, P.PATTERN, 3)
    text = "onex twoxy threexy fourxy onex twoxy fivexy threexy onex " * 3
    assert codec.encode(text) == THEIRS.encode_ordinary(text)


def test_round_trip_and_digests(spark, odd):
    got = bpe.encode(odd, PATH, P.PATTERN, keep=["doc_id", "text", "score"], outputs=list(bpe.OUTPUTS)).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = THEIRS.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_decode(spark, odd):
    tokens = bpe.encode(odd, PATH, P.PATTERN, keep=["text"], outputs=["ids"])
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode(tokens, PATH, P.PATTERN, keep=["text"]).collect())


def test_empty_table(empty):
    assert bpe.encode(empty, PATH, P.PATTERN, keep=["doc_id"], outputs=["ids", "n_tokens"]).collect() == []


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = bpe.documents_query(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows[:60]:
        assert r.n_tokens == len(THEIRS.encode_ordinary(docs[r.doc_id] or ""))
