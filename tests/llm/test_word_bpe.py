import hashlib
import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tvloom.llm import word_bpe

PATH = P.path("word_bpe_49k.json")
FILE = open(PATH, "rb").read()
CODEC = word_bpe.Codec(FILE)
THEIRS = Tokenizer.from_file(PATH)


def encoded(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


def decoded(ids):
    return THEIRS.decode(ids, skip_special_tokens=False)


def test_agrees_on_random_text():
    random.seed(1)
    signs = ["a", "b", "s", "ss", "'s", "'ll", "'", "é", "é", "Σ", "ΑΣ", "İ", "ß", "中", "1", "२", "Ⅷ", "!", "—", "\n", "\x1c", "\x85", " ", "​", "<|endoftext|>", "<|startoftext|>", "<|", "\U00010d50", "th", "ing", "ation", "zz", "\U0001f600"]
    for _ in range(5000):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 25)))
        ids = CODEC.encode(text)
        assert ids == encoded(text), text
        assert CODEC.decode(np.array(ids, "i8")).decode() == decoded(ids)


@pytest.mark.parametrize("letters", ["a", "ab", "aabns", "etaoinshrdlu", "the"])
def test_agrees_on_words_without_sense(letters):
    random.seed(2)
    for _ in range(1500):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 120)))
        assert CODEC.encode(text) == encoded(text), text


def test_all_letters():
    text = " ".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    assert CODEC.encode(text) == encoded(text)


def test_long_words():
    for text in ("a" * 30_000, "ab" * 9_000, "é" * 5_000, "!" * 20_001, "thein" * 5_000):
        assert CODEC.encode(text) == encoded(text)


def test_forgetting_changes_nothing():
    codec = word_bpe.Codec(FILE, 3, 3)
    text = "onexq twoxyq threexyq fourxyq onexq twoxyq fivexyq threexyq " * 4
    assert codec.encode(text) == encoded(text)


def test_compatible_pairs_are_those_that_merging_leaves():
    random.seed(4)
    words = {t: s for s, t in CODEC.whole.items() if ord(s[-1]) < 256 and all(97 <= ord(c) <= 122 for c in s)}
    ids = random.sample(sorted(words), 400)
    for a, b in zip(ids[::2], ids[1::2]):
        # with a last letter that joins nothing before it, the pair is what merging makes of its letters
        pair = THEIRS.model.tokenize(words[a] + words[b])
        inner = [t.id for t in pair]
        last = CODEC.merge(words[a] + words[b][:-1] + chr(ord(words[b][-1]) + 256))
        assert inner == last
        assert CODEC._stay(a, b) == (CODEC.merge(words[a] + words[b]) == [a, b])


def test_on_odd_rows(spark, odd):
    got = word_bpe.encode(odd.withColumnRenamed("h", "__text"), PATH, keep=["doc_id", "text", "__text"], outputs=list(word_bpe.OUTPUTS)).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = encoded(r.text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded(ids).encode()).hexdigest()
    tokens = word_bpe.encode(odd, PATH, keep=["text"], outputs=["ids"])
    assert all(r.decoded == decoded(encoded(r.text)) for r in word_bpe.decode(tokens, PATH, keep=["text"]).collect())


def test_refusals_and_empty_table(spark, odd, empty):
    assert word_bpe.encode(empty, PATH, keep=["doc_id"], outputs=["ids", "n_tokens"]).collect() == []
    with pytest.raises(ValueError):
        word_bpe.encode(odd.withColumnRenamed("h", "ids"), PATH, keep=["ids"], outputs=["ids"])
    with pytest.raises(ValueError):
        word_bpe.Codec(json.dumps(json.loads(FILE) | {"normalizer": None}).encode())


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = word_bpe.documents_query(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = encoded(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded(ids).encode()).hexdigest()
