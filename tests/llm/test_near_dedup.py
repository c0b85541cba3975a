import random
import re

import numpy as np
import pytest

from tvloom.llm import near_dedup as nd
from tvloom.llm.words import Words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randrange(rng.choice([3, 50])) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.choice([0, 1])] = rng.choice([[], [rng.randrange(50)]])
        if b:
            m = lcs(a, b)
            assert nd.aligned(np.array(a), np.array(b)) == (m / (len(a) + len(b) - m) >= 0.8 - 1e-12), (a, b)


def plain_shingles(text):
    """Numbers of the runs of five words, made without the operator."""
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    return [KNOWN.setdefault(tuple(words[i : i + 5]), len(KNOWN)) for i in range(max(len(words) - 4, min(len(words), 1)))]


KNOWN = {}


def similar(a, b):
    m = lcs(a, b)
    return m / (len(a) + len(b) - m) >= 0.8 - 1e-12


def shingles(text):
    data = (text or "").encode()
    return nd.shingles(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0]


def test_shingles():
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(" ,")) == 0
    assert len(shingles("x y " * 200)) == 396
    for text in ("a b c", "a b c d e f g a b c d e f g", "É é x. Y"):
        own, plain = shingles(text).tolist(), plain_shingles(text)
        assert [own.index(x) for x in own] == [plain.index(x) for x in plain]


def test_repeats_count(spark):
    said = " ".join(f"w{i}" for i in range(30))
    texts = [said, said + " spam" * 10_000, "ha " * 6, "ha " * 5000, "ha " * 5010, "x y " * 200 + said, "x y " * 200 + said.replace("w5 ", "v5 ")]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}


def test_recall_near_the_threshold():
    """Pairs at 0.8 to 0.82 share a sketch, and their signatures let them through, for texts of any size."""
    rng = random.Random(9)
    found = pairs = 0
    for size in (9, 14, 17, 19, 22, 30, 60, 150, 600):
        for _ in range(120):
            a = [rng.randrange(1 << 40) for _ in range(size)]
            b = list(a)
            for _ in range(size):
                c = list(b)
                at = rng.randrange(len(c))
                c[at : at + 1] = [] if rng.random() < 0.5 else [rng.randrange(1 << 40)]
                m = lcs(a, c) if size < 200 else len(set(a) & set(c))
                if m / (len(a) + len(c) - m) < 0.8:
                    break
                b = c
            both = nd.mixed(np.array(a + b, np.uint64))
            (x, y), bits = nd.sketches(both, np.array([0, len(a), len(a) + len(b)]))
            pairs += 1
            found += bool(set(x) & set(y))
            differing = sum(int(w).bit_count() for w in (bits[0] ^ bits[1]).view(np.uint64))
            assert differing <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-9
    assert found >= 0.995 * pairs, (found, pairs)


def corpus(rng):
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(rng.randint(8, 120))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(99))
            docs.append(" ".join(copy))
    return docs


@pytest.mark.parametrize("cell", [512, 2])
def test_classes_against_brute_force(spark, cell):
    texts = corpus(random.Random(7)) + ["one two", "One, two!", "one two three", "", None, "...", "exact copy of a text with words", "exact copy of a text with words"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r.doc_id: (r.class_id, r.class_size) for r in nd.classes(docs, cell=cell).collect()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    s = [plain_shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(s[i]) and len(s[j]) and similar(s[i], s[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in range(len(texts))}
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(n == sum(c == w for w in want.values()) for c, n in got.values())


def test_a_large_group_of_copies_is_one_class(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(150)] = f"c{i}"
        rows.append((i, " ".join(copy if i % 3 else base)))
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 300)}


def test_odd_rows_and_empty_table(odd, empty):
    rows = nd.classes(odd).collect()
    assert len(rows) == odd.count()
    assert {r.class_size for r in rows if r.doc_id in (7, 8, 9)} == {4}
    assert nd.classes(empty).collect() == []
