"""The similarity join against all pairs."""

import random

import pytest

from tvloom.functions.text import similarity
from tvloom.operators import match


def names(rng, n, letters="abcdefghijklmnop0123"):
    out = set()
    while len(out) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 22)))
        out.add(word)
        for _ in range(rng.randint(0, 3)):  # others like it
            at, kind = rng.randrange(len(word)), rng.randrange(4)
            word = word[:at] + (rng.choice(letters) + word[at:] if kind == 0 else word[at + 1 :] if kind == 1 else rng.choice(letters) + word[at + 1 :] if kind == 2 else word[at:] + rng.choice(letters))
            if not word:
                break
            out.add(word)
    return sorted(out)[:n]


@pytest.mark.parametrize("n,minimum,letters", [(1000, 86.0, "abcdefghijklmnop0123"), (250, 50.0, "abcd"), (250, 100.0, "ab"), (200, 3.0, "abcdefg"), (300, 86.0, "ab")])
def test_all_pairs(spark, n, minimum, letters):
    rng = random.Random(n)
    left, right = names(rng, n, letters), names(rng, n, letters)
    right = sorted(set(right) | set(rng.sample(left, n // 5)))
    got = {(r.left_key, r.right_key): r.score for r in match.alike(*[spark.createDataFrame([(k,) for k in keys], "key string") for keys in (left, right)], minimum).collect()}
    theirs = {(a, b): s for a in left for b in right if (s := similarity(a, b)) >= minimum}
    assert got == theirs


def test_candidates_grow_with_matches(spark):
    """Keys without a like meet few others, far from all of about their length."""
    rng = random.Random(7)
    made = []
    for n in (1000, 4000):
        keys = [spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)),) for _ in range(n)], "key string").distinct() for _ in range(2)]
        made.append(match.candidates(*keys, 86.0).count() / n)
    assert made[0] < 6 and made[1] < 20, made


def test_bad_minimum(spark):
    one = spark.createDataFrame([("a",)], "key string")
    with pytest.raises(ValueError):
        match.candidates(one, one, 0.0)


def test_empty(spark):
    none = spark.createDataFrame([], "key string")
    assert match.alike(none, none, 86.0).collect() == []
