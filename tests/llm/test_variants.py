import random
import re
import zlib
from collections import Counter

import pytest

from tvloom.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def brute(counts, times=2):
    """word: (form, root, n, n_near, form_n), by the deletions of each word."""
    around = {}
    for w in counts:
        for i in range(len(w) + 1):
            around.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    near = {w: {v for i in range(len(w) + 1) for v in around.get(w[:i] + w[i + 1 :], ()) if one_edit(w, v)} | {v for v in around.get(w, ()) if one_edit(w, v)} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= times * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def grouped(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_one_edit():
    assert one_edit("", "a") and one_edit("abc", "abd") and one_edit("abc", "ab") and one_edit("aab", "aaab")
    assert not one_edit("abc", "abc") and not one_edit("ab", "ba") and not one_edit("abcd", "bcde")


@pytest.mark.parametrize("letters,longest", [("ab", 9), ("abcdefgh", 5), ("aàßÿ÷×zb", 6), ("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿßß", 3)])
def test_against_brute_force(spark, letters, longest):
    random.seed(len(letters))
    counts = {"".join(random.choice(letters) for _ in range(random.randint(0, longest))): random.choice([1, 1, 2, 2, 4, 9, 30]) for _ in range(700)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert grouped(variants.group(words)) == brute(counts)


def test_letters_beyond_those_dealt(spark, monkeypatch):
    monkeypatch.setattr(variants, "DEALT", 2)
    counts = {w: i + 1 for i, w in enumerate(["abcde", "abcd", "xbcde", "中文字", "中文", "\U0001f600文字", "zzzzz"])}
    assert grouped(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_long_chain(spark):
    counts = {"a" * k: 2**k for k in range(1, 40)}
    got = grouped(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[1] for r in got.values()} == {"a" * 39}


def test_nulls_and_empty_tables(spark, empty):
    words = spark.createDataFrame([(None, 3), ("abc", 2), ("abd", None)], "word string, n long")
    assert grouped(variants.group(words)) == {"abc": (None, "abc", 2, 1, None), "abd": (None, "abd", None, 1, None)}
    assert variants.group(variants.occurrences(empty)).collect() == []


def test_a_pair_is_made_once(spark):
    words = [f"{a}bcdefgh{b}" for a in "xyzw" for b in "xyzw"]
    pairs = variants.near(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    assert len(pairs) == len({(r.word, r.other) for r in pairs}) == sum(one_edit(a, b) for a in words for b in words if a < b)


def counted(rows):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if run:
                counts[run] += 1
    return counts


def test_occurrences_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    got = {r.word: r.n for r in variants.occurrences(odd.withColumnRenamed("h", "word").withColumnRenamed("lang", "n"), rewrite=variants.mangled).collect()}
    assert got == counted([(r.doc_id, r.text) for r in odd.collect()])
    plain = {r.word: r.n for r in variants.occurrences(odd).collect()}
    assert plain["same"] == 4 and plain["ß"] == 1 and plain["Ü"] == 1 and plain["word"] == 3000


def test_query_against_brute_force(spark, small):
    counts = counted([(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])
    theirs = brute({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = grouped(variants.documents_query(spark, small))
    assert got == theirs and any(r[0] for r in got.values())


def test_no_table_passes_through_the_driver(spark):
    """Nothing is broadcast, however small its file."""
    words = spark.createDataFrame([("letter", 9), ("leter", 3), ("lettter", 1), ("other", 2)], "word string, n long")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        assert grouped(variants.group(words)) == brute({r.word: r.n for r in words.collect()})
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
