import random

import pytest
from pyspark.sql import functions as F

from tvloom.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, step, most):
    """Dropped (id, text, line number)."""
    lines = [((d is not None, d or 0, n), line, d, t) for d, t in set(docs) if t is not None for n, line in enumerate(t.split("\n")) if line.strip()]

    def near(a, b):
        edits = min(most, min(len(a), len(b)) // step)
        return a == b or abs(len(a) - len(b)) <= edits and distance(a, b) <= edits

    return {(d, t, p[2]) for p, line, d, t in lines if any(q < p and near(line, other) for q, other, _, _ in lines)}


def mutated(rng, line, k):
    out = list(line)
    for _ in range(k):
        i = rng.randrange(len(out) + 1)
        out[i : i + rng.choice([0, 1, 1])] = rng.choice(["", "z", "q"])
    return "".join(out)


@pytest.mark.parametrize("step,most,hot,cell", [(20, 1, 100, 512), (10, 2, 2, 3), (9, 4, 100, 512), (9, 4, 1, 2)])
def test_against_brute_force(spark, step, most, hot, cell):
    rng = random.Random(step + hot)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 50))).strip() or "x" for _ in range(18)]
    docs = [(i, "\n".join(mutated(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3, 5])) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, " \n\t"), (3, "third\n" + base[0]), (None, base[1]), docs[5], (600, "".join("a" for _ in range(70))), (601, "a" * 68), (602, "😀" * 40), (603, "😀" * 39 + "x")]
    names = ["doc_id", "old", "text", "dropped", "id", "t", "kept", "__id"]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as old", "1 as dropped", "2 as id", "3 as t", "4 as kept", "5 as __id")
    got = ld.dedup(table, keep=names, step=step, most=most, hot=hot, cell=cell).collect()
    gone = brute(docs, step, most)
    assert len(got) == len(docs) and gone
    for r in got:
        lines = (r.old or "").split("\n")
        solid = sum(bool(x.strip()) for x in lines)
        lost = {n for d, t, n in gone if (d, t) == (r.doc_id, r.old)}
        want = None if r.old is None else "" if lost and len(lost) == solid else "\n".join(x for n, x in enumerate(lines) if n not in lost)
        assert (r.text, r.n_lines, r.n_dropped, r.dropped, r.id, r.t, r.kept, r["__id"]) == (want, solid, len(lost), 1, 2, 3, 4, 5), r


def test_banded_distance(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice(rng.choice(["ab", "abcdefgh", "a"])) for _ in range(rng.choice([4, 12, 60, 150])))
        b = mutated(rng, a, rng.randint(0, 9))
        a, b = max(a, b, key=len), min(a, b, key=len)
        if len(b) >= 3:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 4, 6):
        rows = df.where(f"length(a) - length(b) <= {edits} and length(b) >= {edits}").select("a", "b", ld.within(df["a"], df["b"], edits).alias("near"), ld.banded(df["a"], df["b"], edits + 1, F.lit(edits)).alias("banded")).collect()
        assert all(r.near == r.banded == (distance(r.a, r.b) <= edits) for r in rows) and len({r.near for r in rows}) == 2


def test_signatures_lose_no_pair(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(300):
        a = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(1, 80)))
        pairs.append((i, a, mutated(rng, a, rng.randint(0, 6)) or "x"))
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    signed = [{r.h: r for r in ld._signatures(df.selectExpr("i as h", "0 as g", f"{c} as line")).collect()} for c in "ab"]
    for i, a, b in pairs:
        differing = sum(((signed[0][i][f"s{w}"] ^ signed[1][i][f"s{w}"]) & (2**64 - 1)).bit_count() for w in range(ld.SIGNED))
        longer = abs(len(a) - len(b))
        assert differing + longer <= 4 * distance(a, b)
        counts = sum(((signed[0][i][f"c{w}"] ^ signed[1][i][f"c{w}"]) & (2**64 - 1)).bit_count() for w in range(ld.COUNTED))
        assert counts + longer <= 2 * distance(a, b)
        assert any(signed[k][i][f"c{w}"] for k in (0, 1) for w in range(ld.COUNTED)) == any((a, b))


def test_serial_numbers_and_a_text_of_repeated_lines(spark):
    rng = random.Random(6)
    docs = [(i, f"Entry {rng.randrange(10**8):08d} was filed in the register of the city") for i in range(6_000)]
    docs.append((10**6, "the same line again\n" * 100_000))
    got = {r.doc_id: r.n_dropped for r in ld.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), keep=["doc_id"]).collect()}
    assert got[10**6] == 99_999
    few = docs[:400]
    gone = {d for d, _, _ in brute(few, ld.STEP, ld.MOST)}
    for d, _ in few:
        assert got[d] == (d in gone)


def test_clash(odd):
    with pytest.raises(ValueError):
        ld.dedup(odd.withColumn("n_lines", odd["score"]), keep=["n_lines"])


def test_odd_rows_and_empty_table(odd, empty):
    assert ld.dedup(odd, keep=["doc_id", "text", "h"]).count() == odd.count()
    assert ld.dedup(empty, keep=["doc_id", "text"]).collect() == []


@pytest.mark.parametrize("hot", [100, 2])
def test_edits_follow_the_length(spark, hot):
    rng = random.Random(hot)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)).strip() or "x" for n in (19, 24, 39, 41, 58, 61, 79, 85, 99, 101, 119, 121, 158, 161, 245)]
    head = "".join(rng.choice("abc ") for _ in range(60)).strip()
    base += [head + "".join(rng.choice("xyz ") for _ in range(70)).strip() for _ in range(6)]
    docs = [(i, "\n".join(mutated(rng, rng.choice(base), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])) for _ in range(2))) for i in range(45)]
    day = "On the first day of the month the council met again in the old town hall and spoke on {} for an hour"
    docs += [(500, day.format("roads")), (501, day.format("water")), (502, None), docs[3]]
    gone = brute(docs, ld.STEP, ld.MOST)
    assert any(d == 501 for d, _, _ in gone)
    got = ld.dedup(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as old"), keep=["doc_id", "old"], hot=hot, cell=7).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_dropped == sum((d, t) == (r.doc_id, r.old) for d, t, _ in gone), r


@pytest.mark.parametrize("moved", range(9))
def test_cover(moved):
    own, places = ld.cover(moved)
    assert own <= set(places) and {b - a for a in own for b in places} >= set(range(-moved, moved + 1))


@pytest.mark.parametrize("step,most", [(20, 6), (20, 9), (3, 4), (1, 3)])
def test_a_segment_is_found_however_it_moved(step, most):
    rule = ld.Rule(step, most)
    rng = random.Random(step)
    for _ in range(2_000):
        c = rng.randrange(most + 1)
        short = "".join(rng.choice("ab") if rng.random() < 0.2 else chr(rng.randrange(97, 123)) for _ in range(rng.randint(rule.classes[c], min(rule.highest[c], 300))))
        other = mutated(rng, short, rng.randint(0, rule.allowed(rule.classes[c])))
        if abs(len(other) - len(short)) > rule.allowed(rule.classes[c]) or distance(short, other) > rule.allowed(rule.classes[c]) or len(other) < len(short):
            continue

        def keys(line, own):
            places = [(i, b if b >= 0 else len(line) + b, size) for _, i, b, size, o in rule.substrings(c) if o or not own]
            return {(i, line[at : at + size]) for i, at, size in places}

        assert keys(short, True) & keys(other, False)


def test_lines_too_long_to_count(spark):
    """Counts of 16 bits don't hold their characters: no letter may overflow them, and near lines are still found."""
    texts = [c * 40_000 + end for c in "abcdefghijklmnopqrstuvwxyz" for end in "01"] + ["jm" * 500_000 + "x", "jm" * 500_000 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = ld.dedup(docs, keep=["doc_id"]).collect()
    assert {r.doc_id for r in got if r.n_dropped} == {i for i in range(len(texts)) if i % 2}
