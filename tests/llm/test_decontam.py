import re

import pytest

from tvloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, bench):
    w, hit, items = words(text), set(), set()
    for name, t in bench:
        b = words(t)
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if name is not None:
                    items.add(str(name))
    return len(w), len(hit), sorted(items)


LONG = " ".join(f"w{i}" for i in range(40))
BENCH = [(1, LONG), (2, "Kurz, ganz KURZ"), (3, None), (4, ""), (5, "ÄPFEL äpfel"), (6, "a a a a a a a a a a a a"), (11, LONG.upper() + " tail"), (None, "nobody named this")]
DOCS = [
    None, "", "!!!", "x " + LONG + " y", " ".join(LONG.split()[5:15]), " ".join(LONG.split()[5:14]), "so ganz kurz oder kurz ganz kurz", "äpfel äpfel äpfel", "ÄPFEL äpfel",
    "a " * 30, "a " * 9, "nobody NAMED this", " ".join(f"w{i}" for i in list(range(3, 20)) + [99] + list(range(20, 33))), "z " * 5000 + " ".join(LONG.split()[20:31]) + " z" * 5000,
]


@pytest.mark.parametrize("block", [8_000_000, 30])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(DOCS)] + [(3, DOCS[3], "again")], "doc_id long, text string, score string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = decontam.find(docs, bench, keep=["doc_id", "text"]).withColumn("n_hit", decontam.n_hit()).collect()
    assert len(rows) == len(DOCS) + 1
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, BENCH), r.text


def test_odd_rows_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontam.find(odd, bench, keep=["doc_id"]).count() == odd.count()
    assert decontam.find(empty, bench, keep=["doc_id"]).collect() == []
    assert all(r["items"] == [] for r in decontam.find(odd, bench.where("false"), keep=["doc_id"]).collect())


def test_clashing_names_are_refused(odd, spark):
    with pytest.raises(ValueError):
        decontam.find(odd, spark.createDataFrame(BENCH, "item_id long, text string"), keep=["doc_id", "items"])
