import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tvloom.llm import langid
from tvloom.llm import langid as li


def test_held_out_accuracy(spark, small):
    rows = langid.documents_query(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_und_and_odd_rows(spark, odd):
    model = langid.Model.fit([("the and of to in", "en"), ("der die das und", "de")] * 3)
    got = {(r.doc_id, r.text): r for r in langid.predict(odd, model, keep=["doc_id", "text"]).collect()}
    for (_, text), r in got.items():
        lettered = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not lettered) and (lettered or r.score == 0)
    assert model.predict(["12 3!", "and the", "und die"])[0] == ["und", "en", "de"]


def test_nothing_learnt(spark, odd, empty):
    model = langid.fit(empty, langid.held_out(empty["doc_id"]))
    assert model.languages == []
    assert {r.lang_pred for r in langid.predict(odd, model, keep=["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty, model, keep=["doc_id"]).collect() == []


def test_whole_text_counts():
    model = langid.Model.fit([("the and of to in " * 5, "en"), ("der die das und ist " * 5, "de")])
    assert model.predict(["1" * 300_000 + " der die das und"])[0] == ["de"]


def test_a_language_of_long_texts_only(spark):
    rng = random.Random(4)
    english, german = "the and of to in that is was for with".split(), "der die und das ist nicht mit sich auf ein".split()
    rows = [(i, " ".join(rng.choices(english, k=10_000)), "en") for i in range(12)] + [(100 + i, " ".join(rng.choices(german, k=12)), "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs, F.lit(True))
    assert model.languages == ["de", "en"]
    assert {(r.lang, r.lang_pred) for r in li.predict(docs, model, keep=["lang"]).collect()} == {("de", "de"), ("en", "en")}


def test_fit_against_a_plain_kernel_ridge():
    """Scores of the multiplied-out model and of kernels, projection and ridge computed one by one."""
    rng = random.Random(5)
    rows = [(" ".join("".join(rng.choices(a, k=4)) for _ in range(6)), label) for _ in range(10) for a, label in (("abcd", "x"), ("cdef", "y"), ("efgh", "z"))]
    rows.sort(key=lambda r: r[1])
    model = li.Model.fit(rows)

    def grams(text):
        return set(np.flatnonzero(li.presence([text])[0][0]).tolist())

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    sets = [grams(t) for t, _ in rows]
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(gram)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = gram @ root
    sign = np.array([[1.0 if label == name else -1.0 for name in "xyz"] for _, label in rows])
    weights = np.linalg.solve(features.T @ features + li.RIDGE * np.eye(len(rows)), features.T @ sign)
    for text in ("abab cdcd", "efgh hgfe", "dede fefe abba"):
        plain = np.array([kernel(grams(text), s) for s in sets]) @ root @ weights
        x = li.presence([text])[0]
        own = (x @ model.weights) / np.sqrt(x.sum())
        assert np.allclose(plain, own[0], atol=1e-3), (plain, own)


def test_clash(odd):
    with pytest.raises(ValueError):
        li.predict(odd, li.Model.fit([]), keep=["score"])

def test_only_texts_go_to_python(spark):
    """Kept columns stay where they are, and a filter on the result runs the model no second time."""
    rows = [(i, "the and of to in that is was " * 20, "en" if i % 2 else "de", "x" * 10_000) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, payload string")
    model = li.Model.fit([("the and of to in", "en"), ("der die das und", "de")])
    found = li.predict(docs, model, keep=docs.columns).where("lang_pred = 'en' and score > 0")
    assert {(r.doc_id, len(r.payload)) for r in found.collect()} == {(i, 10_000) for i in range(300)}
    plan, moved = found._jdf.queryExecution().executedPlan(), {"pythonDataSent": 0, "pythonDataReceived": 0}
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        for name in moved:
            if node.metrics().contains(name):
                moved[name] += node.metrics().apply(name).value()
    texts = sum(len(r[1]) for r in rows)
    assert texts <= moved["pythonDataSent"] < 1.5 * texts
    assert moved["pythonDataReceived"] < texts / 2
