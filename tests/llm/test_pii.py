import random
import re

from tvloom.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def test_base_spans(spark, odd):
    rng = random.Random(5)
    parts = ["a@b.c", "x", "@", ".", "-", "_", "1", "12", "255", "256", "0001", "4532015112830366", "4111 1111 1111 1111", " ", "é", "+", "+1 (269) 555-3296", "(", "a.b@c-d.e", "10.0.0.1", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 22))) for _ in range(600)] + [None, "a" * 20000, "1" * 20000, "1.2.3.4." * 300, "a@b.c_d@e.f@g.h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs, keep=["doc_id", "text"]).collect():
        assert [tuple(s) for s in r.spans if s.kind in pii.KINDS] == brute(r.text), r.text
    assert pii.find(odd, keep=["doc_id", "h"]).count() == odd.count()


def test_terms_that_disclose(spark):
    named = [(i, f"doc {i} filler{i % 7} says Zorblat of x{i}: zorb@corp.example then y{i}") for i in range(6)]
    plain = [(100 + i, f"plain {i} says filler{i % 5} of all then doc") for i in range(200)]
    docs = spark.createDataFrame(named + plain + [(900, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitize(docs, keep=["doc_id"]).collect()}
    terms = {s.value for i in range(6) for s in got[i].spans if s.kind == "term"}
    assert "Zorblat" in terms and not terms & {"of", "says", "then"}
    assert "[TERM]" in got[0].clean_text and "[EMAIL]" in got[0].clean_text and "zorb" not in got[0].clean_text.lower().replace("[term]", "")
    assert all(not got[100 + i].spans for i in range(200)) and got[900].clean_text == ""
    for i, text in named:
        assert all(text[s.start : s.end] == s.value for s in got[i].spans)


def test_copies_count_once(spark):
    docs = spark.createDataFrame([(i, "Only Once said to me@here.example") for i in range(30)] + [(50 + i, f"other {i}") for i in range(50)], "doc_id long, text string")
    assert {s.kind for r in pii.find(docs, keep=["doc_id"]).collect() for s in r.spans} == {"email"}


def test_an_entity_mentioned_once(spark):
    rows = [(i, f"plain text number {i % 90} that says nothing of a person") for i in range(1000)] + [(2000, "nothing of Zorblat, whose mail is zorb@corp.example, that says text")]
    docs = spark.createDataFrame([(i, f"{t} x{i}") for i, t in rows], "doc_id long, text string")
    got = {(r.doc_id, s.kind, s.value) for r in pii.find(docs, keep=["doc_id"]).collect() for s in r.spans}
    assert (2000, "class", "Zorblat") in got and not {v for _, _, v in got} & {"nothing", "of", "that", "says", "text"}


def test_copies_do_not_hide_a_term(spark):
    named = [(i, f"doc {i} says Zorblat of x{i}: zorb@corp.example then y{i}") for i in range(6)]
    copies = [(100 + i, named[0][1]) for i in range(60)]
    plain = [(1000 + i, f"plain {i} says filler of all then doc") for i in range(200)]
    docs = spark.createDataFrame(named + copies + plain, "doc_id long, text string")
    found = {(r.doc_id, s.kind) for r in pii.find(docs, keep=["doc_id"]).collect() for s in r.spans if s.value == "Zorblat"}
    assert found == {(i, "term") for i, _ in named + copies}


def test_empty_table(empty):
    assert pii.find(empty, keep=["doc_id"]).collect() == []
