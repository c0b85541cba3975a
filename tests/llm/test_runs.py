import hashlib
import random
import zlib

from tvloom.llm import runs


def brute(w):
    """Runs by comparing words at each distance."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(12, 2 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(random, n, letters):
    w = [random.randint(0, letters) for _ in range(n)]
    for _ in range(random.randint(0, 3)):
        if n > 10:
            p = random.randint(1, n // 3)
            s = random.randint(0, n - p)
            m = random.randint(p, max(p, n - s))
            w[s : s + m] = (w[s : s + p] * (m // p + 1))[:m]
    return w


def test_against_brute_force():
    random.seed(1)
    for _ in range(3000):
        w = sample(random, random.randint(0, 90), random.choice([0, 1, 2, 3, 5]))
        assert runs.find_runs(w) == brute(w)


def test_sets_of_several_blocks(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 4)
    random.seed(2)
    for k in range(600):
        w = sample(random, random.randint(50, 120), 1)
        if k % 2:
            w = (w[: random.randint(1, 9)] * len(w))[: len(w)]
        assert runs.find_runs(w) == brute(w)


def test_ordered_set():
    random.seed(3)
    values = random.sample(range(100_000), 8_000)
    ends = runs.Ends(values[0])
    for v in values[1:]:
        ends.add(v)
    ordered = sorted(values)
    assert ends.members() == ordered and ends.size == len(values)
    for i in range(0, len(ordered), 7):
        assert ends.around(ordered[i]) == (ordered[i - 1] if i else None, ordered[i + 1] if i + 1 < len(ordered) else None)


def test_long_texts():
    assert runs.find_runs([b"a"] * 150_000) == [(0, 150_000, 1)]
    assert runs.find_runs(list(range(9_000)) * 11) == [(0, 99_000, 9_000)]
    assert runs.find_runs(list(range(100_000))) == []


def test_collapse():
    w = list("abcabcabcabcabx")
    assert "".join(runs.collapse(w, runs.find_runs(w))) == "abcx"
    assert runs.collapse(["a", "b"], []) == ["a", "b"]


def test_find_on_odd_rows(spark, odd):
    got = runs.find(odd, keep=["doc_id", "text", "h", "items"]).collect()
    assert len(got) == odd.count()
    for r in got:
        words = (r.text or "").encode().split()
        found = brute([w for w in words]) if len(words) < 200 else [(0, len(words), 1)]
        assert [tuple(x) for x in r.runs] == found
    assert {r.collapsed for r in got if r.text == "word " * 3000} == {"word"}


def test_names_and_empty_table(spark, odd, empty):
    assert runs.find(empty, keep=["doc_id"]).collect() == []
    named = odd.withColumnsRenamed({"score": "__text", "h": "k", "lang": "i0"})
    assert runs.find(named, keep=["__text", "k", "i0"]).count() == odd.count()
    try:
        runs.find(odd.withColumnRenamed("h", "runs"), keep=["runs"])
    except ValueError:
        pass
    else:
        raise AssertionError


def rewritten(id, words):
    h = zlib.crc32(str(id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = runs.documents_query(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    held = 0
    for r in rows:
        words = rewritten(r.doc_id, (docs[r.doc_id] or "").encode().split())
        if len(words) > 500:
            continue
        found = brute(words)
        held += bool(found)
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
    assert held > 5
