import base64
import collections
import gzip
import hashlib

import pytest

from tvloom.llm import warc

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y%", "<p>x</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "é" * 9000 + "\r\n\r\nWARC/1.1"), (5, "http://e/", "é" * 9000 + "\r\n\r\nWARC/1.1"), (None, "http://f/", "<p>x</p>")]


@pytest.fixture
def archives(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3), path)
    return path


def test_round_trip(spark, archives):
    rows = warc.read(spark, archives).collect()
    assert len(rows) == len(PAGES)
    by_type = {t: [r for r in rows if r.record_type == t] for t in ("response", "revisit")}
    assert {bytes(r.payload).decode() for r in by_type["response"]} == {h or "" for _, _, h in PAGES} and len(by_type["response"]) == 3
    assert all(r.payload is None and r.headers["WARC-Profile"] == warc.REVISIT for r in by_type["revisit"])
    ids = {r.record_id: r for r in by_type["response"]}
    for r in by_type["revisit"]:
        assert ids[r.refers_to].payload_digest == r.payload_digest
    assert len({r.record_id for r in rows}) == len(rows)
    assert {r.target_uri for r in rows} == {u for _, u, _ in PAGES}
    for r in by_type["response"]:
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()


def test_members_are_plain_gzip(archives):
    import pathlib

    text = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(archives.removeprefix("file://")).glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type") == len(PAGES)


def test_predicates_and_skipped_payloads(spark, archives, monkeypatch):
    assert warc.read(spark, archives).where("record_type = 'revisit'").count() == 4
    assert warc.read(spark, archives, types="response").count() == 3
    assert warc.read(spark, archives, payload="false").where("payload is not null").count() == 0
    assert warc.read(spark, archives, **{"header.WARC-Target-URI": "http://d/"}).count() == 1
    plan = warc.read(spark, archives).where("record_type = 'revisit' and target_uri like '%f/%'")
    assert plan.count() == 1


def test_skipping_never_inflates_a_payload(tmp_path, monkeypatch):
    big = warc.record("response", "<a>", "u", "d", "t", None, {}, bytes(range(256)) * 8000)
    (tmp_path / "x.warc.gz").write_bytes(big + warc.record("resource", "<b>", "u", "d", "t", None, {}, b"small"))
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "types": "resource"})
    called = []
    monkeypatch.setattr(warc, "_payload", lambda h, b: called.append(h["WARC-Type"]) or b)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["payload"] for r in rows] == [b"small"] and called == ["resource"]


@pytest.mark.parametrize("split", [300, 1 << 25])
def test_files_are_cut_at_records(tmp_path, monkeypatch, split):
    monkeypatch.setattr(warc, "SPLIT_BYTES", split)
    own = [warc.record("resource", f"<{i}>", "u", "d", "t", None, {}, (b"\x1f\x8b\x08" * i) + str(i).encode() * 50) for i in range(40)]
    plain = [gzip.compress(gzip.decompress(x)) for x in own]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(own))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(plain))
    (tmp_path / "c.warc").write_bytes(b"".join(map(gzip.decompress, own)))
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["record_id"] for r in rows) == sorted(f"<{i}>" for i in range(40) for _ in range(3)) and (len(parts) > 5) == (split == 300)


def test_a_wrong_digest_is_an_error(tmp_path):
    record = gzip.decompress(warc.record("response", "<a>", "u", "d", "t", None, {}, b"payload"))
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record.replace(b"payload\r\n", b"pay!oad\r\n")))
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))


def test_small_payloads_are_all_responses(spark, tmp_path):
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), f"file://{tmp_path}/w", at_least=9)
    rows = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sum(r.record_type == "revisit" for r in rows) == 1


def test_empty_table(spark, tmp_path):
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").collect() == []


def test_uris_stay_as_they_are(spark, tmp_path):
    uris = ["https://h/a%20b?q=100%25", "https://h/?x=%0Ay%0D", "a\nb", " space ", "X-JSON-y: \"z\"", "é"]
    warc.archive(spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(uris)], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert {r.target_uri for r in warc.read(spark, f"file://{tmp_path}/w").collect()} == set(uris)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert b"WARC-Target-URI: https://h/a%20b?q=100%25\r\n" in text
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://h/?q=100%25&x=%0Ay\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    (tmp_path / "o.warc").write_bytes(other)
    assert [r.target_uri for r in warc.read(spark, f"file://{tmp_path}/o.warc").collect()] == ["http://h/?q=100%25&x=%0Ay"]


def test_appending_keeps_what_was_there(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    for begin, n in ((0, 100), (100, 150)):
        warc.archive(spark.range(begin, begin + n).selectExpr("id as page_id", "'u' as url", "concat('p', id) as html"), path)
    assert warc.read(spark, path).count() == 250
    one = spark.createDataFrame([("resource", "<r>", "u", "d", "t", None, {}, b"x")], "record_type string, record_id string, target_uri string, date string, content_type string, refers_to string, headers map<string,string>, payload binary")
    one.write.format("warc").mode("overwrite").save(path)
    assert [r.record_id for r in warc.read(spark, path).collect()] == ["<r>"]


def brute(pages, at_least=0):
    """Rows of the query: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    groups = collections.defaultdict(list)
    for page_id, _, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = collections.Counter()
    for body, ids in groups.items():
        head = max((i for i in ids if i is not None), default=None)
        tail = list(ids)
        tail.remove(head)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out[(head, len(body), digest, "response", None)] += 1
        for i in tail:
            revisit = len(body) >= at_least
            out[(i, len(body), digest, "revisit" if revisit else "response", head if revisit else None)] += 1
    return out


def rows_of(df):
    return collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_twins_against_brute_force(spark, tmp_path):
    pages = PAGES + [(5, "http://e/", "x"), (5, "http://e/", "x"), (5, "http://f/", "x"), (4, "u", "x"), (4, "u", "x"), (None, None, "n"), (None, None, "n")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert rows_of(warc.pages_query(spark, str(tmp_path))) == brute(pages)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = [(p.page_id, p.url, p.html) for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert rows_of(warc.pages_query(spark, sf_dir)) == brute(pages)


def test_text_ids_and_repeated_writes(spark, tmp_path):
    """Ids of any text come back, and a second write of the same pages names them alike."""
    ids = ["null", None, "z", "", "/", "a:b", "<urn:page:/x:0123456789abcdef:0>", "a\nb"]
    pages = [(i, f"http://{n % 3}/", "same" if n % 2 else f"own{n}") for n, i in enumerate(ids)] + [("z", "u", "own2"), ("z", "u", "own2")]
    df = spark.createDataFrame(pages, "page_id string, url string, html string")
    names = []
    for k in range(2):
        warc.archive(df.repartition(k + 1), f"file://{tmp_path}/{k}", at_least=0)
        rows = warc.read(spark, f"file://{tmp_path}/{k}")
        names.append(sorted(r.record_id for r in rows.collect()))
        got = rows.select(warc.page_of("record_id").alias("id")).collect()
        assert collections.Counter(r.id for r in got) == collections.Counter(p[0] for p in pages)
    assert names[0] == names[1] and len(set(names[0])) == len(pages)
