import random

import pytest
from pyspark.sql import functions as F

from tvloom.operators import history
from tvloom.schemas import RESPONSE
from tvloom.sinks import run_log

HEALTH = "ord long, stream_url string, status string"


def plain(runs):
    """What is known, one check after the other."""
    out = {}
    for n, rows in runs:
        for key, status in {u.strip(): s for _, u, s in rows if u.strip()}.items():
            k = out.setdefault(key, [n, n, 0, 0, None, 0, ""])
            good = status in ("online", "reachable")
            k[1], k[2], k[3], k[6] = n, k[2] + 1, k[3] + (not good), status
            k[4], k[5] = (n, 0) if good else (k[4], k[5] + 1)
    return sorted((k, *v) for k, v in out.items())


def told(spark, path):
    return sorted(tuple(r) for r in history.known(spark, path).select([c.split(" ")[0] for c in history.STRETCH.split(", ")]).collect())


@pytest.mark.parametrize("compacted", [(), (1,), (0, 2), (0, 1, 2, 3, 4)])
def test_runs_add_up_whenever_they_are_compacted(spark, tmp_path, compacted):
    rnd = random.Random(len(compacted))
    runs = [(10 * i, [(k, f" u{rnd.randrange(6)} ", rnd.choice(["online", "reachable", "offline", "offline"])) for k in range(rnd.randrange(9))] + [(99, " ", "online")]) for i in range(5)]
    path = f"file://{tmp_path}/log"
    assert told(spark, path) == []
    for i, (n, rows) in enumerate(runs):
        history.remember(spark.createDataFrame(rows, HEALTH), path, n)
        if i in compacted:
            history.compact(spark, path)
    assert told(spark, path) == plain(runs)
    assert {r.key for r in history.failing(spark, path, 2).collect()} == {k[0] for k in plain(runs) if k[6] >= 2}


def test_a_run_again_an_unfinished_one_and_a_late_one(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    day = lambda *rows: spark.createDataFrame(list(rows), HEALTH)
    history.remember(day((0, "a", "online"), (1, "b", "offline")), path, 1)
    history.remember(day((0, "a", "offline")), path, 2)
    history.remember(day((0, "a", "online")), path, 2)  # the same run once more
    (tmp_path / "log" / "run-3").mkdir()  # a run that died
    (tmp_path / "log" / "base-9-0").mkdir()
    assert told(spark, path) == [("a", 1, 2, 2, 0, 2, 0, "online"), ("b", 1, 1, 1, 1, None, 1, "offline")]
    history.compact(spark, path)
    with pytest.raises(ValueError):
        history.remember(day((0, "a", "online")), path, 2)
    reading = history.known(spark, path)
    history.remember(day((0, "a", "offline")), path, 4)
    history.compact(spark, path)
    assert reading.count() == 2  # planned before: its files are still there
    assert told(spark, path) == [("a", 1, 4, 3, 1, 2, 1, "offline"), ("b", 1, 1, 1, 1, None, 1, "offline")]
    history.compact(spark, path, since=2)
    assert [r[0] for r in told(spark, path)] == ["a"] and not (tmp_path / "log" / "run-1").exists()


def test_forgetting(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    history.remember(spark.createDataFrame([(0, "a", "online"), (1, "b", "online"), (2, "c", "offline")], HEALTH), path, 1)
    history.forget(spark, path, spark.createDataFrame([("b",), ("b",), ("none",)], "key string"))
    assert [r[0] for r in told(spark, path)] == ["a", "c"]
    history.forget(spark, path)
    assert told(spark, path) == [] and run_log.runs(path) == []
    history.remember(spark.createDataFrame([(0, "a", "offline")], HEALTH), path, 2)
    assert told(spark, path) == [("a", 2, 2, 1, 1, None, 1, "offline")]


def test_downloads(spark, tmp_path):
    path = f"{tmp_path}/downloads"
    rows = spark.createDataFrame([("u", 200, "t", "u", bytearray(b"abc"), "", "", 5, [(1, "ok", 200, 5, "")]), ("v", None, "", "v", None, "network", "x", 7, [])], RESPONSE)
    history.remember_downloads(rows, path, 1)
    history.remember_downloads(rows.where("url = 'v'"), path, 2)
    run_log.compact(spark, path, history.DOWNLOAD)
    got = history.downloads(spark, path)
    assert sorted((r.url, r.run, r.bytes, r.error_type, len(r.attempts)) for r in got.collect()) == [("u", 1, 3, "", 1), ("v", 1, None, "network", 0), ("v", 2, None, "network", 0)]
    assert got.groupBy("url").agg(F.max_by("run", "run").alias("n")).count() == 2
