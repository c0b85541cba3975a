import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from tvloom.operators import match
from tvloom.plans import catalogue


def run(spark, playlist, shown):
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(playlist)], "ord long, name string, tvg_id string, tvg_name string")
    g = spark.createDataFrame([(i, *r) for i, r in enumerate(shown)], "ord long, channel_id string, display_names array<string>")
    found = match.match(p, g)
    return [(r.status, r.guide_id, r.method, r.score) for r in found.orderBy("ord").collect()], found


GUIDE = [("Rai1.it", ["Rai 1"]), ("RaiNews24.it", ["Rai News 24"]), ("Rai3.it", ["Rai 3"]), ("Rai3Regione.it", ["Rai 3"]), ("TeleNorba.it", ["TeleNorba Bari"]), ("RaiSportPlus.it", ["Rai Sport +"])]


def test_tiers(spark):
    rows, found = run(spark, [("x", "rai1.IT", ""), ("x", "Rai1.it@SD", ""), ("Rai News 24 HD", "", ""), ("Rai Uno", "", ""), ("Rai 3", "", ""), ("Tele Norba Barì X", "", ""), ("zzzz", "", ""), ("Rai Sport + HD", "", "")], GUIDE)
    assert rows[0] == ("matched", "Rai1.it", "exact_tvg_id", 100.0) and rows[1] == ("matched", "Rai1.it", "normalized_tvg_id", 97.0)
    assert rows[2][1:3] == ("RaiNews24.it", "exact_name") and rows[3] == ("matched", "Rai1.it", "alias", 89.0)
    assert rows[4][0] == "ambiguous" and rows[5][:3] == ("matched", "TeleNorba.it", "similarity") and rows[6][0] == "unmatched"
    assert rows[7][1] == "RaiSportPlus.it"
    s = match.stats(found).first()
    assert (s.matched, s.unmatched, s.ambiguous, s.coverage_percent) == (6, 1, 1, 75.0)


def test_fill(spark):
    channels = spark.createDataFrame([(0, "", "", ""), (1, "a", "kept", "kept"), (2, "z", "", "")], "ord long, tvg_id string, tvg_name string, logo string")
    matched = spark.createDataFrame([(0, "matched", "a"), (1, "matched", "a"), (2, "ambiguous", None)], "ord long, status string, guide_id string")
    shown = spark.createDataFrame([(0, "a", ["Name"], "icon")], "ord long, channel_id string, display_names array<string>, icon_url string")
    got = [tuple(r) for r in match.fill(channels, matched, shown).orderBy("ord").collect()]
    assert got == [(0, "a", "Name", "icon", True), (1, "a", "kept", "kept", False), (2, "z", "", "", False)]


def test_nothing(spark):
    assert run(spark, [("x", "", "")], GUIDE[:0] or [("none", [])])[0][0][0] == "unmatched"


def looked_up(spark, tmp_path, monkeypatch, rows):
    """What match finds for rows, and the number of texts for which each task made keys."""

    @F.pandas_udf(match.KEYS)
    def counted(tvg_id: pd.Series, tvg_name: pd.Series, name: pd.Series) -> pd.Series:
        with open(f"{tmp_path}/{TaskContext.get().taskAttemptId()}", "a") as out:
            out.write("x" * len(name))
        return pd.Series([[{"tier": a, "key": b, "shown": c} for a, b, c in match._playlist_keys(*row)] for row in zip(tvg_id, tvg_name, name)], dtype="object")

    monkeypatch.setattr(match, "playlist_keys", counted)
    return run(spark, rows, GUIDE)[0], sorted(f.stat().st_size for f in tmp_path.iterdir())


def test_a_text_is_looked_up_once(spark, tmp_path, monkeypatch):
    """Rows of equal texts, null or empty, are matched alike, and keys are made for one of them."""
    texts = [("Rai 1", "", ""), ("Rai 3", None, None), ("Rai 3", "", ""), (None, "rai1.IT", None), ("Tele Norba Barì X", "", ""), ("zzzz", "", None), (None, None, None)]
    found, sizes = looked_up(spark, tmp_path, monkeypatch, texts * 40)
    assert sum(sizes) == 6
    assert found == found[:7] * 40 and found[1] == found[2]
    assert [f[0] for f in found[:7]] == ["matched", "ambiguous", "ambiguous", "matched", "matched", "unmatched", "unmatched"]


def test_texts_are_dealt_by_number(spark, tmp_path, monkeypatch):
    """However few files different texts are in, no task has all of them."""
    rows = [(name, f"9{i}qx", "") for i in range(60) for name in ("Rai 1", "Rai 3", "zzzz")]
    monkeypatch.setattr(match, "TEXTS_A_TASK", 10, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64m")
    try:
        found, sizes = looked_up(spark, tmp_path, monkeypatch, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert sum(sizes) == 180 and max(sizes) < 40
    assert [f[:2] for f in found] == [("matched", "Rai1.it"), ("ambiguous", None), ("unmatched", None)] * 60


def test_many_customers_are_not_broadcast(spark):
    """A file says little of its rows: the nations are broadcast, however small the customers' file is."""
    for query in (catalogue.q08, catalogue.q42):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joined = plan[: plan.index("c_custkey#", plan.index("Relation [c_custkey#"))].splitlines()
        assert any("Join Inner" in line and "rightHint=(strategy=broadcast)" in line for line in joined)
