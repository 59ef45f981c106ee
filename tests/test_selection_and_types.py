"""Selections, name likeness, rollovers and types where the made-up queries have no such rows."""

import datetime as dt
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from millrace.functions import event_classes, text
from millrace.operators import archetypes, rollover, selection


def test_names_step_by_step(spark):
    pairs = [("Ann Lee", "ann  lee", 1.0), ("Robert", "Roberto Carlos", 0.9), ("Lee Ann", "Ann Lee", 0.98), ("Bo Li", "Bo Xu Li", 0.92), ("Bo Xu Li", "Li Bo", 0.9), ("Bo", "Bo Li", 0.82), ("Jo Ann Li", "Jo Bea Li", 0.95), ("", "x", 0.0), (None, "x", 0.0), ("R & D", "r and d", 1.0), ("gundogan", "guendogan", None), ("abc", "xyz", 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in df.orderBy("i").select(text.name_score(F.col("a"), F.col("b")).alias("s")).collect()]
    for (a, b, want), s in zip(pairs, got, strict=True):
        assert s == pytest.approx(SequenceMatcher(None, a, b).ratio() if want is None else want), (a, b)
    first = df.where("i in (5, 6)").orderBy("i").select(text.name_score(F.col("a"), F.col("b"), allow_first_name=True).alias("s")).collect()
    assert [r["s"] for r in first] == [0.0, 0.95]
    one = spark.createDataFrame([("Jo Ann", "Jo Bea")], "a string, b string").select(text.name_score(F.col("a"), F.col("b"), allow_first_name=True).alias("s")).first()
    assert one["s"] == 0.72


def test_matches_by_last_few_days_and_limit(spark):
    at = lambda day: dt.datetime(2024, 1, day, 12)
    m = spark.createDataFrame([(1, "Completed ", at(3)), (2, "completed", at(1)), (3, "scheduled", at(2)), (4, "completed", None), (5, "completed", at(3))], "match_id int, status string, kickoff timestamp")
    ids = lambda **k: [r["match_id"] for r in selection.completed_matches(m, **k).collect()]
    assert ids() == [4, 2, 1, 5] and ids(last=2) == [1, 5] and ids(limit=2) == [4, 2] and ids(match_id=5) == [5]
    assert ids(first_day=dt.date(2024, 1, 1), last_day=dt.date(2024, 1, 2)) == [2]
    assert ids(first_day=dt.date(2024, 1, 1), last_day=dt.date(2024, 1, 3), limit=2) == [2, 1]


def test_scopes_and_their_errors(spark):
    rows = [("ENG1", "2024-25", True, True, "domestic_league", True, 500), ("NED1", "2024-25", True, True, "domestic_league", True, 400), ("GER1", "2024-25", True, False, "domestic_league", True, 1), ("UCL", "2024-25", True, True, "continental_cup", False, 2), ("ITA1", "2024-25", True, True, "domestic_league", True, 600), ("ITA1", "2024", True, True, "domestic_league", True, 600)]
    s = spark.createDataFrame(rows, "code string, season string, is_active boolean, is_published boolean, competition_type string, in_aggregates boolean, least_minutes int")
    codes = lambda *a: sorted(r["code"] for r in selection.scope(s, *a).collect())
    assert codes("all", ["2024-25"]) == ["ENG1", "ITA1", "NED1"] and codes("BIG5", ["2024-25"]) == ["ENG1", "ITA1"] and codes(" eng1", ["2024-25", "2024"]) == ["ENG1"]
    for bad in (("ITA1", ["2024-25", "2024"]), ("GER1", ["2024-25"]), ("", ["2024"]), ("ENG1", [])):
        with pytest.raises(ValueError):
            selection.scope(s, *bad)
    assert selection.least_minutes(selection.scope(s, "ALL", ["2024-25"])).first()[0] == 400
    assert selection.least_minutes(s.limit(0)).first()[0] == 450


def test_pins_labels_and_relevance(spark):
    p = spark.createDataFrame([(i, float(i), i % 10 == 0) for i in range(25)], "k int, v double, pinned boolean")
    assert selection.labelled(p.where("k < 20")).count() == 20 and selection.labelled(p).count() == 3
    pins = spark.createDataFrame([(3,), (99,)], "k int")
    got = lambda asked: sorted((r["k"], r["how"]) for r in selection.pins_in_effect(p, asked, "k", [F.desc("v")]).collect())
    assert got(pins) == [(3, "asked")] and got(pins.where("k = 99")) == [(22, "automatic"), (23, "automatic"), (24, "automatic")]
    order = selection.by_relevance(p, "k", [7, 2, 7]).orderBy(F.col("place").asc_nulls_last(), "k").limit(3).collect()
    assert [r["k"] for r in order] == [7, 2, 0]


def test_scatter_places_leave_out_missing_axes(spark):
    p = spark.createDataFrame([(1, 1.0, 5.0, None), (2, 5.0, 1.0, 1), (3, None, 1.0, 9), (4, 3.0, 3.0, None), (5, 3.0, 3.0, 2)], "k int, x double, y double, t int")
    got = selection.scatter_places(p, "k", "x", "y", "t").orderBy("place").collect()
    assert [(r["k"], r["rank_sum"]) for r in got] == [(5, 4), (4, 4), (2, 5), (1, 5)]


def test_weights_add_up_and_flags_have_their_share():
    w = archetypes.feature_weights({"a": "creation", "b": "creation", "c": "carrying", "d": "nowhere"}, flags=["a"])
    assert sum(w.values()) == pytest.approx(1) and w["a"] == w["b"] == pytest.approx(4 * w["a__missing"]) and "d" not in w
    assert w["c"] / w["a"] == pytest.approx(0.12 / 0.10)
    assert archetypes.cluster_sizes(20, "FWD") == [] and archetypes.cluster_sizes(40, "MID") == [3] and archetypes.cluster_sizes(100, "MID") == [3, 4, 5, 6]


def test_profiles_of_features(spark):
    make = lambda good: spark.createDataFrame([(f"m{i}", 0.9 if i < good else 0.1) for i in range(12)], "metric string, covered double")
    full, broad = ["m0", "m1"], [f"m{i}" for i in range(12)]
    assert [archetypes.profile(make(n), need, broad).first()["profile"] for n, need in ((12, full), (9, ["m11"]), (7, ["m11"]))] == ["full", "broad", "none"]


def test_rows_lie_between_their_landmarks(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "k int, v array<double>")
    marks = rows.where("k in (0, 4)").withColumn("p", F.array(F.col("v")[0] * 10, F.lit(1.0)))
    got = {r["k"]: r["p"] for r in archetypes.interpolated(rows, marks, "k", "v", "p", k=2).collect()}
    assert got[0] == [0.0, 1.0] and got[4] == [40.0, 1.0] and got[2] == pytest.approx([20.0, 1.0]) and got[1] == pytest.approx([40 * (1 / 3) / (1 + 1 / 3), 1.0])
    a, b = (sorted(r["k"] for r in archetypes.landmarks(rows.repartition(n), "k", 3).collect()) for n in (1, 3))
    assert a == b and len(a) == 3


def test_confidence_by_spread(spark):
    rows = [(i, "g", "a", float(d), float(d + 2), {"a": float(d), "b": float(d + 2)}) for i, d in enumerate((1, 2, 3))]
    m = spark.createDataFrame(rows, "i int, g string, primary string, d_primary double, d_secondary double, all_d map<string,double>")
    got = {r["i"]: r["confidence"] for r in archetypes.confidence(m, ["g"]).collect()}
    assert got == {i: pytest.approx(1 - d / (d + 2 + 2)) for i, d in enumerate((1, 2, 3))}


def test_explanations_by_group(spark):
    rows = [("p", f"m{i}", g, d, w) for i, (g, d, w) in enumerate([("x", 1.0, 0.2), ("x", 3.0, 0.2), ("y", 0.5, 0.3), ("z", 9.0, 0.1), ("u", 4.0, 0.2)])]
    df = spark.createDataFrame(rows, "k string, metric string, group string, delta double, weight double")
    r = archetypes.explanation(df, ["k"], top=2).first()
    assert r["shared"] == ["y", "x", "u"] and r["different"] == ["z", "u"] and r["features"] == ["m3", "m4"]


def test_ready_only_without_findings(spark):
    slices = spark.createDataFrame([("a",), ("b",)], "slice string")
    found = spark.createDataFrame([("a", "provider_name_change")], "slice string, code string")
    assert {r["slice"]: r["ready"] for r in rollover.ready(slices, found).collect()} == {"a": False, "b": True}


def test_kinds_of_odd_names(spark):
    df = spark.createDataFrame([("Goal", ["Blocked"], 1, None), ("SavedShot", ["Blocked"], None, "Unsuccessful"), (None, None, None, None), ("Aerial", ["Defensive", "Head"], 0, "Successful")], "n string, q array<string>, v int, o string")
    n, q = F.col("n"), F.col("q")
    got = df.select(event_classes.kind(n), event_classes.shot_outcome(n, q), event_classes.success(F.col("v"), F.col("o")), event_classes.body_part(q), event_classes.flags(q)["defensive"]).collect()
    assert [tuple(r) for r in got] == [("shot", "goal", True, "unknown", False), ("shot", "blocked", False, "unknown", False), ("unknown", "unknown", None, "unknown", False), ("aerial", "unknown", True, "head", True)]
