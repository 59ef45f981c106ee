"""Edges that the driver tables do not have: nulls, ties, empty groups, zero exposure."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import rates, seasons, text
from millrace.operators import cohort, distribution, merge, quality, ranking, regression, similarity, spatial
from millrace.sources import files, match_events
from millrace.streaming import events as streams


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_rates_do_not_raise_on_zero_or_null(spark):
    df = spark.createDataFrame([(10.0, 90.0), (10.0, 0.0), (None, 90.0), (10.0, None), (10.0, -1.0)], "t double, m double")
    assert [r[0] for r in df.select(rates.per_unit(F.col("t"), F.col("m"))).collect()] == [10.0, None, None, None, None]
    assert [r[0] for r in df.select(rates.ratio(F.col("t"), F.col("m"))).collect()][:2] == [10 / 90, None]
    assert [r[0] for r in df.select(rates.share_of_known(F.lit(0), F.lit(0), F.col("m"))).collect()] == [0.0, None, 0.0, None, None]


def test_missing_counts_are_zero_only_where_recorded(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None)], "s string, n int")
    assert values(df.withColumn("c", rates.count_or_null(F.col("n"), ["s"])), "s", "c") == [("a", 0), ("a", 1), ("b", None)]


def test_roundings_and_ordinals(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "v double")
    assert [r[0] for r in df.select(rates.half_up(F.col("v"))).collect()] == [3, 4, -2]
    assert [r[0] for r in df.select(rates.rescale(F.col("v"), F.lit(90), "rate", whole=True)).collect()] == [2.0, 4.0, -2.0]
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 11, 12, 13, 21, 111, 122)], "n int")
    assert [r[0] for r in n.select(rates.ordinal(F.col("n"))).collect()] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th", "122nd"]


def brute_midrank(vs):
    known = [v for v in vs if v is not None]
    return [None if v is None else (sum(x < v for x in known) + sum(x <= v for x in known)) / 2 / len(known) * 100 for v in vs]


@pytest.mark.parametrize("vs", [[1.0, 1.0, 2.0, None, 0.0, -3.5, 1e300, -1e-300, 0.1, 0.1], [None, None], [5.0], [7.0] * 6])
def test_midrank(spark, vs):
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(vs)], "i int, g string, v double")
    out = ranking.midrank_percentile(df, ["g"], "v", "p").orderBy("i").collect()
    assert [r["p"] for r in out] == pytest.approx(brute_midrank(vs))


def test_magnitude_never_falls(spark):
    rng = np.random.default_rng(1)
    vs = sorted({0.0, -0.0, *rng.normal(size=2000), *(rng.normal(size=500) * 1e12), *(2.0**k for k in range(-30, 60)), *(-(2.0**k) for k in range(-30, 60)), *(math.nextafter(2.0**k, 0) for k in range(-30, 60))})
    codes = [r[0] for r in spark.createDataFrame([(float(v),) for v in vs], "v double").coalesce(1).select(ranking.magnitude(F.col("v"))).collect()]
    assert codes == sorted(codes)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100):
        v = np.round(rng.normal(size=n), 1)
        df = spark.createDataFrame([(0, float(x)) for x in v], "g int, v double")
        got = ranking.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.97}).first()
        assert [got["a"], got["b"], got["c"]] == pytest.approx(list(np.quantile(v, [0.05, 0.5, 0.97])))
    assert ranking.quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0


def test_external_percentile_of_a_stranger(spark):
    pop = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 2.0, 5.0)], "g string, v double")
    probes = spark.createDataFrame([("x", 2.0), ("x", 9.0), ("x", 0.0), ("y", 1.0)], "g string, v double")
    assert values(ranking.external_percentile(probes, pop, ["g"], "v", "p"), "v", "p") == [(0.0, 0.0), (1.0, None), (2.0, 50.0), (9.0, 100.0)]


def test_zscore_of_constant_values_is_zero(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", None)], "g string, v double")
    assert values(distribution.winsorized_zscore(df, ["g"], "v", "z"), "v", "z") == [(3.0, 0.0), (3.0, 0.0), (None, None)]


def test_histogram_of_one_value_and_empty(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0)], "g string, v double")
    assert values(distribution.histogram(df, ["g"], "v"), "bin", "n") == [(0, 2)]
    assert distribution.histogram(df.limit(0), ["g"], "v").count() == 0


def test_robust_scale_falls_back(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 9.0), (6, None)], "i int, v double").withColumn("g", F.lit(0))
    out = {r["i"]: r["s"] for r in distribution.robust_scaled(df, ["g"], "v", "s").collect()}
    assert out[6] == 0.0 and out[5] == pytest.approx(8 / np.std([1, 1, 1, 1, 9]))


def test_tolerant_ranks_chain(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 9.95), (3, 9.9), (4, 5.0)], "i int, v double").withColumn("g", F.lit(0))
    exact = ranking.competition_rank(df, ["g"], "v", "r")
    assert values(exact, "i", "r") == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_pages_guards_and_orders(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "i int, v int")
    assert [r["i"] for r in cohort.ordered(df, "-v", ["i"], {"v"}).collect()] == [3, 2, 1]
    assert [r["i"] for r in cohort.ordered(df, "v", ["i"], {"v"}).collect()] == [2, 3, 1]
    with pytest.raises(ValueError):
        cohort.ordered(df, "w", [], {"v"})
    assert cohort.guarded(df, ["a", "b", "a"], {"a", "b"})[1] == ["a", "b"]
    with pytest.raises(ValueError):
        cohort.guarded(df, ["a"], {"a"}, most_rows=2)
    assert cohort.page(df, 0, 9999).count() == 3


def test_versions_and_upserts(spark):
    old = spark.createDataFrame([(1, "a", True, None), (2, "b", True, None), (1, "z", False, None)], "k int, v string, is_current boolean, superseded_at timestamp")
    new = spark.createDataFrame([(1, "c"), (3, "d")], "k int, v string")
    out = merge.supersede(old, new, ["k"], F.lit("2020-01-01").cast("timestamp"))
    assert values(out.where("is_current"), "k", "v") == [(1, "c"), (2, "b"), (3, "d")]
    assert out.where("superseded_at is not null").count() == 1
    assert values(merge.upsert(old.select("k", "v"), new, ["k"]), "k", "v") == [(1, "c"), (2, "b"), (3, "d")]
    assert values(merge.changed(old.where("is_current"), new, ["k"], ["v"]), "k", "change") == [(1, "changed"), (2, "removed"), (3, "added")]


def test_full_merge_prefers_and_keeps_both_sides(spark):
    a = spark.createDataFrame([(1, "a1", 5), (1, "a2", 6), (2, "a3", None)], "k int, name string, m int")
    b = spark.createDataFrame([(2, "b1", 9), (3, "b2", 9)], "k int, name string, m int")
    out = merge.full_merge(a, b, ["k"], [F.desc("m")], [F.desc("m")], {"name": "b"})
    assert values(out, "k", "name", "m", "authority") == [(1, "a2", 6, "a"), (2, "b1", 9, "a"), (3, "b2", 9, "b")]


def test_unique_match_rejects_two(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "i int, a string")
    c = spark.createDataFrame([(10, "x"), (20, "y"), (21, "y")], "c int, a string")
    assert values(merge.unique_match(rows, c, "a", "i", "c"), "i", "c") == [(1, 10)]


def test_grid_edges_and_encoding(spark):
    df = spark.createDataFrame([(0, 0), (10000, 10000), (9999, 0), (None, 1)], "x int, y int")
    assert [r[0] for r in df.select(spatial.cell(F.col("x"), F.col("y"), 12, 8)).collect()] == [0, 95, 88, None]
    e = spark.createDataFrame([(99.995,), (100.0,), (100.1,), (-0.1,), (None,), (50.005,)], "v double")
    assert [r[0] for r in e.select(spatial.encode(F.col("v"))).collect()] == [10000, 10000, None, None, None, 5001]
    grid = spatial.dense_grid(df.withColumn("k", F.lit(1)), ["k"], "x", "y")
    assert grid.count() == 96 and grid.agg(F.sum("n")).first()[0] == 3


def test_seasons(spark):
    df = spark.createDataFrame([("2025",), ("2025-26",), ("1999",), ("1999-00",), ("x",)], "l string")
    assert [r[0] for r in df.select(seasons.aggregate_label(F.col("l"))).collect()] == ["2025-26", "2025-26", "1999-00", "1999-00", None]
    assert [r[0] for r in df.select(seasons.sort_order(F.col("l"))).collect()] == [2025, 2026, 1999, 2000, None]


def test_names(spark):
    df = spark.createDataFrame([("J&ouml;rg  Müller-Lüdenscheidt",), ("Łódź ÅØ",), (None,)], "n string")
    assert [r[0] for r in df.select(text.canonical_name(F.col("n"))).collect()] == ["jorg muller ludenscheidt", "odz a", None]
    assert [r[0] for r in df.select(text.fold(F.col("n"))).collect()][1] == "lodz ao"
    pairs = spark.createDataFrame([("Ann Lee", "ann lee"), ("Lee Ann", "Ann Lee"), ("Ann B Lee", "Ann C Lee"), ("Ann", "Ann Lee"), ("Xu", "Yi"), (None, "a")], "a string, b string")
    assert [r[0] for r in pairs.select(text.name_likeness(F.col("a"), F.col("b"))).collect()][:4] == [1.0, 0.98, 0.95, 0.9]
    g = spark.createDataFrame([("D C",), ("gk",), ("odd",)], "p string")
    assert [r[0] for r in g.select(text.position_group(F.col("p"), [("GK", ["GK"]), ("DEF", ["D"])])).collect()] == ["DEF", "GK", "UNK"]


def test_gates(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "k string, v int")
    out = quality.gate(df, ["k"], {"n": F.count("*"), "share": F.avg(F.col("v").isNotNull().cast("int"))}, {"rows": F.col("n") >= 2, "share": F.col("share") >= 0.9})
    assert values(out, "k", "failed") == [("a", ["share"]), ("b", ["rows"])]
    level = spark.createDataFrame([(1, 100), (2, 100), (5, 100), (6, 100)], "p int, w int")
    assert [r[0] for r in level.select(quality.share_level(F.col("p"), F.col("w"))).collect()] == ["ok", "warn", "warn", "fail"]


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [1, 10]
    y = 3 + x @ [2.0, -0.5] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, y double")
    fit = regression.ridge(df, ["a", "b"], "y", key=F.col("i"), alphas=np.array([1.0]))
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert [fit["coefficients"]["a"], fit["coefficients"]["b"]] == pytest.approx(list(w))
    with pytest.raises(ValueError):
        regression.ridge(df.limit(10), ["a"], "y", key=F.col("i"))


def test_nearest_ties_and_groups(spark):
    v = spark.createDataFrame([(1, "a", [0.0]), (2, "a", [1.0]), (3, "a", [-1.0]), (4, "b", [1.0])], "i int, g string, v array<double>")
    out = similarity.nearest(v.where("i = 1"), v, "i", "v", 3, group="g", blocks=3)
    assert [r["neighbour"] for r in out.orderBy("rank").collect()] == [2, 3, 4]


def test_register_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,type,x_id,y_id\n1,player,7,\n2,team,8,9\n3,player,—,nan\n,player,1,1\n5,player,,\n")
    o = spark.createDataFrame([("5", "55")], "id string, x_id string")
    got = files.read_register(spark, str(tmp_path / "p.csv"), "player", "id", ["x_id", "y_id"], o)
    assert values(got, "id", "x_id") == [("1", "7"), ("5", "55")]


def test_pages_merge_last_value_first_name(spark):
    p = spark.createDataFrame([(1, 1, "Ann", {"g": 1.0}), (1, 2, "Bob", {"g": 2.0, "h": 3.0})], "k int, page int, name string, stats map<string,double>")
    r = files.merged_pages(p, ["k"], "page", ["name"], ["stats"]).first()
    assert r["name"] == "Ann" and r["stats"] == {"g": 2.0, "h": 3.0}


def test_slices_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, s string")
    files.write_slices(df, path, "s")
    files.write_slices(spark.createDataFrame([(9, "b")], "v int, s string"), path, "s")
    assert values(spark.read.parquet(path), "v", "s") == [(1, "a"), (9, "b")]


def test_match_documents(spark, tmp_path):
    event = lambda i, minute, x, q: {"id": i, "eventId": i, "minute": minute, "second": 0, "teamId": 1, "playerId": None, "x": x, "y": 50.0, "period": {"value": 1, "displayName": "First"}, "type": {"value": 1, "displayName": "Pass"}, "outcomeType": {"value": 1, "displayName": "Successful"}, "qualifiers": [{"type": {"value": 2, "displayName": n}} for n in q]}
    (tmp_path / "m.json").write_text(json.dumps({"matchId": 5, "events": [event(2, 9, 101.0, []), event(1, 3, 33.335, ["Cross"])]}))
    got = match_events.typed_events(files.read_documents(spark, str(tmp_path / "m.json"), match_events.MATCH), {"is_cross": "Cross"})
    assert values(got, "event_index", "x", "is_cross", "success") == [(0, 3334, True, True), (1, None, False, True)]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = streams.event_stream(spark, str(tmp_path / "in"), src.schema, files_a_batch=1)
    streams.run_once(stream, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "cp"))
    assert sum(c for _, c in seen) == src.count()
    q = streams.windowed_counts(streams.event_stream(spark, str(tmp_path / "in"), src.schema), "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert values(spark.table("counts"), "window_start", "event_type", "n") == values(streams.windowed_counts(src, "ts", ["event_type"]), "window_start", "event_type", "n")
