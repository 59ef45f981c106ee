"""Nulls in groups, infinities and NaN, and ranks that no longer sort a group in one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import distribution, merge, ranking

INF, NAN = math.inf, math.nan


def test_infinities_and_nan_have_places(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, NAN, 1e9, INF, -INF, None, NAN, -5.0])], "i int, v double").withColumn("g", F.lit("a"))
    codes = [r["c"] for r in df.where("v is not null").orderBy("v").select(ranking.magnitude(F.col("v")).alias("c")).collect()]
    assert codes == sorted(codes) and len(set(codes)) == 6
    # in order: -inf, -5, 1, 1e9, inf, NaN twice
    got = {r["i"]: (r["p"], r["r"]) for r in ranking.competition_rank(ranking.midrank_percentile(df, ["g"], "v", "p"), ["g"], "v", "r").collect()}
    place = {4: 0, 7: 1, 0: 2, 2: 3, 3: 4}
    for i, k in place.items():
        assert got[i] == (pytest.approx((k + 0.5) / 7 * 100), 7 - k)
    assert got[1] == got[6] == (pytest.approx(6 / 7 * 100), 1) and got[5] == (None, None)
    q = ranking.quantiles(df.where("not isnan(v)"), ["g"], "v", {"low": 0.0, "mid": 0.5, "top": 1.0}).first()
    assert (q["low"], q["mid"], q["top"]) == (-INF, 1.0, INF)


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 7.0), (3, None, 7.0), (4, "a", 1.0), (5, None, None)], "i int, g string, v double")
    rank = {r["i"]: r["r"] for r in ranking.competition_rank(df, ["g"], "v", "r").collect()}
    assert rank == {1: 3, 2: 1, 3: 1, 4: 1, 5: None}
    z = {r["i"]: r["z"] for r in distribution.winsorized_zscore(df, ["g"], "v", "z").collect()}
    assert z[1] < 0 < z[2] == z[3] and z[4] == 0.0 and z[5] is None
    probes = spark.createDataFrame([(None, 6.0), ("b", 6.0)], "g string, v double")
    assert {r["g"]: r["p"] for r in ranking.external_percentile(probes, df, ["g"], "v", "p").collect()} == {None: pytest.approx(100 / 3), "b": None}
    assert {r["g"]: (r["n"], r["p50"]) for r in distribution.summary(df, ["g"], "v").collect()} == {None: (3, 7.0), "a": (1, 1.0)}
    bins = distribution.histogram(df, ["g"], "v").groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {r["g"]: r["n"] for r in bins} == {None: 3, "a": 1}
    scaled = {r["i"]: r["s"] for r in distribution.robust_scaled(df, ["g"], "v", "s").collect()}
    assert scaled[5] == 0.0 and scaled[1] == -2.0
    heat = {r["i"]: r["h"] for r in distribution.min_max_heat(df, ["g"], "v", "h").collect()}
    assert heat == {1: 0.0, 2: 100.0, 3: 100.0, 4: 50.0, 5: None}
    zero = {r["i"]: r["o"] for r in distribution.zero_where_recorded(df, ["g"], "v", "o").collect()}
    assert zero[5] == 0.0


def chained(values, tolerance):
    places, before, place = {}, None, 0
    for n, v in enumerate(sorted(values, reverse=True), 1):
        if before is None or abs(v - before) > tolerance * max(1.0, abs(v), abs(before)):
            place = n
        places[v], before = place, v
    return places


@pytest.mark.parametrize("tolerance", [1e-9, 0.01, 0.2])
def test_tolerant_ranks_follow_chains_through_buckets(spark, tolerance):
    random.seed(4)
    values = [random.choice([1, 10, 1000]) * (1 + random.random()) * random.choice([-1, 1, 1]) for _ in range(400)] + [10.0, 9.95, 9.9, 5.0, 0.0, 0.0]
    df = spark.createDataFrame([(i, "x" if i % 2 else None, float(v)) for i, v in enumerate(values)], "i int, g string, v double")
    want = [chained(values[k::2], tolerance) for k in (0, 1)]
    got = ranking.tolerant_rank(df, ["g"], "v", "r", tolerance).collect()
    assert [r["i"] for r in got if r["r"] != want[r["i"] % 2][r["v"]]] == []


def test_ordinal_ranks_and_extremes(spark):
    df = spark.createDataFrame([(i, None if i < 6 else "b", float(i // 2)) for i in range(9)], "i int, g string, v double")
    got = {r["i"]: r["r"] for r in ranking.ordinal_rank(df, ["g"], "v", [F.col("i")], "r").collect()}
    assert got == {4: 1, 5: 2, 2: 3, 3: 4, 0: 5, 1: 6, 8: 1, 6: 2, 7: 3}
    sides = {r["i"]: r["side"] for r in ranking.best_and_worst(df, ["g"], "v", "i").collect()}
    assert sides == {4: "best", 5: "best", 1: "worst", 0: "worst", 8: "best", 6: "best", 7: "worst"}


def test_rows_without_a_shared_id_stay(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, None)], "i int, s int")
    assert {r["i"]: r["s"] for r in merge.sole_owner(df, "s", [F.desc("i")]).collect()} == {1: None, 2: 5, 3: None, 4: None}


def test_values_close_together_are_parted(spark, monkeypatch):
    """Times of one year lie in one bucket, which is parted; ranks stay exact, with outliers, ties and infinities too."""
    rng = random.Random(9)
    values = [1_700_000_000.0 + rng.randint(0, 3000) for _ in range(900)] + [INF, -INF, NAN, 1.0, 1_700_000_000.5] + [1_650_000_000.0 + i for i in range(40)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("g", F.col("i") % 2)
    before = {(r["g"], r["v"] if r["v"] == r["v"] else "nan"): (r["n"], r["below"], r["total"]) for r in ranking.cumulative_counts(df, ["g"], "v").collect()}
    monkeypatch.setattr(ranking, "BUCKET_VALUES", 16)
    parted = ranking.cumulative_counts(df, ["g"], "v")
    assert {(r["g"], r["v"] if r["v"] == r["v"] else "nan"): (r["n"], r["below"], r["total"]) for r in parted.collect()} == before
    for g in (0, 1):
        mine = sorted((v for i, v in enumerate(values) if i % 2 == g), key=lambda v: (v != v, v))
        assert all(before[g, v][1] == mine.index(v) for v in mine if v == v)
