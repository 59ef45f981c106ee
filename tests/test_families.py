"""Types by family against plain k-means rules, silhouettes by all pairs, and places between landmarks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import families
from millrace.operators.steps import stored

SCHEMA = "key long, family string, v array<double>"


def blobs(rng, family, centres, n, first):
    x = np.concatenate([rng.normal(c, 0.3, size=(n, len(c))) for c in centres])
    return [(first + i, family, v.tolist()) for i, v in enumerate(x)]


def table(spark):
    rng = np.random.default_rng(1)
    rows = blobs(rng, "DEF", [(0, 0), (9, 0), (0, 9)], 20, 0) + blobs(rng, "MID", [(0, 0), (9, 0), (0, 9), (9, 9)], 15, 1000) + blobs(rng, "FWD", [(0, 0)], 10, 2000)
    return rows, stored(spark.createDataFrame(rows, SCHEMA))


def silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_families_get_the_types_they_were_made_of(spark):
    rows, df = table(spark)
    found = families.chosen(df)
    assert {f: None if m is None else len(m.centres) for f, m in found.items()} == {"DEF": 3, "MID": 4, "FWD": None}
    for f in ("DEF", "MID"):
        x = np.array([v for _, g, v in rows if g == f])
        label = ((x[:, None] - found[f].centres[None]) ** 2).sum(2).argmin(1)
        assert found[f].cost == pytest.approx(((x - found[f].centres[label]) ** 2).sum()) and found[f].sizes.tolist() == np.bincount(label).tolist()
        assert np.allclose(found[f].centres, [x[label == c].mean(axis=0) for c in range(len(found[f].centres))])
        assert families.silhouettes(df, [found[f]], {"DEF": 60, "MID": 60, "FWD": 10})[0] == pytest.approx(silhouette(x, label), abs=1e-6)


def test_the_best_of_the_starts_counts(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    df = stored(spark.createDataFrame([(i, "DEF", v.tolist()) for i, v in enumerate(x)], SCHEMA))
    costs = [families.fits(df, {"DEF": [4]}, {"DEF": 150}, starts=n)[0].cost for n in (1, 10)]
    assert costs[1] <= costs[0] + 1e-9
    m = families.fits(df, {"DEF": [4]}, {"DEF": 150}, starts=10)[0]
    label = ((x[:, None] - m.centres[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(m.centres, [x[label == c].mean(axis=0) for c in range(4)], atol=1e-4)  # a fixed point


def test_members_and_representatives(spark):
    rows, df = table(spark)
    centres = {"DEF": np.array([[0.0, 0.0], [9.0, 0.0]])}
    told = {r["key"]: r for r in families.members(df, centres).collect()}
    x = {k: np.array(v) for k, f, v in rows if f == "DEF"}
    for k, v in x.items():
        d = np.sqrt(((centres["DEF"] - v) ** 2).sum(1))
        assert told[k]["primary"] == str(d.argmin()) and told[k]["d_secondary"] == pytest.approx(d.max()) and told[k]["all_d"]["0"] == pytest.approx(d[0])
    assert told[2000]["primary"] == told[2000]["secondary"] == "0"
    reps = families.representatives(families.members(df, centres)).where("family = 'DEF' and primary = '1'").orderBy("rank").collect()
    own = sorted((np.sqrt(((centres["DEF"][1] - v) ** 2).sum()), k) for k, v in x.items() if told[k]["primary"] == "1")
    assert [r["key"] for r in reps] == [k for _, k in own[:5]]


def test_weights_of_positions_and_their_roots(spark):
    groups = {"a": "attacking_threat", "b": "creation", "c": "creation"}
    w = families.type_weights("FWD", groups, {"a__missing": 0.4}, flags=["a__missing"])
    assert w == pytest.approx({"a": 0.30 / 0.56, "b": 0.13 / 0.56, "c": 0.13 / 0.56, "a__missing": 0.1})
    df = spark.createDataFrame([(1, "DEF", [1.0, 2.0]), (2, "GK", [1.0, 2.0])], SCHEMA)
    assert [r["v"] for r in families.rooted(df, "family", "v", {"DEF": [4.0, 0.25]}).orderBy("key").collect()] == [[2.0, 1.0], None]


def test_many_rows_go_by_landmarks_and_few_do_not(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 6)))], "k long, v array<double>")
    assert families.projection(df, "k", "v", full_rows=90)[1] == "all"
    placed, how = families.projection(df, "k", "v", full_rows=50, landmarks=20)
    again, _ = families.projection(df, "k", "v", full_rows=50, landmarks=20)
    got = {r["k"]: r["point"] for r in placed.collect()}
    assert how == "landmarks" and len(got) == 90 and {len(p) for p in got.values()} == {3}
    assert got == {r["k"]: r["point"] for r in again.collect()}
    with pytest.raises(ValueError):
        families.between(df, df.withColumn("point", F.col("v")), "k", "v", "point", most=10)


def test_no_rows(spark):
    empty = stored(spark.createDataFrame([], SCHEMA))
    assert families.chosen(empty) == {} and families.members(empty, {}).count() == 0
