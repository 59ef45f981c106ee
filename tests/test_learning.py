"""Fits, clusters and projections against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import regression, similarity


def table(spark, x, names):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ", ".join(["i long", *(f"{n} double" for n in names)]))


def test_out_of_fold_predictions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 2)) * [1, 20]
    y = 2 + x @ [1.0, 0.3] + rng.normal(size=120)
    df = table(spark, np.column_stack([x, y]), ["a", "b", "y"])
    got = {r["i"]: r["predicted"] for r in regression.out_of_fold(df, ["a", "b"], "y", fold=F.col("i") % 4, alpha=3.0).collect()}
    want = np.zeros(120)
    for f in range(4):
        inside = np.arange(120) % 4 == f
        u, v = x[~inside], y[~inside]
        m, s = u.mean(0), u.std(0)
        z = (u - m) / s
        w = np.linalg.solve(z.T @ z + 3.0 * np.eye(2), z.T @ (v - v.mean()))
        want[inside] = v.mean() + (x[inside] - m) / s @ w
    assert [got[i] for i in range(120)] == pytest.approx(want.tolist())
    q = regression.fit_quality(regression.out_of_fold(df, ["a", "b"], "y", fold=F.col("i") % 4, alpha=3.0), "y").first()
    assert (q["mae"], q["rmse"], q["r2"]) == (pytest.approx(np.abs(y - want).mean()), pytest.approx(np.sqrt(((y - want) ** 2).mean())), pytest.approx(1 - ((y - want) ** 2).sum() / ((y - y.mean()) ** 2).sum()))


def test_checks_before_a_fit(spark):
    x = np.random.default_rng(7).normal(size=(40, 1))
    df = table(spark, np.column_stack([x, x * 2 + 1e-3, x[::-1]]), ["a", "b", "y"]).withColumn("b", F.when(F.col("i") > 3, F.col("b")))
    known = {"a", "b", "y"}
    r = regression.fit_checks(df, ["a", "b"], "y", known).first()
    assert (r["rows"], r["usable"], r["dropped"], r["warnings"]) == (40, 36, 4, ["few_rows", "close:a|b"])
    for bad in (["a", "a"], ["y"], ["c"], []):
        with pytest.raises(ValueError):
            regression.fit_checks(df, bad, "y", known)
    with pytest.raises(ValueError):
        regression.fit_checks(df.limit(20), ["a"], "y", known)


def test_projection_equals_numpy(spark):
    x = np.random.default_rng(8).normal(size=(60, 4)) @ np.diag([5.0, 2.0, 1.0, 0.1])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, v array<double>")
    got = np.array([r["point"] for r in similarity.projected(df, "i", "v", 3).orderBy("i").collect()])
    c = x - x.mean(0)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    want = c @ axes[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8) and np.allclose(got @ got.T, want @ want.T, atol=1e-8)


def test_clusters_and_their_least_size(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(20, 2)) * 0.1 + c for c in ((0, 0), (9, 0), (0, 9))])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, v array<double>")
    got = [r["cluster"] for r in similarity.clustered(df, "i", "v", [2, 3, 4], starts=3).orderBy("i").collect()]
    assert len(set(got)) == 3 and all(len(set(got[a : a + 20])) == 1 for a in (0, 20, 40))
    assert {r["cluster"] for r in similarity.clustered(df, "i", "v", [3], starts=1, least=30).collect()} == {0}
    assert {r["cluster"] for r in similarity.clustered(df, "i", "v", []).collect()} == {0}
