"""Whitening against numpy on the distinct vectors, and its edges."""

import numpy as np
import pytest

from millrace.llm import queries, whitening
from millrace.llm.common import stored, table
from millrace.llm.whitening import Summary

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x string, part int"


def by_hand(vectors):
    """(distinct x, sums, eigenvalues, unit eigenvectors as rows) by one decomposition of everything."""
    x = np.unique(np.floor(256 * np.asarray(vectors, float)).astype(np.int64), axis=0)
    sums = x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x, sums, values[::-1], vectors[:, ::-1].T


def test_query_equals_numpy(spark):
    rows = table(spark, SF, "embeddings").toPandas()
    x, sums, values, vectors = by_hand(rows["embedding"].tolist())
    got = queries.op11_whitening(spark, SF).toPandas()
    assert len(got) == 4 * len(rows) and set(got["n"]) == {len(x)}
    of = dict(zip(rows["vec_id"], rows["embedding"], strict=True))
    for c, part in got.groupby("component"):
        part = part.sort_values("vec_id")
        mine = np.floor(256 * np.array([of[i] for i in part["vec_id"]], float)).astype(np.int64)
        want = (mine - sums / len(x)) @ vectors[c - 1] / np.sqrt(values[c - 1])
        assert min(abs(part["whitened"] - s * want).max() for s in (1, -1)) < 1e-8
        assert part["explained"].iloc[0] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert part["deviation"].tolist() == [sum(int(d) ** 2 for d in len(x) * v - sums) for v in mine]
    assert 0 <= got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1


def test_merging_keeps_every_dimension():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (400, 12))
    parts = [Summary.of(x[i : i + k]) for i, k in ((0, 1), (1, 4), (5, 95), (100, 300))]
    left = parts[0] + parts[1] + parts[2] + parts[3]
    right = parts[0] + (parts[1] + (parts[2] + parts[3]))
    for s in (left, right):
        product = (s.singular[:, None] * s.vectors).T @ (s.singular[:, None] * s.vectors)
        assert s.n == 400 and (s.sums == x.sum(axis=0)).all() and len(s.singular) == 12
        assert product == pytest.approx(400 * np.cov(x.T, bias=True), rel=1e-10, abs=1e-6)


def test_rounds_of_merges(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    distinct = stored(whitening.integers(df).select("x").repartition(70))  # three rounds
    model = whitening.fit(distinct)
    _, sums, values, _ = by_hand(vectors)
    assert (model.sums == sums).all() and model.eigenvalues == pytest.approx(values, rel=1e-10)
    assert whitening.identity_error(distinct, model, 5) < 1e-10


def test_all_components_can_be_had(spark):
    done, model = whitening.whitened(table(spark, SF, "embeddings"), k=64)
    w = np.array(done.toPandas()["whitened"].tolist())
    assert w.shape[1] == 64 and model.vectors @ model.vectors.T == pytest.approx(np.eye(64), abs=1e-10)


def test_rows_that_are_left_out_and_columns_that_clash(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0, 2.0], "a", 1), (2, None, "a", 1), (3, [nan, 1.0, 1.0], "a", 1), (4, [inf, 1.0, 1.0], "a", 1), (5, [None, 1.0, 1.0], "a", 1), (6, [], "a", 1), (7, [1.0, 1.0], "a", 1), (None, [1.0, 0.0, 0.0], "a", 1), (1, [0.0, 1.0, 2.0], "b", 2), (8, [3.0, 0.0, -1.0], "a", 1)]
    got = whitening.components(spark.createDataFrame(rows, SCHEMA), k=4).toPandas()
    assert sorted(map(str, got["vec_id"])) == sorted(["1.0"] * 6 + ["nan"] * 3 + ["8.0"] * 3)
    assert set(got["n"]) == {3} and set(got["component"]) == {1, 2, 3}
    # three points lie in a plane: the third component has no eigenvalue
    third = got[got["component"] == 3]
    assert third["whitened"].isna().all() and (third["explained"] == 0).all() and got["identity_error"].max() < 1e-9
    once = got[(got["vec_id"] == 1) & (got["component"] == 1)]["whitened"]
    assert once.nunique() == 1 and len(once) == 2


def test_no_rows_one_row_and_equal_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], "a", 1), (2, [1.0, 2.0], "a", 1)], SCHEMA)
    got = whitening.components(one, k=4).toPandas()
    assert len(got) == 4 and got["whitened"].isna().all() and got["identity_error"].isna().all() and set(got["n"]) == {1} and set(got["deviation"]) == {0}
    assert whitening.components(one.limit(0), k=4).count() == 0
    assert whitening.components(one.limit(0), k=4).columns == got.columns.tolist()


def test_a_vector_that_a_third_of_the_rows_share_counts_once(spark):
    rng = np.random.default_rng(4)
    vectors = [*rng.normal(size=(40, 3)).tolist(), *[[9.0, 9.0, 9.0]] * 20]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(vectors)], SCHEMA)
    got = whitening.components(df, k=1).toPandas()
    assert len(got) == 60 and set(got["n"]) == {41}


def test_deviations_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(1, [1e9], "", 0), (2, [0.0], "", 0), (3, [1e5], "", 0)], SCHEMA)
    got = {r["vec_id"]: r["deviation"] for r in whitening.components(df, k=1).collect()}
    sums = int(256 * np.float32(1e9)) + int(256 * np.float32(1e5))
    exact = {1: (3 * int(256 * np.float32(1e9)) - sums) ** 2, 2: sums**2, 3: (3 * int(256 * np.float32(1e5)) - sums) ** 2}
    assert got == {i: (d if d < 2**63 else None) for i, d in exact.items()}
