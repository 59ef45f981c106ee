"""Faults that showed at size only, on small tables that hold what brings them about."""

import datetime as dt

import pytest

from compare import duck, rows
from millrace.plans import catalog, document_queries

SF = "/root/testdata/sf0.001"


def folder(tmp_path, **tables):
    """A folder with these tables and the generated ones for the rest."""
    from compare import TABLES

    for t in TABLES:
        if t in tables:
            tables[t].write.parquet(str(tmp_path / f"{t}.parquet"))
        else:
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    return str(tmp_path)


def sql(d, name):
    """The query's SQL over such a folder; tables that Spark wrote are folders of files."""
    import duckdb
    from pathlib import Path

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in Path(d).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return rows(con.sql(catalog.ORACLES[name]).df())


def test_f4_means_do_not_hang_on_the_order_of_rows_and_null_users_stay(spark, tmp_path):
    made = [(i, dt.datetime(2024, 1, 1 + i % 2, 0, i % 60), user, "view", value, "{}") for i, (user, value) in enumerate([(1, 0.7), (1, 0.7), (1, 0.1), (2, 0.1), (2, 0.7), (2, 0.7), (None, 3.0), (None, 5.0)])]
    d = folder(tmp_path, events=spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1))
    assert rows(catalog.QUERIES["event_conditional_counts"](spark, d).toPandas()) == sql(d, "event_conditional_counts")
    values = [14.04, 3.42, 8.02, 2.63, 129.39]  # their mean is 31.5, and a bit less by sums in some orders
    for turn in range(5):
        own = values[turn:] + values[:turn]
        at = tmp_path / str(turn)
        at.mkdir()
        d = folder(at, events=spark.createDataFrame([(i, dt.datetime(2024, 1, 1), 1, "view", v, "{}") for i, v in enumerate(own)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1))
        assert catalog.QUERIES["event_conditional_counts"](spark, d).first()["mean_view"] == 32.0


def test_f5_events_of_a_document_are_in_order_whatever_the_order_of_rows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    d = folder(tmp_path, events=events.orderBy("value").repartition(5))
    assert rows(catalog.QUERIES["match_ledger"](spark, d).toPandas()) == sql(d, "match_ledger")


def test_f2_more_landmarks_than_a_task_holds(spark):
    from millrace.operators import families

    v = spark.range(6000).selectExpr("id as k", "array(cast(pmod(id * 7919, 6007) as double), cast(pmod(id * 31, 101) as double)) as v")
    marks = v.where("k < 5500").withColumn("p", v["v"])
    by_blocks = {r["k"]: r["p"] for r in families.between(v, marks, "k", "v", "p", k=2).collect()}  # 5 500 landmarks
    at_once = {r["k"]: r["p"] for r in families.between(v, marks, "k", "v", "p", k=2, most=6000).collect()}
    assert set(by_blocks) == set(range(6000)) and all(by_blocks[k] == [pytest.approx(x) for x in p] for k, p in at_once.items())


def test_f7_f9_neighbours_of_rows_in_blocks_and_missing_vectors_last(spark):
    import numpy as np

    from millrace.operators import similarity

    rng = np.random.default_rng(3)
    made = [(i, i % 3, [float(x) for x in np.round(rng.normal(size=5), 1)]) for i in range(700)] + [(700, 1, None), (701, 1, [1.0, None, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(made, "i long, g int, v array<double>").cache()
    w = [1.0, 0.5, 2.0, 1.0, 0.0]
    got = {}
    for r in similarity.nearest(v.where("i % 50 = 0"), v, "i", "v", 4, group="g", weights=w, block_rows=6, blocks=3).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((r["neighbour"], r["distance"]))
    for i in range(0, 700, 50):
        def far(j):
            d = 0.0
            for x, y, f in zip(made[i][2], made[j][2], w, strict=True):
                d += abs(x - y) * f
            return d * (1.0 if made[i][1] == made[j][1] else 1.25)
        assert got[i] == [(j, d) for d, j in sorted((far(j), j) for j in range(700) if j != i)[:4]]
    assert [j for j, _ in got[700]] == [0, 1, 2, 3] and {d for _, d in got[700]} == {None}
    few = similarity.nearest(v.where("i = 0"), v.where("i in (5, 700, 701)"), "i", "v", 3)
    assert [r["neighbour"] for r in few.orderBy("rank").collect()] == [5, 700, 701]


def test_f7_neighbours_of_a_score_are_looked_for_once(spark, monkeypatch):
    from millrace.operators import similarity

    met, plain = spark.sparkContext.accumulator(0), similarity.in_blocks

    def counted(queries, pool, work, schema, blocks, keys):
        def told(q, p):
            met.add(len(q) * len(p))
            return work(q, p)

        return plain(queries, pool, told, schema, blocks, keys)

    monkeypatch.setattr(similarity, "in_blocks", counted)
    assert len(catalog.QUERIES["similarity_scores"](spark, SF).collect()) == 375
    assert met.value == 25 * 500  # every query against every row, not again for the scale


@pytest.mark.parametrize("name", ["similarity_scores", "knn_weighted_l1_top15"])
def test_f7_near_and_exact_copies_missing_labels_and_other_lengths(spark, tmp_path, name):
    """Copies nearer than the sixth digit go by their ids, rows without a label are unlike all, a longer vector spoils no block."""
    import numpy as np

    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 4))
    made = [(i, [float(x) for x in base[i % 6] + (1e-10 * (300 - i) if i // 6 % 2 == 0 else 0.0)], None if i % 7 == 0 else i % 3) for i in range(300)]
    v = spark.createDataFrame([*made, (300, None, 1), (301, [], 2)], "vec_id long, embedding array<double>, label int")
    d = folder(tmp_path, embeddings=v)
    assert rows(catalog.QUERIES[name](spark, d).toPandas()) == sql(d, name)


def test_f7_vectors_of_other_lengths_meet_their_own(spark):
    from millrace.operators import similarity

    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [0.0, 0.0, 2.0])], "i int, v array<double>")
    out = similarity.nearest(v, v, "i", "v", 1, blocks=1).orderBy("query").collect()
    assert [(r["neighbour"], r["distance"]) for r in out] == [(2, 1.0), (1, 1.0), (4, 2.0), (3, 2.0)]


def test_f6_candidates_meet_no_row_one_by_one(spark):
    """A key that many rows and candidates share gives one row a side, not their product."""
    from pyspark.sql import functions as F

    from millrace.operators import merge

    rows_, cands = spark.range(3000).select(F.col("id").alias("s"), (F.col("id") % 2).alias("a"), F.lit(1).alias("b")), spark.range(3000).select(F.col("id").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("b")).unionByName(spark.createDataFrame([(9000, 1, 1)], "c long, a int, b int"))
    got = merge.unique_match(rows_, cands, ["a", "b"], "s", "c")
    assert got.count() == 1500 and {r["c"] for r in got.limit(5).collect()} == {9000}
    agreed = merge.unique_match(rows_.limit(40), cands, "a", "s", "c", agree=F.col("r.b") == F.col("c.b"))
    assert agreed.count() == 20


def test_f8_f10_nearest_lengths_with_ties_copies_and_missing_lengths(spark, tmp_path):
    made = [(i, "t", "en" if i % 2 else "de", "s1", None if i % 17 == 0 else (i * 7) % 40) for i in range(400)] + [(401, "t", "fr", "s9", 5), (420, "t", None, "s9", 5), (440, "t", "fr", "s9", None)]
    d = folder(tmp_path, documents=spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"))
    for name in ("related_articles", "related_articles_all"):
        assert rows(catalog.QUERIES[name](spark, d).toPandas()) == sql(d, name)


def test_f1_f3_sets_of_words_by_classes(spark):
    """Against all pairs; and 60 000 rows of the same words, which by pairs are 180 000 000."""
    import random

    from millrace.plans import further_queries

    draw = random.Random(4)
    names = {i: " ".join(draw.choices("abcdefgh", k=draw.randint(0, 5))) for i in range(300)} | {i: f"x y w{i // 3} w{i // 2} w{i}" for i in range(300, 420)}
    df = spark.createDataFrame(list(names.items()), "p_partkey long, p_name string")
    for asked, given in ((20, 1), (2, 3), (3, 2)):
        want = set()
        for k in (i for i in names if i % asked == 0):
            w = set(names[k].split())
            near = sorted((-len(w & set(n.split())) / len(w | set(n.split())), c) for c, n in names.items() if c % given == 0 and c != k and w & set(n.split()))
            if near and -near[0][0] >= 0.3 and (len(near) == 1 or near[1][0] - near[0][0] > 0.03):
                want.add((k, near[0][1], round(-near[0][0], 6)))
        assert want or asked == 20
        assert {tuple(r) for r in further_queries.best_by_words(df, f"p_partkey % {asked} = 0", f"p_partkey % {given} = 0").collect()} == want
    copies = spark.range(60_000).selectExpr("id as p_partkey", "'large ring brand 7' as p_name")
    assert further_queries.best_by_words(copies, "p_partkey % 20 = 0", "true").count() == 0


def _jobs(spark, run):
    """(what run() gives, number of Spark jobs that it started)"""
    counted = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = counted()
    out = run()
    return out, counted() - before


def test_f11_runs_of_k_means_go_through_the_rows_together(spark):
    from millrace.operators import similarity

    spots = [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]
    df = spark.createDataFrame([(i, [spots[i % 3][0] + i % 7 / 10, spots[i % 3][1] + i % 5 / 10]) for i in range(90)], "i long, v array<double>").repartition(3)
    got, jobs = _jobs(spark, lambda: [r["cluster"] for r in similarity.clustered(df, "i", "v", [2, 3, 4], starts=10, least=6).orderBy("i").collect()])
    assert len({tuple(got[i] for i in range(n, 90, 3)) for n in range(3)}) == 3 and all(len(set(got[n::3])) == 1 for n in range(3))
    assert jobs < 3 * 10 * 12  # starts alone; by runs one after the other each round was a job more


def test_f14_a_round_of_fits_is_one_job(spark):
    import numpy as np
    from millrace.operators import kmeans

    rows = spark.createDataFrame([("A" if i % 2 else "B", [float(i % 11), float(i % 3), 1.0]) for i in range(200)], "family string, v array<double>")
    models = [kmeans.Fit(f, np.array([[float(s), 0.0, 1.0], [9.0 - s, 2.0, 1.0]])) for f in "AB" for s in range(5)]
    told, jobs = _jobs(spark, lambda: kmeans.round_of(rows, models, list(range(10)), 4))
    assert jobs == 1  # sums went through a shuffle before, with a job of its own
    by_tasks = kmeans.round_of(rows, models, list(range(10)))
    for i, m in enumerate(models):
        x = np.array([r["v"] for r in rows.where(f"family = '{m.family}'").collect()])
        d = ((x[:, None] - m.centres[None]) ** 2).sum(axis=2)
        want = np.array([[(d.argmin(1) == k).sum(), d.min(1)[d.argmin(1) == k].sum(), *x[d.argmin(1) == k].sum(0)] for k in range(2)])
        assert np.allclose(told[i], want) and np.allclose(by_tasks[i], want)


def test_f12_no_side_that_grows_with_the_rows_goes_through_the_driver(spark):
    from millrace.operators import identity
    from millrace.plans import identity_queries

    t = identity_queries._tables(spark, SF)
    rows = t["a"].unionByName(t["b"])
    known = identity_queries._evidence(t)
    told = identity.resolve(rows, t["mappings"], t["canonical"], t["register"], known, ["W"])
    for df in (known, told, identity.mappings_after(told, t["mappings"]), identity.canonical_after(told, t["canonical"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_f13_rows_of_a_season_are_made_once_and_their_parts_gathered_by_no_shuffle(spark):
    made = catalog.QUERIES["season_scores"](spark, SF)
    assert made.inputFiles() and not [f for f in made.inputFiles() if "lineitem" in f or "part.parquet" in f]  # each use of them was a pass more
    assert "collect_list" not in made._jdf.queryExecution().toString()
    assert rows(made.toPandas()) == sql(SF, "season_scores")


def test_f13_moments_by_numbers_of_equal_values(spark):
    import numpy as np

    from millrace.operators import distribution

    rng = np.random.default_rng(5)
    groups = {"a": list(np.round(rng.normal(1e6, 2.0, 400), 2)), None: list(np.round(rng.exponential(1.0, 300), 1)), "b": [0.1] * 7, "c": [3.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)], "g string, v double")
    got = {r["g"]: r for r in distribution.winsorized_moments(df, ["g"], "v").collect()}
    assert set(got) == set(groups)  # a group without values has no row
    for g, vs in groups.items():
        low, high = np.quantile(vs, [0.05, 0.95])
        held = np.clip(vs, low, high)
        assert [got[g][c] for c in ("low", "high", "mean", "dev")] == [pytest.approx(x, rel=1e-9, abs=1e-12) for x in (low, high, held.mean(), held.std())]
    assert got["b"]["dev"] == 0.0 and got["c"]["dev"] == 0.0
