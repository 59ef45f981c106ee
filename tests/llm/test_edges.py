"""Clashing names, repeated ids, very long texts and ties, for operators whose other tests have none."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lines, mixing, neighbours, pii, quality
from millrace.llm.common import table

SF = "/root/testdata/sf0.001"


def test_repeated_vectors_and_clashing_columns(spark):
    rows = [(0, [0.0, 1.0], 9, 9, "x"), (1, [0.0, 2.0], 9, 9, "x"), (1, [0.0, 3.0], 9, 9, "x"), (2, [0.0, 2.0], 9, 9, "x"), (0, [0.0, 1.0], 9, 9, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, part int, projected string")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") == 0, k=10).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 1, 2.0)]


def test_many_equal_vectors_are_all_found(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=64).tolist()
    df = spark.createDataFrame([(i, v) for i in range(300)] + [(1000 + i, rng.normal(size=64).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") == 7, k=10, part_rows=64).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 0.0) for i in range(11) if i != 7]


def test_parts_are_copied_for_their_own_queries_only(spark):
    df = table(spark, SF, "embeddings").select("vec_id", "embedding")
    few = neighbours.nearest(df, F.col("vec_id") % 20 == 0, part_rows=50, query_rows=3)
    many = neighbours.nearest(df, F.col("vec_id") % 20 == 0, part_rows=50, query_rows=4096)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_very_long_texts_are_counted_and_cut_whole(spark):
    text = "\n".join(f"word {i % 1000} of {i}" for i in range(200_000))
    df = spark.createDataFrame([(1, text, "en", "s", 0), (2, text, "en", "s", 0)], "doc_id long, text string, lang string, source string, tokens int")
    assert [r["tokens"] for r in mixing.weighed(df).collect()] == [800_000, 800_000]
    got = {r["doc_id"]: (r["__lines"], r["__removed"], len(r["text"])) for r in lines.dedup(df).collect()}
    assert got == {1: (200_000, 0, len(text)), 2: (200_000, 200_000, 0)}


def test_equal_texts_have_equal_scores_and_the_threshold_is_kept(spark):
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    long = "the same words again " * 40_000
    df = spark.createDataFrame([(1, long), (2, long), (3, "short"), (3, "short")], "doc_id long, text string")
    got = [(r["doc_id"], r["score"]) for r in quality.score(df, model).collect()]
    assert len({s for i, s in got if i < 3}) == 1 and len({s for i, s in got if i == 3}) == 1
    least = min(s for _, s in got)
    assert quality.kept(df, model, threshold=least).count() == 4 and {r["predicted"] for r in quality.classify(df, model, threshold=least).collect()} == {1}


def test_ties_of_start_are_listed_by_kind(spark):
    df = spark.createDataFrame([(1, "4111111111111111@b.cd"), (2, "x " * 100_000 + "a@b.cd")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"]) for s in r["base"]] for r in pii.find(df, pii.fit(df.limit(0))).collect()}
    assert got == {1: [(0, "email"), (0, "card")], 2: [(200_000, "email")]}
