"""Whole-table queries where the table is larger than the id subsets of their older forms."""

import pytest

from compare import duck, rows
from millrace.plans import catalog, further_queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["similarity_explanation_all", "fuzzy_match_all", "related_articles_all"])
def test_equals_sql_over_the_whole_table(spark, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck(SF).sql(catalog.ORACLES[name]).df())


def test_no_part_or_query_is_left_out(spark):
    parts = {r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert {r["p_partkey"] for r in catalog.QUERIES["similarity_explanation_all"](spark, SF).collect()} == parts - {1}
    asked = {r["doc_id"] for r in catalog.QUERIES["related_articles_all"](spark, SF).collect()}
    assert any(i % 100 for i in asked) and all(i % 20 == 0 for i in asked)


def test_best_match_and_ties_over_every_other_part(spark, tmp_path):
    """The generated names are tied throughout, so these are made up; brute force over all pairs."""
    names = {20: "red green blue", 21: "red green", 35: "red green blue black", 40: "gold silver", 41: "gold", 52: "silver", 60: "lone", 80: "one two three", 83: "one two three", 91: "one two"}
    spark.createDataFrame(list(names.items()), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    want = set()
    for k in (i for i in names if i % 20 == 0):
        w = set(names[k].split())
        near = sorted((-len(w & set(n.split())) / len(w | set(n.split())), c) for c, n in names.items() if c != k and w & set(n.split()))
        if near and -near[0][0] >= 0.3 and (len(near) == 1 or near[1][0] - near[0][0] > 0.03):
            want.add((k, near[0][1]))
    assert want == {(20, 35), (80, 83)}
    got = catalog.QUERIES["fuzzy_match_all"](spark, str(tmp_path))
    assert {(r["k"], r["c"]) for r in got.collect()} == want
    tenth = further_queries.best_by_words(spark.read.parquet(str(tmp_path / "part.parquet")), "p_partkey % 10 = 0", "p_partkey % 10 = 1")
    assert {(r["k"], r["c"]) for r in tenth.collect()} == {(20, 21), (40, 41), (80, 91)}
