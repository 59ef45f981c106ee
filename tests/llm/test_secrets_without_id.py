"""Texts that only rows without doc_id hold are scanned as any other."""

from millrace.llm import secrets


def test_rows_without_id_have_their_findings(spark):
    rows = [(None, "TOKEN=abcdef"), (None, "secret: otherone x"), (None, "TOKEN=abcdef"), (None, None), (None, "token=both_of"), (1, "token=both_of"), (2, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    paths, found, entries = secrets.scan(docs)
    listed = secrets.by_path(paths, found).withColumn("spans", secrets.listing())
    got = sorted((str(r["path"]), r["spans"]) for r in listed.collect())
    assert got == sorted([("None", "assign:0:12"), ("None", "assign:0:16"), ("None", "assign:0:12"), ("None", ""), ("None", "assign:0:13"), ("1", "assign:0:13"), ("2", "")])
    assert found.count() == 5 and entries.count() == 15
    assert secrets.scan(docs, entries)[1].count() == 0


def test_no_pair_is_scanned_twice(spark, tmp_path):
    """Two versions of the texts and of a rule: each run lists new pairs only, and reports stay whole."""
    ledger = f"file://{tmp_path}/ledger"
    old = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, None)], "doc_id long, text string")
    new = spark.createDataFrame([(1, "token=abcdef"), (2, "AKIA" + "A" * 16), (4, "token=abcdef " * 500)], "doc_id long, text string")
    assert secrets.update(old, ledger, secrets.RULES[:2]) == 4
    assert secrets.update(old, ledger, secrets.RULES[:2]) == 0
    assert secrets.update(new, ledger) == 2 * 3 + 1  # two new blobs, and the known one that is left for the added rule
    longer = tuple(secrets.Rule(r.kind, r.version + (r.kind == "assign"), r.pattern, r.group, 7 if r.kind == "assign" else r.least) for r in secrets.RULES)
    assert secrets.update(new, ledger, longer) == 3
    pairs = spark.read.parquet(f"{ledger}/pairs")
    assert pairs.count() == pairs.distinct().count() == 14
    count = lambda rules: {r["path"]: (len(r["assign"]), len(r["access"])) for r in secrets.report(new, ledger, rules).collect()}
    assert count(secrets.RULES) == {1: (1, 0), 2: (0, 1), 4: (500, 0)} and count(longer) == {1: (0, 0), 2: (0, 1), 4: (0, 0)}
    assert "token" not in str(spark.read.parquet(f"{ledger}/findings").collect())
