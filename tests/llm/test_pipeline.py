"""The pipeline's stages, each against brute force on what its predecessor kept, and on rows that have everything wrong."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import quality, queries
from millrace.llm.common import table
from test_pairs_and_passages import ALNUMS, BLANKS, FOLD, brute_components, brute_windows
from test_scores_and_spans import rake_by_hand, sort

SF = "/root/testdata/sf0.001"


def ids_of(df):
    return sorted(r["doc_id"] for r in df.collect())


def near_kept(rows):
    """Rows whose doc_id is the smallest of those linked at 0.80."""
    return sorted({i for i, _, component in brute_components(rows, 80) if i is not None and i == component})


def unleaked(rows, items):
    patterns = brute_windows(items)
    lengths = sorted({len(p) for p in patterns})
    words = {i: ALNUMS.findall((t or "").translate(FOLD)) for i, t in rows}
    return sorted(i for i, w in words.items() if not any(tuple(w[a : a + k]) in patterns for k in lengths for a in range(len(w) - k + 1)))


def drawn(rows):
    """(doc_id, text, source, lang) rows that the mixing stage draws, by hand."""
    form = lambda t: "table" if " | " in t else "figures" if re.search("[0-9]", t) else "calls" if "!" in t else "prose"
    f = pd.DataFrame([(i, s or "(none)", g or "(none)", form(t or ""), float(len(BLANKS.findall(t or "")))) for i, t, s, g in rows], columns=["doc_id", "source", "lang", "topic", "tokens"])
    cells = f.groupby(["source", "lang", "topic"], as_index=False)["tokens"].sum()
    goals = {m: (lambda by: (by**0.7 / (by**0.7).sum() * by.sum()).to_dict())(cells.groupby(m)["tokens"].sum()) for m in ("source", "lang", "topic")}
    cells["p"] = np.minimum(1.0, rake_by_hand(cells, goals, 12))
    f = f.merge(cells[["source", "lang", "topic", "p"]], on=["source", "lang", "topic"])
    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return sorted(i for i, p in zip(f["doc_id"], f["p"], strict=True) if draw(i) < p)


def encoded(rows):
    tokenizer, at, out = Tokenizer.from_file(queries.TOKENIZER), 0, []
    for i, t in sorted(rows):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, queries.END_ID], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_stages_and_run_by_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    good = corpus_pipeline.good(spark, docs, SF).cache()
    assert ids_of(good) == sorted(i for i, s in scores.items() if s >= 0.7)
    distinct = corpus_pipeline.distinct(spark, good, SF).cache()
    assert ids_of(distinct) == near_kept([(r["doc_id"], r["text"]) for r in good.collect()])
    clean = corpus_pipeline.unleaked(spark, distinct, SF).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert ids_of(clean) == unleaked([(r["doc_id"], r["text"]) for r in distinct.collect()], items)
    mixed = corpus_pipeline.mix(spark, clean, SF).cache()
    assert ids_of(mixed) == drawn([(r["doc_id"], r["text"], r["source"], r["lang"]) for r in clean.collect()])
    for stage in (good, distinct, clean, mixed):
        assert stage.columns == docs.columns
    want = encoded([(r["doc_id"], r["text"]) for r in mixed.collect()])
    assert sort(tuple(r) for r in corpus_pipeline.tokens(spark, mixed, SF).collect()) == sort(want)
    assert sort(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sort(want)


LONG = " ".join(f"w{i}" for i in range(40))
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, LONG, "en", None), (4, LONG + " x", None, "s"), (5, LONG, "en", "s"), (5, LONG, "en", "s"), (None, LONG, "en", "s"), (None, None, None, None), (6, "q " * 100_000, "en", "s"), (7, "\n", "fr", "t")]


def folder(spark, tmp_path, docs):
    """A folder of tables with these documents, and the labels and benchmark of the small ones."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0 if name == "labels" else 10**6).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_rows_with_everything_wrong(spark, tmp_path):
    """Without labels all rows stay in the first stage; copies, rows without doc_id and repeated rows go in the second."""
    clash = "doc_id long, text string, lang string, source string, __k0 string, score double, n_chars int"
    d = folder(spark, tmp_path, spark.createDataFrame([(*r, "clash", 0.5, 9) for r in ODD], clash))
    docs = table(spark, d, "documents")
    good = corpus_pipeline.good(spark, docs, d)
    assert good.columns == docs.columns and good.count() == len(ODD)
    distinct = corpus_pipeline.distinct(spark, good, d)
    assert distinct.columns == docs.columns and ids_of(distinct) == [1, 2, 3, 6, 7]
    clean = corpus_pipeline.unleaked(spark, distinct, d)
    assert clean.columns == docs.columns and ids_of(clean) == [1, 2, 3, 6, 7]
    mixed = corpus_pipeline.mix(spark, clean, d)
    assert mixed.columns == docs.columns and set(ids_of(mixed)) <= {1, 2, 3, 6, 7}
    texts = {i: t for i, t, *_ in ODD}
    assert sort(tuple(r) for r in corpus_pipeline.run(spark, d).collect()) == sort(encoded([(i, texts[i]) for i in ids_of(mixed)]))


def test_no_rows_at_all(spark, tmp_path):
    d = folder(spark, tmp_path, table(spark, SF, "documents").limit(0))
    assert corpus_pipeline.run(spark, d).count() == 0


@pytest.mark.parametrize("name", ["STAGES", "ORACLE_SQL", "run"])
def test_contract(name):
    assert hasattr(corpus_pipeline, name) and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
