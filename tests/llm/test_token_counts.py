"""Token counts of prefixes against the tokenizer itself, prefix by prefix."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import queries, token_counts
from millrace.llm.common import table

SF = "/root/testdata/sf0.001"
FILE = queries.BYTE_TOKENIZER
SCHEMA = "doc_id long, text string, counts int, n_tokens string"
PARTS = ["a", "b", "'", "'re", "'ll", "'ve", "'s", " ", "  ", "\n", "\t", "<|endoftext|>", "<|", "é", "日本", "12", "!", "the", "ing", " ", "　", "😀", "\x1c", "́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(FILE)


def by_library(library, text):
    return [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20).map("".join))
def test_every_prefix_of_odd_texts(library, counter, text):
    flat, bounds = counter.block([text])
    assert flat.tolist() == by_library(library, text) and bounds.tolist() == [0, len(text) + 1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_every_prefix_of_any_text(library, counter, text):
    assert counter.block([text])[0].tolist() == by_library(library, text)


def test_walks_agree(counter):
    """Pieces together, level by level, and each by itself, byte by byte."""
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice(["a", "the", "on", "x", "é", "ing", "ß"]) for _ in range(rng.randint(1, 12))).encode() for _ in range(500)})
    raws = [np.frombuffer(p, np.uint8) for p in pieces]
    together = counter.merges.counts(np.concatenate(raws), np.array([len(p) for p in pieces]))
    assert together.tolist() == [n for raw in raws for n in counter.merges.walk(raw).tolist()]


def test_a_full_table_of_pairs_and_forgotten_chunks_change_nothing(library):
    small = token_counts.Counter(FILE)
    small.merges.met = token_counts.Lookup(4)
    texts = ["some words, they're here", "some other words", "wörter und wörter"]
    flat, bounds = small.block(texts)
    small.forget()
    again, _ = small.block(texts)
    assert flat.tolist() == again.tolist() == [n for t in texts for n in by_library(library, t)] and bounds[-1] == len(flat)


def test_query_equals_the_library(spark, library):
    docs = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    n_ids = [len(e.ids) for e in library.encode_batch(docs["text"].fillna("").tolist(), add_special_tokens=False)]
    want = {i: (len((t or "").encode()), n, n > 512) for i, t, n in zip(docs["doc_id"], docs["text"], n_ids, strict=True)}
    got = queries.op13_token_counts(spark, SF).toPandas()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got.itertuples()} == want
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    cut = got[got["over_limit"]].head(12)
    for r in cut.itertuples():  # the longest prefix within the budget, by the library
        near = [i for i in range(r.fits_chars, min(r.fits_chars + 200, len(text[r.doc_id])) + 1) if len(library.encode(text[r.doc_id][:i], add_special_tokens=False).ids) <= queries.BUDGET]
        assert near == [r.fits_chars]
    assert (got[~got["over_limit"]]["fits_chars"] == got[~got["over_limit"]]["doc_id"].map(lambda i: len(text[i] or ""))).all()


def test_stored_counts_of_all_prefixes(spark, library):
    docs = table(spark, SF, "documents").where("n_chars < 800").limit(25)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    path = token_counts.write_counts(docs, FILE)
    for r in token_counts.read_counts(spark, path).collect():
        assert r["counts"] == by_library(library, text[r["doc_id"]])


def test_nulls_repeats_places_and_clashing_columns(spark):
    rows = [(1, None, 3, "x"), (2, "", 3, "x"), (None, "a b", 3, "x"), (3, "a b", 3, "x"), (3, "a b", 3, "x"), (4, "x<|endoftext|>", 3, "x")]
    counts = token_counts.prefix_counts(spark.createDataFrame(rows, SCHEMA), FILE)
    got = sorted((tuple(r) for r in token_counts.answers(counts, 1).collect()), key=repr)
    assert got == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (None, 3, 2, 1), (3, 3, 2, 1), (3, 3, 2, 1), (4, 14, 2, 1)], key=repr)
    at = counts.where("doc_id = 3").limit(1).selectExpr("*", "explode(array(0, 2, 3, 4)) as place")
    assert [r["tokens"] for r in token_counts.tokens_before(at, "place").orderBy("place").collect()] == [0, 2, 2, None]
    assert token_counts.answers(counts.limit(0), 1).count() == 0


def test_very_long_texts(spark, library):
    texts = ["word " * 200_000, "x" * 30_000, "é" * 20_000, " " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.answers(token_counts.prefix_counts(df, FILE), 512).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(queries.TOKENIZER)
