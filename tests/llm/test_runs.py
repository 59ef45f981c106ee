"""Periodic runs against brute force over all periods, their seeds and edges."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries, runs
from millrace.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs int, kept int, start string"


def brute(words):
    """(start, length, period) of all runs, period by period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def mine(words):
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
    at = {b: p.tolist() for b, p in runs.recurring(ids, np.array([0, len(words)])).items()}
    return runs.runs(ids, at)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=18), st.integers(1, 40)), max_size=6))
def test_equals_brute_force(stretches):
    words = [w for unit, n in stretches for w in (unit * n)[:n]]
    assert mine(words) == brute(words)


def test_long_texts_of_few_words_equal_brute_force():
    rng = random.Random(5)
    for alphabet in ("a", "ab", "abcdefghij"):
        words = []
        while len(words) < 700:
            unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 90))]
            words += (unit * 9)[: rng.randint(1, len(unit) * 6)]
        assert mine(words) == brute(words)


def test_every_period_has_one_block_size_that_surely_meets_it():
    """A stretch of max(q, 12 - q) equal pairs holds an aligned block of its size."""
    seen = [q for b in (2, 4, 8, 16, 32, 64) for q in range(runs.periods(b)[0], runs.periods(b)[1] + 1)]
    assert seen == list(range(1, 255))
    for b in (2, 4, 8, 16, 32, 64):
        assert all(max(q, 12 - q) >= 2 * b - 1 for q in range(runs.periods(b)[0], runs.periods(b)[1] + 1))


def test_seeds_are_all_occurrences_at_fitting_distances():
    rng = random.Random(6)
    words = np.array([rng.randint(0, 2) for _ in range(400)] * 2, np.int64)
    names, size = words, 1
    for block in (2, 4, 8, 16, 32):
        while runs.KEY * size < block:
            names, size = runs.doubled(names, size), 2 * size
        least, most = runs.periods(block)
        starts = list(range(0, len(words) - block + 1, block))
        want = sorted((d, s) for s in starts for d in range(least, most + 1) if s + d + block <= len(words) and (words[s : s + block] == words[s + d : s + d + block]).all())
        assert sorted(runs.seeds(names, size, block, starts)) == want


def test_query_equals_brute_force(spark):
    want = {}
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        words = (r["text"] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute(words) if n < 4000 else mine(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        want[r["doc_id"]] = (
            len(found),
            *(best or (None, None, None)),
            1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        )
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert got == want and sum(bool(v[0]) for v in want.values()) > 10


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    again = "a b c " * 8
    rows = [(1, None, 1, 1, "x"), (2, "", 1, 1, "x"), (3, " \t\n ", 1, 1, "x"), (None, again, 1, 1, "x"), (4, again, 1, 1, "x"), (4, again, 1, 1, "x"), (5, "a " * 11, 1, 1, "x"), (6, "é é " * 12, 1, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = runs.find(df)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept"]) for r in found.collect()), key=repr)
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 24, [(0, 24, 3)], "a b c"), (4, 24, [(0, 24, 3)], "a b c"), (4, 24, [(0, 24, 3)], "a b c"), (5, 11, [], " ".join("a" * 11)), (6, 12, [(0, 12, 1)], "é é")], key=repr)
    told = {(r["doc_id"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in runs.described(found).collect()}
    assert told == {(1, None, None, None, None), (2, None, None, None, None), (3, None, None, None, None), (None, 0, 24, 3, 8000), (4, 0, 24, 3, 8000), (5, None, None, None, None), (6, 0, 12, 1, 12000)}
    assert runs.described(runs.find(df.limit(0))).count() == 0
    assert queries.with_planted_runs(df).count() == len(rows)


def test_of_equally_long_runs_the_first_is_the_greatest(spark):
    text = "a " * 12 + "x y " + "b c " * 6
    r = runs.described(runs.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"]) == (2, 0, 12, 1)


def test_very_long_texts_of_one_word(spark):
    df = spark.createDataFrame([(1, "x " * 300_000), (2, " ".join(str(i % 100_000) for i in range(300_000)))], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.find(df).collect()}
    assert got == {1: [(0, 300_000, 1)], 2: [(0, 300_000, 100_000)]}
