"""Words that polynomial codes modulo a power of two confuse, and codes that are made to collide."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import minhash, passages
from millrace.llm.wordcode import BY_BLANKS, split


def thue_morse(n):
    """Two words of n letters, complements of each other: equal under any polynomial modulo 2**64 from n = 1024 on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_codes_differ(n):
    a, b = thue_morse(n)
    words = split(pa.array([f"{a} {b} {a}"]), BY_BLANKS, False)
    codes = words.codes()
    assert codes[0] != codes[1] and codes[0] == codes[2]
    assert words.ids().tolist() == [0, 1, 0]


def test_such_words_link_and_remove_nothing(spark):
    a, b = thue_morse(2048)
    same = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"{same} {a}"), (4, f"{same} {b}"), (5, a), (6, f"v1 v2 v3 v4 v5 v6 {a}"), (7, f"v1 v2 v3 v4 v5 v6 {b}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    # 3 and 4 share 15 of 17 shingles, 6 and 7 share 2 of 4
    assert got == {1: (1, 1), 2: (1, 2), 3: (16, 3), 4: (16, 3), 5: (1, 1), 6: (3, 6), 7: (3, 7)}
    assert {r["doc_id"]: r["n_removed"] for r in passages.dedup(df).collect()} == dict.fromkeys(range(1, 8), 0)


def test_links_hold_words_against_words(monkeypatch):
    a = " ".join(f"a{i}" for i in range(40))
    pairs = [(a, a.replace("a39", "z")), (a, a.replace("a", "b")), (a, a.replace("a20", "z")), ("a b c d", "a b c d"), (a, "")]
    sides = [pa.array(x) for x in zip(*pairs, strict=True)]
    want = [True, False, False, False, False]  # of 36 shingles each: 35, 0 and 31 shared
    assert minhash.similar(*sides, 85).tolist() == want
    monkeypatch.setattr(minhash, "codes_at", lambda codes, at, n: np.zeros(len(at), np.uint64))  # all codes collide
    assert minhash.similar(*sides, 85).tolist() == want


def test_window_digests_are_those_of_the_words():
    text = "  ".join(f"é{i}" for i in range(25))
    words = split(pa.array([text]), BY_BLANKS, False)
    got = passages.window_digests(words, np.array([0, 5]))
    for i, d in zip((0, 5), got, strict=True):
        plain = "".join(f"é{k} " for k in range(i, i + 20)).encode()
        assert d.tobytes() == hashlib.blake2b(plain, digest_size=16).digest()


def test_rows_of_one_id_are_told_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(1, a, 0), (5, a, 0), (5, b, 0), (5, b, 1)], "doc_id long, text string, address int")
    assert sorted((r["doc_id"], r["text"]) for r in minhash.one_of_each(df).collect()) == [(1, a), (5, b)]
