"""Near duplicates, passages and lines against brute force over whole small tables."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from millrace.llm import components, decontaminate, lines, minhash, passages
from millrace.llm.common import table
from millrace.llm.wordcode import ALNUM, BY_BLANKS, split

SF = "/root/testdata/sf0.001"
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i}" for i in range(60))
#: nulls, empty and wordless texts, ties, repeated rows and doc_ids, a very long text
ODD = [(90001, None), (90002, ""), (90003, " \n\t"), (90004, "a b"), (90005, "A  b"), (90006, LONG), (90007, LONG), (90007, LONG), (90008, "x " + LONG + " y"), (90009, "aa " * 90), (90010, "é É ß " * 10), (None, LONG), (None, None), (90011, "q " * 30_000), (90012, LONG.replace("w30", "z"))]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in ODD], "doc_id long, text string, lang string, source string, node string")
    real = table(spark, SF, "documents").selectExpr("doc_id", "text", "lang", "source", "'x' as node")
    return real.unionByName(odd)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_words_equal_regex():
    texts = ["Ab c\td", "", None, "é,É x-y_z", "a\x0bb\x1cc\xa0d\x7fe", "\x85 z", "edge"]
    for rule, pattern in ((BY_BLANKS, BLANKS), (ALNUM, ALNUMS)):
        words = split(pa.array(texts, pa.string()), rule, True)
        got = [[words.word(i).decode() for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        assert got == [pattern.findall((t or "").translate(FOLD)) for t in texts]
    sliced = split(pa.array(["skip me", None, "a b"], pa.string()).slice(1), BY_BLANKS, False)
    assert [sliced.word(i) for i in range(len(sliced.start))] == [b"a", b"b"]


def shingles(text):
    w = BLANKS.findall((text or "").translate(FOLD))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows, percent):
    reps = defaultdict(list)
    for i, t in rows:
        if i is not None and shingles(t):
            reps[shingles(t)].append(i)
    sets, parent = list(reps), list(range(len(reps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds, both = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            both.update((j, k) for j in holds[g])
            holds[g].append(k)
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, s in enumerate(sets):
        least[root(k)] += reps[s]
    number = {s: k for k, s in enumerate(sets)}
    return ordered((i, len(shingles(t)), None if i is None else min(least[root(number[shingles(t)])]) if shingles(t) else i) for i, t in rows)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, rows, percent):
    got = minhash.near_duplicates(docs, percent=percent)
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, percent)


def test_star_of_near_copies_needs_the_exact_rest(spark):
    """Copies with several edits each: most are similar to the original only or to a few others."""
    base = [f"t{i}" for i in range(150)]
    made = []
    for i in range(160):
        words = list(base)
        for k in range(i % 5):
            words[(i * 37 + k * 31) % 150] = f"e{i % 23}_{k}"
        made.append((i, " ".join(words)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()) == brute_components(made, 85)


def test_one_of_each_keeps_one_row(spark, docs):
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 90006 in ids and 90007 not in ids and 90001 in ids
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_passages(docs, rows):
    first: dict = {}
    for i, t in rows:
        w = BLANKS.findall(t or "")
        for a in range(len(w) - 19 if i is not None else 0):
            key = tuple(w[a : a + 20])
            first[key] = min(first.get(key, (i, a)), (i, a))
    want = []
    for i, t in rows:
        w = BLANKS.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19 if i is not None else 0):
            if first[tuple(w[a : a + 20])] != (i, a):
                gone[a : a + 20] = [True] * 20
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert ordered(tuple(r) for r in passages.dedup(docs).collect()) == ordered(want)


def test_cover_brings_any_two_places_together():
    p, cover = passages.PERIOD, set(passages.COVER)
    assert passages.ANCHOR + p - 1 == passages.WINDOW
    assert all(any((i + s) % p in cover and (j + s) % p in cover for s in range(p)) for i in range(p) for j in range(p))


def test_passages_of_nothing(spark, docs):
    assert passages.dedup(docs.limit(0)).count() == 0
    assert lines.dedup(docs.limit(0)).count() == 0


def brute_windows(items):
    found = defaultdict(set)
    for i, t in items:
        w = ALNUMS.findall((t or "").translate(FOLD))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            found[tuple(w[a : a + k])] |= {str(i)} if i is not None else set()
    return found


@pytest.mark.parametrize("slice_bytes", [8 << 20, 2000])
def test_decontamination(spark, docs, rows, slice_bytes):
    extra = spark.createDataFrame([(9001, "the and"), (9002, "ea"), (9003, ""), (9004, None), (9001, "nd the of"), (None, "ab b"), (9005, "AA aa, aa aa aa aa aa aa aa aa aa")], "item_id long, text string")
    items = table(spark, SF, "benchmark").select("item_id", "text").union(extra)
    patterns = brute_windows([tuple(r) for r in items.collect()])
    lengths = sorted({len(p) for p in patterns})
    want = []
    for i, t in rows:
        w = ALNUMS.findall((t or "").translate(FOLD))
        hit, named = [False] * len(w), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in patterns:
                    hit[a : a + k] = [True] * k
                    named |= patterns[tuple(w[a : a + k])]
        want.append((i, len(w), sum(hit), ",".join(sorted(named))))
    got = decontaminate.search(docs, items, slice_bytes=slice_bytes)
    assert ordered((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in got.collect()) == ordered(want)
    clean = decontaminate.clean(docs, items, slice_bytes=slice_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(w[2] == 0 for w in want)


def test_decontamination_of_and_by_nothing(spark, docs):
    none = table(spark, SF, "benchmark").limit(0)
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.search(docs.limit(0), table(spark, SF, "benchmark")).count() == 0


def test_lines(docs, rows):
    """Chunk bounds come from the operator itself; what is repeated, and how far around, is decided here by bytes."""
    cut, first = {}, {}
    for k, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        if t is None:
            cut[k] = i, None, []
            continue
        start, end, _ = lines.chunk_spans(lines.line_spans(pa.array([t], pa.string())))
        own = t.encode().split(b"\n")
        cut[k] = i, own, list(zip(start.tolist(), end.tolist(), strict=True))
        for n, (a, b) in enumerate(cut[k][2]):
            if i is not None and b - a >= lines.LEAST_LINES:
                first.setdefault(tuple(own[a:b]), (k, n))
    want = []
    for k, (i, own, spans) in cut.items():
        if own is None:
            want.append((i, None, 0))
            continue
        gone = [n for n, (a, b) in enumerate(spans) if i is not None and b - a >= lines.LEAST_LINES and first[tuple(own[a:b])] != (k, n)]
        drop = set()
        for n in gone:
            a, b = spans[n]
            drop |= set(range(a, b))
            other, m = first[tuple(own[a:b])]
            _, theirs, their_spans = cut[other]
            if n and m and n - 1 not in gone:
                x, y = own[spans[n - 1][0] : a][::-1], theirs[their_spans[m - 1][0] : their_spans[m][0]][::-1]
                drop |= set(range(a - sum(all(u == v for u, v in zip(x[: j + 1], y[: j + 1], strict=True)) for j in range(min(len(x), len(y)))), a))
            if n + 1 < len(spans) and m + 1 < len(their_spans) and n + 1 not in gone:
                x, y = own[b : spans[n + 1][1]], theirs[their_spans[m][1] : their_spans[m + 1][1]]
                drop |= set(range(b, b + sum(all(u == v for u, v in zip(x[: j + 1], y[: j + 1], strict=True)) for j in range(min(len(x), len(y))))))
        want.append((i, b"\n".join(w for j, w in enumerate(own) if j not in drop).decode(), len(drop)))
    got = lines.dedup(docs)
    assert got.columns == [*docs.columns, "__lines", "__chunks", "__removed"]
    assert ordered((r["doc_id"], r["text"], r["__removed"]) for r in got.collect()) == ordered(want)


def test_chunk_bounds_move_with_their_lines():
    body = "\n".join(f"line {i * i}" for i in range(60))
    cut = lambda t: {t.split("\n")[a] for a in lines.chunk_spans(lines.line_spans(pa.array([t])))[0]}
    assert len(cut("one\ntwo\nthree\n" + body) & cut(body)) >= len(cut(body)) - 2
