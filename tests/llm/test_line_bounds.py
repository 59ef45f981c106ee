"""Chunk bounds of the line operator: no short chunks, whole copies go, most repeated runs go."""

import random

import pyarrow as pa
import xxhash

from millrace.llm import lines


def chunks(text):
    start, end, _ = lines.chunk_spans(lines.line_spans(pa.array([text], pa.string())))
    own = text.split("\n")
    return ["\n".join(own[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def texts(n, seed, least=1):
    rng = random.Random(seed)
    return ["\n".join(f"line {rng.random()}" for _ in range(rng.randint(least, 40))) for _ in range(n)]


def test_bounds_are_the_same_for_all_texts_at_once():
    made = texts(200, 1) + ["", "one", "one\ntwo", "a\n\nb\n\nc", "same\n" * 9]
    for t in made:
        assert "\n".join(chunks(t)) == t
    start, _, _ = lines.chunk_spans(lines.line_spans(pa.array(made, pa.string())))
    assert len(start) == sum(len(chunks(t)) for t in made)


def test_nothing_of_a_whole_copy_stays(spark):
    made = texts(40, 2, least=2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made + made)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()}
    assert got == dict(enumerate(made)) | {i + 40: "" for i in range(40)}


def recall(spark, length, n=60):
    """The share of a run's repeats that goes when it stands between other lines in n documents."""
    rng = random.Random(length)
    run = [f"run {rng.random()}" for _ in range(length)]
    put = lambda: [f"x{rng.random()}" for _ in range(rng.randint(1, 9))]
    made = ["\n".join(put() + run + put()) for _ in range(n)]
    got = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert all(x in run for i, t in enumerate(made) for x in set(t.split("\n")) - set(got[i]["text"].split("\n")))  # other lines stay
    assert all(x in got[0]["text"] for x in run)
    return sum(r["__removed"] for r in got.values()) / (length * (n - 1))


def test_runs_between_other_lines_go(spark):
    """Runs of ten lines and more go whole as good as always, also their ends; short ones as often as a pair stands in them wherever they are."""
    assert recall(spark, 10) > 0.95 and recall(spark, 25) > 0.97 and recall(spark, 6) > 0.6


M64 = (1 << 64) - 1


def mixed(x):
    """The splitmix finaliser on whole numbers."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def line_code(line):
    return xxhash.xxh3_64_intdigest(line.encode())


def bounds_by_rule(text):
    """Ends of chunks as the module's text says, line by line."""
    own = text.split("\n")
    n, base = len(own), int(lines.BASE)
    code = [line_code(x) for x in own]
    rolled = [mixed((code[i] * base + code[i + 1]) & M64) for i in range(n - 1)]
    at = lambda i: rolled[i] if 0 <= i < n - 1 else 1 << 64
    cuts = {n}
    for i in range(n - 1):
        if at(i) < at(i - 1) and at(i) <= at(i + 1):
            cuts |= {i, i + 2} - {0}
    out, before = [], 0
    for cut in sorted(cuts):
        while cut - before > lines.MOST_LINES:
            before += lines.MOST_LINES
            out.append(before)
        out.append(cut)
        before = cut
    return out


def test_bounds_follow_the_rule_line_by_line():
    rng = random.Random(9)
    made = [*texts(60, 5), "", "x", "same\n" * 300, "\n" * 130, "\n".join(rng.choice("abcdé") * rng.randint(0, 90) for _ in range(400)), "long " * 40 + "\nb\nc"]
    start, end, code = lines.chunk_spans(lines.line_spans(pa.array(made, pa.string())))
    want, at = [], 0
    for t in made:
        want += [at + e for e in bounds_by_rule(t)]
        at += t.count("\n") + 1
    assert end.tolist() == want and start.tolist() == [0, *want[:-1]]
    every = "\n".join(made).split("\n")
    held: dict = {}
    for a, b, c in zip(start.tolist(), end.tolist(), code.tolist(), strict=True):
        assert held.setdefault(c, tuple(every[a:b])) == tuple(every[a:b])
    assert len(held) == len(set(held.values()))
    assert max(end - start) <= lines.MOST_LINES
