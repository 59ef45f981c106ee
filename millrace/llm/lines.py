"""Removal of repeated runs of lines, found as content-defined chunks.

A text's lines get hashes, and a rolling hash goes over two lines at a time.  Two lines
whose rolling hash is smaller than that of their neighbours on either side - the pairs one
line before and one line on - are a chunk, and what lies between such pairs is another.
So a bound hangs on four lines and moves with them when something is put in or taken out
elsewhere; pairs never overlap, and a run of repeated lines has the same pairs wherever it
stands, but for those at its two ends.  A stretch without pairs is parted after every
`MOST_LINES` lines.  Chunks of at least two lines whose hash occurs more than once in the
corpus are candidates.  The bytes of every candidate are compared with those of its first
occurrence (smallest doc_id, then place) and, if equal, it is removed; the first one stays.

The lines around it are compared as well: of the chunk before, the last lines that are those
before the first occurrence, and of the chunk behind, the first lines that are those behind
it, go too.  So the ends of a run, which lie in chunks with other lines, go with it.

Texts meet their marks in merge joins whatever the size of either, so the plan is
the same for a small corpus as for a large one.  Hash groups are reduced to their first occurrence by partial sums before any
shuffle; the candidates then meet that one row, in joins that split hot keys.

Defined results: texts and lines of any length are taken whole; a null text stays null and has no lines; an empty text has one
empty line; rows without doc_id stay as they are; rows of one doc_id stand at
the same place, so they never remove each other's chunks; chunks of equal hash
and different bytes are kept (with the lines around them); an empty table gives an empty result; further
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, meet, prepare, stored, tidied
from .wordcode import BASE, Words, scramble

LEAST_LINES = 2
MOST_LINES = 64
BLOCK_BYTES = 1 << 20


def line_spans(texts: pa.Array) -> Words:
    """The lines of each text (split at newlines) as spans of its bytes; a null has none."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    edge = offsets - lo
    newline = np.flatnonzero(data == 10)
    there = ~np.asarray(raw.is_null())
    count = (np.searchsorted(newline, edge[1:]) - np.searchsorted(newline, edge[:-1]) + 1) * there
    starts = np.sort(np.concatenate([edge[:-1][there], newline + 1]), kind="stable")
    ends = np.sort(np.concatenate([newline, edge[1:][there]]), kind="stable")
    return Words(data, starts, ends, np.concatenate([[0], np.cumsum(count)]))


def line_codes(lines: Words) -> np.ndarray:
    """A 64-bit hash of each line's bytes; bytes are compared before anything goes."""
    view = memoryview(np.ascontiguousarray(lines.data))
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(lines.start.tolist(), lines.end.tolist(), strict=True)], np.uint64)


def chunk_spans(lines: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, end line, hash) of all chunks; they never cross texts."""
    n = len(lines.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = line_codes(lines)
    place = np.arange(n) - np.repeat(lines.first[:-1], lines.count)
    left = np.repeat(lines.count, lines.count) - 1 - place
    # the rolling hash of a line and the next one; none at the last line of a text
    rolled = np.full(n + 2, np.iinfo(np.uint64).max)
    rolled[1:n] = scramble(codes[:-1] * BASE + codes[1:])
    rolled[1:-1][left == 0] = rolled[0]
    here = rolled[1:-1]
    pair = np.flatnonzero((left > 0) & (here < rolled[:-2]) & (here <= rolled[2:]))
    last = np.zeros(n, bool)
    last[lines.first[1:][lines.count > 0] - 1] = True
    last[pair + 1] = True
    last[pair[place[pair] > 0] - 1] = True
    end = np.flatnonzero(last) + 1
    start = np.concatenate([[0], end[:-1]])
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        if b - a > MOST_LINES:
            last[a + MOST_LINES - 1 : b - 1 : MOST_LINES] = True
    end = np.flatnonzero(last) + 1
    start = np.concatenate([[0], end[:-1]])
    # a line's part in its chunk's code hangs on its place there
    at = np.arange(n) - np.repeat(start, end - start)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(codes + scramble(at.astype(np.uint64) * BASE + BASE)))])
    return start, end, scramble(total[end] - total[start] + (end - start).astype(np.uint64))


def _texts_with(given: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow over blocks of rows with their lines and chunks."""
    prepare(given.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES, "__text"):
            lines = line_spans(batch.column("__text"))
            start, end, code = chunk_spans(lines)
            text = np.searchsorted(lines.first, start, "right") - 1
            nth = np.arange(len(start)) - np.searchsorted(text, text)
            yield work(batch, lines, start, end, code.view(np.int64), text, nth)

    return given.mapInArrow(tidied(run), schema)


def chunks(docs: DataFrame) -> DataFrame:
    """(code, doc_id, nth, n_lines) of all chunks of at least LEAST_LINES lines."""

    def work(batch, lines, start, end, code, text, nth):
        many = np.flatnonzero(end - start >= LEAST_LINES)
        return pa.RecordBatch.from_arrays([pa.array(code[many]), batch.column("__id").take(pa.array(text[many])), pa.array(nth[many].astype(np.int32)), pa.array((end - start)[many].astype(np.int32))], ["code", "doc_id", "nth", "n_lines"])

    given = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text")).where("__id is not null")
    return _texts_with(given, work, "code long, doc_id long, nth int, n_lines int")


def candidates(found: DataFrame) -> DataFrame:
    """(doc_id, marks): chunks whose code occurs elsewhere, marks being an array of (nth, code, is_first)."""
    firsts = found.groupBy("code").agg(F.min(F.struct("doc_id", "nth")).alias("first"), F.max(F.struct("doc_id", "nth")).alias("last")).where("first <> last").select("code", "first")
    marked = meet(found, firsts, "code").select("doc_id", F.struct("nth", "code", (F.struct("doc_id", "nth") == F.col("first")).alias("is_first")).alias("mark"))
    return marked.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))


def _alike(a: str, b: str, backwards: bool) -> Column:
    """How many lines of two texts are the same from the start, or from the end; none of a null."""
    cut = [F.split(F.col(c).cast("string"), "\n") for c in (a, b)]
    same = F.zip_with(*(F.reverse(c) for c in cut) if backwards else cut, lambda x, y: x.eqNullSafe(y))
    unlike = F.array_position(same, False)
    return F.coalesce(F.when(unlike == 0, F.size(same)).otherwise(unlike - 1), F.lit(0)).cast("int")


def repeats(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, nth, code, before, behind): the candidates whose bytes equal those of the first occurrence, and how many lines around them do so as well."""

    def work(batch, lines, start, end, code, text, nth):
        at = {(int(t), int(n)): i for i, (t, n) in enumerate(zip(text, nth, strict=True))}
        out: list[tuple] = []

        def held(i: int | None) -> bytes | None:
            return None if i is None else lines.data[lines.start[start[i]] : lines.end[end[i] - 1]].tobytes()

        for t, (doc_id, marks) in enumerate(zip(batch.column("__id").to_pylist(), batch.column("marks").to_pylist(), strict=True)):
            going = {m["nth"] for m in marks if not m["is_first"]}
            for m in marks:
                k = m["nth"]
                i = at.get((t, k))
                if i is not None and code[i] == m["code"]:
                    # the chunk beside one that goes is not needed where it goes itself
                    around = [None if not m["is_first"] and n in going else held(at.get((t, n))) for n in (k - 1, k + 1)]
                    out.append((doc_id, k, m["code"], m["is_first"], held(i), *around))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "nth", "code", "is_first", "bytes", "before", "behind"])

    given = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text")).join(marked.withColumnRenamed("doc_id", "__id").hint("merge"), "__id").select("__id", "__text", "marks")
    cut = stored(_texts_with(given, work, "doc_id long, nth int, code long, is_first boolean, bytes binary, before binary, behind binary"))
    firsts = cut.where("is_first").dropDuplicates(["code"]).select("code", *(F.col(c).alias(f"first_{c}") for c in ("bytes", "before", "behind")))
    same = meet(cut.where("not is_first"), firsts, "code").where("bytes = first_bytes")
    around = same.select("doc_id", "nth", "code", _alike("before", "first_before", True).alias("before"), _alike("behind", "first_behind", False).alias("behind"))
    return around.groupBy("doc_id", "nth", "code").agg(F.min("before").alias("before"), F.min("behind").alias("behind"))  # rows that share a doc_id


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with `text` cleaned, and __lines, __chunks, __removed: numbers of lines, chunks and removed lines."""
    marked = stored(candidates(chunks(docs)))
    gone = repeats(docs, marked).groupBy("doc_id").agg(F.collect_list(F.struct("nth", "code", "before", "behind")).alias("__gone")).withColumnRenamed("doc_id", "__id")
    names = docs.columns
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    keep = [c for c in names if c != "text"]

    def work(batch, lines, start, end, code, text, nth):
        texts, n = batch.column("__text").to_pylist(), len(batch)
        removed = np.zeros(n, np.int64)
        at = None
        for t, gone in enumerate(batch.column("__gone").to_pylist()):
            if not gone:
                continue
            if at is None:
                at = np.searchsorted(text, np.arange(n + 1))
            first, n_lines = lines.first[t], lines.count[t]
            drop = np.zeros(n_lines, bool)
            for g in gone:
                i = at[t] + g["nth"]
                if i < at[t + 1] and code[i] == g["code"]:
                    drop[start[i] - first - g["before"] : end[i] - first + g["behind"]] = True
            kept = [lines.data[lines.start[i] : lines.end[i]].tobytes() for i in first + np.flatnonzero(~drop)]
            removed[t] = drop.sum()
            texts[t] = b"\n".join(kept).decode()
        n_chunks = np.bincount(text, minlength=n)
        return pa.RecordBatch.from_arrays([*(batch.column(f"__k{i}") for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(lines.count.astype(np.int64)), pa.array(n_chunks.astype(np.int64)), pa.array(removed)], [*(f"__k{i}" for i in range(len(keep))), "__text", "__lines", "__chunks", "__removed"])

    given = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"), *(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep))).join(gone.hint("merge"), "__id", "left").drop("__id")
    schema = ", ".join([*(f"__k{i} {types[c]}" for i, c in enumerate(keep)), "__text string, __lines long, __chunks long, __removed long"])
    done = _texts_with(given, work, schema)
    place = {c: f"__k{i}" for i, c in enumerate(keep)} | {"text": "__text"}
    return done.select(*(F.col(place[c]).alias(c) for c in names), "__lines", "__chunks", "__removed")
