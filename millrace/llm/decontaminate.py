"""Benchmark decontamination by multi-pattern search over words (Wu and Manber's scheme).

Words are [0-9a-z] and all characters beyond ASCII, after folding A-Z.  The
patterns are the windows of `window` consecutive words of every benchmark item
(an item of fewer words is one window).  Patterns of one length k are searched
together: a table over hashed pairs of words tells, for the pair that ends at
the current word, how far the next possible end of a window is, so most words
are never looked at; where that distance is 0, the pair's bucket gives the
windows that end in it, which are compared code by code and then byte by byte.
Many stretches of text advance at once, one numpy step each.

The benchmark goes to every task in slices of at most `slice_bytes` of text and
one item.  Most benchmarks are one slice and one pass over the documents.  Of a
larger one, every slice but the first is searched and taken back from the tasks
before the next is handed out; only rows with hits are kept of those passes, by
doc_id and digest of their text, and joined to the pass of the first slice.  So
what is handed out at a time is bounded whatever the size of the benchmark.

Defined results: null or wordless texts have no words and no hits; null or
wordless items have no windows; items that share an item_id count as one; a null
item_id can cause hits but is not counted; every document row gives one row,
rows without doc_id and repeated rows included; texts of any length are searched
whole; an empty table gives an empty result; further columns are ignored
(`search`) or kept (`clean`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, prepare, stored, tidied
from .wordcode import ALNUM, BASE, Words, scramble, sequence_codes, split

WINDOW = 10
BLOCK_BYTES = 1 << 20
STRETCH = 256


class Group:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.words = list(patterns)
        self.items = [patterns[p] for p in self.words]
        self.length = k = len(self.words[0])
        self.pair = min(2, k)
        self.text = [b" ".join(p) for p in self.words]
        flat = [w for p in self.words for w in p]
        self.codes = split(pa.array(flat, pa.large_binary()), ALNUM, False).codes().reshape(-1, k)
        bits = max(16, int(np.ceil(np.log2(8 * self.codes.size + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, k - self.pair + 1, np.uint8)
        for at in range(self.pair - 1, k):  # from the longest distance to 0
            self.shift[self.block(self.codes[:, at - 1] if self.pair == 2 else None, self.codes[:, at])] = k - 1 - at
        bucket = self.block(self.codes[:, -2] if self.pair == 2 else None, self.codes[:, -1])
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]

    def block(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        code = last if before is None else scramble(before * BASE + last)
        return (code & self.mask).astype(np.int64)

    def find(self, words: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence; windows never cross texts."""
        k = self.length
        lows, highs = words.first[:-1] + k - 1, words.first[1:]
        n = np.maximum(0, -(-(highs - lows) // STRETCH))
        if not n.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        at = lows[text] + nth * STRETCH
        stop = np.minimum(at + STRETCH, highs[text])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            hashed = self.block(codes[at - 1] if self.pair == 2 else None, codes[at])
            step = self.shift[hashed].astype(np.int64)
            here = np.flatnonzero(step == 0)
            if len(here):
                found.append(self.verify(words, codes, at[here], hashed[here]))
                step[here] = 1
            at = at + step
            live = at < stop
            at, stop = at[live], stop[live]
        starts, patterns = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return starts, patterns

    def verify(self, words: Words, codes: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.bucket, hashed, "left"), np.searchsorted(self.bucket, hashed, "right")
        n = hi - lo
        starts = np.repeat(ends - self.length + 1, n)
        patterns = self.order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        for j in range(self.length):
            same = codes[starts + j] == self.codes[patterns, j]
            starts, patterns = starts[same], patterns[same]
        sure = np.fromiter((b" ".join(words.word(s + j) for j in range(self.length)) == self.text[p] for s, p in zip(starts.tolist(), patterns.tolist(), strict=True)), bool, len(starts))
        return starts[sure], patterns[sure]


def compile_items(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Group]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item_id, text in items:
        words = split(pa.array([text], pa.large_string()), ALNUM, True)
        w = [words.word(i) for i in range(len(words.start))]
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            by_length.setdefault(k, {}).setdefault(tuple(w[i : i + k]), set()).update([] if item_id is None else [item_id])
    return [Group(by_length[k]) for k in sorted(by_length)]


def _slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in parts of about `slice_bytes`; the driver holds one at a time."""
    given = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held: list[tuple[str | None, str | None]] = []
    size = 0
    for row in given.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= slice_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _occurrences(words: Words, groups: list[Group]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Hit stretches of all texts (first word, end word, bounds of each text's in those), and item_ids by text."""
    codes, hit = words.codes(), np.zeros(len(words.start) + 1, np.int64)
    named: dict[int, set[str]] = {}
    text_of = words.text_of()
    for group in groups:
        starts, found = group.find(words, codes)
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + group.length, -1)
        for t, p in set(zip(text_of[starts].tolist(), found.tolist(), strict=True)):
            named.setdefault(t, set()).update(group.items[p])
    inside = np.concatenate([[False], np.cumsum(hit)[:-1] > 0, [False]])
    bounds = np.zeros(len(inside), bool)
    bounds[words.first] = True  # stretches end with their text
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | bounds[:-2]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | bounds[1:-1])) + 1
    return begin, end, np.searchsorted(begin, words.first), named


FOUND = "n_words long, span_starts array<int>, span_ends array<int>, item_ids array<string>"
KEY = ("__id", "__digest")


def _pass(given: DataFrame, handed: Broadcast) -> DataFrame:
    """__id, __digest and FOUND of every row of `given` (__id, __digest, __text) for one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES, "__text"):
            words = split(batch.column("__text"), ALNUM, True)
            begin, end, at, named = _occurrences(words, handed.value)
            owner, lists = np.repeat(words.first[:-1], np.diff(at)), pa.array(at.astype(np.int32))
            spans = [pa.ListArray.from_arrays(lists, pa.array((x - owner).astype(np.int32))) for x in (begin, end)]
            items = pa.array([sorted(named.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(words.count), *spans, items], [*KEY, "n_words", "span_starts", "span_ends", "item_ids"])

    return given.mapInArrow(tidied(run), "__id long, __digest string, " + FOUND)


def _keyed(docs: DataFrame, several: bool) -> list[Column]:
    """doc_id and, where passes must be joined, a digest of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("__id"), (F.sha2(text.cast("binary"), 256) if several else F.lit("")).alias("__digest")]


def _handed(docs: DataFrame, benchmark: DataFrame, window: int, slice_bytes: int) -> tuple[Broadcast, DataFrame | None]:
    """The first slice, handed out, and the rows with hits of all others (__id, __digest, FOUND), None if there are none."""
    spark = docs.sparkSession
    prepare(spark)
    parts = _slices(benchmark, slice_bytes)
    first = compile_items(next(parts, []), window)
    more: DataFrame | None = None
    for part in parts:
        handed = spark.sparkContext.broadcast(compile_items(part, window))
        given = docs.select(*_keyed(docs, True), F.col("text").cast("string").alias("__text"))
        hits = stored(_pass(given, handed).where(F.size("span_starts") > 0).dropDuplicates([*KEY]))
        handed.destroy()
        more = hits if more is None else more.unionByName(hits)
    return spark.sparkContext.broadcast(first), more


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each key of (__id, __digest, found: list of FOUND), with stretches and items united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, items, n_words = [], [], [], []
            for found in batch.column("found").to_pylist():
                n_words.append(found[0]["n_words"])
                hit = np.zeros(n_words[-1] + 2, np.int64)
                for f in found:
                    np.add.at(hit, np.array(f["span_starts"], np.int64) + 1, 1)
                    np.add.at(hit, np.array(f["span_ends"], np.int64) + 1, -1)
                edge = np.diff((np.cumsum(hit) > 0).astype(np.int8))
                starts.append(np.flatnonzero(edge == 1).tolist())
                ends.append(np.flatnonzero(edge == -1).tolist())
                items.append(sorted({i for f in found for i in f["item_ids"]}))
            spans = [pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(n_words, pa.int64()), *spans, pa.array(items, pa.list_(pa.string()))], [*KEY, "n_words", "span_starts", "span_ends", "item_ids"])

    return rows.mapInArrow(tidied(run), "__id long, __digest string, " + FOUND)


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["__id"].eqNullSafe(b["__id"]) & (a["__digest"] == b["__digest"])


def search(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slice_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted as strings), span_starts and span_ends (words, ends exclusive)."""
    first, more = _handed(docs, benchmark, window, slice_bytes)
    found = _pass(docs.select(*_keyed(docs, more is not None), F.col("text").cast("string").alias("__text")), first)
    if more is not None:
        found = stored(found)
        state = F.struct("n_words", "span_starts", "span_ends", "item_ids")
        hits = more.unionByName(found.where(F.size("span_starts") > 0).dropDuplicates([*KEY])).groupBy(*KEY).agg(F.collect_list(state).alias("found"))  # a list of one for each slice at most
        hits = stored(_merged(hits)).withColumnsRenamed({c: f"h_{c}" for c in ("n_words", "span_starts", "span_ends", "item_ids")})
        joined = found.join(hits.hint("merge"), _same_key(found, hits), "left")
        found = joined.select(found["__id"], "n_words", *(F.coalesce(f"h_{c}", c).alias(c) for c in ("span_starts", "span_ends", "item_ids")))
    hits = F.aggregate(F.zip_with("span_ends", "span_starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(F.col("__id").alias("doc_id"), "n_words", hits.alias("n_hit"), "item_ids", "span_starts", "span_ends")


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slice_bytes: int = 8 << 20) -> DataFrame:
    """The rows of `docs` without any hit, with their columns as they were; each goes to Python once."""
    first, more = _handed(docs, benchmark, window, slice_bytes)
    names = docs.columns
    columns = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)]
    given = docs.select(*columns)
    if more is not None:
        keyed = docs.select(*_keyed(docs, True), *columns)
        given = keyed.join(more, _same_key(keyed, more), "left_anti").drop(*KEY)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES, f"__k{at}"):
            _, _, stretches, _ = _occurrences(split(batch.column(at), ALNUM, True), first.value)
            yield batch.filter(pa.array(np.diff(stretches) == 0))

    return given.mapInArrow(tidied(run), given.schema).select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(names)))
