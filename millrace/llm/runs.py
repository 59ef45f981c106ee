"""Maximal periodic runs of words, by block matching.

A run is a stretch of words with smallest period q (words q apart are identical) that no
neighbouring word extends, of at least SHORTEST words and two periods.  Its words have
q-apart equals over a stretch of max(q, SHORTEST - q) words or more, and such a stretch
covers a whole block of B words that starts at a multiple of B as soon as it has 2 * B - 1.
So periods are dealt out to block sizes, powers of two: B = 2 finds those up to 6, and B those
from 2 * B - 1 to 4 * B - 2.  For each size the blocks of a text become integer-sequence
keys of an Aho-Corasick automaton, each of KEY integers at most: an integer names a word or,
in longer blocks, a stretch of 2, 4, ... words (names are numbered by pairs of shorter ones).
The automaton goes once over the text, and each occurrence of a block at a distance that fits
its size is a seed.  A seed grows word by word in both directions
for as long as words at that distance are the same, which gives the run itself.

Blocks that do not come again within reach are no keys: 64-bit codes of two, four, ... words,
of all texts at once, are sorted to see that (equal blocks have equal codes, so none is lost).
Periods are met from small to large, so a multiple of a period is known by its equal bounds,
and seeds inside of a run are skipped where their distance is a multiple of its period.

Defined results: a null, empty or blank text has no words, no runs and empty results; every row
has its row of results, repeated rows and any doc_id too; texts of any length are searched whole,
one text at a time (a text longer than a block is a block of its own); of runs of equal length the
one with the smaller start, then period, counts as the greatest; an empty table gives an empty
one; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, prepare, tidied
from .wordcode import BASE, BY_BLANKS, scramble, split

SHORTEST = 12
FIRST = 2
#: the most names in a key: the automaton may look at that many shorter stretches for each place of a text
KEY = 8
BLOCK_BYTES = 2 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


def periods(block: int) -> tuple[int, int]:
    """The periods that blocks of a size find."""
    return (1 if block == FIRST else 2 * block - 1), (6 if block == FIRST else 4 * block - 2)


def recurring(ids: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
    """For each block size, the places of blocks of it that come again within reach in their own text.

    ids: numbers of the words of all texts in a row; text i has first[i]:first[i + 1].
    """
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    local = np.arange(len(ids)) - first[text]
    left = size[text] - local  # words from here to the end of the text
    code = scramble((ids.astype(np.uint64) + scramble(text.astype(np.uint64) * BASE)) * BASE)
    found, block = {}, 1
    places = np.flatnonzero(left >= FIRST)  # where a block of the next size starts that may come again
    while len(places):
        block *= 2
        longer = scramble(code[places] * BASE + code[places + block // 2])
        order = np.argsort(longer, kind="stable")
        same = longer[order[1:]] == longer[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        again = np.zeros(len(places), bool)
        again[a] = again[b] = True
        reach = np.zeros(len(places), bool)
        reach[a] = places[b] - places[a] <= periods(block)[1]
        reach &= local[places] % block == 0
        if reach.any():
            found[block] = places[reach]
        code[places] = longer
        # a block of twice the size comes again only if both its halves do
        repeats = np.zeros(len(ids) + 1, bool)
        repeats[places[again]] = True
        places = places[again]
        places = places[(left[places] >= 2 * block)]
        places = places[repeats[places + block]]
    return found


def doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all stretches of 2 * size words, given those of `size` words; equal stretches and no others share one."""
    if len(names) <= size:
        return names[:0]
    pairs = names[:-size] * (int(names.max()) + 1) + names[size:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def seeds(names: np.ndarray, size: int, block: int, starts: list[int]) -> list[tuple[int, int]]:
    """(distance, start) of each occurrence of the blocks at `starts`, in rising order, as far behind them as fits their size.

    A block is the key of block / size names of stretches of `size` words in a row; the text is as many
    sequences of such stretches as there are places to begin with, which the automaton reads one after another.
    """
    import ahocorasick

    least, most = periods(block)
    first = starts[0]
    near = names[first : starts[-1] + most + block - size + 1]
    tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    where: dict[tuple[int, ...], list[int]] = {}
    for s in starts:
        where.setdefault(tuple(near[s - first : s - first + block : size].tolist()), []).append(s)
    for key, places in where.items():
        tree.add_word(key, places)
    tree.make_automaton()
    rows = -(-len(near) // size)
    laid = np.full((size, rows + 1), int(near.max()) + 1)  # a name of its own between two sequences
    laid[:, :rows] = np.concatenate([near, np.full(rows * size - len(near), laid[0, 0])]).reshape(rows, size).T
    out = []
    for end, places in tree.iter(tuple(laid.ravel().tolist())):
        phase, row = divmod(end, rows + 1)
        at = first + phase + (row + 1) * size - block
        for k in range(bisect_left(places, at - most), len(places)):
            if at - places[k] < least:
                break
            out.append((at - places[k], places[k]))
    return out


def _equal_from(words: np.ndarray, place: int, distance: int, step: int) -> int:
    """How many words in a row from `place` on (step 1) or before it (step -1) equal those `distance` on."""
    n, done, width = len(words), 0, 32
    while True:
        if step > 0:
            lo, hi = place + done, min(place + done + width, n - distance)
        else:
            lo, hi = max(place - done - width, 0), place - done
        if lo >= hi:
            return done
        differ = words[lo:hi] != words[lo + distance : hi + distance]
        if step < 0:
            differ = differ[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, width = done + hi - lo, width * 2


def runs(words: np.ndarray, blocks_at: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. blocks_at: for each size, starts of blocks that come again."""
    found: dict[tuple[int, int], int] = {}
    names, size = words, 1
    end_at, period_at = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    for block in sorted(blocks_at):
        starts, distance, past = np.array(blocks_at[block]), 0, 0
        # a block no shorter than the period of a run that holds all its reach comes again there at multiples of that period only
        starts = starts[(period_at[starts] > block) | (starts + periods(block)[1] + block > end_at[starts])]
        while KEY * size < block:
            names, size = doubled(names, size), 2 * size
        for d, s in sorted(seeds(names, size, block, starts.tolist())) if len(starts) else []:
            if d != distance:
                distance, past = d, 0
            if s < past or (d % period_at[s] == 0 and s + block + d <= end_at[s]):
                continue
            past = s + block + _equal_from(words, s + block, d, 1)
            start = s - _equal_from(words, s, d, -1)
            length = past - start + d
            if length >= max(SHORTEST, 2 * d) and (start, length) not in found:
                found[start, length] = d
                if length >= 4 * d:
                    end_at[start : start + length], period_at[start : start + length] = start + length, d
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period), kept (the words that stay, joined by one blank); nothing is shuffled."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            texts = batch.column("text")
            words = split(texts, BY_BLANKS, False)
            ids = words.ids().astype(np.int64)
            first = words.first
            by_text: dict[int, dict[int, list[int]]] = {}
            for block, places in recurring(ids, first).items():
                for t, at in zip((np.searchsorted(first, places, side="right") - 1).tolist(), places.tolist(), strict=True):
                    by_text.setdefault(t, {}).setdefault(block, []).append(at - int(first[t]))
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
            for t, at in by_text.items():
                found[t] = runs(ids[first[t] : first[t + 1]], at)
            kept = []
            for i, n in enumerate(words.count.tolist()):
                text = (texts[i].as_py() or "").encode().split()  # at ASCII blanks, as bytes are
                if found[i]:
                    text = [w for w, s in zip(text, collapsed(n, found[i]).tolist(), strict=True) if s]
                kept.append(b" ".join(text).decode())
            listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count.astype(np.int64)), listed, pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(work), SCHEMA)


def described(found: DataFrame) -> DataFrame:
    """Per row of find(): doc_id, n_runs, the greatest run, and digests of all runs and of the kept words."""
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("r"), "runs", "kept")
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    milli = F.floor(F.lit(1000) * F.col("r.length") / F.col("r.period"))
    return rows.select("doc_id", "n_runs", "r.start", "r.length", "r.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
