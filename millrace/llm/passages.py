"""Removal of repeated passages, found by difference-cover anchors.

A passage is a window of WINDOW words.  Only windows of ANCHOR words that start
at cover places - places whose remainder modulo PERIOD is in COVER - are hashed.
Every difference modulo PERIOD is a difference of two members of COVER, so for
any two places of equal passages some shift below PERIOD brings both to cover
places, and since ANCHOR + PERIOD - 1 = WINDOW, the anchor there lies inside
both passages.  Hence a passage that occurs twice contains an anchor that occurs
twice.  From each repeated anchor the search extends to the full windows around
it, and only those are compared across the corpus, by BLAKE2b digests of 128
bits over the bytes of their words.  Anchor codes only propose windows, so their
collisions cost work and change no result; two windows of different words with
one digest are as good as impossible, also on purpose.

A window goes if the same words start earlier: at a smaller doc_id, or earlier
in the same document.  Windows are judged on the input, not on what is left.

Hot passages: a text that an earlier document holds byte for byte goes as a
whole, before any window of it is looked at; windows that repeat inside one
block of documents are settled there, only a block's first goes on; anchors and
windows are reduced by partial sums before shuffles; the joins back are plain
ones that split hot keys.

Defined results: null, empty and short texts have no windows; texts of any length
are searched whole; kept words are
joined by one blank, a null text gives an empty one; rows of one doc_id do not
outrank each other at equal places; rows without doc_id are not searched; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, meet, prepare, release, stored, tidied
from .wordcode import BY_BLANKS, Words, codes_at, split

WINDOW = 20
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 1 << 20
WIDE_BYTES = 8 << 20
_AT_COVER = np.isin(np.arange(PERIOD), COVER)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text; the tag, 60 bits of a SHA-256 digest, tells rows of one doc_id apart by their text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tag = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), text.alias("text"))


def anchor_places(words) -> tuple[np.ndarray, np.ndarray]:
    """(place among all words, number of its text) of every anchor in texts that have windows."""
    text = words.text_of()
    n = words.count[text]
    place = np.arange(len(text)) - words.first[:-1][text]
    at = np.flatnonzero(_AT_COVER[place % PERIOD] & (place + ANCHOR <= n) & (n >= WINDOW))
    return at, text[at]


def anchors(docs: DataFrame) -> DataFrame:
    """(code, doc_id, times): anchors by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            words = split(batch.column("text"), BY_BLANKS, False)
            at, text = anchor_places(words)
            code = codes_at(words.codes(), at, ANCHOR)
            order = np.lexsort((code, text))
            code, text = code[order], text[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(code))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(code[first].view(np.int64)), batch.column("doc_id").take(pa.array(text[first])), pa.array(times)], ["code", "doc_id", "times"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(tidied(run), "code long, doc_id long, times int")


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, codes): anchors that occur more than once in the corpus, by document."""
    every = anchors(docs)
    often = every.groupBy("code").agg(F.sum("times").alias("times")).where("times > 1").select("code")
    return meet(every.select("code", "doc_id"), often, "code").groupBy("doc_id").agg(F.collect_list("code").alias("codes"))


def copies(keyed: DataFrame) -> DataFrame:
    """(doc_id, tag) of rows whose whole text an earlier document holds."""
    rows = keyed.where("doc_id is not null").select("doc_id", "tag", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    return meet(rows, first, "sha").where("doc_id > first").select("doc_id", "tag").distinct()


def window_digests(words: Words, start: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a digest of the WINDOW words from each start on."""
    joined, at = words.joined()
    view = memoryview(joined)
    made = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at[start].tolist(), at[start + WINDOW].tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, g, doc_id, tag, start, leads): windows around repeated anchors; leads: the first of its words in its block.

    h and g are the halves of the window's digest.

    wanted: doc_id, tag and the codes of repeated anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, WIDE_BYTES):
            found: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                words = split(batch.column("text").slice(i, 1), BY_BLANKS, False)
                n, code = len(words.start), words.codes()
                at, _ = anchor_places(words)
                known = np.sort(batch.column("codes")[i].values.to_numpy().view(np.uint64))
                mine = codes_at(code, at, ANCHOR)
                spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                at = at[known[spot] == mine]
                edge = np.zeros(n + 2, np.int32)
                np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(edge, at + 1, -1)
                start = np.flatnonzero(np.cumsum(edge)[: max(0, n - WINDOW + 1)] > 0)
                found.append((*window_digests(words, start).T, np.full(len(start), i), start))
            h, g, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
            ids = batch.column("doc_id").to_numpy()[row]
            order = np.lexsort((start, ids, g, h))
            leads = np.ones(len(h), bool)
            a, b = order[1:], order[:-1]
            # equal places of rows that share a doc_id lead together
            same = (h[a] == h[b]) & (g[a] == g[b])
            leads[a] = ~same | ((ids[a] == ids[b]) & (start[a] == start[b]))
            for k in np.flatnonzero(same & leads[a]):  # such a row leads only if the one before it does
                leads[a[k]] = leads[b[k]]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(ids), batch.column("tag").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(leads)], ["h", "g", "doc_id", "tag", "start", "leads"])

    return _keyed(docs).join(wanted.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "codes").mapInArrow(tidied(run), "h long, g long, doc_id long, tag long, start int, leads boolean")


def repeats(found: DataFrame) -> DataFrame:
    """(doc_id, tag, starts): windows whose words start earlier somewhere."""
    leading = found.where("leads")
    firsts = leading.groupBy("h", "g").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    later = meet(leading, firsts, ["h", "g"]).where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "tag", "start")
    return later.unionByName(found.where("not leads").select("doc_id", "tag", "start")).groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"))


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the kept words, joined by one blank)."""
    spark = docs.sparkSession
    prepare(spark)
    keyed = _keyed(docs)
    whole = stored(copies(keyed))
    marked = stored(repeated_anchors(keyed))
    wanted = keyed.select("doc_id", "tag").distinct().join(whole, ["doc_id", "tag"], "left_anti").join(marked, "doc_id")
    found = stored(windows(docs, wanted))
    release(spark, marked)
    gone = stored(repeats(found).select("doc_id", "tag", "starts", F.lit(False).alias("whole")).unionByName(whole.select("doc_id", "tag", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))))
    release(spark, found, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            n_words, n_removed, kept = [], [], []
            for text, starts, whole in zip(batch.column("text").to_pylist(), batch.column("starts"), batch.column("whole").to_pylist(), strict=True):
                words = text.encode().split()  # at ASCII blanks, as bytes are
                n_words.append(len(words))
                if whole:
                    words = words if len(words) < WINDOW else []
                elif starts.is_valid:
                    at = starts.values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return keyed.join(gone.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "whole").mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept string")
