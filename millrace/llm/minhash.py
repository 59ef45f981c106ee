"""Near-duplicate documents by MinHash with tensored banding, verified on full sets.

A document is its set of distinct shingles of five words (A-Z folded; of fewer
words, the whole sequence is one shingle).  Documents with the same words in the
same order, by a BLAKE2b digest of them, form a class.  For every class of five
words and more (shorter ones are similar to nothing but their own class) n half
keys are computed, each from `ROWS` minimum
hashes; table keys are all pairs of half keys, so n * ROWS hashes serve
n * (n - 1) / 2 tables.  Two sets of similarity s agree in a half key with
probability s**ROWS, and are missed only if they agree in fewer than two.
`half_count` takes as many half keys as it needs for at most `MISSED` at the
threshold itself: 12 at 0.85 and 16 at 0.80, both about 2 in 10,000; pairs above
the threshold are missed less (at 0.85, those of 0.9 less than 1 in 100,000).

A half key that only one class has cannot be in a shared table key, so most
classes leave before any pair of half keys is formed.  Then

1. in every table key each class is compared, on full sets, with the key's
   smallest class only; links merge classes into components;
2. keys whose classes ended in one component are done.  Classes of all other
   keys enter an exact join: with shingles in order of frequency, two sets that
   are similar enough must share one near the front of both, nearer in the
   smaller one (prefix and position bounds).  A shingle first meets components,
   not classes, so a component of any size that shares it costs its classes
   nothing; classes are compared only with those of other components.

Codes only propose links.  `verified` holds the two texts' words against each
other: words get exact numbers, and a shingle counts as shared if all its five
words are the same.  So no table key is ever expanded into its pairs, none is cut
off, and no collision of codes can link two documents.

Defined results: null, empty and wordless texts have no shingles and stand
alone; texts of any length are used whole; rows of one doc_id and different texts
are classes of their own, but classes with the same smallest doc_id count as
linked; rows without doc_id get no component and are not kept; an empty table
gives an empty result; further columns are ignored (`near_duplicates`) or kept
(`one_of_each`, which tells rows of one doc_id apart by their text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, meet, prepare, stored, tidied
from .components import components
from .wordcode import BASE, BY_BLANKS, Words, codes_at, scramble, sequence_codes, split

SHINGLE = 5
HALVES = 12
ROWS = 3
#: share of the pairs at the threshold that may agree in fewer than two half keys
MISSED = 2.2e-4
BLOCK_BYTES = 1 << 20


def half_count(percent: int) -> int:
    """The number of half keys, HALVES at least, that misses at most MISSED of the pairs at the threshold."""
    p = (percent / 100) ** ROWS
    n = HALVES
    while p < 1 and (1 - p) ** n + n * p * (1 - p) ** (n - 1) > MISSED:
        n += 1
    return n


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): sorted distinct shingle codes of text i are codes[first[i]:first[i + 1]]; fewer than SHINGLE words have none."""
    runs, count = sequence_codes(words.codes(), SHINGLE), words.count
    none = np.zeros(0, np.uint64)
    sets = [np.unique(runs[a : a + n - SHINGLE + 1]) if n >= SHINGLE else none for a, n in zip(words.first[:-1].tolist(), count.tolist(), strict=True)]
    return np.concatenate([none, *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def digests(words: Words) -> list[bytes | None]:
    """A digest of each text's words in order; none for texts without words."""
    joined, start = words.joined()
    edge = start[words.first].tolist()
    return [hashlib.blake2b(joined[a:b], digest_size=16).digest() if b > a else None for a, b in zip(edge[:-1], edge[1:], strict=True)]


def half_keys(codes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n codes for each set, all sets non-empty."""
    seeds = scramble(np.arange(1, 2 * n * ROWS + 1, dtype=np.uint64) * BASE)
    factors, shifts = seeds[: n * ROWS] | np.uint64(1), seeds[n * ROWS :]
    out = np.zeros((n, len(first) - 1), np.uint64)
    for k in range(n * ROWS):
        least = np.minimum.reduceat(codes * factors[k] + shifts[k], first[:-1])
        out[k // ROWS] = out[k // ROWS] * BASE + scramble(least)
    return scramble(out).T


def _address() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, address, n_shingles, digest, halves) of every row; halves are null below SHINGLE words, and digests for none."""
    prepare(docs.sparkSession)
    n_halves = half_count(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            words = split(batch.column("text"), BY_BLANKS, True)
            codes, first = shingle_sets(words)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            keys = half_keys(codes, np.concatenate([first[full], first[-1:]]), n_halves).view(np.int64) if len(full) else np.zeros(0, np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), n_halves).cast(pa.list_(pa.int64()))
            halves = lists.take(pa.array(np.cumsum(sizes > 0) - 1, mask=sizes == 0))
            n = np.where(words.count < SHINGLE, np.minimum(words.count, 1), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("address"), pa.array(n), pa.array(digests(words), pa.binary()), halves], ["doc_id", "address", "n_shingles", "digest", "halves"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _address().alias("address"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(tidied(run), "doc_id long, address string, n_shingles long, digest binary, halves array<long>")


def full_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, digest, words: joined by blanks) of the documents whose doc_id is in nodes (node, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            words = split(batch.column("text"), BY_BLANKS, True)
            joined, start = words.joined()
            edge = start[words.first]
            text = pa.Array.from_buffers(pa.large_string(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(joined)]).cast(pa.string())
            mine = pa.array([x == y for x, y in zip(digests(words), batch.column("digest").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("digest"), text], ["node", "digest", "words"]).filter(mine)

    text = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return nodes.join(text, "node").select("node", "digest", "text").mapInArrow(tidied(run), "node long, digest binary, words string").dropDuplicates(["node", "digest"])


def shingles_of(texts: DataFrame) -> DataFrame:
    """(node, shingles: distinct codes) of full_texts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES, "words"):
            codes, first = shingle_sets(split(batch.column("words"), BY_BLANKS, False))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(codes.view(np.int64)))], ["node", "shingles"])

    return texts.select("node", "words").mapInArrow(tidied(run), "node long, shingles array<long>")


def similar(a: pa.Array, b: pa.Array, percent: int) -> np.ndarray:
    """For each pair of texts, whether their sets of shingles, compared word by word, are similar enough."""
    m = len(a)
    words = split(pa.concat_arrays([a, b]), BY_BLANKS, False)
    ids, text = words.ids(), words.text_of()
    left = np.repeat(words.first[1:], words.count) - np.arange(len(text))  # words from here to the text's end
    at = np.flatnonzero(left >= SHINGLE)
    if not len(at):
        return np.zeros(m, bool)
    code, pair, side = codes_at(scramble(ids.astype(np.uint64) + BASE), at, SHINGLE), text[at] % m, text[at] // m
    order = np.lexsort((code, pair))
    at, code, pair, side = at[order], code[order], pair[order], side[order]
    new = np.ones(len(at), bool)
    new[1:] = (code[1:] != code[:-1]) | (pair[1:] != pair[:-1])
    again = np.flatnonzero(~new)
    equal = np.ones(len(again), bool)
    for k in range(SHINGLE):
        equal &= ids[at[again] + k] == ids[at[again - 1] + k]
    begin = np.flatnonzero(new)
    sides = np.bitwise_or.reduceat(1 << side, begin)
    count = lambda which: np.bincount(pair[begin][which], minlength=m)
    na, nb, both = count(sides & 1 > 0), count(sides & 2 > 0), count(sides == 3)
    for p in np.unique(pair[again[~equal]]).tolist():  # different words under one code: this pair is counted by the words themselves
        x, y = ({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for w in (t[p].as_py().split(" ") for t in (a, b)))
        na[p], nb[p], both[p] = len(x), len(y), len(x & y)
    return (both > 0) & (100 * both >= percent * (na + nb - both))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES, "a"):
            linked = pa.array(similar(batch.column("a"), batch.column("b"), percent))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(linked)

    a = texts.select(F.col("node").alias("u"), F.col("words").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("words").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(tidied(run), "u long, v long").distinct()


def table_keys(classes: DataFrame) -> DataFrame:
    """(node, key, n): table keys, from pairs of half keys, that can have more than one class."""
    halves = classes.select("node", "n", F.posexplode("halves").alias("i", "h"))
    shared = halves.groupBy("i", "h").agg(F.count("*").alias("c")).where("c > 1").select("i", "h")
    left = meet(halves, shared, ["i", "h"], "left_semi").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("halves")).where(F.size("halves") > 1)
    first = left.select("node", "n", "halves", F.posexplode("halves").alias("at", "x"))
    second = first.select("node", "n", "x", F.explode(F.slice("halves", F.col("at") + 2, F.size("halves"))).alias("y"))
    return second.select("node", "n", F.xxhash64("x.i", "x.h", "y.i", "y.h").alias("key"))


def near_front(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes n and m that first share what is i-th and j-th (from 0) can still be similar enough."""
    return (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)


def residual_pairs(texts: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """(u, v) in different components that share a shingle near the front of both; of: (node, component)."""
    rows = shingles_of(texts.join(of.select("node"), "node", "left_semi")).join(of, "node")
    rows = stored(rows.select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s")))
    counts = rows.groupBy("s").agg(F.count("*").alias("c"), F.min("component").alias("first"), F.max("component").alias("last")).where("c > 1")
    ranked = meet(rows, counts, "s", "left").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("c", F.lit(1)), "s")) - 1)
    # against any partner a set must share one of its first n - ceil(n * percent / 100) + 1, in two components
    front = stored(ranked.where(F.col("c").isNotNull() & (F.col("first") < F.col("last")) & (100 * (F.col("n") - F.col("at")) >= percent * F.col("n"))).select("s", "node", "component", "n", "at"))
    x = front.select("s", *(F.col(c).alias(f"x_{c}") for c in ("node", "component", "n", "at")))
    # the smaller of two, or either of equals, must share one nearer its front
    small = front.where((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n"))
    y = stored(small.select("s", *(F.col(c).alias(f"y_{c}") for c in ("node", "component", "n", "at"))))
    of_component = y.groupBy("s", "y_component").agg(F.min("y_n").alias("least"), F.max("y_n").alias("most"))
    sizes_fit = (F.col("least") <= F.col("x_n")) & (100 * F.col("most") >= percent * F.col("x_n"))
    may = stored(x.join(stored(of_component).hint("merge"), "s").where((F.col("x_component") != F.col("y_component")) & sizes_fit).drop("least", "most"))
    fit = (F.col("y_n") <= F.col("x_n")) & near_front(F.col("x_n"), F.col("y_n"), F.col("x_at"), F.col("y_at"), percent)
    return may.join(y.hint("merge"), ["s", "y_component"]).where(fit).select(F.least("x_node", "y_node").alias("u"), F.greatest("x_node", "y_node").alias("v")).distinct()


def links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(u, v): verified links that connect whatever is linked; classes: node, n, digest, halves."""
    keys = stored(table_keys(classes))
    centres = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last")).where("first.node < last").select("key", F.col("first.node").alias("u"), F.col("first.n").alias("nu"))
    met = stored(meet(keys, centres, "key"))
    # similar sets have similar sizes; a larger ratio needs no look at the sets
    sizes_fit = 100 * F.least("n", "nu") >= percent * F.greatest("n", "nu")
    stars = stored(met.where((F.col("u") != F.col("node")) & sizes_fit).select("u", F.col("node").alias("v")).distinct())
    wanted = stored(met.select("node").distinct())
    texts = stored(full_texts(docs, classes.select("node", "digest").join(wanted, "node", "left_semi")))
    links_ = stored(verified(stars, texts, percent))
    found = components(links_)
    at = stored(met.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    open_keys = at.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    left = stored(meet(at, open_keys, "key", "left_semi").select("node", "component").distinct())
    more = stored(verified(residual_pairs(texts, left, percent), texts, percent))
    return links_.unionByName(more)


def _marked(docs: DataFrame, percent: int) -> DataFrame:
    """Per row: doc_id, address, n_shingles, component_id, kept."""
    seen = stored(signatures(docs, percent))
    # equal texts meet in one class before anything is compared
    reps = seen.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node")).where("node is not null")
    own = seen.where("halves is not null").select("digest", F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "halves")
    classes = stored(own.join(reps, ["digest", "node"]).dropDuplicates(["digest", "node"]))
    found = components(links(docs, classes, percent))
    of_digest = reps.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("of"))
    joined = meet(seen.select("doc_id", "address", "n_shingles", "digest"), of_digest, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return joined.select("doc_id", "address", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id linked to it, over any number of links), kept."""
    return _marked(docs, percent).drop("address")


def one_of_each(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """The rows of `docs` that near_duplicates() keeps, with their columns as they were; repeated rows stay once."""
    keep = stored(_marked(docs, percent).where("kept").select(F.col("doc_id").alias("__id"), F.col("address").alias("__address")))
    distinct = keep.distinct()
    repeated = not keep.groupBy("__id", "__address").count().where("count > 1").isEmpty()
    named = docs.select(F.col("doc_id").cast("long").alias("__id"), _address().alias("__address"), *(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(docs.columns)))
    out = named.join(distinct, ["__id", "__address"], "left_semi").select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)))
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
