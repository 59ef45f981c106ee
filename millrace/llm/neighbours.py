"""Approximate nearest neighbours in a stable low-dimensional projection.

Vectors are multiplied by DIMS Gaussian vectors.  For a vector at Euclidean
distance d from a query, the squared distance of the projections is d**2 times a
chi-square variable with DIMS degrees of freedom.  So with the distance d_k of
the k-th best candidate so far, a vector that is nearer than d_k has a projected
squared distance above q * d_k**2, q being the chi-square quantile of
`confidence`, with probability 1 - confidence at most: the search goes through
candidates by growing projected distance, measures each on the original vectors,
and stops there.

A kd-tree over the projections gives that order.  Its upper part splits the
corpus into cells and is fitted on a bounded sample of projections
(`sample_rows`); cells with more than `part_rows` vectors are cut into parts by
vec_id, so equal or crowded vectors never pile up in one task.  Within a part,
each task builds the lower part of the tree.  A first round searches, for each
query, one part of the query's own cell; the distance it ends with then picks
the cells, through the same test on their bounding boxes, that the second round
searches.  Only parts that a query asks for are dealt out, and a part is copied
only if more than `query_rows` queries ask for it, once for each so many.

Defined results: vectors that are null or zero, hold null or non-finite
components, or have another length than most take no part; null vec_ids neither;
rows that share a vec_id are candidates each; equal distances go to smaller
vec_ids; rounding of projections is allowed for, so that equal vectors always
pass the test; fewer candidates than k give all of them; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, stored, tidied, uniform

DIMS = 8  # even, so that the chi-square distribution has a closed form
LEAF = 64
#: squared relative rounding error of a projection, with room to spare
ROUNDING = 1e-24


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """x with P(chi-square <= x) = p, for an even number of degrees of freedom."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def directions(length: int, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, DIMS))


def usable(vectors: DataFrame, length: int) -> Column:
    e = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col("vec_id").isNotNull() & (F.size(e) == length) & F.forall(e, fine) & F.exists(e, lambda x: x != 0)


class Cells:
    """The upper kd-tree: median splits of a sample, to a given number of cells."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.axes: list[int] = []
        self.cuts: list[float] = []
        level = [sample]
        for _ in range(depth):
            below = []
            for rows in level:
                axis = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) else 0
                cut = float(np.median(rows[:, axis])) if len(rows) else 0.0
                self.axes.append(axis)
                self.cuts.append(cut)
                side = rows[:, axis] > cut if len(rows) else np.zeros(0, bool)
                below += [rows[~side], rows[side]]
            level = below
        self.depth = depth

    def of(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        axes, cuts = np.array(self.axes, np.int64), np.array(self.cuts)
        for _ in range(self.depth):
            node = 2 * node + 1 + (projected[np.arange(len(node)), axes[node]] > cuts[node])
        return node - ((1 << self.depth) - 1)


class Tree:
    """The lower kd-tree of one part: leaves of at most LEAF rows with their bounding boxes."""

    def __init__(self, projected: np.ndarray) -> None:
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(projected))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            values = projected[rows]
            axis = int(np.argmax(np.ptp(values, axis=0)))
            order = np.argsort(values[:, axis], kind="stable")
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.low = np.array([projected[x].min(0) for x in self.leaves])
        self.high = np.array([projected[x].max(0) for x in self.leaves])

    def leaf_distances(self, query: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        return (gap * gap).sum(1)


def search_part(ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, q_projected: np.ndarray, bounds: np.ndarray, k: int, quantile: float) -> list[tuple[int, int, float]]:
    """(query, vec_id, distance): the k best of one part for each query, under the stopping test."""
    tree = Tree(projected)
    out: list[tuple[int, int, float]] = []
    for q_id, q, qp, bound in zip(q_ids.tolist(), q_vectors, q_projected, bounds.tolist(), strict=True):
        to_leaf = tree.leaf_distances(qp)
        order, slack = np.argsort(to_leaf, kind="stable"), ROUNDING * float(qp @ qp)
        best_d, best_i, kth = np.zeros(0), np.zeros(0, np.int64), bound
        for leaf in order:
            if to_leaf[leaf] > quantile * kth * kth + slack:
                break  # whatever is left is nearer only with probability 1 - confidence
            rows = tree.leaves[leaf]
            rows = rows[ids[rows] != q_id]
            near = ((projected[rows] - qp) ** 2).sum(1) <= quantile * kth * kth + slack
            rows = rows[near]
            difference = vectors[rows] - q
            d = np.sqrt((difference * difference).sum(1))
            best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[rows]])
            if len(best_d) > k:
                first = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[first], best_i[first]
            if len(best_d) == k:
                kth = min(kth, float(best_d.max()))
        out += [(q_id, i, d) for d, i in zip(best_d.tolist(), best_i.tolist(), strict=True)]
    return out


def index(vectors: DataFrame, *, sample_rows: int = 200_000, part_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(rows, cells).

    rows: vec_id, embedding (array<double>), projected, cell, part.
    cells: cell, parts, low, high (bounding box of the projections).
    """
    spark = vectors.sparkSession
    prepare(spark)
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = int(sizes["n"]) if sizes else 1
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    given = given.where(usable(given, length))
    base = directions(length)
    n = given.count()
    chance = min(1.0, 1.5 * sample_rows / max(n, 1))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projected = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, length) @ base
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in projected.T], [f"p{i}" for i in range(DIMS)])

    drawn = given.where(uniform(F.col("vec_id"), "index") < chance).select("embedding").mapInArrow(tidied(project), ", ".join(f"p{i} double" for i in range(DIMS)))
    sample = drawn.limit(sample_rows).toPandas().to_numpy(np.float64)  # DIMS numbers a row: 13 MB at most
    depth = max(0, math.ceil(math.log2(max(n, 1) / part_rows)))
    depth = min(depth, max(0, int(math.log2(max(len(sample), 1) / 8))))
    cells = Cells(sample.reshape(-1, DIMS), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("embedding")
            projected = e.flatten().to_numpy(zero_copy_only=False).reshape(-1, length) @ base
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), e, pa.array(list(projected), pa.list_(pa.float64())), pa.array(cells.of(projected).astype(np.int32))], ["vec_id", "embedding", "projected", "cell"])

    placed = stored(given.mapInArrow(tidied(place), "vec_id long, embedding array<double>, projected array<double>, cell int"))
    axes = range(DIMS)
    box = placed.groupBy("cell").agg(F.count("*").alias("n"), *(f(F.col("projected")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in axes))
    boxes = stored(box.select("cell", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"), F.array(*(f"low{i}" for i in axes)).alias("low"), F.array(*(f"high{i}" for i in axes)).alias("high")))
    rows = placed.join(F.broadcast(boxes.select("cell", "parts")), "cell")  # at most 2**depth cells, some thousand rows a cell
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts"), boxes


def _round(rows: DataFrame, asked: DataFrame, k: int, quantile: float, query_rows: int) -> DataFrame:
    """Search parts; asked: query_id, q_embedding, q_projected, bound, q_cell, q_part.

    A task meets one part and one block of the queries sent to it, both bounded.
    """

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        stack = lambda c: np.stack(c.to_numpy())
        found = search_part(left["vec_id"].to_numpy(), stack(left["embedding"]), stack(left["projected"]), right["query_id"].to_numpy(), stack(right["q_embedding"]), stack(right["q_projected"]), right["bound"].to_numpy(), k, quantile)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    wanted = asked.groupBy(F.col("q_cell").alias("cell"), F.col("q_part").alias("part")).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("n_blocks"))
    wanted = stored(wanted)
    blocks = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")
    dealt = rows.join(wanted.hint("merge"), ["cell", "part"]).select("cell", "part", "vec_id", "embedding", "projected", blocks)
    sizes = wanted.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), "n_blocks")
    queries = asked.join(sizes.hint("merge"), ["q_cell", "q_part"]).withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("n_blocks")).cast("int")).drop("n_blocks")
    return dealt.groupBy("cell", "part", "block").cogroup(queries.groupBy("q_cell", "q_part", "q_block")).applyInPandas(work, "query_id long, vec_id long, score double")


def _near_cells(seek: DataFrame, boxes: DataFrame, quantile: float) -> DataFrame:
    """`seek` with q_cell and parts, one row for each cell whose box may hold something near enough.

    boxes has one row a cell, as many as the index has leaves: a table bounded by its depth.
    """
    held = boxes.toPandas()
    cell, parts = held["cell"].to_numpy(), held["parts"].to_numpy()
    low, high = (np.array(held[c].tolist(), np.float64).reshape(-1, DIMS) for c in ("low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q_projected").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            hits = [np.flatnonzero((np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(1) <= quantile * b * b + ROUNDING * float(p @ p)) for p, b in zip(q, bound, strict=True)]
            for i in range(0, len(hits), 256):
                at = np.concatenate(hits[i : i + 256])
                near = batch.take(pa.array(np.repeat(np.arange(i, min(i + 256, len(hits))), [len(h) for h in hits[i : i + 256]])))
                yield pa.RecordBatch.from_arrays([*near.columns, pa.array(cell[at].astype(np.int32)), pa.array(parts[at].astype(np.int32))], [*near.schema.names, "q_cell", "parts"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seek.schema.fields)
    return seek.mapInArrow(tidied(run), f"{schema}, q_cell int, parts int")


def nearest(vectors: DataFrame, queries: Column, *, k: int = 10, confidence: float = 0.999, sample_rows: int = 200_000, part_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for the k nearest found to each row that `queries` selects."""
    rows, boxes = index(vectors, sample_rows=sample_rows, part_rows=part_rows)
    quantile = chi_square_quantile(confidence)
    rows = stored(rows)
    infinite = F.lit(float("inf"))
    asked = stored(rows.where(queries).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_embedding"), F.col("projected").alias("q_projected"), F.col("cell").alias("q_cell"), F.col("part").alias("q_part")))
    own = stored(_round(rows, asked.withColumn("bound", infinite), k, quantile, query_rows))
    reached = own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(infinite).alias("bound"))
    seek = asked.withColumnsRenamed({"q_cell": "own_cell", "q_part": "own_part"}).join(reached, "query_id", "left").withColumn("bound", F.coalesce("bound", infinite))
    near = _near_cells(seek, boxes, quantile).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = near.where(~((F.col("q_cell") == F.col("own_cell")) & (F.col("q_part") == F.col("own_part")))).select("query_id", "q_embedding", "q_projected", "bound", "q_cell", "q_part")
    both = own.unionByName(_round(rows, stored(others), k, quantile, query_rows))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
