"""Weighted neighbours, centroids, clusters and projections of feature vectors."""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .kmeans import Fit, advance, round_of, squared
from .steps import ship

#: starts of k-means that are drawn beside each other, as each is some small jobs
PARALLEL = 8


def weighted_l1(a: Column, b: Column, weights: list[float] | None = None) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if weights is not None:
        parts = F.zip_with(parts, F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: x * w)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles; a missing vector, and one of another length, is all NaN."""
    gone = np.full(width, np.nan)
    rows = [gone if v is None or len(v) != width else np.asarray(v, dtype=float) for v in vectors]
    return np.stack(rows) if rows else np.zeros((0, width))


def _codes(x: np.ndarray, pool: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both tables as short integers and the numbers of a unit of distance, so that sums of their differences, less one for each entry, are never above scale * distance.

    Entries are cut to the range in which nearly all of the pool's lie, which makes no difference larger, and differences add up to less than 2**16.
    """
    low, high = np.quantile(pool, [0.0005, 0.9995], axis=0)
    low, high = np.where(low < high, [low, high], [pool.min(axis=0), pool.max(axis=0)]) * weights
    wide, room = high - low, 65_535 - 2 * pool.shape[1]
    scale = min(room / wide.sum(), 32_000 / wide.max()) if room > 0 and np.isfinite(wide.sum()) and wide.sum() > 1e-300 else 0.0
    coded = [np.rint((np.clip(m * weights, low, high) - low) * scale).astype(np.int16) for m in (x, pool)]
    return coded[0], coded[1], scale


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Halves go up, as in round() of DuckDB."""
    many = d * 10.0**digits
    with np.errstate(invalid="ignore"):
        whole = np.floor(many)
        return np.where(np.isfinite(many), (whole + (many - whole >= 0.5)) / 10.0**digits, d)


def nearest_of(x: np.ndarray, pool: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], weights: np.ndarray, other_group: float, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of the pool, distance): the k nearest by weighted L1 of every row, nearest first, ties to the earlier row of the pool.

    `same` numbers mark rows not to be compared, a negative group is unlike any other, and distances are rounded to
    `digits` before they are ranked.  32 rows are held against the pool at a time: distances are screened by sums of
    short integers, which are never too large; those that may count are added up in doubles, entry by entry; a NaN one is the largest.
    """
    n, d = pool.shape
    finite = np.isfinite(pool).all(axis=1)
    by = np.flatnonzero(finite)[np.argsort(groups[1][finite], kind="stable")]  # a group's rows are neighbours
    plain = np.isfinite(x).all(axis=1)
    screened = len(by) > 8 * (k + 1) and bool((weights >= 0).all()) and bool(np.isfinite(weights).all()) and other_group > 0
    codes, flat, scale = _codes(np.where(plain[:, None], x, 0.0), pool[by], weights) if screened else (None, None, 0.0)
    screened &= scale > 0
    if screened:
        flat, parts = np.ascontiguousarray(flat.T), max(64, 8 * (k + 1))
        parts = min(parts, len(by))
        own = [np.where(groups[0] < 0, 0, np.searchsorted(groups[1][by], groups[0], side)) for side in ("left", "right")]

    def exact(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at))
        with np.errstate(invalid="ignore"):
            for lo in range(0, len(at), 16_384):
                i, j = at[lo : lo + 16_384], to[lo : lo + 16_384]
                apart, total = np.abs(x[i] - pool[j]) * weights, out[lo : lo + 16_384]
                for c in range(d):
                    total += apart[:, c]
                total *= np.where((groups[0][i] == groups[1][j]) & (groups[0][i] >= 0), 1.0, other_group)
        return out

    def best(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = same[0][at] != same[1][to]
        at, to = at[keep], to[keep]
        far = exact(at, to)
        far = far if digits is None else rounded(far, digits)
        order = np.lexsort((to, far, at))
        at, to, far = at[order], to[order], far[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[first], to[first], far[first]

    def met(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(rows, len(columns)), np.tile(columns, len(rows))

    def near(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        thin, sums = codes[rows], np.empty((len(rows), len(by)), dtype=np.uint16)
        for c in range(0, len(by), 4096):
            part = flat[:, c : c + 4096]
            total, one = np.zeros((len(rows), part.shape[1]), dtype=np.uint16), np.empty((len(rows), part.shape[1]), dtype=np.int16)
            for j in range(d):
                np.subtract(thin[:, j, None], part[j], out=one)
                np.abs(one, out=one)
                total += one.view(np.uint16)
            sums[:, c : c + 4096] = total
        # in units of the larger of the two factors, never rounded up
        unit = max(1.0, other_group)
        for r, row in enumerate(rows if other_group != 1.0 else []):
            lo, hi = own[0][row], own[1][row]
            for at in (slice(lo, hi),) if other_group > 1.0 else (slice(0, lo), slice(hi, None)):
                sums[r, at] = sums[r, at] * np.float32((1 - 1e-6) * min(other_group, 1 / other_group))
        # k + 1 of these parts have a row of this size at most, so k rows besides its own are at hand
        least = sums[:, : len(by) // parts * parts].reshape(len(rows), -1, parts).min(axis=1)
        some = np.flatnonzero(sums <= np.partition(least, k, axis=1)[:, k, None])
        at, _, far = best(rows[some // len(by)], by[some % len(by)])
        last = np.searchsorted(at, rows, "right") - 1
        bound = np.where(last - np.searchsorted(at, rows) == k - 1, far[last] if len(far) else 0.0, np.inf) * (1 + 1e-9) + (0.0 if digits is None else 10.0**-digits)
        room = np.fmin(bound / unit * scale + d + 2, 65_535).astype(np.uint16)
        some = np.flatnonzero(sums <= room[:, None])
        return best(rows[some // len(by)], by[some % len(by)])

    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    lost, twins = np.isnan(x).any(axis=1), np.unique(same[1], return_counts=True)[1].max(initial=0)
    for kind, work in ((lost, lambda rows: best(*met(rows, np.arange(min(n, k + twins))))), (plain & screened, near), (~lost & ~(plain & screened), lambda rows: best(*met(rows, np.arange(n))))):
        rows = np.flatnonzero(kind)
        out += [work(rows[lo : lo + 32]) for lo in range(0, len(rows), 32)]
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def in_blocks(queries: DataFrame, pool: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, blocks: tuple[int, int], keys: tuple[str, str]) -> DataFrame:
    """What `work` makes of each block of queries and each block of the pool; rows are dealt by their keys, and a task holds one block of either."""
    ship(queries.sparkSession)
    dealt = lambda df, key, n: df.withColumn(f"__{key[0]}", F.pmod(F.xxhash64(key[1]), F.lit(n)).cast("int"))
    every = lambda df, name, n: df.withColumn(f"__{name}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    q = every(dealt(queries, ("qb", keys[0]), blocks[0]), "pb", blocks[1])
    p = every(dealt(pool, ("pb", keys[1]), blocks[1]), "qb", blocks[0])
    return q.groupBy("__qb", "__pb").cogroup(p.groupBy("__qb", "__pb")).applyInPandas(work, schema)


def block_numbers(queries: DataFrame, pool: DataFrame, query_rows: int, pool_rows: int) -> tuple[int, int]:
    """Blocks of about so many rows, and as many pairs of them as there are task slots at least."""
    of_queries = max(1, math.ceil(queries.count() / query_rows))
    return of_queries, max(1, math.ceil(pool.count() / pool_rows), math.ceil(queries.sparkSession.sparkContext.defaultParallelism / of_queries))


def nearest(queries: DataFrame, pool: DataFrame, key: str, vector: str, k: int, *, group: str | None = None, weights: list[float] | None = None, other_group: float = 1.25, digits: int | None = None, block_rows: int = 20_000, blocks: int | None = None) -> DataFrame:
    """query, neighbour, distance, rank: the k nearest of the pool to each of a stated set of queries.

    Distances between different groups (a missing one is unlike all) are stretched by `other_group`, and all are rounded
    to `digits`, if given, before ranks are settled.  Queries and pool are dealt by their keys into blocks of about
    `block_rows` (the pool into `blocks`, if given), and every block of the one meets every block of the other; a pair of blocks keeps its k best for each query before anything is gathered.  Vectors that are missing, or of
    another length than those they meet, have a null distance, which comes last.
    """
    of_queries, of_pool = block_numbers(queries, pool, block_rows, block_rows)
    own = lambda df, name: df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).alias("g"))
    kind = dict(pool.dtypes)[key]

    def work(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"query": q["query"][:0], "neighbour": p["neighbour"][:0], "distance": np.zeros(0)})
        p = p.sort_values("neighbour", ignore_index=True)
        ids = pd.factorize(pd.concat([q["query"], p["neighbour"]]))[0]
        sides = pd.factorize(pd.concat([q["g"], p["g"]]))[0]
        twins = p["neighbour"].value_counts(dropna=False).max()
        n, lengths, out = len(q), np.array([1 if v is None else max(1, len(v)) for v in q["v"]]), []
        for width in np.unique(lengths):  # mostly one
            rows, there = np.flatnonzero(lengths == width), _matrix(p["v"], width)
            # of equal vectors of a group the first k, besides those of the query's own key, can be among the k nearest
            few = np.flatnonzero(pd.DataFrame({"v": [v.tobytes() for v in there], "g": sides[n:]}).groupby(["v", "g"]).cumcount() < k + twins)
            w = np.ones(width) if weights is None else np.asarray(weights, dtype=float)[:width]
            at, to, d = nearest_of(_matrix(q["v"].iloc[rows], width), there[few], k, (ids[:n][rows], ids[n:][few]), (sides[:n][rows], sides[n:][few]), w, other_group if group else 1.0, digits)
            out.append(pd.DataFrame({"query": q["query"].to_numpy()[rows[at]], "neighbour": p["neighbour"].to_numpy()[few[to]], "distance": d}))
        return pd.concat(out)

    met = in_blocks(own(queries, "query"), own(pool, "neighbour"), work, f"query {dict(queries.dtypes)[key]}, neighbour {kind}, distance double", (of_queries, blocks or of_pool), ("query", "neighbour"))
    met = met.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
    order = [F.col("distance").asc_nulls_last(), F.col("neighbour")]
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "neighbour", "distance", "rank")


def scored(edges: DataFrame, n_candidates: Column, scale: Column) -> DataFrame:
    """Adds candidate_score (by rank), absolute_score (by distance), score (the smaller) and weak."""
    by_rank = F.when(n_candidates <= 1, 100.0).otherwise(100.0 * (1.0 - (F.col("rank") - 1) / (n_candidates - 1)))
    # a scale of 0 (the nearest are copies) leaves nothing to what is farther away, and to copies no number
    none = F.when(F.col("distance") > 0, 0.0).when(F.col("distance") == 0, float("nan"))
    by_distance = F.when(scale == 0, none).otherwise(100.0 * F.exp(-F.col("distance") / F.nullif(scale, F.lit(0.0))))
    out = edges.withColumn("candidate_score", by_rank).withColumn("absolute_score", by_distance)
    return out.withColumn("score", F.least("candidate_score", "absolute_score")).withColumn("weak", F.col("absolute_score") < F.col("candidate_score") - 10)


def two_nearest(rows: DataFrame, centroids: DataFrame, key: str, vector: str, label: str, distance, most: int = 2000) -> DataFrame:
    """key, primary, secondary, margin; more than `most` centroids, which every task holds, are an error."""
    if centroids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centroids")
    c = centroids.select(F.col(label).alias("__label"), F.col(vector).alias("__c")).agg(F.collect_list(F.struct("__label", "__c")).alias("__all"))
    ranked = F.array_sort(F.transform("__all", lambda x: F.struct(distance(F.col(vector), x["__c"]).alias("d"), x["__label"].alias("label"))))
    met = rows.crossJoin(F.broadcast(c)).withColumn("__r", ranked)  # one row of centroids
    return met.select(key, F.col("__r")[0]["label"].alias("primary"), F.try_element_at("__r", F.lit(2))["label"].alias("secondary"), (F.try_element_at("__r", F.lit(2))["d"] - F.col("__r")[0]["d"]).alias("margin"))


def clustered(rows: DataFrame, key: str, vector: str, choices: range | list[int], seed: int = 42, penalty: float = 0.015, starts: int = 10, least: int = 1) -> DataFrame:
    """key, cluster for the number of clusters with the best silhouette less `penalty` for each cluster.

    Of `starts` runs for a number the one with the least cost counts; a number whose
    smallest cluster has fewer than `least` rows is left out.  Without any number, or
    with none above zero, all rows are in one cluster.  Spark's KMeans draws the starts;
    from there all runs go through the rows together, by its rules (30 rounds, tolerance 1e-4).
    """
    spark, choices = rows.sparkSession, list(choices)
    given = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    given.count()  # read once, not by every start at the same time
    draw = lambda k, i: Fit("", np.array(KMeans(k=k, seed=seed + i, maxIter=0).fit(given).clusterCenters()))
    runs = [inheritable_thread_target(spark)(lambda k=k, i=i: draw(k, i)) for k in choices for i in range(starts)]
    with ThreadPool(PARALLEL) as pool:
        made = pool.map(lambda run: run(), runs, chunksize=1)
    table, parts = given.select(F.lit("").alias("family"), vector_to_array("features").alias("v")), given.rdd.getNumPartitions()
    advance(table, made, 30, lambda by: bool(((by**2).sum(axis=1) <= 1e-4**2).all()), parts)
    least_cost = [min(made[n * starts : (n + 1) * starts], key=lambda m: m.cost) for n in range(len(choices))]
    sizes = round_of(table, least_cost, list(range(len(choices))), parts) if choices else {}
    best, chosen = 0.0, None
    for n, k in enumerate(choices):
        if len(sizes[n]) < k or sizes[n][:, 0].min() < least:
            continue
        out = _labelled(given, least_cost[n].centres)
        worth = ClusteringEvaluator().evaluate(out) - penalty * k
        if worth > best:
            best, chosen = worth, out
    given.unpersist()  # the chosen centres are applied to the rows anew
    if chosen is None:
        return rows.select(key, F.lit(0).alias("cluster"))
    return chosen.select(key, F.col("prediction").alias("cluster"))


def _labelled(given: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with `prediction`, the number of the centre nearest to their features."""

    @F.pandas_udf("int")
    def nearest_centre(v: pd.Series) -> pd.Series:
        return pd.Series(squared(np.stack(v.to_numpy()), centres).argmin(axis=1)) if len(v) else pd.Series([], dtype="int32")

    return given.withColumn("prediction", nearest_centre(vector_to_array("features")))


def projected(rows: DataFrame, key: str, vector: str, dims: int = 3) -> DataFrame:
    """key, point: principal components of the centred vectors."""
    given = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(given).transform(given)
    return PCA(k=dims, inputCol="features", outputCol="point").fit(centred).transform(centred).select(key, vector_to_array("point").alias("point"))
