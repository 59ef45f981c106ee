"""Types within families: many k-means fits at once, their choice by silhouette, members, representatives; places between landmarks.

All fits - each family, each number of clusters, each start - go through the rows together: a round is one pass in
which tasks add up rows by model and cluster, and one sum of their results.  The driver holds the centres, which are
as many as families, numbers and starts ask for and never grow with the rows, and samples of SAMPLE_ROWS rows a family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .archetypes import LEAST_CLUSTER, cluster_sizes, feature_weights, interpolated
from .kmeans import Fit, advance, by_family, matrix, round_of, squared, summed
from .similarity import projected
from .steps import ship, stored

#: rows of a family that starts are drawn from, and that the silhouette is measured at, against all rows
SAMPLE_ROWS = 2000
PENALTY = 0.015
REPRESENTATIVES = 5
FULL_ROWS, LANDMARKS, NEIGHBOURS = 2500, 400, 8
#: landmarks that a task may hold
HELD = 5000
# The weight of each group of features in the types of a position.
TYPE_WEIGHTS = {
    "FWD": {"attacking_threat": 0.30, "creation": 0.26, "possession_buildup": 0.14, "carrying": 0.18, "defending_duels": 0.10, "discipline_errors": 0.02},
    "MID": {"attacking_threat": 0.12, "creation": 0.24, "possession_buildup": 0.26, "carrying": 0.12, "defending_duels": 0.22, "discipline_errors": 0.04},
    "DEF": {"attacking_threat": 0.06, "creation": 0.14, "possession_buildup": 0.28, "carrying": 0.08, "defending_duels": 0.38, "discipline_errors": 0.06},
}


def type_weights(position: str, groups: dict[str, str], base: dict[str, float], flags: list[str] = []) -> dict[str, float]:  # noqa: B006
    """A position's weights of features; a flag of missing values has a quarter of its weight in `base`."""
    return feature_weights(groups, TYPE_WEIGHTS[position]) | {f: base.get(f, 0.0) * 0.25 for f in flags}


def rooted(rows: DataFrame, family: str, vector: str, weights: dict[str, list[float]]) -> DataFrame:
    """Vectors times the square roots of their family's weights, so that squared distances are weighted ones; null for other families."""
    out = F.lit(None).cast("array<double>")
    for name, w in weights.items():
        factors = F.array(*(F.lit(float(max(x, 0.0)) ** 0.5) for x in w))
        out = F.when(F.col(family) == name, F.zip_with(vector, factors, lambda v, f: v.cast("double") * f)).otherwise(out)
    return rows.withColumn(vector, out)


def _sample(rows: DataFrame, counts: dict[str, int], seed: int) -> dict[str, np.ndarray]:
    """Up to SAMPLE_ROWS rows of each family, the first by a hash of the key."""
    chance = F.lit(0.0)
    for f, n in counts.items():
        chance = F.when(F.col("family") == f, min(1.0, 2.0 * SAMPLE_ROWS / n)).otherwise(chance)
    order = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.withColumn("order", order).where(F.col("order") < chance).toPandas().sort_values(["order", "key"])
    return {f: np.stack(part["v"].head(SAMPLE_ROWS).to_numpy()) for f, part in drawn.groupby("family")}


def _start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn by its squared distance from those before."""
    chosen = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = squared(x, np.array(chosen)).min(axis=1)
        chosen.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    return np.array(chosen)


def fits(rows: DataFrame, choices: dict[str, list[int]], counts: dict[str, int], *, starts: int = 10, rounds: int = 50, seed: int = 42, tolerance: float = 1e-10) -> list[Fit]:
    """The fit of least cost of `starts` for each family and number of clusters. rows: key, family, v (a stored table)."""
    sample = _sample(rows.where(F.col("family").isin(list(choices))), {f: counts[f] for f in choices}, seed)
    models = [Fit(f, _start(sample[f], k, np.random.default_rng([seed, s, k]))) for f, ks in choices.items() for k in ks for s in range(starts)]

    parts = rows.rdd.getNumPartitions()
    advance(rows, models, rounds, lambda by: bool((by**2).sum() <= tolerance), parts)
    for i, told in round_of(rows, models, list(range(len(models))), parts).items():
        models[i].sizes, models[i].cost = told[:, 0].astype(np.int64), float(told[:, 1].sum())
    best: dict[tuple[str, int], Fit] = {}
    for m in models:
        at = m.family, len(m.centres)
        # equal costs differ by the order of their sums: the first start stays
        best[at] = m if at not in best or m.cost < best[at].cost * (1 - 1e-9) else best[at]
    return list(best.values())


def silhouettes(rows: DataFrame, models: list[Fit], counts: dict[str, int], seed: int = 42) -> list[float]:
    """Of each fit the mean silhouette by Euclidean distance of a sample of its family, all of it up to SAMPLE_ROWS rows, against all of its rows."""
    queries = _sample(rows.where(F.col("family").isin(sorted({m.family for m in models}))), {m.family: counts[m.family] for m in models}, seed)

    def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = {i: np.zeros((len(queries[m.family]), len(m.centres))) for i, m in enumerate(models)}
        for batch in batches:
            for f, _, x in by_family(batch):
                q = queries.get(f)
                for lo in range(0, len(x) if q is not None else 0, 256):
                    part = x[lo : lo + 256]
                    d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (part**2).sum(1)[None] - 2 * q @ part.T, 0))
                    for i, m in enumerate(models):
                        if m.family == f:
                            out[i] += d @ np.eye(len(m.centres))[squared(part, m.centres).argmin(axis=1)]
        return out

    told = summed(rows.select("family", "v"), work)
    worth = []
    for i, m in enumerate(models):
        q, n = queries[m.family], m.sizes
        own = squared(q, m.centres).argmin(axis=1)
        sums = told[i].reshape(len(q), -1)
        inside = sums[np.arange(len(q)), own] / np.maximum(n[own] - 1, 1)
        means = np.where(n > 0, sums / np.maximum(n, 1), np.inf)
        means[np.arange(len(q)), own] = np.inf
        outside = means.min(axis=1)
        s = np.where(n[own] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)
        worth.append(float(s.mean()))
    return worth


def chosen(rows: DataFrame, *, starts: int = 10, seed: int = 42) -> dict[str, Fit | None]:
    """The fit of each family, None where it stays whole: too few rows, too small clusters, or none worth more than nothing."""
    counts = {r["family"]: r["n"] for r in rows.groupBy("family").agg(F.count("*").alias("n")).collect()}  # one row a family
    choices = {f: ks for f, n in counts.items() if (ks := cluster_sizes(n, f))}
    out: dict[str, Fit | None] = dict.fromkeys(counts)
    if not choices:
        return out
    made = [m for m in fits(rows, choices, counts, starts=starts, seed=seed) if m.sizes.min() >= max(3, LEAST_CLUSTER // 2)]
    best = dict.fromkeys(counts, 0.0)
    for m, s in zip(made, silhouettes(rows, made, counts, seed) if made else [], strict=True):
        worth = s - PENALTY * len(m.centres)
        if worth >= best[m.family] and (out[m.family] is None or worth > best[m.family]):
            best[m.family], out[m.family] = worth, m
    return out


def members(rows: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """key, family, primary, secondary, d_primary, d_secondary, all_d: clusters by distance, "0", "1", ...; a family without centres is one cluster."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = [{}] * len(batch)
            for f, at, x in by_family(batch):
                d = np.sqrt(squared(x, centres[f])) if f in centres else np.zeros((len(x), 1))
                order = np.argsort(d, axis=1, kind="stable")
                second = order[:, min(1, d.shape[1] - 1)]
                for i, a, b, row in zip(at.tolist(), order[:, 0].tolist(), second.tolist(), d.tolist(), strict=True):
                    out[i] = {"primary": str(a), "secondary": str(b), "d_primary": row[a], "d_secondary": row[b], "all_d": [(str(j), v) for j, v in enumerate(row)]}
            kinds = {"primary": pa.string(), "secondary": pa.string(), "d_primary": pa.float64(), "d_secondary": pa.float64(), "all_d": pa.map_(pa.string(), pa.float64())}
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("family"), *(pa.array([o[c] for o in out], t) for c, t in kinds.items())], ["key", "family", *kinds])

    schema = f"key {dict(rows.dtypes)['key']}, family string, primary string, secondary string, d_primary double, d_secondary double, all_d map<string,double>"
    return rows.select("key", "family", "v").mapInArrow(run, schema)


def representatives(told: DataFrame, n: int = REPRESENTATIVES) -> DataFrame:
    """family, primary, rank, key, d_primary: the n members nearest to each centre; tasks send their own n only."""
    order = ["d_primary", "key"]
    local = Window.partitionBy("part", "family", "primary").orderBy(*order)
    near = told.select("family", "primary", "d_primary", "key", F.pmod(F.xxhash64("key"), F.lit(64)).alias("part")).withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= n)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("family", "primary").orderBy(*order))).where(F.col("rank") <= n).select("family", "primary", "rank", "key", "d_primary")


def between(rows: DataFrame, marks: DataFrame, key: str, vector: str, point: str, k: int = NEIGHBOURS, most: int | None = None) -> DataFrame:
    """key, point of every row: a landmark keeps its own, others lie between their k nearest landmarks (L1), by inverse distance; ties go to the smaller key.

    Up to HELD landmarks each task holds them all and rows are not shuffled; above that blocks of rows meet blocks of
    landmarks.  More than `most` are an error, if it is given.
    """
    if marks.limit((HELD if most is None else most) + 1).count() > (HELD if most is None else most):
        if most is not None:
            raise ValueError(f"more than {most} landmarks")
        return interpolated(rows, marks, key, vector, point, k)
    ship(rows.sparkSession)
    held = marks.select(key, vector, point).toPandas().sort_values(key)
    own = {i: p for i, p in zip(held[key].tolist(), held[point], strict=True)}
    vectors, points = np.stack(held[vector].to_numpy()).astype(float), np.stack(held[point].to_numpy()).astype(float)
    k = min(k, len(vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = matrix(batch.column("v")), []
            for lo in range(0, len(x), 64):
                d = np.abs(x[lo : lo + 64, None, :] - vectors[None]).sum(axis=2)
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                w = 1.0 / np.maximum(np.take_along_axis(d, near, axis=1), 1e-6)
                out.append((points[near] * w[:, :, None]).sum(axis=1) / w.sum(axis=1)[:, None])
            placed = np.concatenate(out) if out else np.zeros((0, points.shape[1]))
            listed = [own[i] if i in own else p for i, p in zip(batch.column("key").to_pylist(), placed, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([list(map(float, p)) for p in listed], pa.list_(pa.float64()))], [key, point])

    given = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return given.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {point} array<double>")


def projection(rows: DataFrame, key: str, vector: str, *, full_rows: int = FULL_ROWS, landmarks: int = LANDMARKS, neighbours: int = NEIGHBOURS, seed: str = "landmarks") -> tuple[DataFrame, str]:
    """(key and point of every row, how): principal components of all rows, or above `full_rows` those of a draw of landmarks, between which the others are placed."""
    given = stored(rows.select(key, F.col(vector).cast("array<double>").alias(vector)))
    if given.count() <= full_rows:
        return projected(given, key, vector), "all"
    marks = stored(given.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(max(4, landmarks)))
    fitted = stored(marks.join(projected(marks, key, vector), key))
    return between(given, fitted, key, vector, "point", neighbours), "landmarks"
