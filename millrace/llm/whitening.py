"""Whitening of embeddings by merged singular value decompositions.

Components are components of a matrix that no task holds.  Each task decomposes what
it reads, batch by batch, and keeps a summary: the number of rows, their integer sums,
all singular values and all right singular vectors of the rows about their own mean.
Two summaries become one by stacking values times vectors of both and one row more, the
difference of the means times sqrt(n1 * n2 / (n1 + n2)), and decomposing that again; the
stack has the same product with itself as the centred rows, so no dimension is lost.
Summaries of tasks are merged FAN at a time, round by round, until one is left: that one,
as large as the dimension squared, is all that the driver sees, and FAN of them are the
most that a task holds.

Rows are fitted as integers: x = floor(STEPS * c) for each entry c, each distinct vector once.
Partial aggregation meets repeated vectors before they are shuffled.

Defined results: rows whose vector is null or holds nothing, null, NaN or infinite entries are
left out, and so are rows of another length than the most frequent one (of equally frequent
ones, the longest); every other row, with or without an id, repeated or not, has its rows of
results; equal vectors have equal results; components with an eigenvalue of zero (less than
the rounding of the largest) have null in `whitened`, explain nothing, and are not counted in
`identity_error`, which is null where no component is left; `deviation` is null where it
passes 2**63; entries beyond 2**53 / STEPS lose exactness; an empty table gives an empty one;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, tidied

STEPS = 256
BATCH_BYTES = 16 << 20
FAN = 8
SUMMARY = "part long, n long, sums array<long>, singular array<double>, vectors array<double>"


@dataclass
class Summary:
    """Rows about their mean: n of them, integer sums, singular values and right vectors (one a row)."""

    n: int
    sums: np.ndarray
    singular: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        sums = x.sum(axis=0)
        _, s, v = np.linalg.svd(x - sums / len(x), full_matrices=False)
        return Summary(len(x), sums, s, v)

    def __add__(self, other: Summary) -> Summary:
        n = self.n + other.n
        shift = (self.sums / self.n - other.sums / other.n) * np.sqrt(self.n / n * other.n)
        _, s, v = np.linalg.svd(np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, shift[None]]), full_matrices=False)
        return Summary(n, self.sums + other.sums, s, v)

    def row(self, part: int) -> tuple:
        return part, self.n, self.sums, self.singular, self.vectors.ravel()

    @staticmethod
    def read(row: object) -> Summary:
        sums = np.asarray(row.sums, np.int64)
        return Summary(int(row.n), sums, np.asarray(row.singular), np.asarray(row.vectors).reshape(-1, len(sums)))


@dataclass
class Whitener:
    """What a fit leaves: n, sums, eigenvalues (falling), unit vectors (one a row), and the error of the whitened covariance."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        top = self.eigenvalues[0] if len(self.eigenvalues) else 0.0
        return self.eigenvalues > top * (np.finfo(float).eps * max(len(self.sums), 1)) ** 2

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened components of integer vectors; NaN for those without an eigenvalue."""
        out = np.full((len(x), k), np.nan)
        on = np.flatnonzero(self.live[:k])
        out[:, on] = (x - self.sums / self.n) @ self.vectors[on].T / np.sqrt(self.eigenvalues[on])
        return out


def _matrix(lists: pa.Array, dtype: type) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(lists), -1)


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>): rows with finite vectors of the most frequent length."""
    prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = rows.where(F.size("v") > 0).where(F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))  # NaN is above infinity
    # one row for each length
    lengths = finite.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return finite.where(F.size("v") == (lengths["d"] if lengths else -1)).select("vec_id", F.transform("v", lambda c: F.floor(c * STEPS)).alias("x"))


def _merged(parts: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row from rows numbered by `part`, FAN at a time."""
    parts = stored(parts)
    n_parts = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n_parts > 1:
        n_parts = -(-n_parts // FAN)
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("part")).applyInPandas(merge, schema)
    return parts


def fit(distinct: DataFrame) -> Whitener | None:
    """All components of a stored table of distinct integer vectors x; None where it is empty."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Summary | None = None
        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            x = _matrix(batch.column("x"), np.int64)
            step = max(BATCH_BYTES // (8 * max(x.shape[1], 1)), 1)
            for lo in range(0, len(x), step):
                one = Summary.of(x[lo : lo + step])
                held = one if held is None else held + one
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(["part", "n", "sums", "singular", "vectors"], held.row(part), strict=True))], pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("singular", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        first, *rest = [Summary.read(r) for r in rows.sort_values("part").itertuples()]
        for other in rest:
            first += other
        return pd.DataFrame([first.row(int(rows["part"].min()) // FAN)], columns=["part", "n", "sums", "singular", "vectors"])

    parts = distinct.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(tidied(summed), SUMMARY)
    last = _merged(parts, merge, SUMMARY).collect()
    if not last:
        return None
    found = Summary.read(last[0])
    d = len(found.sums)
    values = np.zeros(d)
    values[: len(found.singular)] = found.singular**2 / found.n
    vectors = np.zeros((d, d))
    vectors[: len(found.singular)] = found.vectors
    return Whitener(found.n, found.sums, values, vectors, float(values.sum()))


def identity_error(distinct: DataFrame, model: Whitener, k: int) -> float | None:
    """The largest entry of the covariance of the first k whitened components less the identity, over the fit list.

    Tasks sum centred products and merge them as the fits are merged.
    """
    live = np.flatnonzero(model.live[:k])
    if not len(live):
        return None
    schema = "part long, n long, mean array<double>, products array<double>"

    def together(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, products = rows[0]
        for m, other, more in rows[1:]:
            shift = other - mean
            products = products + more + np.outer(shift, shift) * (n / (n + m) * m)
            mean, n = mean + shift * (m / (n + m)), n + m
        return n, mean, products

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            w = model.project(_matrix(batch.column("x"), np.int64), k)[:, live]
            mean = w.mean(axis=0)
            held = [together([*held, (len(w), mean, (w - mean).T @ (w - mean))])]
        for n, mean, products in held:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])], ["part", "n", "mean", "products"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n, mean, products = together([(r.n, np.asarray(r.mean), np.asarray(r.products).reshape(len(live), -1)) for r in rows.sort_values("part").itertuples()])
        return pd.DataFrame([(int(rows["part"].min()) // FAN, n, mean, products.ravel())], columns=["part", "n", "mean", "products"])

    parts = distinct.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(tidied(summed), schema)
    last = _merged(parts, merge, schema).first()
    return float(np.abs(np.reshape(last["products"], (len(live), -1)) / last["n"] - np.eye(len(live))).max())


def whiten(rows: DataFrame, model: Whitener | None, k: int) -> DataFrame:
    """(vec_id, n, deviation, whitened array<double>) of rows with integer vectors; the array has k entries, or as many as there are dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64)
            with np.errstate(over="ignore"):
                off = x * model.n - model.sums
                exact = (off * off).sum(axis=1)  # modulo 2**64, so exact wherever the sum is below 2**63
            near = ((x.astype(float) * model.n - model.sums) ** 2).sum(axis=1)
            w = model.project(x, min(k, x.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.full(len(x), model.n)), pa.array(exact, mask=near >= 2.0**63), lists], ["vec_id", "n", "deviation", "whitened"])

    schema = "vec_id long, n long, deviation long, whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(tidied(run), schema)


def whitened(embeddings: DataFrame, k: int) -> tuple[DataFrame, Whitener | None]:
    """Fit on the distinct vectors of a table and whiten all its rows; the model has every component and the error of the first k."""
    rows = integers(embeddings)
    distinct = stored(rows.select("x").distinct())
    model = fit(distinct)
    if model is not None:
        model.identity_error = identity_error(distinct, model, k)
    return whiten(rows, model, k), model


def components(embeddings: DataFrame, k: int) -> DataFrame:
    """One row for each row with a vector and component from 1 to k: vec_id, component, n, deviation, whitened, explained, identity_error."""
    done, model = whitened(embeddings, k)
    shares = [] if model is None else [float(e / model.total) if live else 0.0 for e, live in zip(model.eigenvalues[:k], model.live[:k], strict=True)]
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("component")) if shares else F.lit(None).cast("double")
    long = done.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("nth", "whitened")).withColumn("component", (F.col("nth") + 1).cast("int"))
    error = F.lit(None if model is None else model.identity_error).cast("double")
    return long.select("vec_id", "component", "n", "deviation", "whitened", share.alias("explained"), error.alias("identity_error"))
