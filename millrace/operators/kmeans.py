"""Many k-means fits at once: a round of all fits is one pass over the rows and one sum of what its tasks found.

The driver holds the centres, which never grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .steps import ship

#: sums of more tasks than these are added up by tasks, not by the driver
DIRECT_PARTS = 64
#: vectors with more entries are held against centres by a product of matrices
NARROW = 7


@dataclass
class Fit:
    """A k-means fit of one family; the cost is that of the round that it was last in."""

    family: str
    centres: np.ndarray
    cost: float = np.inf
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    settled: bool = False


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centres."""
    if x.shape[1] > NARROW:
        origin = centres.mean(axis=0)
        a, b = x - origin, centres - origin
        return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1), 0)
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centres[:, j]) ** 2
    return out


def by_family(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(family, places, matrix) of a batch of family and v."""
    coded = batch.column("family").dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    for f in sorted(names):
        at = np.flatnonzero(codes == names.index(f))
        yield f, at, matrix(batch.column("v").take(pa.array(at)))


def summed(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], parts: int | None = None) -> dict[int, np.ndarray]:
    """Arrays by number, added up over all partitions of the rows, which are `parts` if that is known."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = work(batches)
        values = pa.array([v.ravel().tolist() for v in told.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.int32()), values], ["model", "values"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group["model"].iloc[0], np.sum(np.stack(group["values"].to_numpy()), axis=0))], columns=["model", "values"])

    schema = "model int, values array<double>"
    told = rows.mapInArrow(run, schema)
    if parts is None or parts > DIRECT_PARTS:
        told = told.groupBy("model").applyInPandas(add, schema)
    out: dict[int, np.ndarray] = {}
    for r in told.toArrow().to_pylist():  # one array for each model, or DIRECT_PARTS of them at most
        values = np.array(r["values"])
        out[r["model"]] = out[r["model"]] + values if r["model"] in out else values
    return out


def round_of(rows: DataFrame, models: list[Fit], asked: list[int], parts: int | None = None) -> dict[int, np.ndarray]:
    """By number of a fit, for each centre the number of rows nearest to it, their cost, and their sum. rows: family, v."""
    families: dict[str, list[int]] = {}
    for i in asked:
        families.setdefault(models[i].family, []).append(i)
    held = {f: (own, np.cumsum([0, *(len(models[i].centres) for i in own)]), np.concatenate([models[i].centres for i in own])) for f, own in families.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = {f: np.zeros((len(c), c.shape[1] + 2)) for f, (_, _, c) in held.items()}
        for batch in batches:
            for f, _, x in by_family(batch):
                if f not in held:
                    continue
                own, ends, centres = held[f]
                d, one, at = squared(x, centres), np.zeros((len(x), len(centres))), np.arange(len(x))
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    one[at, a + d[:, a:b].argmin(axis=1)] = 1.0
                out[f][:, 0] += one.sum(axis=0)
                out[f][:, 1] += (one * d).sum(axis=0)
                out[f][:, 2:] += one.T @ x
        return {i: out[f][a:b] for f, (own, ends, _) in held.items() for i, a, b in zip(own, ends[:-1], ends[1:], strict=True)}

    return {i: v.reshape(len(models[i].centres), -1) for i, v in summed(rows.select("family", "v"), work, parts).items()}


def advance(rows: DataFrame, models: list[Fit], rounds: int, settles: Callable[[np.ndarray], bool], parts: int | None = None) -> None:
    """Move the centres of all fits to the means of their rows, so many rounds at most; a fit is left alone once what its centres moved by settles it. A centre without rows stays."""
    for _ in range(rounds):
        moving = [i for i, m in enumerate(models) if not m.settled]
        if not moving:
            break
        for i, told in round_of(rows, models, moving, parts).items():
            m, n = models[i], told[:, 0]
            centres = np.where(n[:, None] > 0, told[:, 2:] / np.maximum(n, 1)[:, None], m.centres)
            m.settled, m.cost = settles(centres - m.centres), float(told[:, 1].sum())
            m.centres = centres
