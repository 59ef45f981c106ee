"""Metric and score specifications that compile to columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.distribution import unpivot, winsorized_zscore
from ..operators.ranking import midrank_percentile


@dataclass(frozen=True)
class Metric:
    """A named expression; lower_is_better turns its percentile round in displays."""

    name: str
    column: Callable[[], Column]
    lower_is_better: bool = False


@dataclass(frozen=True)
class Score:
    """A weighted sum of metric z-scores; penalties are subtracted."""

    name: str
    weights: dict[str, float]
    penalties: dict[str, float] = field(default_factory=dict)

    def column(self) -> Column:
        """Null if any part is."""
        plus = [F.col(m) * F.lit(w) for m, w in self.weights.items()]
        minus = [F.col(m) * F.lit(-w) for m, w in self.penalties.items()]
        return sum(plus[1:] + minus, plus[0])

    @property
    def metrics(self) -> list[str]:
        return [*self.weights, *self.penalties]


def with_metrics(df: DataFrame, metrics: list[Metric], keep: list[str]) -> DataFrame:
    return df.select(*keep, *(m.column().alias(m.name) for m in metrics))


def scorecard(df: DataFrame, key: str, group: str, metrics: list[str], scores: list[Score], eligible: Column) -> DataFrame:
    """key, group, each score and its percentile within the group, for eligible rows.

    All metrics go through one unpivoted pass of quantiles and moments.
    """
    rows = df.where(eligible)
    long = winsorized_zscore(unpivot(rows, [key, group], metrics), [group, "metric"], "value", "z")
    z = lambda m: F.max(F.when(F.col("metric") == m, F.col("z"))).alias(m)
    wide = long.groupBy(key, group).agg(*map(z, metrics))
    raw = unpivot(wide.select(key, group, *(s.column().alias(s.name) for s in scores)), [key, group], [s.name for s in scores])
    ranked = midrank_percentile(raw, [group, "metric"], "value", "pct")
    back = [F.max(F.when(F.col("metric") == s.name, F.col(c))).alias(s.name + tail) for s in scores for c, tail in (("value", ""), ("pct", "_percentile"))]
    return ranked.groupBy(key, group).agg(*back)
