"""Winsorised moments, robust scaling, histograms and coverage.

Null groups are groups of their own; null values take no part in statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import join_same, midrank_percentile, quantiles


def _back(df: DataFrame, stats: DataFrame, groups: list[str]) -> DataFrame:
    return join_same(df, stats, groups, "left")


def winsorized_moments(df: DataFrame, groups: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """groups, low, high, mean, dev: two quantiles, and mean and population deviation of values held within them.

    Everything is told from numbers of equal values, so rows are read for those only.  The sums are of distances from
    the lower quantile: between two quantiles they cancel little, and equal values give a deviation of exactly 0.
    """
    bounds = quantiles(df, groups, value, {"low": low, "high": high})
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    over = F.greatest(F.col("low"), F.least(F.col("high"), F.col(value))) - F.col("low")
    sums = _back(counts, bounds, groups).withColumn("over", over).groupBy(*groups).agg(F.first("low").alias("low"), F.first("high").alias("high"), *(F.sum(x).alias(a) for a, x in (("n", F.col("n")), ("one", F.col("n") * F.col("over")), ("two", F.col("n") * F.col("over") * F.col("over")))))
    mean = F.col("one") / F.col("n")
    return sums.select(*groups, "low", "high", (F.col("low") + mean).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("two") / F.col("n") - mean * mean)).alias("dev"))


def winsorized(value: Column, low: Column, high: Column, mean: Column, dev: Column) -> Column:
    """(value held within the two quantiles - mean of those) / population deviation; 0 where that is 0."""
    return F.when(value.isNotNull(), F.when(dev > 0, (F.greatest(low, F.least(high, value)) - mean) / dev).otherwise(0.0))


def winsorized_zscore(df: DataFrame, groups: list[str], value: str, out: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Adds winsorized() of each row's value within its group."""
    parts = ["low", "high", "mean", "dev"]
    told = winsorized_moments(df, groups, value, low, high).withColumnsRenamed({c: f"__{c}" for c in parts})
    return _back(df, told, groups).withColumn(out, winsorized(F.col(value), *(F.col(f"__{c}") for c in parts))).drop(*(f"__{c}" for c in parts))


def robust_scaled(df: DataFrame, groups: list[str], value: str, out: str, clip: float = 5.0) -> DataFrame:
    """Median-imputed value, centred at the median over the interquartile range (else deviation, else 1), clipped."""
    q = quantiles(df, groups, value, {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75})
    dev = df.groupBy(*groups).agg(F.stddev_pop(value).alias("__dev"))
    scale = F.when(F.col("__q3") > F.col("__q1"), F.col("__q3") - F.col("__q1")).when(F.col("__dev") > 0, F.col("__dev")).otherwise(1.0)
    both = _back(_back(df, q, groups), dev, groups)
    scaled = (F.coalesce(F.col(value), F.col("__q2")) - F.col("__q2")) / scale
    return both.withColumn(out, F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled))).drop("__q1", "__q2", "__q3", "__dev")


def summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, low, high, p25, p50, p75 by group."""
    q = quantiles(df, groups, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    ends = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return _back(ends, q, groups)


def histogram(df: DataFrame, groups: list[str], value: str, most: int = 16) -> DataFrame:
    """Equal-width bins (at most `most`, or one for each row if fewer; one if all are equal), empty bins included."""
    known = df.where(F.col(value).isNotNull())
    ends = known.groupBy(*groups).agg(F.count("*").alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"))
    ends = ends.withColumn("bins", F.when(F.col("low") == F.col("high"), 1).otherwise(F.least(F.lit(most), F.col("rows"))).cast("int"))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    at = F.when(F.col("bins") == 1, 0).otherwise(F.least(F.floor((F.col(value) - F.col("low")) / width), F.col("bins") - 1)).cast("int")
    counts = _back(known, ends, groups).withColumn("bin", at).groupBy(*groups, "bin").agg(F.count("*").alias("n"))
    every = ends.select(*groups, "low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return join_same(every, counts, [*groups, "bin"], "left").select(*groups, "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"), F.coalesce("n", F.lit(0)).alias("n"))


def described(df: DataFrame, groups: list[str], value: str, most: int = 16) -> DataFrame:
    """summary() with `bins`, the histogram's counts in order of its bins (at most `most` a group)."""
    bins = histogram(df, groups, value, most).groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda b: b["n"]).alias("bins"))
    return _back(summary(df, groups, value), bins, groups)


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: one row for each metric, so that one pass serves them all."""
    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def coverage(df: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """groups, metric, n, covered: share of rows with a value."""
    long = unpivot(df, groups, metrics)
    return long.groupBy(*groups, "metric").agg(F.count("*").alias("n"), F.avg(F.col("value").isNotNull().cast("double")).alias("covered"))


def coverage_class(covered: Column, core: float = 0.8, low: float = 0.0) -> Column:
    return F.when(covered >= core, "available").when(covered > low, "low").otherwise("unavailable")


def weighted_coverage(df: DataFrame, groups: list[str], share: str, weight: str) -> DataFrame:
    """Coverage over slices by weight; a slice without the metric counts as 0."""
    return df.groupBy(*groups).agg((F.sum(F.coalesce(share, F.lit(0.0)) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("covered"))


def robust_extent(df: DataFrame, groups: list[str], value: str, trim: float = 0.03, pad: float = 0.14) -> DataFrame:
    """Axis bounds: inner quantiles, widened by a share of their distance."""
    q = quantiles(df, groups, value, {"a": trim, "b": 1 - trim})
    return q.select(*groups, (F.col("a") - pad * (F.col("b") - F.col("a"))).alias("axis_low"), (F.col("b") + pad * (F.col("b") - F.col("a"))).alias("axis_high"))


def with_availability(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_known") -> DataFrame:
    """Adds <column><suffix>: whether the slice has any value of the column.  One grouped sum serves all columns."""
    return _back(df, df.groupBy(*keys).agg(*((F.count(c) > 0).alias(c + suffix) for c in columns)), keys)


def zero_where_recorded(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """A missing count is 0 where the slice records the field at all, else null."""
    known = with_availability(df, keys, [column], "__known")
    return known.withColumn(out, F.when(F.col(f"{column}__known"), F.coalesce(column, F.lit(0)))).drop(f"{column}__known")


def min_max_heat(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """0 to 100 between a group's extremes, 50 if they are equal."""
    ends = _back(df, df.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high")), keys)
    share = (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")) * 100
    heat = F.when(F.col("__high") == F.col("__low"), 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)))
    return ends.withColumn(out, F.when(F.col(value).isNotNull(), heat)).drop("__low", "__high")


def with_percentiles(df: DataFrame, keys: list[str], group: str, columns: dict[str, str], eligible: Column) -> DataFrame:
    """Adds mid-rank percentiles within the group among eligible rows: one pass for all columns (column -> name of its percentile).

    keys identify a row.
    """
    long = unpivot(df.where(F.coalesce(eligible, F.lit(False))), [*keys, group], list(columns))
    ranked = midrank_percentile(long, [group, "metric"], "value", "pct")
    wide = ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == c, F.col("pct"))).alias(out) for c, out in columns.items()))
    return join_same(df, wide, keys, "left")
