"""Rates, ratios, fallbacks and roundings as Column builders; nothing here raises on zero or null."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def per_unit(total: Column, exposure: Column, unit: float = 90.0) -> Column:
    """total for each `unit` of exposure; null unless exposure is positive."""
    return F.when(exposure > 0, total * F.lit(unit) / exposure)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null where either is null or whole is 0."""
    return F.when(whole != 0, part / whole)


def sum_required(*parts: Column) -> Column:
    """Sum that is null if any part is."""
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def shrunk_delta(actual: Column, expected: Column, trials: Column, prior: float = 35.0) -> Column:
    """Mean surplus for each trial, drawn towards 0 by `prior` pseudo-trials."""
    return F.when(trials > 0, (actual - expected) / trials * (trials / (trials + F.lit(prior))))


def share_of_known(hits: Column, misses: Column, trials: Column) -> Column:
    """hits / (hits + misses); without those, hits / trials, at most 1; null without hits."""
    known = hits + misses
    return F.when(known > 0, hits / known).when((trials > 0) & hits.isNotNull(), F.least(F.lit(1.0), hits / trials))


def count_or_null(column: Column, slice_keys: list[str]) -> Column:
    """A missing count is 0 where the slice records the field at all, else null.

    A window for small slices; distribution.zero_where_recorded() does the same for slices of any size.
    """
    return F.when(F.count(column).over(Window.partitionBy(*slice_keys)) > 0, F.coalesce(column, F.lit(0)))


def rescale(value: Column, minutes: Column, mode: str, whole: bool = False, unit: float = 90.0) -> Column:
    """A total as a rate (`rate`) or a rate as a total (`full`); whole numbers go half to even."""
    out = F.when(minutes > 0, value * unit / minutes if mode == "rate" else value * minutes / unit)
    return F.bround(out) if whole else out


def half_up(value: Column) -> Column:
    """Rounding of halves towards plus infinity."""
    return F.floor(value + 0.5)


def decay_score(distance: Column, scale: Column) -> Column:
    return F.lit(100.0) * F.exp(-distance / scale)


def rank_percent(rank: Column, n: Column) -> Column:
    """100 for the first of n, 0 for the last."""
    return F.when(n > 1, (n - rank) / (n - 1) * 100.0).otherwise(F.lit(100.0))


def flip(percentile: Column, lower_is_better: Column) -> Column:
    return F.when(lower_is_better, 100 - percentile).otherwise(percentile)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    tens, ones = n % 100, n % 10
    ending = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def safe_int(text: Column) -> Column:
    """Number text to a whole number, null on failure."""
    return text.try_cast("double").try_cast("long")


def pick_nonzero(first: Column, second: Column) -> Column:
    """first, unless it is null or 0."""
    return F.when(first.isNull() | (first == 0), second).otherwise(first)
