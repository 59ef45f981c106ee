"""Exact ranks, percentiles and quantiles that scale past one task for each group.

A window over a few large groups would sort each group in one task.  Here values
are first counted by (group, value); an order-preserving code of a value's binary
exponent and leading bits deals the distinct values into buckets; a bucket of more
than BUCKET_VALUES values (times, ids, years: numbers that lie close together) is parted
evenly between its smallest and largest one; totals of parts, a table of groups times
parts, give each part's offset; and only then does a window run, inside a part.  All
of these are exact figures of the data, so a task done again finds the same parts.

Defined results: null values have no place; null groups are groups of their own;
infinities are values like others, and NaN counts as one value above all others,
as Spark sorts it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 32  # buckets for each doubling
BUCKET_VALUES = 20_000
_BEYOND = (1100 + 1100) * STEPS  # above the code of any finite value


def magnitude(value: Column, steps: int = STEPS) -> Column:
    """A whole number that never falls as the value grows."""
    value = value.cast("double")
    size = F.abs(value)
    power = F.floor(F.log2(size))
    code = (power + 1100) * steps + F.floor((size / F.pow(F.lit(2.0), power) - 1) * steps)
    code = F.when(size == float("inf"), F.lit(_BEYOND * steps // STEPS)).otherwise(code)
    return F.when(F.isnan(value), F.lit(_BEYOND * steps // STEPS + 1)).when(value == 0, F.lit(0)).when(value > 0, code).otherwise(-code).cast("int")


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which nulls meet nulls (and NaN meets NaN); the columns of `on` come from the left side."""
    if not on:
        return left.crossJoin(right)  # callers pass one row of totals
    there = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on))
    return left.join(there, same, how).drop(*(f"__on_{c}" for c in on))


def cumulative_counts(df: DataFrame, groups: list[str], value: str, weight: str | None = None) -> DataFrame:
    """groups, value, n (rows of that value), below (rows of smaller ones), total (rows of the group); nulls left out.

    With a weight, its sums stand for numbers of rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    coded = counts.withColumn("bucket", magnitude(F.col(value)))
    number = F.col(value).cast("double")
    ends = coded.groupBy(*groups, "bucket").agg(F.ceil(F.count("*") / BUCKET_VALUES).alias("__parts"), F.min(number).alias("__low"), (F.max(number) - F.min(number)).alias("__wide"))
    part = F.when((F.col("__parts") > 1) & (F.col("__wide") > 0), F.floor((number - F.col("__low")) / F.col("__wide") * F.col("__parts"))).otherwise(0)
    dealt = join_same(coded, ends, [*groups, "bucket"]).withColumn("part", part).drop("__parts", "__low", "__wide")
    totals = dealt.groupBy(*groups, "bucket", "part").agg(F.sum("n").alias("in_part"))
    over = Window.partitionBy(*groups)
    before = over.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "bucket", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"), F.sum("in_part").over(over).alias("total"))
    inside = Window.partitionBy(*groups, "bucket", "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return join_same(dealt, offsets, [*groups, "bucket", "part"]).select(*groups, value, "n", (F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"), "total")


def midrank_percentile(df: DataFrame, groups: list[str], value: str, out: str, eligible: Column | None = None) -> DataFrame:
    """Adds mid-rank percentiles ((below + up to) / 2 / total * 100) among eligible rows with a value; null elsewhere."""
    fits = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    marked = df.withColumn("__fits", fits & F.col(value).isNotNull())
    ranks = cumulative_counts(marked.where("__fits").select(*groups, value), groups, value)
    pct = ranks.select(*(F.col(g).alias(f"__{g}") for g in groups), F.col(value).alias("__v"), ((F.col("below") + F.col("below") + F.col("n")) / 2.0 / F.col("total") * 100.0).alias(out))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    return marked.join(pct, [F.col("__fits"), F.col(value) == F.col("__v"), *same], "left").drop("__fits", "__v", *(f"__{g}" for g in groups))


def external_percentile(probes: DataFrame, population: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Mid-rank percentiles of probes within a population that need not contain them."""
    both = probes.select(*groups, value).distinct().withColumn("__pop", F.lit(0)).unionByName(population.select(*groups, value).withColumn("__pop", F.lit(1)))
    ranked = cumulative_counts(both, groups, value, weight="__pop")
    pct = ranked.select(*groups, value, F.when(F.col("total") > 0, (F.col("below") + F.col("below") + F.col("n")) / 2.0 / F.col("total") * 100.0).alias(out))
    return join_same(probes, pct, [*groups, value], "left")


def quantiles(df: DataFrame, groups: list[str], value: str, probes: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column for each probe; groups without values have no row."""
    ranks = cumulative_counts(df, groups, value)
    picks = []
    for name, q in probes.items():
        place = (F.col("total") - 1) * F.lit(float(q))
        low = F.floor(place)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        lo, hi = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(F.least(low + 1, F.col("total") - 1)), F.col(value)))
        part = F.max(place - low)
        picks.append(F.when((part == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * part).alias(name))
    return ranks.groupBy(*groups).agg(*picks)


def competition_rank(df: DataFrame, groups: list[str], value: str, out: str, descending: bool = True) -> DataFrame:
    """1, 1, 3 ...; null values get no rank."""
    ranks = cumulative_counts(df, groups, value)
    place = (F.col("total") - F.col("below") - F.col("n") + 1) if descending else (F.col("below") + 1)
    return join_same(df, ranks.select(*groups, value, place.alias(out)), [*groups, value], "left")


def ordinal_rank(df: DataFrame, groups: list[str], value: str, ties: list[Column], out: str, descending: bool = True) -> DataFrame:
    """1, 2, 3 ...: equal values are placed by `ties`, among themselves only; null values get no rank."""
    placed = competition_rank(df, groups, value, "__place", descending)
    nth = F.row_number().over(Window.partitionBy(*groups, value).orderBy(*ties))
    return placed.withColumn(out, F.col("__place") + nth - 1).drop("__place")


def tolerant_rank(df: DataFrame, groups: list[str], value: str, out: str, tolerance: float = 1e-9) -> DataFrame:
    """Competition rank, largest first, in which a value within `tolerance` of the next larger one shares its rank, so ties can chain.

    The tolerance is relative above 1 and absolute below.  Chains are followed
    inside a bucket; what goes from bucket to bucket is each one's smallest value
    and the last place that opened a chain.
    """
    ranks = cumulative_counts(df, groups, value)
    rows = ranks.select(*groups, value, (F.col("total") - F.col("below") - F.col("n") + 1).alias("__place")).withColumn("__bucket", -magnitude(F.col(value)))
    within = Window.partitionBy(*groups, "__bucket").orderBy(F.desc(value))
    by_bucket = Window.partitionBy(*groups).orderBy("__bucket")
    ends = rows.groupBy(*groups, "__bucket").agg(F.min(value).alias("__end"))
    ends = ends.select(*groups, "__bucket", F.lag("__end").over(by_bucket).alias("__last"))
    linked = join_same(rows, ends, [*groups, "__bucket"]).withColumn("__before", F.coalesce(F.lag(value).over(within), "__last"))
    bound = F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(F.col(value)), F.abs(F.col("__before")))
    opens = F.col("__before").isNull() | (F.abs(F.col(value) - F.col("__before")) > bound)
    marked = linked.withColumn("__open", F.when(opens, F.col("__place")))
    carried = marked.groupBy(*groups, "__bucket").agg(F.max("__open").alias("__opened"))
    carried = carried.select(*groups, "__bucket", F.max("__opened").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    inside = F.max("__open").over(within.rowsBetween(Window.unboundedPreceding, 0))
    places = join_same(marked.withColumn("__inside", inside), carried, [*groups, "__bucket"]).select(*groups, value, F.coalesce("__inside", "__carried").alias(out))
    return join_same(df, places, [*groups, value], "left")


def rank_sum(df: DataFrame, keys: list[str], values: list[str], tie: str, ordinal: bool = False) -> DataFrame:
    """Adds rank_<value> for each value (largest first) and rank_sum; rows that lack any value are left out."""
    out = df.dropna(subset=values)
    for v in values:
        out = ordinal_rank(out, keys, v, [F.col(tie)], f"rank_{v}") if ordinal else competition_rank(out, keys, v, f"rank_{v}")
    return out.withColumn("rank_sum", sum((F.col(f"rank_{v}") for v in values), F.lit(0)))


def best_and_worst(df: DataFrame, keys: list[str], value: str, tie: str, n: int = 2) -> DataFrame:
    """The n best and n worst of each group as side; a row that is among the best is not among the worst.

    A bound on row numbers lets every task keep its own n first rows of a group before any shuffle.
    """

    def first(order: list[Column]) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.where(F.col(value).isNotNull()).withColumn("__n", nth).where(F.col("__n") <= n).drop("__n")

    best, worst = first([F.desc(value), F.col(tie)]), first([F.asc(value), F.desc(tie)])
    left = worst.join(best.select(*(F.col(k).alias(f"__{k}") for k in [*keys, tie])), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, tie]], "left_anti")
    return best.withColumn("side", F.lit("best")).unionByName(left.withColumn("side", F.lit("worst")))
