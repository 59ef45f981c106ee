"""Events on a scaled pitch: grids, zone flows, and rules on coordinates (0 to 10000 in both axes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = 10_000


def encode(value: Column) -> Column:
    """0..100 to 0..10000, halves up; null outside the range or not finite."""
    scaled = F.round(value.try_cast("decimal(20,10)") * 100, 0).cast("int")
    return F.when(scaled.between(0, FULL), scaled)


def cell(x: Column, y: Column, columns: int, rows: int) -> Column:
    """Column-major number of a grid cell; the far edge belongs to the last cell; null without a place."""
    at = lambda v, n: F.when(v.isNotNull(), F.least(F.floor(v * n / FULL), F.lit(n - 1)))
    return (at(x, columns) * rows + at(y, rows)).cast("int")


def goal_distance(x: Column, y: Column, length: float = 105.0, width: float = 68.0) -> Column:
    return F.sqrt(F.pow((F.lit(float(FULL)) - x) / FULL * length, F.lit(2.0)) + F.pow((F.lit(FULL / 2.0) - y) / FULL * width, F.lit(2.0)))


def progressive(x: Column, y: Column, end_x: Column, end_y: Column) -> Column:
    """Brings play nearer to goal by 30 m within the own half, 15 m across the middle, 10 m in the other half."""
    gain = goal_distance(x, y) - goal_distance(end_x, end_y)
    half = FULL / 2
    return gain >= F.when((x < half) & (end_x < half), 30.0).when((x < half) & (end_x >= half), 15.0).otherwise(10.0)


def in_box(x: Column, y: Column) -> Column:
    return (x >= 8350) & y.between(2110, 7890)


def enters_box(x: Column, y: Column, end_x: Column, end_y: Column, success: Column) -> Column:
    return success & ~in_box(x, y) & in_box(end_x, end_y)


def enters_final_third(x: Column, end_x: Column, success: Column) -> Column:
    return success & (x < 6670) & (end_x >= 6670)


def dense_grid(events: DataFrame, keys: list[str], x: str, y: str, columns: int = 12, rows: int = 8) -> DataFrame:
    """keys, cell, n, share for every cell of every key, empty ones included."""
    counts = events.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, cell(F.col(x), F.col(y), columns, rows).alias("cell")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    every = totals.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(columns * rows - 1))))
    return every.join(counts, [*keys, "cell"], "left").select(*keys, "cell", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def zone_flow(events: DataFrame, keys: list[str], start: str, end: str, success: Column, zones: int) -> DataFrame:
    """keys, from_zone, to_zone, attempts, completions, rate over all pairs of zones; null zones are skipped."""
    counts = events.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*keys, F.col(start).alias("from_zone"), F.col(end).alias("to_zone")).agg(F.count("*").alias("attempts"), F.count_if(success).alias("completions"))
    every = counts.select(*keys).distinct().withColumn("from_zone", F.explode(F.sequence(F.lit(0), F.lit(zones - 1)))).withColumn("to_zone", F.explode(F.sequence(F.lit(0), F.lit(zones - 1))))
    full = every.join(counts, [*keys, "from_zone", "to_zone"], "left").na.fill(0, ["attempts", "completions"])
    return full.withColumn("rate", F.when(F.col("attempts") > 0, F.col("completions") / F.col("attempts")))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a line segment."""
    length = F.pow(bx - ax, F.lit(2.0)) + F.pow(by - ay, F.lit(2.0))
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length))).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), F.lit(2.0)) + F.pow(py - (ay + t * (by - ay)), F.lit(2.0)))
