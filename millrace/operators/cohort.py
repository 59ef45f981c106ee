"""Filtering, ordering, paging, facets and top-n selections over cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(df: DataFrame, slices: DataFrame, key: str) -> DataFrame:
    """Rows whose slice is in `slices`."""
    return df.join(slices.select(key).distinct(), key, "left_semi")


def same_text(a: Column, b: str) -> Column:
    return F.lower(a) == F.lit(b.lower())


def contains_text(a: Column, b: str) -> Column:
    return F.contains(F.lower(a), F.lit(b.lower()))


def event_scope(events: DataFrame, provider: str, slices: DataFrame, key: str, player: int | None = None, team: int | None = None) -> DataFrame:
    """Events of one provider in the slices, of a player or a team if asked for."""
    rows = in_scope(events.where(F.col("provider") == provider), slices, key)
    for column, wanted in (("player", player), ("team", team)):
        rows = rows.where(F.col(column) == wanted) if wanted is not None else rows
    return rows


def at_least(minutes: Column, requested: int, floor: int = 0) -> Column:
    """minutes >= the larger bound; no bound at all keeps nulls."""
    bound = max(requested, floor)
    return minutes >= bound if bound > 0 else F.lit(True)


def ordered(df: DataFrame, key: str, ties: list[str], allowed: set[str]) -> DataFrame:
    """Sort by `key` (a leading minus reverses), nulls last either way, then by ties."""
    name = key.lstrip("-")
    if name not in allowed:
        raise ValueError(f"cannot sort by {name}")
    first = F.col(name).desc_nulls_last() if key.startswith("-") else F.col(name).asc_nulls_last()
    return df.orderBy(first, *(F.col(t).asc_nulls_last() for t in ties))


def page(df: DataFrame, number: int, size: int, most: int = 500) -> DataFrame:
    """One page of an ordered table; numbers start at 1 and sizes are held within 1 and `most`."""
    size = min(max(size, 1), most)
    return df.offset((max(number, 1) - 1) * size).limit(size)


def guarded(df: DataFrame, metrics: list[str], known: set[str], most_rows: int = 20_000, most_cells: int = 250_000, most_metrics: int = 40) -> tuple[DataFrame, list[str]]:
    """The cohort and its metrics (first mentions, in order), or an error beyond the limits."""
    asked = list(dict.fromkeys(metrics))
    if unknown := [m for m in asked if m not in known]:
        raise ValueError(f"unknown metrics: {unknown}")
    if len(asked) > most_metrics:
        raise ValueError(f"more than {most_metrics} metrics")
    n = df.limit(most_rows + 1).count()  # no more is read than decides
    if n > most_rows or n * len(asked) > most_cells:
        raise ValueError("the cohort is too large")
    return df, asked


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value: distinct non-null values of each column."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "facet", "value")
    return long.where("value is not null").distinct()


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def newest(df: DataFrame, keys: list[str], order: list[Column], keep: int) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): the first `keep` rows of each key by order, and the others."""
    placed = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.where(F.col("__n") <= keep).drop("__n"), placed.where(F.col("__n") > keep).drop("__n")


def top_with_pins(df: DataFrame, order: list[Column], n: int, pins: DataFrame, key: str) -> DataFrame:
    """The first n rows, and pinned rows that are not among them; pinned tells which were asked for."""
    top = df.orderBy(*order).limit(n)
    pinned = df.join(pins.select(key).distinct(), key, "left_semi")
    rest = pinned.join(top.select(key), key, "left_anti")
    asked = pins.select(F.col(key).alias("__pin")).distinct()
    both = top.unionByName(rest)
    return both.join(asked, F.col(key) == F.col("__pin"), "left").withColumn("pinned", F.col("__pin").isNotNull()).drop("__pin")


def capped(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows up to `most`, each with the true total and whether any were left out."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > most)  # one row


def in_request_order(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of the asked ids, numbered in the order asked; unknown ids are left out."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    asked = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"`{key}` {kind}, place int")
    return df.join(F.broadcast(asked), key)
