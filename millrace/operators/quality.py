"""Gates, ledgers and reports on data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(checks: dict[str, Column]) -> Column:
    """Codes of the checks that fail (false or null), in order."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items())), lambda x: x.isNotNull())


def gate(df: DataFrame, keys: list[str], measures: dict[str, Column], checks: dict[str, Column]) -> DataFrame:
    """keys, measures, failed (codes) and passed, by group."""
    out = df.groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))
    return out.withColumn("failed", reasons(checks)).withColumn("passed", F.size("failed") == 0)


def share_level(part: Column, whole: Column, warn: float = 1.0, fail: float = 5.0) -> Column:
    """ok, warn or fail by an exact decimal percentage."""
    percent = part.cast("decimal(20,0)") * 100
    over = lambda limit: percent > whole.cast("decimal(20,0)") * F.lit(limit).cast("decimal(10,4)")
    return F.when(over(fail), "fail").when(over(warn), "warn").otherwise("ok")


def volumes(df: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Totals overall and by each of the levels alone."""
    sets = [[], *([x] for x in levels)]
    level = F.when(F.grouping(levels[0]) == 0, levels[0])
    for x in levels[1:]:
        level = level.when(F.grouping(x) == 0, x)
    return df.groupingSets(sets, *levels).agg(level.otherwise("all").alias("level"), *(c.alias(n) for n, c in measures.items()))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """check, value, n: values that more than one row has, for each column."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "check", "value")
    return long.where("value is not null").groupBy("check", "value").agg(F.count("*").alias("n")).where("n > 1")


def memberships(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Keys that hold more than one member, with their number."""
    return df.groupBy(*keys).agg(F.countDistinct(member).alias("members")).where("members > 1")


def ledger(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, reason: one row for each check a row fails."""
    return df.select(key, F.explode(reasons(checks)).alias("reason"))
