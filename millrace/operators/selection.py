"""Which slices, matches, rows and labels a request covers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scope codes, the five competitions of the narrower one, and the threshold without any slice.
EVERY, FIVE = "ALL", "BIG5"
FIVE_CODES = ["ENG1", "GER1", "SPA1", "FRA1", "ITA1"]
DEFAULT_MINUTES = 450


def public_slices(slices: DataFrame) -> DataFrame:
    """Active, published slices."""
    return slices.where(F.col("is_active") & F.col("is_published"))


def domestic(slices: DataFrame) -> DataFrame:
    """Slices of domestic leagues that count towards aggregates."""
    return slices.where((F.col("competition_type") == "domestic_league") & F.col("in_aggregates"))


def scope(slices: DataFrame, code: str, labels: list[str], five: list[str] = FIVE_CODES) -> DataFrame:
    """Public slices of a scope: one competition, all domestic ones, or the five.

    labels: the season labels that the request stands for.  A single competition
    with several slices, and a scope without any, are errors.
    """
    code = code.strip().upper()
    if not code or not labels:
        raise ValueError("a competition and a season are needed")
    rows = public_slices(slices).where(F.col("season").isin(*labels))
    if code in (EVERY, FIVE):
        rows = domestic(rows)
        rows = rows.where(F.col("code").isin(*five)) if code == FIVE else rows
    else:
        rows = rows.where(F.upper("code") == code)
    n = len(rows.limit(2).collect())
    if not n:
        raise ValueError("unknown competition and season")
    if n > 1 and code not in (EVERY, FIVE):
        raise ValueError(f"more than one slice of {code}")
    return rows


def least_minutes(slices: DataFrame) -> DataFrame:
    """One row: the smallest threshold of the slices."""
    return slices.agg(F.coalesce(F.min("least_minutes"), F.lit(DEFAULT_MINUTES)).alias("least_minutes"))


def in_scope(code: str, season: str, five: list[str] = FIVE_CODES) -> Column:
    """Whether a membership (competition, season, aggregate_season, competition_type, in_aggregates) is in a scope."""
    wide = code in (EVERY, FIVE)
    labelled = (F.coalesce("aggregate_season", "season") if wide else F.col("season")) == season
    inland = (F.col("competition_type") != "continental_cup") & F.coalesce("in_aggregates", F.lit(True))
    wider = inland if code == EVERY else inland & F.col("competition").isin(*five) if code == FIVE else F.lit(False)
    return F.coalesce(labelled & ((F.col("competition") == code) | wider), F.lit(False))


def membership_priority(memberships: DataFrame, key: str, code: str, season: str) -> DataFrame:
    """key, priority: 0 with the exact slice, 1 with one in the scope, 2 with the competition in another season, else 3."""
    exact = (F.col("competition") == code) & (F.col("season") == season)
    level = F.when(exact, 0).when(in_scope(code, season), 1).when(F.col("competition") == code, 2).otherwise(3)
    return memberships.groupBy(key).agg(F.min(level).alias("priority"))


def completed_matches(matches: DataFrame, *, match_id: int | None = None, last: int | None = None, first_day: dt.date | None = None, last_day: dt.date | None = None, limit: int | None = None) -> DataFrame:
    """Completed matches in order of kick-off (unknown ones first) and id, by one of: an id, the last few, a range of days and a limit."""
    done = matches.where(F.lower(F.trim("status")) == "completed")
    order = [F.col("kickoff").asc_nulls_first(), F.col("match_id").asc()]
    if match_id is not None:
        return done.where(F.col("match_id") == match_id)
    if last is not None:
        return done.orderBy(F.col("kickoff").desc_nulls_last(), F.col("match_id").desc()).limit(last).orderBy(*order)
    if first_day is not None and last_day is not None:
        done = done.where(F.to_date("kickoff").between(F.lit(first_day), F.lit(last_day)))
    done = done.orderBy(*order)
    return done if limit is None else done.limit(limit)


def scatter_places(points: DataFrame, key: str, x: str, y: str, tie: str) -> DataFrame:
    """Points with both values, x_rank, y_rank, their sum, and place by sum, larger tie, larger y, larger x, smaller key."""
    from .ranking import competition_rank, join_same, ordinal_rank

    both = points.dropna(subset=[x, y]).where(~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    ranked = competition_rank(competition_rank(both, [], x, "x_rank"), [], y, "y_rank").withColumn("rank_sum", F.col("x_rank") + F.col("y_rank"))
    ties = [F.coalesce(tie, F.lit(0)).desc(), F.desc(y), F.desc(x), F.asc(key)]
    placed = ordinal_rank(ranked.select(key, x, y, tie, "rank_sum"), [], "rank_sum", ties, "place", descending=False)
    return join_same(ranked, placed.select(key, "place"), [key])


def labelled(points: DataFrame, most: int = 20) -> DataFrame:
    """Points to label: all of a few, else the pinned ones (points has pinned)."""
    n = points.agg((F.count("*") <= most).alias("__few"))
    return points.crossJoin(F.broadcast(n)).where(F.col("__few") | F.col("pinned")).drop("__few")  # one row


def pins_in_effect(points: DataFrame, pins: DataFrame, key: str, order: list[Column], automatic: int = 3) -> DataFrame:
    """key, how: the asked pins that are among the points, or the first few by order if none is."""
    asked = points.join(pins.select(key).distinct(), key, "left_semi").select(key, F.lit("asked").alias("how"))
    first = points.orderBy(*order).limit(automatic).select(key, F.lit("automatic").alias("how"))
    none = asked.agg((F.count("*") == 0).alias("__none"))
    return asked.unionByName(first.crossJoin(F.broadcast(none)).where("__none").drop("__none"))  # one row


def by_relevance(rows: DataFrame, key: str, relevant: list) -> DataFrame:
    """Adds place: that of the key in the list; keys not in the list come behind, with no place."""
    kind = dict(rows.dtypes)[key]
    listed = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(relevant))], f"`{key}` {kind}, place int")
    return rows.join(F.broadcast(listed), key, "left")  # as long as the request
