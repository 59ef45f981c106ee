"""Ranks of team figures, each in the direction in which it is good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distribution import unpivot
from .ranking import competition_rank, join_same

# Figures of which less is better; of all others more is.
LOWER_IS_BETTER = [
    "accurate_passes_against", "big_chances_against", "big_chances_created_against", "big_chances_missed", "clearances_against", "corners_against", "fouls", "goals_against", "interceptions_against", "losses", "offsides", "offsides_against",
    "own_goals", "penalty_goals_conceded", "possession_lost", "rank", "red_cards", "red_cards_against", "shots_against", "shots_from_inside_the_box_against", "shots_from_outside_the_box_against", "shots_on_target_against", "tackles_against",
    "yellow_cards", "yellow_cards_against",
]


def direction(stat: Column) -> Column:
    """higher or lower."""
    return F.when(stat.isin(LOWER_IS_BETTER), "lower").otherwise("higher")


def ranked(rows: DataFrame, keys: list[str], groups: list[str], stats: list[str]) -> DataFrame:
    """keys, groups, stat, place, of_n: competition ranks (1 is best) of each figure among those of its group that have it."""
    long = unpivot(rows, [*keys, *groups], stats).withColumnRenamed("metric", "stat").where("value is not null")
    turned = long.withColumn("__v", F.when(direction(F.col("stat")) == "lower", -F.col("value")).otherwise(F.col("value")))
    placed = competition_rank(turned, [*groups, "stat"], "__v", "place")
    sizes = long.groupBy(*groups, "stat").agg(F.count("*").alias("of_n"))
    return join_same(placed, sizes, [*groups, "stat"]).select(*keys, *groups, "stat", "place", "of_n")
