"""Profiles of typed events: counts, grids of places, and flows of passes between zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.event_classes import is_action, is_defensive
from .ranking import join_same
from .spatial import cell

GRID = (12, 8)
ZONES = (5, 3)


def summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """Seventeen counts and the mean place of touches by key.

    events: kind, success, x, y, is_touch, the flags key_pass, cross, long_ball, big_chance and defensive,
    progressive, final_third and box_entry, and shot_outcome.  A null success is no success.
    """
    c = F.col
    well = F.coalesce(c("success"), F.lit(False))
    passes, shots, dribbles = (c("kind") == k for k in ("pass", "shot", "take_on"))
    placed = c("x").isNotNull() & c("y").isNotNull()
    counts: dict[str, Column] = {
        "valid_location_actions": placed & is_action(c("kind"), c("defensive")),
        "touches": c("is_touch"),
        "pass_attempts": passes,
        "pass_completions": passes & well,
        "progressive_pass_attempts": passes & c("progressive"),
        "progressive_pass_completions": passes & c("progressive") & well,
        "final_third_entries": passes & c("final_third"),
        "box_entries": passes & c("box_entry"),
        "key_passes": passes & c("key_pass"),
        "crosses": passes & c("cross"),
        "long_balls": passes & c("long_ball"),
        "shots": shots,
        "goals": shots & (c("shot_outcome") == "goal"),
        "big_chance_shots": shots & c("big_chance"),
        "take_ons_attempted": dribbles,
        "take_ons_successful": dribbles & well,
        "defensive_actions": is_defensive(c("kind"), c("defensive")),
    }
    mean = lambda v: F.bround(F.avg(F.when(c("is_touch") & placed, c(v)))).cast("int")
    return events.groupBy(*keys).agg(*(F.count_if(which).alias(n) for n, which in counts.items()), mean("x").alias("average_touch_x"), mean("y").alias("average_touch_y"))


def action_grid(events: DataFrame, minutes: DataFrame, keys: list[str], columns: int = GRID[0], rows: int = GRID[1]) -> DataFrame:
    """keys, cell, n, per_90, share, available, sparse for every cell; minutes: keys and minutes, one row for each key to list."""
    placed = events.where(F.col("x").isNotNull() & F.col("y").isNotNull() & is_action(F.col("kind"), F.col("defensive")))
    counts = placed.groupBy(*keys, cell(F.col("x"), F.col("y"), columns, rows).alias("cell")).agg(F.count("*").alias("n"))
    totals = join_same(minutes, counts.groupBy(*keys).agg(F.sum("n").alias("total")), keys, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    every = totals.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(columns * rows - 1))))
    n = F.coalesce("n", F.lit(0))
    rate = F.when(F.col("minutes") > 0, n * 90.0 / F.col("minutes"))
    share = F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0)
    return join_same(every, counts, [*keys, "cell"], "left").select(*keys, "cell", n.alias("n"), rate.alias("per_90"), share.alias("share"), (F.col("total") >= 20).alias("available"), (F.col("total") < 100).alias("sparse"))


def pass_flow(events: DataFrame, keys: list[str], columns: int = ZONES[0], rows: int = ZONES[1]) -> DataFrame:
    """keys, origin, destination, attempts, completions, rate, progressive attempts and completions for all pairs of zones.

    Passes that lack a coordinate are skipped; keys are those with a pass.
    """
    c = F.col
    well = F.coalesce(c("success"), F.lit(False))
    passes = events.where((c("kind") == "pass") & c("x").isNotNull() & c("y").isNotNull() & c("end_x").isNotNull() & c("end_y").isNotNull())
    counts = passes.groupBy(*keys, cell(c("x"), c("y"), columns, rows).alias("origin"), cell(c("end_x"), c("end_y"), columns, rows).alias("destination")).agg(
        F.count("*").alias("attempts"), F.count_if(well).alias("completions"), F.count_if(c("progressive")).alias("progressive_attempts"), F.count_if(c("progressive") & well).alias("progressive_completions")
    )
    zone = F.sequence(F.lit(0), F.lit(columns * rows - 1))
    every = counts.select(*keys).distinct().withColumn("origin", F.explode(zone)).withColumn("destination", F.explode(zone))
    numbers = ["attempts", "completions", "progressive_attempts", "progressive_completions"]
    full = join_same(every, counts, [*keys, "origin", "destination"], "left").na.fill(0, numbers)
    return full.select(*keys, "origin", "destination", *numbers, F.when(c("attempts") > 0, c("completions") / c("attempts")).alias("completion_rate"))


def directional_pick(events: DataFrame, current: DataFrame, key: str, direction: tuple[int, int], x: str = "x", y: str = "y") -> DataFrame:
    """From each current event, the nearest one ahead in a direction: forward distance and 2.5 times the lateral one.

    current: a few rows of events, `key` and the `group` within which events are looked for.
    """
    a, b = direction
    at = current.select("group", F.col(key).alias("current"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    met = events.join(at, "group").where(F.col(key) != F.col("current"))
    dx, dy = F.col(x) - F.col("__x"), F.col(y) - F.col("__y")
    ahead, aside = dx * a + dy * b, F.abs(dx * b - dy * a)
    scored = met.withColumn("score", ahead + aside * 2.5).where(ahead > 0)
    return scored.groupBy("current").agg(F.min(F.struct("score", key)).alias("best")).select("current", F.col(f"best.{key}").alias("picked"), "best.score")


# Names of pass filters, and other names they are asked by.
PASS_FILTERS = ["completed", "progressive", "final_third_entry", "box_entry", "key_pass", "cross", "long_ball", "failed"]
PASS_ALIASES = {
    "all": "completed", "all_completed": "completed", "box-entry": "box_entry", "box_entries": "box_entry", "crosses": "cross", "failed_passes": "failed", "final-third-entry": "final_third_entry",
    "final_third_entries": "final_third_entry", "key-pass": "key_pass", "key_passes": "key_pass", "long-ball": "long_ball", "long_balls": "long_ball",
}
_PASS_COLUMNS = {"final_third_entry": "final_third"}


def pass_filter(name: str | None = None) -> Column:
    """The test of typed passes for a filter's name or other name, completed without one; an unknown name is an error."""
    asked = (name or "completed").strip().lower()
    asked = PASS_ALIASES.get(asked, asked)
    if asked not in PASS_FILTERS:
        raise ValueError(f"no pass filter {name!r}; there are {', '.join(PASS_FILTERS)}")
    if asked in ("completed", "failed"):
        return F.col("success").eqNullSafe(asked == "completed")
    return F.col(_PASS_COLUMNS.get(asked, asked))
