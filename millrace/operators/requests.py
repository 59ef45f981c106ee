"""Values and rows as a request asks for them: rates or totals, filters on several columns, searches and axes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import half_up
from ..functions.text import fold
from .distribution import with_percentiles

# Metrics that a season's view shows as stored totals, and those it works out from their rates.
STORED_TOTALS = {"xgbuildup_per_90": "xgbuildup", "xgchain_per_90": "xgchain", "npxg_per_90": "npxg", "xa_per_90": "xa"}
DERIVED_TOTALS = [
    "tackles_per_90", "interceptions_per_90", "clearances_per_90", "blocks_per_90", "defensive_action_density", "completed_passes_per_90", "key_passes_per_90", "big_chances_created_per_90",
    "successful_dribbles_per_90", "chance_involvement_per_90", "goals_per_90", "assists_per_90", "shots_per_90",
]
TOTALS = ["tackles_won", "shots_on_target", "shots_off_target", "aerial_duels_won", "ground_duels_won", "ball_recoveries", "fouls", "offsides"]
UNSCALED_IN_RANKS, UNSCALED_IN_PROFILES = ["rank", "matches"], ["rank", "points", "matches"]


@dataclass(frozen=True)
class RateModes:
    """What a table of metrics shows in a mode: stored totals by rate, totals worked out from rates (whole ones rounded), and totals that rates are worked out from."""

    stored: dict[str, str]
    derived: list[str]
    totals: list[str]
    whole: bool = False


OUTFIELD = RateModes(STORED_TOTALS, DERIVED_TOTALS, TOTALS)
# The same for goalkeepers.
KEEPERS = RateModes({"saves_per_90": "saves", "saved_shots_inside_box_per_90": "saved_shots_inside_box", "runs_out_per_90": "runs_out"}, ["completed_passes_per_90", "accurate_long_balls_per_90"], ["clean_sheets", "penalty_saves"], whole=True)


def in_mode(metric: str, mode: str, minutes: Column, modes: RateModes = OUTFIELD) -> Column:
    """A metric's value in mode `rate` or `full`: as stored, the stored total, a total from the rate, or a rate from the total."""
    if mode == "full" and metric in modes.stored:
        return F.col(modes.stored[metric])
    if mode == "full" and metric in modes.derived:
        season = F.when(minutes > 0, F.col(metric) * minutes / 90.0)
        return half_up(season).cast("double") if modes.whole else season
    if mode == "rate" and metric in modes.totals:
        return F.when(minutes > 0, F.col(metric) * 90.0 / minutes)
    return F.col(metric)


def stored_percentile(metric: str, mode: str, modes: RateModes = OUTFIELD) -> str | None:
    """The metric whose stored percentile goes with a value in a mode; none where it must be worked out over the rows shown."""
    if mode == "full" and metric in modes.stored:
        return modes.stored[metric]
    if (mode == "full" and metric in modes.derived) or (mode == "rate" and metric in modes.totals):
        return None
    return metric


def in_rate_mode(rows: DataFrame, keys: list[str], metrics: list[str], mode: str, group: str, eligible: Column, modes: RateModes = OUTFIELD) -> DataFrame:
    """keys, and each metric with its percentile in a mode; percentiles of rows that are not eligible are null.

    keys identify a row; rows: keys, minutes, group, the metrics with their totals, and <metric>_percentile where it is stored.
    """
    out = rows.withColumns({f"__m_{m}": in_mode(m, mode, F.col("minutes"), modes) for m in metrics})
    held = {m: stored_percentile(m, mode, modes) for m in metrics}
    fresh = {f"__m_{m}": f"__p_{m}" for m, h in held.items() if h is None}
    if fresh:
        out = with_percentiles(out, keys, group, fresh, eligible)
    out = out.withColumns({f"__p_{m}": F.when(eligible, F.col(f"{h}_percentile")) for m, h in held.items() if h is not None})
    return out.select(*keys, *(F.col(f"__{side}_{m}").alias(m + tail) for m in metrics for side, tail in (("m", ""), ("p", "_percentile"))))


def profile_bar(kind: str, rate: str, full: str | None, mode: str, minutes: Column, eligible: Column, whole: bool = False) -> tuple[Column, Column]:
    """(value, percentile) of a profile's bar in a mode, with the percentile columns <metric>_percentile.

    invariant: one metric in either mode; paired: a stored metric for each; derived: a season's total from the rate, whole
    if asked for, which keeps the rate's percentile.  Percentiles of rows that are not eligible are null.
    """
    if kind not in ("invariant", "paired", "derived"):
        raise ValueError(f"no kind of bar {kind!r}")
    shown = full if kind == "paired" and mode == "full" and full else rate
    value = F.col(shown)
    if kind == "derived" and mode == "full":
        season = F.when(minutes > 0, F.col(rate) * minutes / 90.0)
        value = half_up(season).cast("double") if whole else season
    return value, F.when(eligible, F.col(f"{shown}_percentile"))


def per_match(field: str, value: Column, matches: Column, percentage: bool) -> Column:
    """For ranks: percentages, rank and matches as they are, others by match; null without matches."""
    played = F.when(matches > 0, value if field in UNSCALED_IN_RANKS else value / matches)
    return value if percentage else played


def shown_per_match(field: str, value: Column, matches: Column, percentage: bool) -> Column:
    """For profiles: points stay as well, and what has no matches stays as it is."""
    return value if percentage or field in UNSCALED_IN_PROFILES else F.when(matches > 0, value / matches).otherwise(value)


def several(positions: list[str], team_ids: list[int], team_names: list[str], position: str = "position", team_id: str = "team_id", team_name: str = "team_name") -> Column:
    """Any of the positions (letter case aside), and a team by id or by name; an empty list asks for nothing."""
    fits = F.upper(F.col(position)).isin(*(p.upper() for p in positions)) if positions else F.lit(True)
    by_id, by_name = F.col(team_id).isin(*team_ids), F.lower(F.col(team_name)).isin(*(n.lower() for n in team_names))
    team = by_id | by_name if team_ids and team_names else by_id if team_ids else by_name if team_names else F.lit(True)
    return F.coalesce(fits & team, F.lit(False))


def outfield(position: Column) -> Column:
    """Known positions but goalkeepers."""
    return F.coalesce(position != "GK", F.lit(False))


def plain_year(label: Column) -> Column:
    return label.rlike(r"^\d{4}$")


def padded_domain(rows: DataFrame, columns: list[str], share: float = 0.07) -> DataFrame:
    """One row, low and high: the finite values of the columns with a margin; around one value a tenth of its magnitude, 0 to 1 without any."""
    finite = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double")) for c in columns]
    ends = rows.agg(F.min(F.least(*finite) if len(finite) > 1 else finite[0]).alias("a"), F.max(F.greatest(*finite) if len(finite) > 1 else finite[0]).alias("b"))
    a, b = F.col("a"), F.col("b")
    half = F.when(a == 0, 1.0).otherwise(F.pow(F.lit(10.0), F.floor(F.log10(F.abs(a)))) * 0.1)
    margin = F.when(a == b, half).otherwise((b - a) * share)
    return ends.select(F.coalesce(a - margin, F.lit(0.0)).alias("low"), F.coalesce(b + margin, F.lit(1.0)).alias("high"))


def intensity(cells: DataFrame, keys: list[str], share: str = "share") -> DataFrame:
    """Adds intensity: the root of a cell's share of its key's largest; null where that is 0 or the cell is empty."""
    from .ranking import join_same

    top = cells.groupBy(*keys).agg(F.max(share).alias("__top"))
    return join_same(cells, top, keys).withColumn("intensity", F.when((F.col(share) > 0) & (F.col("__top") > 0), F.sqrt(F.col(share) / F.col("__top")))).drop("__top")


def search(entities: DataFrame, name: str, text: str, order: list[Column], limit: int) -> DataFrame:
    """The first few entities by priority, then `order`, whose folded name holds the folded text."""
    needle = text.strip()
    found = entities.where(F.contains(fold(F.col(name)), fold(F.lit(needle)))) if needle else entities
    return found.orderBy("priority", *order).limit(limit)


def member_lists(rows: DataFrame, key: str, parts: list[str], first: list[Column], minutes: str, counted: Column) -> DataFrame:
    """key, members (the first row of each combination of parts, as structs in their order), and minutes over all counted rows."""
    from .cohort import best_row

    lists = best_row(rows, [key, *parts], first).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts, minutes))).alias("members"))
    totals = rows.groupBy(key).agg(F.sum(F.when(counted, F.coalesce(minutes, F.lit(0))).otherwise(0)).alias("total_minutes"))
    return lists.join(totals, key)


def profiles(rows: DataFrame, derived: DataFrame, keys: list[str], team: int | None) -> DataFrame:
    """Season totals (team null) or one team's split, for keys with a current derived row and at least one available module."""
    split = F.col("team_id").isNull() if team is None else F.col("team_id") == team
    return rows.where(split & F.exists("modules", lambda m: m["available"])).join(derived.where("is_current").select(*keys).distinct(), keys, "left_semi")
