"""Metrics and scores of an entity's season from two sources, as columns over one row for each entity and slice.

Of either source, fields end in _a (first source) or have no ending (second
source).  A count that the second source leaves out is 0 where its slice records
the field at all and the entity has a row there; the first source goes first
where both have a field.  Everything is null where a part is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import per_unit, ratio, share_of_known, shrunk_delta, sum_required
from ..operators.distribution import unpivot, winsorized, winsorized_moments, with_availability
from ..operators.ranking import midrank_percentile
from ..operators.steps import stored

# Field, metric, section and position names, weights and thresholds that results are compared by.
FIRST = ["goals_a", "npg_a", "xg_a", "npxg_a", "xa_a", "xgchain_a", "xgbuildup_a", "shots_a", "assists_a", "key_passes_a"]
COUNTS = [
    "blocks", "tackles", "interceptions", "clearances", "shots_on_target", "shots_off_target", "total_shots", "goals", "assists", "key_passes",
    "big_chances_created", "successful_dribbles", "accurate_passes", "accurate_crosses", "accurate_long_balls", "inaccurate_passes", "total_passes",
    "tackles_won", "aerial_duels_won", "ground_duels_won", "ball_recoveries", "fouls", "offsides", "errors_lead_to_goal",
]
MEASURES = ["expected_goals", "expected_assists", "accurate_passes_percentage", "summary_passes_percentage", "tackles_won_share", "dribbles_share"]
KEEPER = ["rating", "saves", "clean_sheets", "penalty_saves", "saved_shots_inside_box", "runs_out", "appearances"]
OUTFIELD = ("DEF", "MID", "FWD")
LEAST_MINUTES = 450
WINSORIZE = (0.05, 0.95)
COMPONENT_COVERAGE = 0.9
CORE_COVERAGE, STYLE_COVERAGE = 0.8, 0.7
STYLE = {"npxg_per_shot", "xa_per_key_pass", "buildup_share", "chance_involvement_per_90", "defensive_action_density", "kp_share_per90", "inaccurate_pass_rate", "finishing_shrunk_delta_per_shot", "sot_rate"}
SECTIONS = {
    "attack": ["xg", "xg_per_90", "npxg", "npxg_per_90", "xa", "xa_per_90", "xgchain", "xgchain_per_90", "xgbuildup", "xgbuildup_per_90", "goals_per_90", "assists_per_90", "offsides", "offsides_per_90"],
    "volume": ["shots_per_90", "key_passes_per_90", "big_chances_created_per_90", "successful_dribbles_per_90", "completed_passes_per_90", "shots_on_target", "shots_off_target", "accurate_crosses_per_90", "accurate_long_balls_per_90"],
    "efficiency_style": ["goals_minus_xg", "goals_minus_npxg", "finishing_shrunk_delta_per_shot", "sot_rate", "npxg_per_shot", "xa_per_key_pass", "buildup_share", "chance_involvement_per_90", "pass_accuracy", "successful_dribbles_percentage", "kp_share_per90", "inaccurate_pass_rate"],
    "defending": ["tackles_per_90", "interceptions_per_90", "clearances_per_90", "blocks_per_90", "defensive_action_density", "tackles_won", "tackles_won_percentage", "aerial_duels_won", "ground_duels_won", "ball_recoveries", "fouls", "ball_recoveries_per_90", "ground_duels_won_per_90", "aerial_duels_won_per_90", "fouls_per_90", "errors_lead_to_goal_per_90"],
}
METRICS = [m for names in SECTIONS.values() for m in names]
KEEPER_METRICS = ["rating", "saves", "saves_per_90", "clean_sheets", "clean_sheet_rate", "penalty_saves", "saved_shots_inside_box", "saved_shots_inside_box_per_90", "runs_out", "runs_out_per_90", "pass_accuracy", "completed_passes_per_90", "accurate_long_balls_per_90", "appearances"]
_FINISHING = {"finishing_shrunk_delta_per_shot": 0.65, "sot_rate": 0.20, "npxg_per_shot": 0.10, "shots_per_90": 0.05}
_WINNING_LOSS = {"fouls_per_90": 0.06, "errors_lead_to_goal_per_90": 0.14}
WEIGHTS = {
    "finishing_score": {p: _FINISHING for p in OUTFIELD},
    "creation_score": {
        "FWD": {"xa_per_90": 0.34, "big_chances_created_per_90": 0.26, "key_passes_per_90": 0.16, "accurate_crosses_per_90": 0.08, "successful_dribbles_per_90": 0.12, "kp_share_per90": 0.04},
        "MID": {"xa_per_90": 0.36, "big_chances_created_per_90": 0.24, "key_passes_per_90": 0.16, "accurate_crosses_per_90": 0.08, "successful_dribbles_per_90": 0.12, "kp_share_per90": 0.04},
        "DEF": {"xgbuildup_per_90": 0.3, "xa_per_90": 0.22, "big_chances_created_per_90": 0.16, "accurate_long_balls_per_90": 0.18, "accurate_crosses_per_90": 0.06, "kp_share_per90": 0.08},
    },
    "buildup_score": {
        "FWD": {"xgbuildup_per_90": 0.3, "buildup_share": 0.24, "completed_passes_per_90": 0.18, "accurate_long_balls_per_90": 0.1, "successful_dribbles_per_90": 0.18},
        "MID": {"xgbuildup_per_90": 0.3, "buildup_share": 0.22, "completed_passes_per_90": 0.22, "accurate_long_balls_per_90": 0.12, "successful_dribbles_per_90": 0.14},
        "DEF": {"xgbuildup_per_90": 0.28, "buildup_share": 0.2, "completed_passes_per_90": 0.2, "accurate_long_balls_per_90": 0.22, "successful_dribbles_per_90": 0.1},
    },
    "ball_winning_score": {
        "FWD": {"tackles_per_90": 0.18, "interceptions_per_90": 0.18, "ball_recoveries_per_90": 0.24, "tackles_won_percentage": 0.14, "ground_duels_won_per_90": 0.16, "aerial_duels_won_per_90": 0.1},
        "MID": {"tackles_per_90": 0.19, "interceptions_per_90": 0.19, "ball_recoveries_per_90": 0.24, "tackles_won_percentage": 0.14, "ground_duels_won_per_90": 0.14, "aerial_duels_won_per_90": 0.1},
        "DEF": {"tackles_per_90": 0.16, "interceptions_per_90": 0.18, "ball_recoveries_per_90": 0.22, "tackles_won_percentage": 0.14, "ground_duels_won_per_90": 0.14, "aerial_duels_won_per_90": 0.16},
    },
    "involvement_score": {
        "FWD": {"xgchain_per_90": 0.42, "chance_involvement_per_90": 0.34, "shots_per_90": 0.12, "key_passes_per_90": 0.06, "successful_dribbles_per_90": 0.06},
        "MID": {"xgchain_per_90": 0.46, "chance_involvement_per_90": 0.34, "shots_per_90": 0.04, "key_passes_per_90": 0.06, "successful_dribbles_per_90": 0.1},
        "DEF": {"xgchain_per_90": 0.56, "chance_involvement_per_90": 0.34, "key_passes_per_90": 0.03, "successful_dribbles_per_90": 0.07},
    },
}
PENALTIES = {"buildup_score": {p: {"inaccurate_pass_rate": 0.1} for p in OUTFIELD}, "ball_winning_score": {p: _WINNING_LOSS for p in OUTFIELD}, "involvement_score": {"FWD": {"offsides_per_90": 0.04}}}


def components() -> list[tuple[str, str, str, float]]:
    """(score, position, metric, signed weight) of every score; penalties are negative."""
    plus = [(s, p, m, w) for s, by in WEIGHTS.items() for p, parts in by.items() for m, w in parts.items()]
    return plus + [(s, p, m, -w) for s, by in PENALTIES.items() for p, parts in by.items() for m, w in parts.items()]


def resolved(rows: DataFrame, slice_key: str) -> DataFrame:
    """rows with their counts settled: 0 where the slice records the field and the entity has a second source (has_b)."""
    known = with_availability(rows, [slice_key], COUNTS)
    there = {c: F.when(F.col("has_b") & F.col(f"{c}_known"), F.coalesce(c, F.lit(0))) for c in COUNTS}
    return known.withColumns(there).drop(*(f"{c}_known" for c in COUNTS))


def outfield_metrics(rows: DataFrame, keys: list[str], slice_key: str) -> DataFrame:
    """keys and METRICS; rows: keys, the slice, minutes, has_b, and the fields of both sources."""
    c = F.col
    minutes = c("minutes")
    rate = lambda x: per_unit(x, minutes)
    percent = lambda x: x * 100.0
    shots = F.coalesce("shots_a", "total_shots", c("shots_on_target") + c("shots_off_target"))
    goals, assists, key_passes = (F.coalesce(f"{x}_a", x) for x in ("goals", "assists", "key_passes"))
    xg, xa = F.coalesce("xg_a", "expected_goals"), F.coalesce("xa_a", "expected_assists")
    passes = F.coalesce("total_passes", c("accurate_passes") + c("inaccurate_passes"))
    finish = c("npg_a") - c("npxg_a")
    made: dict[str, Column] = {
        "xg": xg, "xa": xa, "npxg": c("npxg_a"), "xgchain": c("xgchain_a"), "xgbuildup": c("xgbuildup_a"),
        "goals_minus_xg": goals - xg,
        "goals_minus_npxg": finish,
        "finishing_shrunk_delta_per_shot": shrunk_delta(c("npg_a"), c("npxg_a"), shots),
        "sot_rate": share_of_known(c("shots_on_target"), c("shots_off_target"), shots),
        "npxg_per_shot": ratio(c("npxg_a"), shots),
        "xa_per_key_pass": ratio(xa, key_passes),
        "buildup_share": ratio(c("xgbuildup_a"), c("xgchain_a")),
        "chance_involvement_per_90": rate(sum_required(shots, key_passes, c("big_chances_created"))),
        "pass_accuracy": F.coalesce("accurate_passes_percentage", "summary_passes_percentage", percent(ratio(c("accurate_passes"), passes))),
        "defensive_action_density": rate(sum_required(*(c(x) for x in ("tackles", "interceptions", "clearances", "blocks")))),
        "tackles_won_percentage": F.coalesce("tackles_won_share", percent(ratio(c("tackles_won"), c("tackles")))),
        "successful_dribbles_percentage": c("dribbles_share"),
        "kp_share_per90": ratio(c("key_passes"), passes),
        "inaccurate_pass_rate": ratio(c("inaccurate_passes"), passes),
    }
    totals = {"shots": shots, "goals": goals, "assists": assists, "key_passes": key_passes, "completed_passes": c("accurate_passes")}
    for m in METRICS:
        if m not in made:
            base = m.removesuffix("_per_90")
            total = made.get(base) if base in made else totals.get(base, c(base))
            made[m] = rate(total) if m != base else total
    return resolved(rows, slice_key).select(*keys, *(made[m].cast("double").alias(m) for m in METRICS))


def keeper_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and KEEPER_METRICS; fields are taken as they are."""
    c = F.col
    made = {
        "clean_sheet_rate": F.when(c("appearances") > 0, c("clean_sheets") * 100.0 / c("appearances")),
        "pass_accuracy": c("accurate_passes_percentage"),
        "completed_passes_per_90": per_unit(c("accurate_passes"), c("minutes")),
    }
    for m in KEEPER_METRICS:
        base = m.removesuffix("_per_90")
        made.setdefault(m, per_unit(c(base), c("minutes")) if m != base else c(base))
    return rows.select(*keys, *(made[m].cast("double").alias(m) for m in KEEPER_METRICS))


def _parts(df: DataFrame) -> DataFrame:
    """components() as a table of some ninety rows, which is what bounds its broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(components(), "score string, position string, metric string, weight double"))


def scores(metrics: DataFrame, key: str) -> DataFrame:
    """key, position, score, raw and percentile of eligible rows (key, position, metrics); raw is null if a part is missing.

    Parts are added in the order of their names, so that equal parts give equal sums.  Rows are made once, into a table;
    quantiles and moments of all parts, one row a position, come to them, so that no part is gathered by a shuffle.
    """
    used, parts = sorted({m for _, _, m, _ in components()}), ["low", "high", "mean", "dev"]
    rows = stored(metrics.where(F.col("position").isin(*sorted({p for _, p, _, _ in components()}))).select(key, "position", *(F.col(m).cast("double").alias(m) for m in used)))
    told = winsorized_moments(unpivot(rows, ["position"], used), ["position", "metric"], "value", *WINSORIZE)
    told = told.groupBy("position").agg(*(F.max(F.when(F.col("metric") == m, F.struct(*parts))).alias(f"__{m}") for m in used))
    z = {m: winsorized(F.col(m), *(F.col(f"__{m}")[p] for p in parts)).alias(m) for m in used}
    scaled = rows.join(F.broadcast(told), "position").select(key, "position", *z.values())  # one row a position

    def added(score: str, position: str) -> Column:
        terms = sorted((m, w) for s, p, m, w in components() if (s, p) == (score, position))
        return F.round(sum((F.col(m) * F.lit(w) for m, w in terms), F.lit(0.0)), 9)

    of = {p: sorted({s for s, q, _, _ in components() if q == p}) for _, p, _, _ in components()}
    each = F.coalesce(*(F.when(F.col("position") == p, F.array(*(F.struct(F.lit(s).alias("score"), added(s, p).alias("raw")) for s in names))) for p, names in of.items()))
    raw = scaled.select(key, "position", F.inline(each))
    return midrank_percentile(stored(raw), ["position", "score"], "raw", "percentile")


def coverage_by_position(metrics: DataFrame) -> DataFrame:
    """position, metric, covered of rows (position, METRICS)."""
    return unpivot(metrics, ["position"], METRICS).groupBy("position", "metric").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("covered"))


def score_availability(covered: DataFrame) -> DataFrame:
    """score, position, available, missing and low (metric names): parts without values, and parts below COMPONENT_COVERAGE."""
    spark = covered.sparkSession
    parts = _parts(covered).join(covered, ["position", "metric"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    names = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("metric"))))
    lists = parts.groupBy("score", "position").agg(names(F.col("covered") <= 0).alias("missing"), names((F.col("covered") > 0) & (F.col("covered") < COMPONENT_COVERAGE)).alias("low"))
    every = spark.createDataFrame([(s, p) for s in WEIGHTS for p in OUTFIELD], "score string, position string")
    return every.join(lists, ["score", "position"], "left").select("score", "position", ((F.size("missing") == 0) & (F.size("low") == 0)).alias("available"), "missing", "low")


def metric_lists(covered: DataFrame) -> DataFrame:
    """metric, class (unavailable, low, shown) and the least coverage for its kind; covered: metric, covered."""
    least = F.when(F.col("metric").isin(*sorted(STYLE)), STYLE_COVERAGE).otherwise(CORE_COVERAGE)
    kind = F.when(F.col("covered") <= 0, "unavailable").when(F.col("covered") < least, "low").otherwise("shown")
    return covered.select("metric", "covered", least.alias("least"), kind.alias("class"))


def sections(metrics: DataFrame, key: str) -> DataFrame:
    """key, section, entries (metric, value, percentile among rows of the position), for metrics with a value, in listed order."""
    place = {m: (s, i) for s, names in SECTIONS.items() for i, m in enumerate(names)}
    listed = metrics.sparkSession.createDataFrame([(m, s, i) for m, (s, i) in place.items()], "metric string, section string, place int")
    ranked = midrank_percentile(unpivot(metrics, [key, "position"], METRICS), ["position", "metric"], "value", "percentile").where("value is not null")
    entries = ranked.join(F.broadcast(listed), "metric")  # one row a metric
    return entries.groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "metric", "value", "percentile"))), lambda x: F.struct(x["metric"].alias("metric"), x["value"].alias("value"), x["percentile"].alias("percentile"))).alias("entries"))
