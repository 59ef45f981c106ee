"""Season metrics, scores, availability and sections over rows that are made from the driver tables by one rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import season_metrics as sm
from .registry import query, read

FIELDS = [*sm.FIRST, *sm.COUNTS, *sm.MEASURES, *sm.KEEPER]
POSITIONS = ["GK", *sm.OUTFIELD]


def rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each part: a brand is a slice, and field number i comes from the part's key and number of order lines."""
    lines = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    k, n = F.col("p_partkey"), F.coalesce("n", F.lit(0))

    def made(i: int, name: str) -> Column:
        value = ((n * (i + 3) + k) % (5 + i)).cast("double") / (1 if name in sm.COUNTS else 4)
        if name in sm.FIRST:
            gone = k % 5 == 0
        else:
            gone = ((k + i) % 13 == 0) | ((F.col("p_brand") == "Brand#11") & F.lit(i % 7 == 0))
        return F.when(~gone, value).alias(name)

    both = read(spark, d, "part").join(lines, F.col("l_partkey") == k, "left")
    position = F.element_at(F.array(*map(F.lit, POSITIONS)), (F.col("p_size") % 4 + 1).cast("int"))
    return both.select(k.alias("entity"), F.col("p_brand").alias("slice"), position.alias("position"), F.when(k % 29 != 0, (k * 37) % 2000).alias("minutes"), (k % 17 != 0).alias("has_b"), *(made(i, f) for i, f in enumerate(FIELDS)))


def _sql_rows() -> str:
    def made(i: int, name: str) -> str:
        gone = "k % 5 = 0" if name in sm.FIRST else f"(k + {i}) % 13 = 0 or (p_brand = 'Brand#11' and {str(i % 7 == 0).lower()})"
        return f"case when not ({gone}) then ((n * {i + 3} + k) % {5 + i})::double / {1 if name in sm.COUNTS else 4} end as {name}"

    positions = ", ".join(f"'{p}'" for p in POSITIONS)
    fields = ", ".join(made(i, f) for i, f in enumerate(FIELDS))
    return f"""raw as (select k as entity, p_brand as slice, ([{positions}])[p_size % 4 + 1] as position, case when k % 29 <> 0 then (k * 37) % 2000 end as minutes, k % 17 <> 0 as has_b, {fields}
        from (select p_partkey as k, p_brand, p_size, coalesce(n, 0) as n from part left join (select l_partkey, count(*) as n from lineitem group by 1) on l_partkey = p_partkey))"""


def _sql_metrics() -> str:
    counts = ", ".join(f"case when has_b and count({c}) over (partition by slice) > 0 then coalesce({c}, 0) end as {c}" for c in sm.COUNTS)
    settled = f"settled as (select * replace ({counts}) from raw)"
    chosen = """chosen as (select *, coalesce(shots_a, total_shots, shots_on_target + shots_off_target) as shots, coalesce(goals_a, goals) as g, coalesce(assists_a, assists) as a, coalesce(key_passes_a, key_passes) as kp,
        coalesce(xg_a, expected_goals) as x_g, coalesce(xa_a, expected_assists) as x_a, coalesce(total_passes, accurate_passes + inaccurate_passes) as passes from settled)"""
    per = lambda x: f"case when minutes > 0 then ({x}) * 90.0::double / minutes end"
    over = lambda a, b: f"case when ({b}) <> 0 then ({a}) / ({b}) end"
    m = {
        "xg": "x_g", "npxg": "npxg_a", "xa": "x_a", "xgchain": "xgchain_a", "xgbuildup": "xgbuildup_a", "offsides": "offsides",
        "xg_per_90": per("x_g"), "npxg_per_90": per("npxg_a"), "xa_per_90": per("x_a"), "xgchain_per_90": per("xgchain_a"), "xgbuildup_per_90": per("xgbuildup_a"),
        "goals_per_90": per("g"), "assists_per_90": per("a"), "offsides_per_90": per("offsides"), "shots_per_90": per("shots"), "key_passes_per_90": per("kp"),
        "big_chances_created_per_90": per("big_chances_created"), "successful_dribbles_per_90": per("successful_dribbles"), "completed_passes_per_90": per("accurate_passes"),
        "shots_on_target": "shots_on_target", "shots_off_target": "shots_off_target", "accurate_crosses_per_90": per("accurate_crosses"), "accurate_long_balls_per_90": per("accurate_long_balls"),
        "goals_minus_xg": "g - x_g", "goals_minus_npxg": "npg_a - npxg_a",
        "finishing_shrunk_delta_per_shot": "case when shots > 0 then (npg_a - npxg_a) / shots * (shots / (shots + 35.0::double)) end",
        "sot_rate": "case when shots_on_target + shots_off_target > 0 then shots_on_target / (shots_on_target + shots_off_target) when shots > 0 and shots_on_target is not null then least(1.0::double, shots_on_target / shots) end",
        "npxg_per_shot": over("npxg_a", "shots"), "xa_per_key_pass": over("x_a", "kp"), "buildup_share": over("xgbuildup_a", "xgchain_a"),
        "chance_involvement_per_90": per("shots + kp + big_chances_created"),
        "pass_accuracy": f"coalesce(accurate_passes_percentage, summary_passes_percentage, {over('accurate_passes', 'passes')} * 100)",
        "successful_dribbles_percentage": "dribbles_share", "kp_share_per90": over("key_passes", "passes"), "inaccurate_pass_rate": over("inaccurate_passes", "passes"),
        "tackles_per_90": per("tackles"), "interceptions_per_90": per("interceptions"), "clearances_per_90": per("clearances"), "blocks_per_90": per("blocks"),
        "defensive_action_density": per("tackles + interceptions + clearances + blocks"), "tackles_won": "tackles_won",
        "tackles_won_percentage": f"coalesce(tackles_won_share, {over('tackles_won', 'tackles')} * 100)",
        "aerial_duels_won": "aerial_duels_won", "ground_duels_won": "ground_duels_won", "ball_recoveries": "ball_recoveries", "fouls": "fouls",
        "ball_recoveries_per_90": per("ball_recoveries"), "ground_duels_won_per_90": per("ground_duels_won"), "aerial_duels_won_per_90": per("aerial_duels_won"),
        "fouls_per_90": per("fouls"), "errors_lead_to_goal_per_90": per("errors_lead_to_goal"),
    }
    listed = ", ".join(f"({m[name]})::double as {name}" for name in sm.METRICS)
    return f"{_sql_rows()}, {settled}, {chosen}, metrics as (select entity, slice, position, minutes, {listed} from chosen)"


_METRICS = _sql_metrics()
_FIT = f"eligible as (select * from metrics where position in ('DEF', 'MID', 'FWD') and minutes >= {sm.LEAST_MINUTES})"
_PARTS = "parts as (select * from (values " + ", ".join(f"('{s}', '{p}', '{m}', {w}::double)" for s, p, m, w in sm.components()) + ") t(score, position, metric, weight))"
_LONG = f"long as (unpivot (select entity, position, {', '.join(sm.METRICS)} from eligible) on {', '.join(sm.METRICS)} into name metric value v)"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return sm.outfield_metrics(rows(spark, d), ["entity", "slice", "position", "minutes"], "slice")


def eligible(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).where(F.col("position").isin(*sm.OUTFIELD) & (F.col("minutes") >= sm.LEAST_MINUTES))


@query(f"with {_METRICS} select entity, {', '.join(f'round({m}, 6) as {m}' for m in sm.METRICS)} from metrics")
def outfield_metric_row(spark: SparkSession, d: str) -> DataFrame:
    """All outfield metrics of every entity."""
    return metrics(spark, d).select("entity", *(F.round(m, 6).alias(m) for m in sm.METRICS))


@query(f"""with {_sql_rows()} select entity, rating, saves, round(case when minutes > 0 then saves * 90.0::double / minutes end, 6) as saves_per_90, clean_sheets, round(case when appearances > 0 then clean_sheets * 100.0::double / appearances end, 6) as clean_sheet_rate,
    penalty_saves, saved_shots_inside_box, round(case when minutes > 0 then saved_shots_inside_box * 90.0::double / minutes end, 6) as saved_shots_inside_box_per_90, runs_out, round(case when minutes > 0 then runs_out * 90.0::double / minutes end, 6) as runs_out_per_90,
    accurate_passes_percentage as pass_accuracy, round(case when minutes > 0 then accurate_passes * 90.0::double / minutes end, 6) as completed_passes_per_90, round(case when minutes > 0 then accurate_long_balls * 90.0::double / minutes end, 6) as accurate_long_balls_per_90, appearances from raw where position = 'GK'""")
def keeper_metric_row(spark: SparkSession, d: str) -> DataFrame:
    made = sm.keeper_metrics(rows(spark, d).where("position = 'GK'"), ["entity"])
    return made.select("entity", *(F.round(m, 6).alias(m) for m in sm.KEEPER_METRICS))


@query(f"""with {_METRICS}, {_FIT}, {_PARTS}, {_LONG}, b as (select position, metric, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from long group by 1, 2),
    held as (select entity, position, metric, greatest(lo, least(hi, v)) as h from long join b using (position, metric)), s as (select position, metric, avg(h) as mean, stddev_pop(h) as dev from held group by 1, 2),
    z as (select entity, position, metric, case when dev > 0 then (h - mean) / dev else 0 end as z from held join s using (position, metric)),
    r as (select e.entity, e.position, p.score, round(case when count(z.z) = count(*) then sum(z.z * p.weight) end, 9) as raw from eligible e join parts p using (position) left join z on z.entity = e.entity and z.metric = p.metric group by 1, 2, 3)
    select entity, score, round(raw, 6) as raw, round(case when raw is not null then (below + below + same) / 2.0 / n * 100 end, 6) as percentile from
    (select *, rank() over (partition by position, score order by raw nulls last) - 1 as below, count(raw) over (partition by position, score, raw) as same, count(raw) over (partition by position, score) as n from r)""")
def season_scores(spark: SparkSession, d: str) -> DataFrame:
    """Five scores of weighted, winsorised z-scores, and their percentiles within the position."""
    # raw has nine digits, so one in a thousand lies half-way at six: rounded in doubles, as the SQL's are
    six = F.signum("raw") * F.floor(F.abs("raw") * 1e6 + 0.5) / 1e6
    return sm.scores(eligible(spark, d), "entity").select("entity", "score", six.alias("raw"), F.round("percentile", 6).alias("percentile"))


_SHARES = ", ".join(f"avg(({m} is not null)::int) as {m}" for m in sm.METRICS)
_COVER = f"wide as (select position, {_SHARES} from eligible group by 1), cover as (unpivot wide on {', '.join(sm.METRICS)} into name metric value covered)"


@query(f"""with {_METRICS}, {_FIT}, {_PARTS}, {_COVER}, c as (select score, position, metric, coalesce(covered, 0) as covered from parts left join cover using (position, metric))
    select score, position, count(*) filter (covered < {sm.COMPONENT_COVERAGE}) = 0 as available, coalesce(string_agg(metric, ',' order by metric) filter (covered <= 0), '') as missing,
    coalesce(string_agg(metric, ',' order by metric) filter (covered > 0 and covered < {sm.COMPONENT_COVERAGE}), '') as low from c group by 1, 2""")
def score_availability(spark: SparkSession, d: str) -> DataFrame:
    """Whether each score can be had by position, with the parts that are missing or too rare."""
    out = sm.score_availability(sm.coverage_by_position(eligible(spark, d)))
    return out.select("score", "position", "available", *(F.concat_ws(",", c).alias(c) for c in ("missing", "low")))


_STYLE = ", ".join(f"'{m}'" for m in sorted(sm.STYLE))


@query(f"""with {_METRICS}, {_FIT}, {_COVER}, w as (select metric, sum(covered * k) / sum(k) as covered from cover join (select position, count(*) as k from eligible group by 1) using (position) group by 1), l as (select *, case when metric in ({_STYLE}) then {sm.STYLE_COVERAGE} else {sm.CORE_COVERAGE} end as least from w)
    select metric, round(covered, 6) as covered, case when covered <= 0 then 'unavailable' when covered < least then 'low' else 'shown' end as class from l""")
def metric_lists(spark: SparkSession, d: str) -> DataFrame:
    """Which metrics are shown, too rare or unavailable over all eligible rows."""
    from ..operators.distribution import coverage

    return sm.metric_lists(coverage(eligible(spark, d), [], sm.METRICS)).select("metric", F.round("covered", 6).alias("covered"), "class")


_PLACES = "places as (select * from (values " + ", ".join(f"('{m}', '{s}', {i})" for s, names in sm.SECTIONS.items() for i, m in enumerate(names)) + ") t(metric, section, place))"


@query(f"""with {_METRICS}, {_FIT}, {_LONG}, {_PLACES}, r as (select *, rank() over (partition by position, metric order by v) - 1 as below, count(*) over (partition by position, metric, v) as same, count(*) over (partition by position, metric) as n from long)
    select entity, section, string_agg(metric, ',' order by place) as metrics, round(sum((below + below + same) / 2.0 / n * 100), 4) as percentiles from r join places using (metric) group by 1, 2""")
def metric_sections(spark: SparkSession, d: str) -> DataFrame:
    """Each eligible entity's metrics by section, in listed order, with their percentiles (here their sum)."""
    made = sm.sections(eligible(spark, d), "entity")
    total = F.aggregate("entries", F.lit(0.0), lambda x, e: x + e["percentile"])
    return made.select("entity", "section", F.concat_ws(",", F.transform("entries", lambda e: e["metric"])).alias("metrics"), F.round(total, 4).alias("percentiles"))
