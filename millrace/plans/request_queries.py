"""Requests over season rows, events and memberships that are made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import requests, selection
from ..operators.distribution import with_percentiles
from . import match_queries, season_queries
from .registry import query, read

_SHOWN = ["xa_per_90", "tackles_per_90", "fouls", "pass_accuracy"]
_PCT = "case when {c} is not null and fit then (rank() over (partition by position, fit order by {c} nulls last) - 1 + (count({c}) over (partition by position, fit, {c})) / 2.0) / count({c}) over (partition by position, fit) * 100 end"


def _mode_sql(mode: str) -> str:
    full = mode == "full"
    value = {"xa_per_90": "xa" if full else "xa_per_90", "tackles_per_90": "case when minutes > 0 then tackles_per_90 * minutes / 90.0::double end" if full else "tackles_per_90", "fouls": "fouls" if full else "case when minutes > 0 then fouls * 90.0::double / minutes end", "pass_accuracy": "pass_accuracy"}
    values = ", ".join(f"{v} as v_{m}" for m, v in value.items())
    shown = ", ".join(f"round(v_{m}, 6) as {m}, round({_PCT.format(c='v_' + m)}, 6) as {m}_percentile" for m in _SHOWN)
    return f"with {season_queries._METRICS}, v as (select entity, position, coalesce(position in ('DEF', 'MID', 'FWD') and minutes >= 450, false) as fit, {values} from metrics) select entity, {shown} from v"


def _in_mode(spark: SparkSession, d: str, mode: str) -> DataFrame:
    fit = F.coalesce(F.col("position").isin("DEF", "MID", "FWD") & (F.col("minutes") >= 450), F.lit(False))
    rows = season_queries.metrics(spark, d).select("entity", "position", "minutes", "xa", *_SHOWN)
    rows = with_percentiles(rows, ["entity"], "position", {m: f"{m}_percentile" for m in ["xa", *_SHOWN]}, fit)
    made = requests.in_rate_mode(rows, ["entity"], _SHOWN, mode, "position", fit)
    return made.select("entity", *(F.round(c, 6).alias(c) for m in _SHOWN for c in (m, f"{m}_percentile")))


@query(_mode_sql("full"))
def rate_mode_full(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as a season's totals, stored or worked out, with the percentiles that go with them."""
    return _in_mode(spark, d, "full")


@query(_mode_sql("rate"))
def rate_mode_rate(spark: SparkSession, d: str) -> DataFrame:
    return _in_mode(spark, d, "rate")


@query("""select s_suppkey, round(case when m > 0 then v / m end, 6) as goals, round(case when m > 0 then v end, 6) as place, v as percentage, round(case when m > 0 then v / m else v end, 6) as shown_goals, v as shown_points from (select s_suppkey, s_acctbal::double as v, s_suppkey % 4 as m from supplier)""")
def team_per_match(spark: SparkSession, d: str) -> DataFrame:
    """A team's value by match, as ranks and as profiles have it."""
    v, m = F.col("s_acctbal").cast("double"), F.col("s_suppkey") % 4
    rate, shown = requests.per_match, requests.shown_per_match
    return read(spark, d, "supplier").select(
        "s_suppkey", F.round(rate("goals", v, m, False), 6).alias("goals"), F.round(rate("rank", v, m, False), 6).alias("place"), rate("possession", v, m, True).alias("percentage"),
        F.round(shown("goals", v, m, False), 6).alias("shown_goals"), shown("points", v, m, False).alias("shown_points"),
    )


@query("""select c_custkey from customer where upper(c_mktsegment) in ('BUILDING', 'MACHINERY') and (c_nationkey in (3, 5) or lower(c_name) = 'customer#000000007' or c_custkey = 7)""")
def several_filters(spark: SparkSession, d: str) -> DataFrame:
    """Several positions, and teams by id or by name."""
    rows = read(spark, d, "customer").withColumn("name", F.when(F.col("c_custkey") == 7, "Seven").otherwise(F.col("c_name")))
    fits = requests.several(["building", "Machinery"], [3, 5], ["SEVEN", "customer#000000007"], "c_mktsegment", "c_nationkey", "name")
    return rows.where(fits).select("c_custkey")


@query("""select min(least(p_size, p_retailprice)) - 0.07 * (max(greatest(p_size, p_retailprice)) - min(least(p_size, p_retailprice))) as low, round(max(greatest(p_size, p_retailprice)) + 0.07 * (max(greatest(p_size, p_retailprice)) - min(least(p_size, p_retailprice))), 6) as high from part""")
def padded_domain(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"))
    return requests.padded_domain(p, ["a", "b"]).select("low", F.round("high", 6).alias("high"))


@query(f"""with {match_queries._EVENTS}, c as (select user_id, least(x * 12 // 10000, 11) * 8 + least(y * 8 // 10000, 7) as cell, count(*) as n from a where action and x is not null and y is not null group by 1, 2)
    select user_id, cell::int as cell, round(sqrt(n / max(n) over (partition by user_id)), 9) as intensity from c""")
def cell_intensity(spark: SparkSession, d: str) -> DataFrame:
    """How strongly each cell with actions is drawn."""
    grid = match_queries.event_action_grid(spark, d).where("n > 0").select("user_id", "cell", F.col("n").cast("double").alias("share"))
    return requests.intensity(grid, ["user_id"]).select("user_id", "cell", F.round("intensity", 9).alias("intensity"))


@query(f"""with {match_queries._MEMBER}, p as (select k, min(case when competition = 'ALL' and season = '1996' then 0 when coalesce(aggregate_season, season) = '1996' and {match_queries._INLAND} then 1 when competition = 'ALL' then 2 else 3 end) as priority from m group by 1)
    select c_custkey, priority from customer join p on k = c_custkey where contains(lower(c_name), '00012') order by priority, c_acctbal desc, c_custkey limit 10""")
def palette_search(spark: SparkSession, d: str) -> DataFrame:
    """The first ten customers whose name holds a text, those within the scope first."""
    first = selection.membership_priority(match_queries._members(spark, d), "k", "ALL", "1996")
    c = read(spark, d, "customer").join(first, F.col("k") == F.col("c_custkey"))
    return requests.search(c, "c_name", " 00012 ", [F.desc("c_acctbal"), F.col("c_custkey")], 10).select("c_custkey", "priority")


@query("""with o as (select o_custkey as k, o_orderpriority as c, year(o_orderdate) as y, floor(o_totalprice)::bigint as m, o_orderkey as i, o_orderstatus <> 'P' as dom from orders),
    f as (select * from o qualify row_number() over (partition by k, c, y order by m desc, i) = 1) select k, string_agg(c || ':' || y || ':' || m, ',' order by c, y, m) as members, any_value(t) as total from f join (select k, sum(case when dom then m else 0 end) as t from o group by 1) using (k) group by 1""")
def member_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each priority and year by customer, and a sum over every counted row."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("c"), F.year("o_orderdate").alias("y"), F.floor("o_totalprice").cast("long").alias("m"), "o_orderkey", "o_orderstatus")
    made = requests.member_lists(o, "k", ["c", "y"], [F.desc("m"), F.col("o_orderkey")], "m", F.col("o_orderstatus") != "P")
    listed = F.concat_ws(",", F.transform("members", lambda x: F.concat_ws(":", x["c"], x["y"].cast("string"), x["m"].cast("string"))))
    return made.select("k", listed.alias("members"), F.col("total_minutes").alias("total"))


@query("""select p_partkey as k, p_size % 3 = 0 as split from part where p_partkey % 4 > 0 and p_partkey % 5 > 0 and (p_size % 3 > 0 or p_size % 6 = 0) and p_size % 3 <> 1""")
def profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Season totals and one team's splits, of entities with a current derived row and an available module."""
    k, s = F.col("p_partkey"), F.col("p_size")
    modules = F.array(F.struct((k % 5 > 0).alias("available")), F.struct(F.lit(False).alias("available")))
    rows = read(spark, d, "part").select(k.alias("k"), F.when(s % 3 == 0, s % 6).when(s % 3 == 1, F.lit(9)).alias("team_id"), modules.alias("modules"))
    derived = read(spark, d, "part").select(k.alias("k"), (k % 4 > 0).alias("is_current"))
    total, split = (requests.profiles(rows, derived, ["k"], t) for t in (None, 0))
    return total.select("k", F.lit(False).alias("split")).unionByName(split.select("k", F.lit(True).alias("split")))


@query(r"""select o_orderkey, regexp_matches(label, '^\d{4}$') as plain, coalesce(position <> 'GK', false) as outfield from (select o_orderkey, case when o_orderkey % 3 = 0 then year(o_orderdate) || '-97' else year(o_orderdate)::varchar end as label, case o_orderkey % 4 when 0 then 'GK' when 1 then 'DEF' when 2 then 'FWD' end as position from orders)""")
def season_and_position_tests(spark: SparkSession, d: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    label = F.when(k % 3 == 0, F.concat(y, F.lit("-97"))).otherwise(y)
    position = F.when(k % 4 == 0, "GK").when(k % 4 == 1, "DEF").when(k % 4 == 2, "FWD")
    return read(spark, d, "orders").select("o_orderkey", requests.plain_year(label).alias("plain"), requests.outfield(position).alias("outfield"))


_KEEPERS = """k as (select s_suppkey as entity, 'GK' as position, case when s_suppkey % 9 > 0 then 90 * (1 + s_suppkey % 30) else 0 end as minutes, s_suppkey % 13 / 4.0::double as saves_per_90, (s_suppkey % 40)::double as saves, s_suppkey % 17 / 3.0::double as completed_passes_per_90, (s_suppkey % 11)::double as clean_sheets, s_suppkey % 7 / 7.0::double as rating from supplier)"""
_BARS = ["saves_per_90", "completed_passes_per_90", "clean_sheets", "rating"]


def _keepers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    number = lambda m, by: ((k % m) / F.lit(float(by)))
    rows = read(spark, d, "supplier").select(k.alias("entity"), F.lit("GK").alias("position"), F.when(k % 9 > 0, 90 * (1 + k % 30)).otherwise(0).alias("minutes"), number(13, 4).alias("saves_per_90"), number(40, 1).alias("saves"), number(17, 3).alias("completed_passes_per_90"), number(11, 1).alias("clean_sheets"), number(7, 7).alias("rating"))
    fit = F.col("minutes") >= 450
    return with_percentiles(rows, ["entity"], "position", {m: f"{m}_percentile" for m in ["saves", *_BARS]}, fit)


def _keeper_sql(mode: str) -> str:
    full = mode == "full"
    value = {"saves_per_90": "saves" if full else "saves_per_90", "completed_passes_per_90": "case when minutes > 0 then floor(completed_passes_per_90 * minutes / 90.0::double + 0.5) end" if full else "completed_passes_per_90", "clean_sheets": "clean_sheets" if full else "case when minutes > 0 then clean_sheets * 90.0::double / minutes end", "rating": "rating"}
    shown = ", ".join(f"round(v_{m}, 6) as {m}, round({_PCT.format(c='v_' + m)}, 6) as {m}_percentile" for m in _BARS)
    return f"with {_KEEPERS}, v as (select entity, position, minutes >= 450 as fit, {', '.join(f'{v} as v_{m}' for m, v in value.items())} from k) select entity, {shown} from v"


def _keeper_rows(spark: SparkSession, d: str, mode: str) -> DataFrame:
    made = requests.in_rate_mode(_keepers(spark, d), ["entity"], _BARS, mode, "position", F.col("minutes") >= 450, requests.KEEPERS)
    return made.select("entity", *(F.round(c, 6).alias(c) for m in _BARS for c in (m, f"{m}_percentile")))


@query(_keeper_sql("full"))
def keeper_mode_full(spark: SparkSession, d: str) -> DataFrame:
    """Goalkeepers' metrics as a season's totals."""
    return _keeper_rows(spark, d, "full")


@query(_keeper_sql("rate"))
def keeper_mode_rate(spark: SparkSession, d: str) -> DataFrame:
    """Goalkeepers' metrics as rates."""
    return _keeper_rows(spark, d, "rate")


def _bar_sql() -> str:
    pct = lambda m: _PCT.format(c=m)
    season = "case when minutes > 0 then floor(completed_passes_per_90 * minutes / 90.0::double + 0.5) end"
    rows = [("rating", "full", "rating", "rating"), ("saves", "full", "saves", "saves"), ("saves", "rate", "saves_per_90", "saves_per_90"), ("passes", "full", season, "completed_passes_per_90"), ("passes", "rate", "completed_passes_per_90", "completed_passes_per_90")]
    return f"with {_KEEPERS}, f as (select *, minutes >= 450 as fit from k) " + " union all ".join(f"select entity, '{b}' as bar, '{m}' as mode, round({v}, 6) as value, round({pct(p)}, 6) as percentile from f" for b, m, v, p in rows)


@query(_bar_sql())
def profile_bars(spark: SparkSession, d: str) -> DataFrame:
    """The three kinds of bars of a profile, by mode, with the percentile that goes with each."""
    rows, fit, minutes = _keepers(spark, d), F.col("minutes") >= 450, F.col("minutes")
    bars = [("rating", "invariant", "rating", None, "full"), ("saves", "paired", "saves_per_90", "saves", "full"), ("saves", "paired", "saves_per_90", "saves", "rate"), ("passes", "derived", "completed_passes_per_90", None, "full"), ("passes", "derived", "completed_passes_per_90", None, "rate")]
    made = [(name, mode, *requests.profile_bar(kind, rate, full, mode, minutes, fit, whole=True)) for name, kind, rate, full, mode in bars]
    cells = F.array(*(F.struct(F.lit(n).alias("bar"), F.lit(m).alias("mode"), F.round(v, 6).alias("value"), F.round(p, 6).alias("percentile")) for n, m, v, p in made))
    return rows.select("entity", F.explode(cells).alias("c")).select("entity", "c.*")
