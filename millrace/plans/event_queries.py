"""Event counts, grids, flows and orders over the driver tables; coordinates are made from event ids and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seasons
from ..operators import spatial
from ..streaming import events as streams
from .registry import query, read

_XY = "select *, (event_id * 7919) % 10001 as x, (event_id * 104729) % 10001 as y, (event_id * 31337) % 10001 as ex, (event_id * 65537) % 10001 as ey, value > 50 as ok from events"


def _xy(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: ((F.col("event_id") * k) % 10001).cast("int")
    return read(spark, d, "events").withColumns({"x": at(7919), "y": at(104729), "ex": at(31337), "ey": at(65537), "ok": F.col("value") > 50})


@query("""select user_id, count(*) as n, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'purchase' and value > 50) as large_purchases, count(distinct ts::date) as days,
    round_even(avg(value) filter (event_type = 'view'), 0) as mean_view, sum(m) as minutes from (select *, case when row_number() over (partition by user_id, ts::date order by minute(ts) desc, event_id) = 1 then minute(ts) else 0 end as m from events) group by 1""")
def event_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """By user and day first, so that a user without an id is a row as well; the mean is settled before it is rounded, as sums in another order differ in their last bits."""
    kind, value = F.col("event_type"), F.col("value")
    viewed = F.when(kind == "view", value)
    days = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(kind == "click").alias("clicks"), F.count_if((kind == "purchase") & (value > 50)).alias("large_purchases"), F.sum(viewed).alias("s"), F.count(viewed).alias("views"), F.max(F.minute("ts")).alias("m")
    )
    longest = F.coalesce("m", F.when(F.col("n") > 1, 0))
    total = [F.sum(c).alias(c) for c in ("n", "clicks", "large_purchases")]
    mean = F.bround(F.round(F.sum("s") / F.nullif(F.sum("views"), F.lit(0)), 9))
    return days.groupBy("user_id").agg(*total, F.count("day").alias("days"), mean.alias("mean_view"), F.sum(longest).alias("minutes"))


@query(f"""with e as ({_XY}), c as (select event_type, least(x * 12 // 10000, 11) * 8 + least(y * 8 // 10000, 7) as cell, count(*) as n from e group by 1, 2),
    t as (select event_type, sum(n) as total from c group by 1) select t.event_type, g.cell::int as cell, coalesce(n, 0) as n, round(coalesce(n, 0) / total, 9) as share from t, unnest(range(96)) as g(cell) left join c on c.event_type = t.event_type and c.cell = g.cell""")
def dense_grid_counts(spark: SparkSession, d: str) -> DataFrame:
    g = spatial.dense_grid(_xy(spark, d), ["event_type"], "x", "y")
    return g.select("event_type", "cell", "n", F.round("share", 9).alias("share"))


@query("""with z as (select event_type, value > 50 as ok, least(floor(value / 20), 4)::int as a, least(floor(lead(value) over (partition by user_id order by ts, event_id) / 20), 4)::int as b from events),
    c as (select event_type, a, b, count(*) as attempts, count(*) filter (ok) as completions from z where b is not null group by all), t as (select distinct event_type from c)
    select t.event_type, f.a::int as from_zone, g.b::int as to_zone, coalesce(attempts, 0) as attempts, coalesce(completions, 0) as completions, round(case when attempts > 0 then completions / attempts end, 9) as rate
    from t, unnest(range(5)) as f(a), unnest(range(5)) as g(b) left join c on c.event_type = t.event_type and c.a = f.a and c.b = g.b""")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    follow = F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    zone = lambda v: F.least(F.floor(v / 20), F.lit(4)).cast("int")
    e = read(spark, d, "events").select("event_type", (F.col("value") > 50).alias("ok"), zone(F.col("value")).alias("a"), zone(follow).alias("b"))
    flow = spatial.zone_flow(e, ["event_type"], "a", "b", F.col("ok"), 5)
    return flow.select("event_type", "from_zone", "to_zone", "attempts", "completions", F.round("rate", 9).alias("rate"))


_GOAL = "sqrt(pow((10000.0::double - {x}) / 10000 * 105, 2) + pow((5000.0::double - {y}) / 10000 * 68, 2))"


@query(f"""select event_id, round({_GOAL.format(x='x', y='y')}, 6) as goal_distance, {_GOAL.format(x='x', y='y')} - {_GOAL.format(x='ex', y='ey')} >= case when x < 5000 and ex < 5000 then 30 when x < 5000 then 15 else 10 end as progressive,
    ok and x < 6670 and ex >= 6670 as final_third, ok and not (x >= 8350 and y between 2110 and 7890) and ex >= 8350 and ey between 2110 and 7890 as box_entry from ({_XY})""")
def spatial_flags(spark: SparkSession, d: str) -> DataFrame:
    x, y, ex, ey, ok = (F.col(c) for c in ("x", "y", "ex", "ey", "ok"))
    return _xy(spark, d).select("event_id", F.round(spatial.goal_distance(x, y), 6).alias("goal_distance"), spatial.progressive(x, y, ex, ey).alias("progressive"), spatial.enters_final_third(x, ex, ok).alias("final_third"), spatial.enters_box(x, y, ex, ey, ok).alias("box_entry"))


@query("select event_id, (props->>'$.k')::bigint as k, coalesce((props->>'$.k')::bigint > 50, false) as large, json_exists(props, '$.missing') as has_missing from events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("p", F.from_json("props", "k long, missing string"))
    return e.select("event_id", F.col("p.k").alias("k"), F.coalesce(F.col("p.k") > 50, F.lit(False)).alias("large"), F.col("p.missing").isNotNull().alias("has_missing"))


@query("""select event_id, row_number() over (partition by user_id order by ts::date, hour(ts), coalesce(minute(ts), 0), event_id) - 1 as event_index, dense_rank() over (partition by user_id order by ts::date) - 1 as day_index from events""")
def event_order_index(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("user_id")
    index = F.row_number().over(by.orderBy(F.to_date("ts"), F.hour("ts"), F.coalesce(F.minute("ts"), F.lit(0)), "event_id")) - 1
    return read(spark, d, "events").select("event_id", index.alias("event_index"), (F.dense_rank().over(by.orderBy(F.to_date("ts"))) - 1).alias("day_index"))


@query("""select event_id, ts + interval 12 hours <= (select max(ts) from events) as settled from events""")
def settlement_window(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", seasons.settled(F.col("ts"), F.col("now")).alias("settled"))  # one row


@query("""select label, (label[:4]::int) || '-' || lpad(((label[:4]::int + 1) % 100)::varchar, 2, '0') as aggregate, label[:4]::int + case when contains(label, '-') then 1 else 0 end as sort_order, count(*) as n from
    (select case when o_orderkey % 2 = 0 then year(o_orderdate)::varchar else year(o_orderdate) || '-' || lpad(((year(o_orderdate) + 1) % 100)::varchar, 2, '0') end as label from orders) group by 1""")
def season_alignment(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    o = read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, y.cast("string")).otherwise(seasons.split_label(y)).alias("label"))
    return o.groupBy("label").agg(F.count("*").alias("n")).select("label", seasons.aggregate_label(F.col("label")).alias("aggregate"), seasons.sort_order(F.col("label")).alias("sort_order"), "n")


@query("""select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def windowed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming counts."""
    out = streams.windowed_counts(read(spark, d, "events"), "ts", ["event_type"], value=F.col("value"))
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""with s as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
    g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts range between unbounded preceding and current row) as k from s)
    select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from g group by user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(read(spark, d, "events"), "ts", "user_id")


@query("""select user_id, round(min(sqrt(pow(x - least(greatest(x, 2000), 8000), 2) + pow(y - 5000, 2))), 6) as nearest, arg_min(event_id, (sqrt(pow(x - least(greatest(x, 2000), 8000), 2) + pow(y - 5000, 2)), event_id)) as event_id from (""" + _XY + """) group by 1""")
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    c = lambda v: F.lit(float(v))
    e = _xy(spark, d).withColumn("away", spatial.segment_distance(F.col("x").cast("double"), F.col("y").cast("double"), c(2000), c(5000), c(8000), c(5000)))
    return e.groupBy("user_id").agg(F.round(F.min("away"), 6).alias("nearest"), F.min_by("event_id", F.struct(F.round("away", 6), "event_id")).alias("event_id"))
