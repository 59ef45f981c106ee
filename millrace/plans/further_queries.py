"""Array lists, schedules, fuzzy matches, explanations and gates over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rates, seasons
from ..functions.text import name_tokens
from ..operators import distribution, ranking, word_sets
from ..operators.distribution import unpivot
from .registry import query, read

#: named predicates over events, combined by name
EVENT_FILTERS = {
    "large": lambda: F.col("value") > 50,
    "morning": lambda: F.hour("ts") < 12,
    "even_user": lambda: F.col("user_id") % 2 == 0,
}


def named_filter(names: list[str]) -> Column:
    """All of the named predicates; an unknown name is an error."""
    out = F.lit(True)
    for n in dict.fromkeys(names):
        out = out & EVENT_FILTERS[n]()
    return out


@query("select event_id from events where value > 50 and hour(ts) < 12 and user_id % 2 = 0")
def named_event_filters(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where(named_filter(["large", "morning", "even_user", "large"])).select("event_id")


@query("""select o_custkey, list_sort(list_filter(list_distinct(list_concat(a, b)), lambda x: not list_contains(c, x))) as others from
    (select o_custkey, coalesce(list(distinct o_orderpriority) filter (o_orderstatus = 'F'), []) as a, coalesce(list(distinct o_orderpriority) filter (o_orderstatus = 'O'), []) as b, coalesce(list(distinct o_orderpriority) filter (o_orderstatus = 'P'), []) as c from orders group by 1)""")
def secondary_lists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct members of two lists without those of a third, in order."""
    one = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    sets = read(spark, d, "orders").groupBy("o_custkey").agg(one("F").alias("a"), one("O").alias("b"), one("P").alias("c"))
    return sets.select("o_custkey", F.array_sort(F.array_except(F.array_union("a", "b"), "c")).alias("others"))


@query("""select n_nationkey, place, round(sum(30 + (n_nationkey * 17) % 11) over (order by place rows between unbounded preceding and current row), 6)::bigint as starts_after from
    (select n_nationkey, row_number() over (order by (n_nationkey + 200) % 25, n_nationkey) as place from nation)""")
def planned_order(spark: SparkSession, d: str) -> DataFrame:
    """A rotation that moves on each day, with jittered delays added up; over a dimension of few rows."""
    day = F.lit("2021-07-19").cast("date")  # the 200th day
    rows = read(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(seasons.rotation(F.col("n_nationkey"), day, 25), "n_nationkey")).alias("place"))
    delay = (30 + (F.col("n_nationkey") * 17) % 11).cast("long")
    return rows.withColumn("starts_after", F.sum(delay).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))


@query("""select o_custkey, o_orderpriority, max(o_orderdate) as last_day, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order from orders where o_orderstatus = 'F' group by 1, 2""")
def latest_success(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "orders").where("o_orderstatus = 'F'")
    return done.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderdate").alias("last_day"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query(r"""with p as (select p_partkey, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size), '[^0-9a-z]+'), lambda x: length(x) > 0))) as w from part),
    s as (select a.p_partkey as k, b.p_partkey as c, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as likeness from p a, p b where a.p_partkey % 20 = 0 and a.p_partkey <> b.p_partkey and list_has_any(a.w, b.w)),
    r as (select *, row_number() over (partition by k order by likeness desc, c) as n, lead(likeness) over (partition by k order by likeness desc, c) as next from s)
    select k, c, round(likeness, 6) as likeness from r where n = 1 and likeness >= 0.3 and (next is null or likeness - next > 0.03)""")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """The best other part of those with ids divisible by 20 by shared words of name, brand, type and size, if it is near enough and no other is about as near."""
    named = read(spark, d, "part").withColumn("p_name", F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size"))
    return best_by_words(named, "p_partkey % 20 = 0", "true")


@query(r"""with p as (select p_partkey, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^0-9a-z]+'), lambda x: length(x) > 0))) as w from part),
    s as (select a.p_partkey as k, b.p_partkey as c, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as likeness from p a, p b where a.p_partkey % 20 = 0 and a.p_partkey <> b.p_partkey and list_has_any(a.w, b.w)),
    r as (select *, row_number() over (partition by k order by likeness desc, c) as n, lead(likeness) over (partition by k order by likeness desc, c) as next from s)
    select k, c, round(likeness, 6) as likeness from r where n = 1 and likeness >= 0.3 and (next is null or likeness - next > 0.03)""")
def fuzzy_match_all(spark: SparkSession, d: str) -> DataFrame:
    """The same by words of the name alone."""
    return best_by_words(read(spark, d, "part"), "p_partkey % 20 = 0", "true")


def best_by_words(parts: DataFrame, queries: str, candidates: str) -> DataFrame:
    """k, c, likeness: the best other part by shared name words, if it is near enough and no other is about as near."""
    part = parts.select("p_partkey", F.array_sort(name_tokens(F.col("p_name"))).alias("w"))
    return word_sets.best(part.where(queries), part.where(candidates), "p_partkey", "w", least=0.3, tie=0.03).select("k", "c", F.round("likeness", 6).alias("likeness"))


_EXPLAINED = """with m as (select p_partkey, unnest(['size', 'price', 'key']) as metric, unnest([p_size / 50.0::double, p_retailprice / 2000.0::double, (p_partkey % 97) / 97.0::double]) as v from part),
    q as (select * from m where p_partkey = 1)
    select m.p_partkey, m.metric, round(abs(m.v - q.v) * case m.metric when 'size' then 0.5::double when 'price' then 0.3::double else 0.2::double end, 6) as delta from m join q using (metric) where m.p_partkey <> 1
    qualify row_number() over (partition by m.p_partkey order by abs(m.v - q.v) * case m.metric when 'size' then 0.5::double when 'price' then 0.3::double else 0.2::double end desc, m.metric) <= 2"""


@query(_EXPLAINED)
def similarity_explanation(spark: SparkSession, d: str) -> DataFrame:
    """The two largest weighted feature differences of every other part to one subject."""
    return explained(read(spark, d, "part"))


@query(_EXPLAINED)
def similarity_explanation_all(spark: SparkSession, d: str) -> DataFrame:
    """The same, under the name it had beside a narrower one."""
    return explained(read(spark, d, "part"))


def explained(parts: DataFrame) -> DataFrame:
    """p_partkey, metric, delta: the two largest weighted feature differences of each part to part 1."""
    part = parts.select("p_partkey", (F.col("p_size") / 50.0).alias("size"), (F.col("p_retailprice") / 2000.0).alias("price"), ((F.col("p_partkey") % 97) / 97.0).alias("key"))
    long = unpivot(part, ["p_partkey"], ["size", "price", "key"])
    subject = long.where("p_partkey = 1").select("metric", F.col("value").alias("own"))  # three rows
    weight = F.when(F.col("metric") == "size", 0.5).when(F.col("metric") == "price", 0.3).otherwise(0.2)
    delta = long.where("p_partkey <> 1").join(F.broadcast(subject), "metric").withColumn("delta", F.abs(F.col("value") - F.col("own")) * weight)
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.desc("delta"), "metric"))
    return delta.withColumn("place", place).where("place <= 2").select("p_partkey", "metric", F.round("delta", 6).alias("delta"))


@query("""select event_type, median(value) as middle, median(value) >= 50 as passed from events where value > 0 group by 1 having count(*) >= 3""")
def median_gate(spark: SparkSession, d: str) -> DataFrame:
    e = distribution.summary(read(spark, d, "events").where("value > 0"), ["event_type"], "value").withColumnRenamed("p50", "middle")
    return e.where("n >= 3").select("event_type", "middle", (F.col("middle") >= 50).alias("passed"))


@query("""select user_id, count(distinct ts::date) as days, least(1.0, count(distinct ts::date) / round_even(30 * 2 / 3.0, 0)) as coverage, count(*) filter (event_type = 'view') > 0 as any_views, count(*) filter (event_type = 'view') >= 20 and count(*) >= 100 as enough from events group by 1""")
def availability_flags(spark: SparkSession, d: str) -> DataFrame:
    views = F.count_if(F.col("event_type") == "view")
    days = F.countDistinct(F.to_date("ts"))
    return read(spark, d, "events").groupBy("user_id").agg(days.alias("days"), F.least(F.lit(1.0), days / F.bround(F.lit(30 * 2 / 3.0), 0)).alias("coverage"), (views > 0).alias("any_views"), ((views >= 20) & (F.count("*") >= 100)).alias("enough"))


@query("""select c_custkey, list_filter([case when n > 0 then 'all' end, case when n >= 10 then 'regular' end, case when late > 0 then 'recent' end], lambda x: x is not null) as scopes from
    (select c_custkey, count(o_orderkey) as n, count(*) filter (o_orderdate >= timestamp '1998-01-01') as late from customer left join orders on o_custkey = c_custkey group by 1)""")
def comparison_scopes(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderdate") >= "1998-01-01").alias("late"))
    scopes = F.filter(F.array(F.when(F.col("n") > 0, "all"), F.when(F.col("n") >= 10, "regular"), F.when(F.col("late") > 0, "recent")), lambda x: x.isNotNull())
    return n.select("c_custkey", scopes.alias("scopes"))


@query("""select c_custkey, coalesce(by_id, by_name) as before, case when by_id is not null then 'id' when by_name is not null then 'name' else 'new' end as found_by from customer
    left join (select s_suppkey as k, s_suppkey * 2 as by_id from supplier where s_suppkey % 2 = 0) a on k = c_custkey
    left join (select substr(s_name, 10) as t, min(s_suppkey) as by_name from supplier group by 1) b on t = substr(c_name, 10)""")
def previous_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an earlier state, found by id and else by name."""
    s = read(spark, d, "supplier")
    by_id = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("c_custkey"), (F.col("s_suppkey") * 2).alias("by_id"))
    by_name = s.groupBy(F.expr("substr(s_name, 10)").alias("t")).agg(F.min("s_suppkey").alias("by_name"))
    c = read(spark, d, "customer").select("c_custkey", F.expr("substr(c_name, 10)").alias("t"))
    both = c.join(by_id, "c_custkey", "left").join(by_name, "t", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("new")
    return both.select("c_custkey", F.coalesce("by_id", "by_name").alias("before"), how.alias("found_by"))


@query("""select l_suppkey, round(100 * exp(-avg(l_discount) / 0.05), 6) as decayed, round((count(*) over () - rank() over (order by count(*) desc)) / (count(*) over () - 1)::double * 100, 6) as standing from lineitem group by 1""")
def decay_and_standing(spark: SparkSession, d: str) -> DataFrame:
    """Decay scores and rank percentages of the suppliers, a table of one row each."""
    g = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("x"), F.count("*").alias("lines"))
    ranked = ranking.competition_rank(g, [], "lines", "place").crossJoin(F.broadcast(g.agg(F.count("*").alias("total"))))  # one row
    return ranked.select("l_suppkey", F.round(rates.decay_score(F.col("x"), F.lit(0.05)), 6).alias("decayed"), F.round(rates.rank_percent(F.col("place"), F.col("total")), 6).alias("standing"))
