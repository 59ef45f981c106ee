"""Rates, percentiles, z-scores, scores, ranks and distributions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rates
from ..operators import distribution, ranking
from .registry import query, read
from .spec import Metric, Score, scorecard, with_metrics

LINE = ["l_orderkey", "l_linenumber"]


@query("""select l_orderkey, l_linenumber,
    round(case when l_quantity > 0 then l_extendedprice * 90.0::double / l_quantity end, 6) as per_90,
    round(case when l_tax <> 0 then l_discount / l_tax end, 6) as discount_to_tax,
    round(l_discount + l_tax, 6) as both_rates from lineitem""")
def rate_per_unit(spark: SparkSession, d: str) -> DataFrame:
    q, p, x, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return read(spark, d, "lineitem").select(*LINE, F.round(rates.per_unit(p, q), 6).alias("per_90"), F.round(rates.ratio(x, t), 6).alias("discount_to_tax"), F.round(rates.sum_required(x, t), 6).alias("both_rates"))


@query("""select c_custkey, coalesce(best_open, best_any, c_acctbal, 0) as spend,
    case when best_open is not null then 'open' when best_any is not null then 'any' when c_acctbal is not null then 'balance' else 'none' end as taken_from
    from customer left join (select o_custkey, max(o_totalprice) filter (o_orderstatus = 'O') as best_open, max(o_totalprice) as best_any from orders group by 1) on c_custkey = o_custkey""")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    best = read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("best_open"), F.max("o_totalprice").alias("best_any"))
    both = read(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    source = F.when(F.col("best_open").isNotNull(), "open").when(F.col("best_any").isNotNull(), "any").when(F.col("c_acctbal").isNotNull(), "balance").otherwise("none")
    return both.select("c_custkey", F.coalesce("best_open", "best_any", "c_acctbal", F.lit(0)).alias("spend"), source.alias("taken_from"))


@query("""select c_custkey, c_mktsegment, case when count(n) over (partition by c_mktsegment) > 0 then coalesce(n, 0) end as orders_or_null
    from (select c_custkey, c_mktsegment, case when c_mktsegment <> 'BUILDING' then k end as n
          from customer left join (select o_custkey, count(*) as k from orders where o_orderstatus = 'F' group by 1) on c_custkey = o_custkey)""")
def null_availability_rule(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("k"))
    both = read(spark, d, "customer").join(k, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.when(F.col("c_mktsegment") != "BUILDING", F.col("k")))
    return distribution.zero_where_recorded(both, ["c_mktsegment"], "n", "orders_or_null").select("c_custkey", "c_mktsegment", "orders_or_null")


@query("""select l_partkey, round(case when n > 0 then (hits - expected) / n * (n / (n + 35.0::double)) end, 9) as surplus,
    round(case when hits + misses > 0 then hits / (hits + misses) when n > 0 then least(1.0, hits / n) end, 9) as hit_share
    from (select l_partkey, count(*)::double as n, sum(case when l_returnflag = 'R' then 1.0::double else 0 end) as hits,
          sum(l_discount) as expected, sum(case when l_returnflag = 'A' then 1.0::double else 0 end) as misses from lineitem group by 1)""")
def shrunk_delta(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, 1.0).otherwise(0.0))
    parts = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").cast("double").alias("n"), flag("R").alias("hits"), F.sum("l_discount").alias("expected"), flag("A").alias("misses"))
    n, h, e, m = (F.col(c) for c in ("n", "hits", "expected", "misses"))
    return parts.select("l_partkey", F.round(rates.shrunk_delta(h, e, n), 9).alias("surplus"), F.round(rates.share_of_known(h, m, n), 9).alias("hit_share"))


_MIDRANK = "((rank() over w - 1) + count(*) over (partition by {g} order by {v} range between unbounded preceding and current row)) / 2.0::double / count(*) over (partition by {g}) * 100.0"


@query("""select l_orderkey, l_linenumber, l_returnflag, round(case when l_quantity >= 10 then ((rank() over w - 1) + count(*) over (w range between unbounded preceding and current row)) / 2.0::double
        / count(*) over (partition by l_returnflag, l_quantity >= 10) * 100.0 end, 9) as percentile from lineitem window w as (partition by l_returnflag, l_quantity >= 10 order by l_extendedprice)""")
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(*LINE, "l_returnflag", "l_extendedprice", "l_quantity")
    out = ranking.midrank_percentile(rows, ["l_returnflag"], "l_extendedprice", "p", eligible=F.col("l_quantity") >= 10)
    return out.select(*LINE, "l_returnflag", F.round("p", 9).alias("percentile"))


@query("""select s_suppkey, s_nationkey, round((count(*) filter (c_acctbal < s_acctbal) + count(*) filter (c_acctbal <= s_acctbal)) / 2.0::double / nullif(count(c_custkey), 0) * 100.0, 9) as percentile
    from supplier left join customer on c_nationkey = s_nationkey group by 1, 2, s_acctbal""")
def scope_percentile_external(spark: SparkSession, d: str) -> DataFrame:
    probes = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"))
    population = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))
    out = ranking.external_percentile(probes, population, ["nation"], "v", "p")
    return out.select("s_suppkey", F.col("nation").alias("s_nationkey"), F.round("p", 9).alias("percentile"))


@query(f"""select l_orderkey, l_linenumber, v as adjusted, round({_MIDRANK.format(g='l_shipmonth', v='v')}, 9) as percentile
    from (select l_orderkey, l_linenumber, month(l_shipdate) as l_shipmonth, round_even(l_extendedprice * 90.0::double / l_quantity, 0) as v from lineitem where l_quantity > 0)
    window w as (partition by l_shipmonth order by v)""")
def rate_adjusted_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").where("l_quantity > 0").select(*LINE, F.month("l_shipdate").alias("m"), rates.rescale(F.col("l_extendedprice"), F.col("l_quantity"), "rate", whole=True).alias("v"))
    return ranking.midrank_percentile(rows, ["m"], "v", "p").select(*LINE, F.col("v").alias("adjusted"), F.round("p", 9).alias("percentile"))


@query("""with b as (select o_orderpriority, quantile_cont(o_totalprice, 0.05) as lo, quantile_cont(o_totalprice, 0.95) as hi from orders group by 1),
    h as (select o_orderkey, o_orderpriority, greatest(lo, least(hi, o_totalprice)) as held from orders join b using (o_orderpriority)),
    m as (select o_orderpriority, avg(held) as mean, stddev_pop(held) as dev from h group by 1)
    select o_orderkey, o_orderpriority, round(case when dev > 0 then (held - mean) / dev else 0 end, 6) as z from h join m using (o_orderpriority)""")
def winsorized_zscore(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return distribution.winsorized_zscore(rows, ["o_orderpriority"], "o_totalprice", "z").select("o_orderkey", "o_orderpriority", F.round("z", 6).alias("z"))


PART_SCORES = [Score("value", {"size": 0.6, "price": 0.4}), Score("demand", {"sold": 0.5, "price": 0.3}, {"discount": 0.2})]
PART_METRICS = [
    Metric("size", lambda: F.col("p_size").cast("double")),
    Metric("price", lambda: F.col("p_retailprice")),
    Metric("sold", lambda: F.col("quantity")),
    Metric("discount", lambda: F.col("discount"), lower_is_better=True),
]


def _parts(spark: SparkSession, d: str) -> DataFrame:
    sold = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return with_metrics(read(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left"), PART_METRICS, ["p_partkey", "p_brand", "p_size"])


def _score_sql(top: int | None) -> str:
    metrics = {"size": "p_size::double", "price": "p_retailprice", "sold": "quantity", "discount": "discount"}
    m = ", ".join(f"{e} as {n}" for n, e in metrics.items())
    b = ", ".join(f"quantile_cont({n}, 0.05) as {n}_lo, quantile_cont({n}, 0.95) as {n}_hi" for n in metrics)
    h = ", ".join(f"case when {n} is not null then greatest({n}_lo, least({n}_hi, {n})) end as {n}" for n in metrics)
    s = ", ".join(f"avg({n}) as {n}_m, stddev_pop({n}) as {n}_d" for n in metrics)
    z = ", ".join(f"case when {n} is not null then case when {n}_d > 0 then ({n} - {n}_m) / {n}_d else 0 end end as {n}" for n in metrics)
    pct = lambda v: f"case when {v} is not null then ((rank() over (partition by p_brand, {v} is null order by {v}) - 1) + count(*) over (partition by p_brand, {v} is null order by {v} range between unbounded preceding and current row)) / 2.0::double / count({v}) over (partition by p_brand) * 100.0 end"
    start, tail = ("", "") if top is None else ("select * from (", f") qualify row_number() over (partition by p_brand order by demand_percentile desc nulls last, p_partkey) <= {top}")
    return f"""{start}with a as (select p_partkey, p_brand, {m} from part left join (select l_partkey, sum(l_quantity) as quantity, avg(l_discount) as discount from lineitem group by 1) on p_partkey = l_partkey where p_size >= 5),
        b as (select p_brand, {b} from a group by 1), h as (select p_partkey, p_brand, {h} from a join b using (p_brand)),
        s as (select p_brand, {s} from h group by 1), z as (select p_partkey, p_brand, {z} from h join s using (p_brand)),
        v as (select p_partkey, p_brand, round(size * 0.6 + price * 0.4, 6) as value, round(sold * 0.5 + price * 0.3 - discount * 0.2, 6) as demand from z)
        select p_partkey, p_brand, value, demand, round({pct('value')}, 6) as value_percentile, round({pct('demand')}, 6) as demand_percentile from v{tail}"""


def _scorecard(spark: SparkSession, d: str) -> DataFrame:
    # scores are rounded before they are ranked, so that ties do not hang on the order of sums
    rounded = [_Rounded(s.name, s.weights, s.penalties) for s in PART_SCORES]
    out = scorecard(_parts(spark, d), "p_partkey", "p_brand", [m.name for m in PART_METRICS], rounded, F.col("p_size") >= 5)
    return out.select("p_partkey", "p_brand", "value", "demand", F.round("value_percentile", 6).alias("value_percentile"), F.round("demand_percentile", 6).alias("demand_percentile"))


class _Rounded(Score):
    def column(self):
        return F.round(super().column(), 6)


@query(_score_sql(None))
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted z-scores of part metrics within brands, with percentiles."""
    return _scorecard(spark, d)


@query(_score_sql(3))
def flagship_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """The three parts of each brand with the highest demand percentile."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("demand_percentile").desc_nulls_last(), "p_partkey"))
    return _scorecard(spark, d).withColumn("place", place).where("place <= 3").drop("place")


_WIDE = "select c_custkey, c_mktsegment, o_totalprice as spend, o_orderkey::double as orders, case when c_acctbal > 0 then c_acctbal end as balance from customer left join (select o_custkey, sum(o_totalprice) as o_totalprice, count(*) as o_orderkey from orders where o_orderstatus = 'P' group by 1) on c_custkey = o_custkey"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count("*").cast("double").alias("orders"))
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", "spend", "orders", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))


@query(f"""select c_mktsegment, metric, count(*) as n, round(avg((value is not null)::int), 9) as covered from
    (select c_mktsegment, unnest(['spend', 'orders', 'balance']) as metric, unnest([spend, orders, balance]) as value from ({_WIDE})) group by 1, 2""")
def coverage_by_group(spark: SparkSession, d: str) -> DataFrame:
    return distribution.coverage(_wide(spark, d), ["c_mktsegment"], ["spend", "orders", "balance"]).select("c_mktsegment", "metric", "n", F.round("covered", 9).alias("covered"))


@query(f"""select c_mktsegment, status, string_agg(metric, ',' order by metric) as metrics from
    (select c_mktsegment, metric, case when c >= 0.8 then 'available' when c > 0 then 'low' else 'unavailable' end as status from
     (select c_mktsegment, metric, avg((value is not null)::int) as c from (select c_mktsegment, unnest(['spend', 'orders', 'balance']) as metric, unnest([spend, orders, balance]) as value from ({_WIDE})) group by 1, 2)) group by 1, 2""")
def availability_lists(spark: SparkSession, d: str) -> DataFrame:
    c = distribution.coverage(_wide(spark, d), ["c_mktsegment"], ["spend", "orders", "balance"])
    return c.groupBy("c_mktsegment", distribution.coverage_class(F.col("covered")).alias("status")).agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("metrics"))


@query("""select r_name, round(sum(share * n) / nullif(sum(n), 0), 9) as covered from
    (select n_regionkey, count(*) as n, avg((c_acctbal > 0)::int) as share from customer join nation on c_nationkey = n_nationkey group by n_nationkey, n_regionkey) join region on n_regionkey = r_regionkey group by 1""")
def weighted_coverage(spark: SparkSession, d: str) -> DataFrame:
    by = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_regionkey").agg(F.count("*").alias("n"), F.avg((F.col("c_acctbal") > 0).cast("double")).alias("share"))
    out = by.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return distribution.weighted_coverage(out, ["r_name"], "share", "n").select("r_name", F.round("covered", 9).alias("covered"))


@query("""select o_orderpriority, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high, round(quantile_cont(o_totalprice, 0.25), 6) as p25,
    round(quantile_cont(o_totalprice, 0.5), 6) as p50, round(quantile_cont(o_totalprice, 0.75), 6) as p75 from orders group by 1""")
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    s = distribution.summary(read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return s.select("o_orderpriority", "n", "low", "high", *(F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")))


@query("""with e as (select o_orderstatus, min(o_totalprice) as lo, max(o_totalprice) as hi, least(16, count(*)) as k from orders group by 1),
    c as (select o_orderstatus, least(floor((o_totalprice - lo) / ((hi - lo) / k)), k - 1)::int as bin, count(*) as n from orders join e using (o_orderstatus) group by 1, 2)
    select e.o_orderstatus, g.bin::int as bin, round(lo + g.bin * ((hi - lo) / k), 6) as bin_low, coalesce(n, 0) as n from e, unnest(range(k::bigint)) as g(bin) left join c on c.o_orderstatus = e.o_orderstatus and c.bin = g.bin""")
def histogram16(spark: SparkSession, d: str) -> DataFrame:
    return distribution.histogram(read(spark, d, "orders"), ["o_orderstatus"], "o_totalprice").select("o_orderstatus", "bin", F.round("bin_low", 6).alias("bin_low"), "n")


@query("""select round(quantile_cont(l_extendedprice, 0.03) - 0.14 * (quantile_cont(l_extendedprice, 0.97) - quantile_cont(l_extendedprice, 0.03)), 4) as axis_low,
    round(quantile_cont(l_extendedprice, 0.97) + 0.14 * (quantile_cont(l_extendedprice, 0.97) - quantile_cont(l_extendedprice, 0.03)), 4) as axis_high, l_linestatus from lineitem group by all""")
def axis_extent(spark: SparkSession, d: str) -> DataFrame:
    e = distribution.robust_extent(read(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice")
    return e.select("l_linestatus", F.round("axis_low", 4).alias("axis_low"), F.round("axis_high", 4).alias("axis_high"))


@query("""select s_suppkey, s_nationkey, rank() over (partition by s_nationkey order by balance desc) as rank_high, rank() over (partition by s_nationkey order by balance) as rank_low,
    rank() over (partition by s_nationkey order by balance desc) || case when rank() over (partition by s_nationkey order by balance desc) % 100 between 11 and 13 then 'th' when rank() over (partition by s_nationkey order by balance desc) % 10 = 1 then 'st'
     when rank() over (partition by s_nationkey order by balance desc) % 10 = 2 then 'nd' when rank() over (partition by s_nationkey order by balance desc) % 10 = 3 then 'rd' else 'th' end as shown
    from (select s_suppkey, s_nationkey, round_even(s_acctbal / 1000, 0) as balance from supplier)""")
def competition_rank_multi(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.bround(F.col("s_acctbal") / 1000, 0).alias("balance"))
    high = ranking.competition_rank(rows, ["s_nationkey"], "balance", "rank_high")
    both = ranking.competition_rank(high, ["s_nationkey"], "balance", "rank_low", descending=False)
    return both.select("s_suppkey", "s_nationkey", "rank_high", "rank_low", rates.ordinal(F.col("rank_high")).alias("shown"))


@query("""select p_partkey, p_brand, rank_p_size, rank_p_retailprice, rank_p_size + rank_p_retailprice as rank_sum from
    (select *, rank() over (partition by p_brand order by p_size desc) as rank_p_size, rank() over (partition by p_brand order by p_retailprice desc) as rank_p_retailprice from part)""")
def rank_sum_scatter(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_sum(read(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"], "p_partkey").select("p_partkey", "p_brand", "rank_p_size", "rank_p_retailprice", "rank_sum")


@query("""select l_partkey, rank_q + rank_p + rank_d as rank_sum from (select *, row_number() over (partition by p_brand order by q desc, l_partkey) as rank_q, row_number() over (partition by p_brand order by p desc, l_partkey) as rank_p,
    row_number() over (partition by p_brand order by d desc, l_partkey) as rank_d from (select l_partkey, p_brand, sum(l_quantity) as q, max(l_extendedprice) as p, max(l_discount) as d from lineitem join part on l_partkey = p_partkey group by 1, 2))""")
def rank_sum_multi(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_partkey", "p_brand").agg(F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("d"))
    return ranking.rank_sum(rows, ["p_brand"], ["q", "p", "d"], "l_partkey", ordinal=True).select("l_partkey", "rank_sum")


@query("""select c_custkey, c_nationkey, case when up <= 2 then 'best' else 'worst' end as side from
    (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as up, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey desc) as down from customer) where up <= 2 or down <= 2""")
def extremes_best_worst(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_and_worst(read(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_custkey", "c_nationkey", "side")


@query("""select c_custkey, round(case when hi = lo then 50.0 else greatest(0, least(100, (c_acctbal - lo) / (hi - lo) * 100)) end, 6) as heat from
    (select c_custkey, c_acctbal, min(c_acctbal) over (partition by c_mktsegment) as lo, max(c_acctbal) over (partition by c_mktsegment) as hi from customer)""")
def minutes_heat(spark: SparkSession, d: str) -> DataFrame:
    heat = distribution.min_max_heat(read(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "heat")
    return heat.select("c_custkey", F.round("heat", 6).alias("heat"))


@query("""with r as (select s_suppkey, s_acctbal as v, lag(s_acctbal) over (order by s_acctbal desc, s_suppkey) as b, row_number() over (order by s_acctbal desc, s_suppkey) as n from supplier)
    select s_suppkey, max(case when b is null or abs(v - b) > 0.01 * greatest(1, abs(v), abs(b)) then n end) over (order by n) as place from r""")
def tolerant_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks in which balances within one in a hundred of the one before share a place."""
    rows = read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return ranking.tolerant_rank(rows, [], "s_acctbal", "place", tolerance=0.01).select("s_suppkey", "place")
