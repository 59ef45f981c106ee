"""Cohort filters, orders, pages, facets, merges and versions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cohort, merge, ranking
from .registry import query, read


@query("""select c_custkey, n, spend from (select c_custkey, count(o_orderkey) filter (o_orderstatus = 'P') as n, round(sum(case when o_orderstatus = 'P' then o_totalprice end), 2) as spend
    from customer left join orders on c_custkey = o_custkey group by 1) order by spend desc nulls last, c_custkey limit 50 offset 50""")
def sorted_page_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderstatus") == "P"
    rows = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count(F.when(p, F.col("o_orderkey"))).alias("n"), F.round(F.sum(F.when(p, F.col("o_totalprice"))), 2).alias("spend"))
    return cohort.page(cohort.ordered(rows, "-spend", ["c_custkey"], {"spend", "n"}), 2, 50)


@query("""select 'n_name' as facet, n_name as value from nation union select 'c_mktsegment', c_mktsegment from customer where c_mktsegment is not null union select 'r_name', r_name from region""")
def facets_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right")
    return cohort.facets(rows, ["n_name", "c_mktsegment", "r_name"])


@query("""select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderdate, o_orderkey) = 1""")
def dedupe_best_row(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderdate"), F.col("o_orderkey")]
    return cohort.best_row(read(spark, d, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""with t as (select *, row_number() over (order by c_acctbal desc, c_custkey) as p from customer)
    select c_custkey, c_acctbal, c_custkey % 150 = 7 as pinned from t where p <= 20 or c_custkey % 150 = 7""")
def top_n_with_pins(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cohort.top_with_pins(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 20, rows.where("c_custkey % 150 = 7"), "c_custkey")


@query("""select event_id, user_id, total, total > 500 as truncated from (select event_id, user_id, ts, count(*) over () as total from events where event_type = 'click') order by ts, event_id limit 500""")
def capped_with_total(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    return cohort.capped(rows, [F.col("ts"), F.col("event_id")], 500).select("event_id", "user_id", "total", "truncated")


@query("""select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by case when c_acctbal < 0 then 0 when c_acctbal < 3000 then 1 when c_acctbal < 6000 then 2 else 3 end, c_acctbal desc, lower(c_name)) as place from customer""")
def squad_order(spark: SparkSession, d: str) -> DataFrame:
    """Places by band, then balance, then name; the bands before are one count for each segment and band."""
    band = F.when(F.col("c_acctbal") < 0, 0).when(F.col("c_acctbal") < 3000, 1).when(F.col("c_acctbal") < 6000, 2).otherwise(3)
    rows = read(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name", band.alias("band"), F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"))
    placed = ranking.ordinal_rank(rows, ["c_mktsegment", "band"], "balance", [F.lower("c_name")], "nth")
    before = Window.partitionBy("c_mktsegment").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("c_mktsegment", "band").agg(F.count("*").alias("n")).select("c_mktsegment", "band", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ranking.join_same(placed, counts, ["c_mktsegment", "band"]).select("c_mktsegment", "c_custkey", (F.col("nth") + F.col("before")).cast("int").alias("place"))


@query("""with a as (select o_custkey as k, o_totalprice as price, o_orderpriority as prio from orders where o_orderstatus = 'O' qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1),
    b as (select o_custkey as k, o_totalprice as price, o_orderdate as day from orders where o_orderstatus = 'P' qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
    select coalesce(a.k, b.k) as k, coalesce(b.price, a.price) as price, prio, day, case when a.k is not null then 'a' else 'b' end as authority from a full join b on a.k = b.k""")
def full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumnsRenamed({"o_custkey": "k", "o_totalprice": "price", "o_orderpriority": "prio", "o_orderdate": "day"})
    a = o.where("o_orderstatus = 'O'").select("k", "price", "prio", "o_orderkey")
    b = o.where("o_orderstatus = 'P'").select("k", "price", "day", "o_orderkey")
    last = [F.desc("o_orderkey")]
    return merge.full_merge(a, b, ["k"], last, last, {"price": "b"}).drop("o_orderkey")


@query("""with cut as (select o_custkey as k, o_totalprice as v, o_orderdate >= timestamp '1996-01-01' as late from orders), old as (select k, max(v) as v from cut where not late group by 1), new as (select k, max(v) as v from cut where late group by 1)
    select k, v, k not in (select k from new) as is_current, case when k in (select k from new) then timestamp '1996-01-01' end as superseded_at from old union all select k, v, true, null from new""")
def scd2_supersede(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), (F.col("o_orderdate") >= "1996-01-01").alias("late"))
    old = o.where("not late").groupBy("k").agg(F.max("v").alias("v")).select("k", "v", F.lit(True).alias("is_current"), F.lit(None).cast("timestamp").alias("superseded_at"))
    new = o.where("late").groupBy("k").agg(F.max("v").alias("v"))
    return merge.supersede(old, new, ["k"], F.lit("1996-01-01 00:00:00").cast("timestamp"))


@query("""select o_orderkey, o_custkey from orders qualify row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate desc, o_orderkey desc) > 2""")
def retention_rank(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return cohort.newest(o, ["o_custkey", "y"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2)[1].select("o_orderkey", "o_custkey")


@query("select c_custkey, c_acctbal from customer where c_nationkey in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')) and c_acctbal >= 450")
def semi_scope(spark: SparkSession, d: str) -> DataFrame:
    region = read(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = read(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return cohort.in_scope(read(spark, d, "customer"), nations, "c_nationkey").where(cohort.at_least(F.col("c_acctbal"), 100, 450)).select("c_custkey", "c_acctbal")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1997-06-01')")
def anti_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order of late."""
    late = read(spark, d, "orders").where(F.col("o_orderdate") >= "1997-06-01").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(late, "c_custkey", "left_anti")


@query("""select a.l_suppkey as team, count(*) as opposed from (select distinct l_orderkey, l_suppkey from lineitem) a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_suppkey is distinct from a.l_suppkey group by 1""")
def self_non_equi_opponents(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    a, b = lines.distinct().alias("a"), lines.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & ~F.col("b.l_suppkey").eqNullSafe(F.col("a.l_suppkey")))
    return met.groupBy(F.col("a.l_suppkey").alias("team")).agg(F.count("*").alias("opposed"))


@query("""select s_nationkey, round(r.n, 2) as region_total, round(sum(s_acctbal), 2) as own_total, round(coalesce(sum(s_acctbal) filter (s_acctbal > 5000), r.n), 2) as shown from supplier
    join (select n_nationkey as k, sum(c_acctbal) as n from nation left join customer on c_nationkey = n_nationkey group by 1) r on r.k = s_nationkey group by 1, r.n""")
def sum_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "nation").join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("s_nationkey")).agg(F.sum("c_acctbal").alias("region_total"))
    own = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("own_total"), F.sum(F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal"))).alias("high"))
    return own.join(base, "s_nationkey").select("s_nationkey", F.round("region_total", 2).alias("region_total"), F.round("own_total", 2).alias("own_total"), F.round(F.coalesce("high", "region_total"), 2).alias("shown"))


@query("""select user_id, list_sort(list_distinct(list(event_type))) as kinds, list_contains(list(event_type), 'purchase') as buys, len(list_distinct(list(event_type))) = 5 as all_kinds,
    list_has_all(['click', 'view'], list_distinct(list(event_type))) as only_looks from events group by 1""")
def set_ops_membership(spark: SparkSession, d: str) -> DataFrame:
    sets = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    looks = F.array(F.lit("click"), F.lit("view"))
    return sets.select("user_id", "kinds", F.array_contains("kinds", "purchase").alias("buys"), (F.size("kinds") == 5).alias("all_kinds"), (F.size(F.array_except("kinds", looks)) == 0).alias("only_looks"))


@query("""select key, in_a, in_b, case when in_a and in_b then 'both' when in_a then 'a' else 'b' end as side from
    (select coalesce(a.k, b.k) as key, a.k is not null as in_a, b.k is not null as in_b from (select distinct o_custkey as k from orders where o_orderstatus = 'P') a full join (select distinct c_custkey as k from customer where c_acctbal < 0) b on a.k = b.k)""")
def union_of_keys(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).distinct().withColumn("in_a", F.lit(True))
    b = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key")).distinct().withColumn("in_b", F.lit(True))
    both = a.join(b, "key", "full_outer").na.fill(False, ["in_a", "in_b"])
    return both.withColumn("side", F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b"))


@query("""select place, c_custkey, c_name from (values (0, 17), (1, 3), (2, 999999), (3, 100)) as t(place, id) join customer on c_custkey = id""")
def request_order(spark: SparkSession, d: str) -> DataFrame:
    return cohort.in_request_order(read(spark, d, "customer").select("c_custkey", "c_name"), [17, 3, 999999, 100, 17], "c_custkey")


@query("""select k, case when a is null then 'added' when b is null then 'removed' when a = b then 'same' else 'changed' end as change from
    (select coalesce(x.k, y.k) as k, x.v as a, y.v as b from (select o_custkey as k, count(*) as v from orders where o_orderdate < timestamp '1995-06-01' group by 1) x
     full join (select o_custkey as k, count(*) as v from orders where o_orderdate < timestamp '1996-06-01' and o_custkey % 3 > 0 group by 1) y on x.k = y.k)""")
def change_hash(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    old = o.where("o_orderdate < '1995-06-01'").groupBy("k").agg(F.count("*").alias("v"))
    new = o.where("o_orderdate < '1996-06-01' and k % 3 > 0").groupBy("k").agg(F.count("*").alias("v"))
    return merge.changed(old, new, ["k"], ["v"])


@query("""select c_custkey, c_mktsegment from customer where c_custkey % 10 <> 0 and c_mktsegment not in (select c_mktsegment from customer where c_custkey % 100 = 0) union all select c_custkey, 'new' from customer where c_custkey % 100 = 0""")
def slice_replacement(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    fresh = c.where("c_custkey % 100 = 0")
    left = merge.replace_slices(c.where("c_custkey % 10 <> 0"), fresh, "c_mktsegment")
    return left.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 100 == 0, "new").otherwise(F.col("c_mktsegment")))
