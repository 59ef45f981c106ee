"""Matching, resolution, gates and reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, quality
from .registry import query, read


@query("""select s_suppkey, min(c_custkey) as c_custkey from supplier join customer on c_nationkey = s_nationkey and floor(s_acctbal / 1000) = floor(c_acctbal / 1000) group by 1 having count(distinct c_custkey) = 1""")
def unique_candidate_match(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("band"))
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 1000).alias("band"))
    return merge.unique_match(s, c, ["nation", "band"], "s_suppkey", "c_custkey")


@query("""select o_orderkey, coalesce(a.e, b.e, case when o_custkey % 5 = 0 then -o_custkey end) as entity, case when a.e is not null then 'mapping' when b.e is not null then 'register' when o_custkey % 5 = 0 then 'native' end as method from orders
    left join (select c_custkey as k, c_custkey * 10 as e from customer where c_custkey % 3 = 0) a on a.k = o_custkey left join (select c_custkey as k, c_custkey * 100 as e from customer where c_acctbal > 5000) b on b.k = o_custkey""")
def identity_ladder(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    mapping = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 10).alias("entity"))
    register = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 100).alias("entity"))
    native = read(spark, d, "orders").where("o_custkey % 5 = 0").select("o_custkey", (-F.col("o_custkey")).alias("entity")).distinct()
    steps = [("mapping", mapping, "o_custkey"), ("register", register, "o_custkey"), ("native", native, "o_custkey")]
    return merge.ladder(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", steps, "entity").select("o_orderkey", "entity", "method")


@query("""select distinct o_custkey as k, 'unresolved' as reason from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0 or c_acctbal > 5000)""")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "customer").where("c_custkey % 3 = 0 or c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().join(known, "k", "left_anti").withColumn("reason", F.lit("unresolved"))


@query("""select s_suppkey, case when row_number() over (partition by s_nationkey order by s_suppkey desc) = 1 then s_nationkey end as s_nationkey from supplier""")
def register_clash_release(spark: SparkSession, d: str) -> DataFrame:
    return merge.sole_owner(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", [F.desc("s_suppkey")])


@query("""select case when grouping(event_type) = 0 then 'event_type' when grouping(hour) = 0 then 'hour' else 'all' end as level, event_type, hour, count(*) as n, count(distinct user_id) as users,
    case when count(*) filter (value < 1) * 100 > count(*) * 5 then 'fail' when count(*) filter (value < 1) * 100 > count(*) then 'warn' else 'ok' end as gate
    from (select *, hour(ts) as hour from events) group by grouping sets ((), (event_type), (hour))""")
def rollup_identity_volume(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("hour", F.hour("ts"))
    out = quality.volumes(e, ["event_type", "hour"], {"n": F.count("*"), "users": F.countDistinct("user_id"), "low": F.count_if(F.col("value") < 1)})
    return out.select("level", "event_type", "hour", "n", "users", quality.share_level(F.col("low"), F.col("n")).alias("gate"))


@query("""select c_nationkey, n, rate, concat_ws(',', case when n < 50 then 'few_rows' end, case when rate < 0.9 then 'low_match' end) as failed, n >= 50 and rate >= 0.9 as passed from
    (select c_nationkey, count(*) as n, round(avg((o.k is not null)::int), 9) as rate from customer left join (select distinct o_custkey as k from orders) o on o.k = c_custkey group by 1)""")
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    rows = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("k"), "left")
    out = quality.gate(rows, ["c_nationkey"], {"n": F.count("*"), "rate": F.round(F.avg(F.col("k").isNotNull().cast("double")), 9)}, {"few_rows": F.col("n") >= 50, "low_match": F.col("rate") >= 0.9})
    return out.withColumn("failed", F.array_join("failed", ","))


@query("""select 'c_nationkey' as "check", c_nationkey::varchar as value, count(*) as n from customer group by 2 having count(*) > 1 union all select 'c_name', lower(c_name), count(*) from customer group by 2 having count(*) > 1""")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_nationkey", F.lower("c_name").alias("c_name"))
    return quality.duplicates(c, ["c_nationkey", "c_name"])


@query("select o_custkey, year(o_orderdate) as y, count(distinct o_orderpriority) as members from orders group by 1, 2 having count(distinct o_orderpriority) > 1")
def multi_membership(spark: SparkSession, d: str) -> DataFrame:
    return quality.memberships(read(spark, d, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey", "y"], "o_orderpriority")


@query("""select c_custkey, unnest(list_filter([case when not coalesce(c_acctbal >= 0, false) then 'negative' end, case when not coalesce(n >= 5, false) then 'few_orders' end], lambda x: x is not null)) as reason
    from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey""")
def exclusion_ledger(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return quality.ledger(read(spark, d, "customer").join(n, "c_custkey", "left"), "c_custkey", {"negative": F.col("c_acctbal") >= 0, "few_orders": F.col("n") >= 5})


@query("""select 'customer' as kind, c_custkey as id, c_name as name, round(coalesce(s, 0), 2) as weight from customer left join (select o_custkey, sum(o_totalprice) as s from orders group by 1) on o_custkey = c_custkey where contains(lower(c_name), '1')
    union all select 'supplier', s_suppkey, s_name, round(s_acctbal, 2) from supplier where contains(lower(s_name), '1')""")
def search_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("s"))
    people = read(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).join(s, "id", "left").select("kind", "id", "name", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("weight"))
    teams = read(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("weight"))
    return people.unionByName(teams, allowMissingColumns=True).where(F.contains(F.lower("name"), F.lit("1")))


@query("""select l_suppkey, list(distinct y order by y) as years, count(distinct l_partkey) as parts from (select l_suppkey, l_partkey, year(l_shipdate) as y from lineitem) group by 1""")
def entity_memberships(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").cast("long").alias("y"))
    return rows.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("y")).alias("years"), F.countDistinct("l_partkey").alias("parts"))
