"""Published slices, profiles kept up to date, plans worked off in ticks, and two rounds of eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eligibility, sink
from ..sources.files import working_folder
from ..streaming import incremental, planner
from ..streaming.events import event_stream
from .registry import query, read


@query("""with r as (select c_custkey as id, c_nationkey as slice, c_acctbal as v, c_mktsegment as seg from customer), g as (select slice, avg((seg = 'BUILDING')::int) >= 0.18 as good from r where slice % 5 > 0 or id % 3 > 0 group by 1)
    select id, slice, case when good and (slice % 5 > 0 or id % 3 > 0) then v + 1 else v end as v, case when good then 'team ' || (id % 4) end as team from r left join g using (slice) where not coalesce(good, false) or slice % 5 > 0 or id % 3 > 0""")
def gated_sink(spark: SparkSession, d: str) -> DataFrame:
    """A second load of all slices over a first: cups are restricted to known ids, slices that fail the gate keep their first rows, the others are switched and resolved."""
    root, schema = working_folder(spark), "id long, slice int, v double, seg string, team string"
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("int").alias("slice"), F.col("c_acctbal").cast("double").alias("v"), F.col("c_mktsegment").alias("seg"))
    share = {"share": F.avg((F.col("seg") == "BUILDING").cast("double"))}
    sink.publish(rows.withColumn("team", F.lit(None).cast("string")), root, "first", "slice", measures=share, checks={"some": F.lit(True)})
    named = lambda df: df.withColumn("team", F.concat(F.lit("team "), F.col("id") % 4))
    again, allowed = rows.withColumn("v", F.col("v") + 1), rows.where("id % 3 > 0").select("slice", "id")
    sink.publish(again, root, "second", "slice", measures=share, checks={"low_share": F.col("share") >= 0.18}, allowed=allowed, restricted=F.col("slice") % 5 == 0, resolve=named)
    return sink.current(spark, root, "slice", schema).select("id", "slice", "v", "team")


_PROFILE = "user_id long, n long, kinds long, total double, last timestamp"


def _profile(events: DataFrame) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(28,6)")).cast("double")
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), total.alias("total"), F.max("ts").alias("last"))


@query("""select user_id, count(*) as n, count(distinct event_type) as kinds, sum(value::decimal(28,6))::double as total, max(ts) as last, 0 as differences from events where user_id is not null group by 1""")
def incremental_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of users brought up to date by a stream of files, each user computed anew when a batch touches them; differences: rows unlike a full rebuild."""
    folder = working_folder(spark)
    events = read(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    events.repartitionByRange(4, "event_id").write.parquet(f"{folder}/incoming")
    stream = event_stream(spark, f"{folder}/incoming", events.schema, files_a_batch=1)
    kept = incremental.keep(stream, folder, "user_id", _profile, _PROFILE, buckets=16)
    unlike = incremental.differences(kept, _profile(events.where("user_id is not null"))).agg(F.count("*").alias("differences"))  # one row
    return kept.crossJoin(F.broadcast(unlike))


@query()
def planned_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers as a plan of items, worked off in twelve ticks with failures, lapsed claims and a cap on costs."""
    folder = working_folder(spark)
    items = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("item"), F.col("s_suppkey").alias("planned_order"))
    planner.begin(planner.planned(items, "day", "2024-01-01 00:00:00", 60, 120), f"{folder}/plan")
    # reports: every hour, for any item and attempt that may run then, good or bad by a hash; a fifth never report
    fate = F.pmod(F.xxhash64("item", "attempt"), F.lit(10))
    told = items.select("item", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt")).crossJoin(spark.range(12).select((F.col("id") + 1).alias("hour")))  # twelve rows
    told = told.where(fate > 1).select(F.timestamp_seconds(F.lit(1704067200) + F.col("hour") * 3600).alias("at"), "item", "attempt", (fate > 3).alias("ok"), F.lit(1).cast("long").alias("cost"), "hour")
    for hour in range(1, 13):  # one file an hour
        told.where(F.col("hour") == hour).drop("hour").coalesce(1).write.parquet(f"{folder}/told/{hour:02d}")
    schema = told.drop("hour").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/told")
    return planner.work(stream, f"{folder}/plan", f"{folder}/checkpoint", slots=20, cap=0, lease_seconds=3000, most_attempts=3).select("item", "planned_order", "status", "attempts")


_ROWS = """r as (select c_custkey::varchar as entity, c_nationkey as slice, ['DEF', 'MID', 'FWD', 'GK'][1 + c_custkey % 4] as family, c_custkey % 1000 as minutes, c_custkey % 9 > 1 as src, case when c_custkey % 5 > 1 then c_acctbal end as f1, case when (c_custkey + c_nationkey) % 3 > 0 then c_acctbal end as f2, c_acctbal as f3 from customer),
    a as (select * from r where family <> 'GK' and minutes >= 20 + slice), n1 as (select slice, count(*) as n from a group by 1), b as (select a.* from a join n1 using (slice) where n >= 10),
    c as (select * from b where src), n2 as (select slice, count(*) as n from c group by 1), e as (select c.* from c join n2 using (slice) where n >= 10), n3 as (select slice, family, count(*) as n from e group by 1, 2), g as (select e.* from e join n3 using (slice, family) where n >= 3),
    low as (select * from (select slice, family, list_filter([case when avg((f1 is not null)::int) < 0.6 then 'f1' end, case when avg((f2 is not null)::int) < 0.6 then 'f2' end], lambda x: x is not null) as low_features from g group by 1, 2) where len(low_features) > 0)"""


def _eligible(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = read(spark, d, "customer")
    family = F.element_at(F.array(*map(F.lit, [*eligibility.FAMILIES, "GK"])), (k % 4 + 1).cast("int"))
    rows = c.select(n.alias("slice"), k.cast("string").alias("entity"), family.alias("family"), (k % 1000).alias("minutes"), (k % 9 > 1).alias("has_source"), F.when(k % 5 > 1, F.col("c_acctbal")).alias("f1"), F.when((k + n) % 3 > 0, F.col("c_acctbal")).alias("f2"), F.col("c_acctbal").alias("f3"))
    least = c.select(n.alias("slice"), (20 + n).alias("least")).distinct()
    return eligibility.eligible(rows, least, ["f1", "f2", "f3"], ["f1", "f2"], ["f2"])


@query(f"with {_ROWS} select slice, entity, family, minutes, f1, f2, f3 from g anti join low using (slice, family)")
def eligible_rows(spark: SparkSession, d: str) -> DataFrame:
    """What two rounds of gates leave."""
    return _eligible(spark, d)[0]


@query(f"""with {_ROWS} select 1 as round, slice, null as family, null as entity, 'insufficient_eligible_players' as reason, n, null as low_features from n1 where n < 10
    union all select 2, slice, family, entity, 'missing_source', null, null from b where not src union all select 2, slice, null, null, 'insufficient_eligible_players_after_source_gate', n, null from n2 where n < 10
    union all select 2, slice, family, null, 'insufficient_position_family_players', n, null from n3 where n < 3 union all select 2, slice, family, null, 'low_broad_profile_coverage', null, low_features from low""")
def eligibility_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What went in which round, and why."""
    return _eligible(spark, d)[1]
