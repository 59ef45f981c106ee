"""Match documents written from the driver tables, read back, and gated; pass filters by name; ranks of team figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import team_ranks
from ..operators.event_profiles import PASS_ALIASES, PASS_FILTERS, pass_filter
from ..sources import match_documents
from ..sources.files import working_folder
from .match_queries import typed
from .registry import query, read

# 125 events a match; every eighth match has a fault of its own kind.
_RAW = """e as (select event_id as k, event_id // 125 as m, event_id % 125 as i from events),
    r as (select k, m, i, case when k % 6 < 2 then 'Pass' when k % 6 = 2 then 'Goal' when k % 6 = 3 then 'Tackle' when k % 6 = 4 then 'Save' when m % 8 = 3 or (m % 8 = 1 and k % 25 = 5) then 'Mystery' else 'Clearance' end as name,
        case when m % 8 = 6 and i % 50 = 0 then 120 when k % 6 = 2 then case when m % 8 = 7 then k % 40 else 60 + k % 40 end else (k * 37) % 101 end as x, (k * 53) % 101 as ex, (k * 11) % 101 as y, (k * 17) % 101 as ey,
        k % 90 as mi, case when m % 8 = 2 and i = 7 then 75 else k % 60 end as se, case when m % 16 = 9 and i = 3 then null else 't' || (k % 2) end as team, m % 8 = 5 and k % 7 = 0 as weird from e),
    f as (select *, case when team is null then 'missing_event_fields' when se > 59 then 'invalid_event_clock' when x > 100 then 'invalid_coordinate' end as fault, row_number() over (partition by m order by mi, se, k) - 1 as spot from r),
    sh as (select m, team, count(*) as n, median(x) as middle from f where name = 'Goal' and fault is null group by 1, 2),
    led as (select m, 'error' as level, fault as code, i as event_index, case fault when 'missing_event_fields' then 'teamId' when 'invalid_event_clock' then mi || ':' || se else 'x' end as detail, 1 as n from f where fault is not null
        union all select m, 'error', 'implausibly_low_event_count', null, null, count(*) from f group by m having count(*) < 100
        union all select m, 'note', 'unknown_event_type', null, '9:Mystery', count(*) from f where name = 'Mystery' group by m
        union all select m, case when count(*) > 5 then 'error' else 'warning' end, case when count(*) > 5 then 'unknown_event_tolerance_exceeded' else 'unknown_event_types' end, null, null, count(*) from f where name = 'Mystery' group by m
        union all select m, 'note', 'unknown_qualifier', null, '?:Weird', count(*) from f where weird and fault is null group by m
        union all select m, case when count(*) > 10 then 'error' else 'warning' end, case when count(*) > 10 then 'unknown_qualifier_tolerance_exceeded' else 'unknown_qualifiers' end, null, null, count(*) from f where weird and fault is null group by m
        union all select m, 'error', 'shot_orientation_failed', null, team, n from sh where n >= 3 and middle < 50)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents, one JSON text a line, as written to files and read back."""
    k = F.col("k")
    e = read(spark, d, "events").select(F.col("event_id").alias("k"), F.floor(F.col("event_id") / 125).alias("m"), (F.col("event_id") % 125).alias("i"))
    m, i = F.col("m") % 8, F.col("i")
    other = F.when((m == 3) | ((m == 1) & (k % 25 == 5)), "Mystery").otherwise("Clearance")
    name = F.when(k % 6 < 2, "Pass").when(k % 6 == 2, "Goal").when(k % 6 == 3, "Tackle").when(k % 6 == 4, "Save").otherwise(other)
    x = F.when((m == 6) & (i % 50 == 0), 120).when(k % 6 == 2, F.when(m == 7, k % 40).otherwise(60 + k % 40)).otherwise((k * 37) % 101)
    named = lambda value, label: F.struct(value.alias("value"), label.alias("displayName"))
    qualifier = lambda holds, q: F.when(holds, F.struct(F.struct(F.lit(q).alias("displayName")).alias("type")))
    event = F.struct(
        k.alias("id"), k.alias("eventId"), (k % 90).alias("minute"), F.when((m == 2) & (i == 7), 75).otherwise(k % 60).alias("second"), F.when(~((F.col("m") % 16 == 9) & (i == 3)), F.concat(F.lit("t"), k % 2)).alias("teamId"),
        x.cast("double").alias("x"), ((k * 11) % 101).alias("y"), ((k * 53) % 101).alias("endX"), ((k * 17) % 101).alias("endY"), (k % 100).alias("goalMouthY"), (k % 3 == 0).alias("isTouch"), named(F.lit(1), F.lit("FirstHalf")).alias("period"),
        named(F.lit(9), name).alias("type"), named(k % 2, F.lit("")).alias("outcomeType"),
        F.filter(F.array(qualifier(k % 3 == 0, "Longball"), qualifier(k % 5 == 0, "Cross"), qualifier(F.lit(True), "Zone"), qualifier((m == 5) & (k % 7 == 0), "Weird")), lambda q: q.isNotNull()).alias("qualifiers"),
    )
    team = lambda t: F.struct(F.lit(t).alias("teamId"), F.lit(f"Team {t}").alias("name"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("i", event.alias("event")))), lambda x: x["event"])  # rows come in any order out of a shuffle
    whole = e.groupBy("m").agg(in_order.alias("events"))  # 125 events a match
    text = whole.select(F.to_json(F.struct(F.col("m").alias("matchId"), team("t0").alias("home"), team("t1").alias("away"), "events")).alias("document"))
    path = working_folder(spark)
    text.write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "document")


@query(f"""with {_RAW} select m::varchar as match_id, level, code, event_index, detail, n from led""")
def match_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with match documents: fields, clocks, coordinates, unknown names, sizes and directions."""
    return match_documents.normalized(_documents(spark, d))[1]


@query(f"""with {_RAW}, b as (select distinct m from led where level = 'error')
    select m::varchar as match_id, spot as event_index, k::varchar as event_id, team as team_id, case name when 'Pass' then 'pass' when 'Goal' then 'shot' when 'Tackle' then 'tackle' when 'Save' then 'save' when 'Clearance' then 'clearance' else 'unknown' end as kind, k % 2 = 1 as success,
    x * 100 as x, ey * 100 as end_y, k % 100 * 100 as goal_mouth_y, k % 3 = 0 as long_ball, k % 5 = 0 as "cross", k % 3 = 0 as is_touch, mi * 60 + se as match_seconds, name = 'Pass' and k % 2 = 1 and x * 100 < 6670 and ex * 100 >= 6670 as final_third from f anti join b using (m) where fault is null""")
def match_events_full(spark: SparkSession, d: str) -> DataFrame:
    """Typed events of the matches that the ledger lets through."""
    events = match_documents.normalized(_documents(spark, d))[0]
    return events.select("match_id", "event_index", "event_id", "team_id", "kind", "success", "x", "end_y", "goal_mouth_y", "long_ball", "cross", "is_touch", "match_seconds", "final_third")


@query(f"""with {_RAW}, b as (select distinct m from led where level = 'error'), g as (select m, row_number() over (order by m % 5, m::varchar) - 1 as match_ref from (select distinct m from r) anti join b using (m))
    select match_ref, spot as event_index, x * 100 as x, 'Goal' as shot_outcome, 'Unknown' as body_part, k % 100 * 100 as goal_mouth_y from f join g using (m) where name = 'Goal' and fault is null""")
def compact_shots(spark: SparkSession, d: str) -> DataFrame:
    """Shots as a request shows them: matches by reference, codes as labels."""
    events = match_documents.normalized(_documents(spark, d))[0]
    matches = match_documents.references(events.select("match_id").distinct().withColumn("kickoff", F.timestamp_seconds(F.col("match_id").cast("long") % 5 * 86400)))
    names = spark.createDataFrame([], "player_id string, player_name string")
    return match_documents.compact(events, matches, names, "shot").select("match_ref", "event_index", "x", "shot_outcome", "body_part", "goal_mouth_y")


def _pass_sql() -> str:
    tests = {"completed": "success", "progressive": "progressive", "final_third_entry": "final_third", "box_entry": "box_entry", "key_pass": "key_pass", "cross": '"cross"', "long_ball": "long_ball", "failed": "not success"}
    every = tests | {a: tests[n] for a, n in PASS_ALIASES.items()}
    from .match_queries import _EVENTS

    return f"with {_EVENTS} " + " union all ".join(f"select '{n}' as filter, count(*) as n from a where kind = 'pass' and {t}" for n, t in every.items())


@query(_pass_sql())
def pass_filters(spark: SparkSession, d: str) -> DataFrame:
    """How many passes each named filter and each of its other names takes."""
    passes = typed(spark, d).where("kind = 'pass'")
    names = [*PASS_FILTERS, *PASS_ALIASES]
    counts = passes.agg(*(F.count_if(pass_filter(n)).alias(n) for n in names))
    return counts.unpivot([], names, "filter", "n")


@query("""with s as (select l_suppkey as k, l_suppkey % 3 as season, sum(l_quantity)::double as shots, count(*) filter (l_returnflag = 'R')::double as fouls, count(*) filter (l_returnflag = 'A')::double as goals_against, case when l_suppkey % 5 > 0 then round(avg(l_discount), 2)::double end as points from lineitem group by 1),
    u as (unpivot s on shots, fouls, goals_against, points into name stat value v)
    select k, season, stat, rank() over (partition by season, stat order by case when stat in ('fouls', 'goals_against') then v else -v end) as place, count(*) over (partition by season, stat) as of_n from u""")
def team_stat_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of team figures within a season, each in its own direction; teams without a figure have no rank in it."""
    li = read(spark, d, "lineitem")
    flag = lambda f: F.count_if(F.col("l_returnflag") == f).cast("double")
    s = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").cast("double").alias("shots"), flag("R").alias("fouls"), flag("A").alias("goals_against"), F.round(F.avg("l_discount"), 2).cast("double").alias("mean"))
    s = s.select("k", (F.col("k") % 3).alias("season"), "shots", "fouls", "goals_against", F.when(F.col("k") % 5 > 0, F.col("mean")).alias("points"))
    return team_ranks.ranked(s, ["k"], ["season"], ["shots", "fouls", "goals_against", "points"])
