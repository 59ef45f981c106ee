"""Typed events, profiles, rollovers, selections and types over rows that are made from the driver tables by one rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import event_classes as ec
from ..functions import text
from ..operators import archetypes, event_profiles, rollover, selection, spatial
from .registry import query, read

NAMES = ["Pass", "Pass", "Pass", *[n for names in ec.KINDS.values() for n in names if n != "Pass"], "Mystery"]
QUALIFIERS = sorted({n for names in [*ec.BODY.values(), *ec.SITUATIONS.values(), *ec.FLAGS.values(), ["Blocked"]] for n in names})
AT = {"x": 7919, "y": 104729, "end_x": 31337, "end_y": 65537}


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, name, qualifiers, outcome, coordinates and period of made-up match events, one for each row of events."""
    k = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, NAMES)), ((k * 13) % len(NAMES) + 1).cast("int"))
    given = F.filter(F.array(*(F.when((k * (i + 3)) % (i + 5) == 0, F.lit(q)) for i, q in enumerate(QUALIFIERS))), lambda x: x.isNotNull())
    places = {c: F.when(k % (11 + i) != 0, ((k * m) % 10001).cast("int")) for i, (c, m) in enumerate(AT.items())}
    return read(spark, d, "events").select(k, "user_id", name.alias("name"), given.alias("qualifiers"), (k % 3).cast("int").alias("outcome"), F.element_at(F.array(*map(F.lit, [*ec.PERIODS, "Half"])), (k % 7 + 1).cast("int")).alias("period_name"), (k % 2 == 0).alias("is_touch"), *(c.alias(n) for n, c in places.items()))


def typed(spark: SparkSession, d: str) -> DataFrame:
    e = raw_events(spark, d)
    x, y, ex, ey = (F.col(c) for c in AT)
    e = e.withColumns({"kind": ec.kind(F.col("name")), "success": ec.success(F.col("outcome"), F.lit(None).cast("string")), "shot_outcome": ec.shot_outcome(F.col("name"), F.col("qualifiers")), **ec.flags(F.col("qualifiers"))})
    passed = F.col("kind") == "pass"
    yes = lambda c: F.coalesce(passed & c, F.lit(False))
    return e.withColumns({"progressive": yes(spatial.progressive(x, y, ex, ey)), "final_third": yes(spatial.enters_final_third(x, ex, F.col("success"))), "box_entry": yes(spatial.enters_box(x, y, ex, ey, F.col("success")))})


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _sql_events() -> str:
    given = ", ".join(f"case when (event_id * {i + 3}) % {i + 5} = 0 then '{q}' end" for i, q in enumerate(QUALIFIERS))
    places = ", ".join(f"case when event_id % {11 + i} <> 0 then (event_id * {m}) % 10001 end as {c}" for i, (c, m) in enumerate(AT.items()))
    kinds = " ".join(f"when name in ({_list(names)}) then '{k}'" for k, names in ec.KINDS.items())
    flags = ", ".join(f"list_has_any(q, [{_list(names)}]) as \"{f}\"" for f, names in ec.FLAGS.items())
    goal = "sqrt(pow((10000.0::double - {x}) / 10000 * 105, 2) + pow((5000.0::double - {y}) / 10000 * 68, 2))"
    gain = f"{goal.format(x='x', y='y')} - {goal.format(x='end_x', y='end_y')} >= case when x < 5000 and end_x < 5000 then 30 when x < 5000 then 15 else 10 end"
    return f"""raw as (select event_id, user_id, ([{_list(NAMES)}])[(event_id * 13) % {len(NAMES)} + 1] as name, list_filter([{given}], lambda z: z is not null) as q, event_id % 3 as outcome, ([{_list([*ec.PERIODS, 'Half'])}])[event_id % 7 + 1] as period_name, event_id % 2 = 0 as is_touch, {places} from events),
        e as (select *, case {kinds} else 'unknown' end as kind, case outcome when 1 then true when 0 then false end as success, {flags},
            case when name = 'SavedShot' and list_contains(q, 'Blocked') then 'blocked' when name = 'Goal' then 'goal' when name = 'SavedShot' then 'saved' when name = 'MissedShots' then 'off_target' when name = 'ShotOnPost' then 'woodwork' else 'unknown' end as shot_outcome from raw),
        t as (select *, coalesce(kind = 'pass' and {gain}, false) as progressive, coalesce(kind = 'pass' and success and x < 6670 and end_x >= 6670, false) as final_third,
            coalesce(kind = 'pass' and success and not (x >= 8350 and y between 2110 and 7890) and end_x >= 8350 and end_y between 2110 and 7890, false) as box_entry from e),
        a as (select *, case when kind in ('aerial', 'challenge') then defensive else kind in ({_list(ec.ACTIONS)}) end as action, kind in ({_list(ec.DEFENSIVE)}) or (kind in ('aerial', 'challenge') and defensive) as guard from t)"""


_EVENTS = _sql_events()
_FIRST = lambda choices: "case " + " ".join(f"when list_has_any(q, [{_list(names)}]) then '{k}'" for k, names in choices.items()) + " else 'unknown' end"
_PERIOD = "case period_name " + " ".join(f"when '{n}' then {i}" for n, i in ec.PERIODS.items()) + " else 0 end"


@query(f"""with {_EVENTS} select event_id, kind, success, shot_outcome, {_PERIOD} as period, {_FIRST(ec.BODY)} as body_part, {_FIRST(ec.SITUATIONS)} as situation, {", ".join(chr(34) + f + chr(34) for f in ec.FLAGS)}, progressive, final_third, box_entry, action, guard from a""")
def event_classes(spark: SparkSession, d: str) -> DataFrame:
    """Kinds, outcomes, periods and flags of every event."""
    e, q = typed(spark, d), F.col("qualifiers")
    period = ec.period(F.lit(None).cast("int"), F.col("period_name"))
    return e.select("event_id", "kind", "success", "shot_outcome", period.alias("period"), ec.body_part(q).alias("body_part"), ec.situation(q).alias("situation"), *ec.FLAGS, "progressive", "final_third", "box_entry", ec.is_action(F.col("kind"), F.col("defensive")).alias("action"), ec.is_defensive(F.col("kind"), F.col("defensive")).alias("guard"))


_COUNTS = {
    "valid_location_actions": "x is not null and y is not null and action", "touches": "is_touch", "pass_attempts": "kind = 'pass'", "pass_completions": "kind = 'pass' and success", "progressive_pass_attempts": "kind = 'pass' and progressive",
    "progressive_pass_completions": "kind = 'pass' and progressive and success", "final_third_entries": "kind = 'pass' and final_third", "box_entries": "kind = 'pass' and box_entry", "key_passes": "kind = 'pass' and key_pass",
    "crosses": "kind = 'pass' and \"cross\"", "long_balls": "kind = 'pass' and long_ball", "shots": "kind = 'shot'", "goals": "kind = 'shot' and shot_outcome = 'goal'", "big_chance_shots": "kind = 'shot' and big_chance",
    "take_ons_attempted": "kind = 'take_on'", "take_ons_successful": "kind = 'take_on' and success", "defensive_actions": "guard",
}


@query(f"""with {_EVENTS} select user_id, {", ".join(f"count(*) filter ({w}) as {n}" for n, w in _COUNTS.items())}, {", ".join(f"round_even(avg({v}) filter (is_touch and x is not null and y is not null), 0)::int as average_touch_{v}" for v in "xy")} from a group by 1""")
def event_profile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Seventeen counts and the mean touch of every user."""
    return event_profiles.summary(typed(spark, d), ["user_id"])


@query(f"""with {_EVENTS}, m as (select user_id, (user_id * 31) % 400 as minutes from a group by 1), c as (select user_id, least(x * 12 // 10000, 11) * 8 + least(y * 8 // 10000, 7) as cell, count(*) as n from a where action and x is not null and y is not null group by 1, 2),
    s as (select user_id, sum(n) as total from c group by 1) select m.user_id, g.cell::int as cell, coalesce(n, 0) as n, round(case when minutes > 0 then coalesce(n, 0) * 90.0::double / minutes end, 9) as per_90, round(case when total > 0 then coalesce(n, 0) / total else 0 end, 9) as share,
    coalesce(total, 0) >= 20 as available, coalesce(total, 0) < 100 as sparse from m cross join unnest(range(96)) as g(cell) left join s on s.user_id = m.user_id left join c on c.user_id = m.user_id and c.cell = g.cell""")
def event_action_grid(spark: SparkSession, d: str) -> DataFrame:
    e = typed(spark, d)
    minutes = e.select("user_id").distinct().withColumn("minutes", (F.col("user_id") * 31) % 400)
    g = event_profiles.action_grid(e, minutes, ["user_id"])
    return g.select("user_id", "cell", "n", F.round("per_90", 9).alias("per_90"), F.round("share", 9).alias("share"), "available", "sparse")


_ZONE = "least({a} * 5 // 10000, 4) * 3 + least({b} * 3 // 10000, 2)"


@query(f"""with {_EVENTS}, p as (select event_id % 10 as team, {_ZONE.format(a='x', b='y')} as origin, {_ZONE.format(a='end_x', b='end_y')} as destination, success, progressive from a where kind = 'pass' and x is not null and y is not null and end_x is not null and end_y is not null),
    c as (select team, origin, destination, count(*) as attempts, count(*) filter (success) as completions, count(*) filter (progressive) as progressive_attempts, count(*) filter (progressive and success) as progressive_completions from p group by all), k as (select distinct team from c)
    select k.team, o.o::int as origin, z.z::int as destination, coalesce(attempts, 0) as attempts, coalesce(completions, 0) as completions, coalesce(progressive_attempts, 0) as progressive_attempts, coalesce(progressive_completions, 0) as progressive_completions, round(completions / attempts, 9) as completion_rate
    from k, unnest(range(15)) as o(o), unnest(range(15)) as z(z) left join c on c.team = k.team and c.origin = o.o and c.destination = z.z""")
def event_pass_flow(spark: SparkSession, d: str) -> DataFrame:
    """Passes between the fifteen zones of the pitch, by team."""
    flow = event_profiles.pass_flow(typed(spark, d).withColumn("team", F.col("event_id") % 10), ["team"])
    return flow.withColumn("completion_rate", F.round("completion_rate", 9))


@query(f"""with {_EVENTS}, c as (select user_id as g, event_id as current, x as cx, y as cy from a where event_id % 50 = 0 and x is not null and y is not null),
    s as (select current, event_id, (x - cx) + 2.5::double * abs(y - cy) as score from a join c on user_id = g where x > cx and y is not null and event_id <> current)
    select current, event_id as picked, score from s qualify row_number() over (partition by current order by score, event_id) = 1""")
def directional_event(spark: SparkSession, d: str) -> DataFrame:
    """From events with ids divisible by 50, the next one of their user ahead along x."""
    e = raw_events(spark, d).where("x is not null and y is not null").withColumn("group", F.col("user_id"))
    return event_profiles.directional_pick(e.select("group", "event_id", "x", "y"), e.where("event_id % 50 = 0"), "event_id", (1, 0))


@query("""with s as (select p_partkey as k, p_name as a, lag(p_name, 1) over (order by p_partkey) as b from part), w as (select k, a, b, string_split(a, ' ') as x, string_split(b, ' ') as y from s where b is not null)
    select k, case when a = b then 1.0::double when length(a) >= 6 and length(b) >= 6 and (contains(a, b) or contains(b, a)) then 0.9 when list_has_all(x, y) and list_has_all(y, x) then 0.98 when len(x) >= 2 and list_has_all(y, x) then 0.92 when len(y) >= 2 and list_has_all(x, y) then 0.9
    when list_has_all(y, x) or list_has_all(x, y) then 0.82 when len(x) > 1 and len(y) > 1 and x[1] = y[1] and x[-1] = y[-1] then 0.95 end as step from w""")
def name_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the name likeness on neighbouring part names."""
    p = read(spark, d, "part").select("p_partkey", "p_name")
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(before, "p_partkey").select(F.col("p_partkey").alias("k"), text.name_steps(F.col("p_name"), F.col("b")).alias("step"))


_LABELS = " ".join(f"when '{k}' then '{v}'" for k, v in text.POSITION_LABELS.items())


@query(f"""select p_partkey, case upper(s) {_LABELS} else s end as label, regexp_replace(p_name || case when p_partkey % 2 = 0 then ' /90' else '' end, '\\s*/\\s*90$', '') as plain
    from (select *, trim(regexp_replace(replace(w, '_', ' '), '\\s+', ' ', 'g')) as s from (select *, ([{_list([*text.POSITION_LABELS, 'left_ wing  back', ' gk '])}])[p_partkey % {len(text.POSITION_LABELS) + 2} + 1] as w from part))""")
def position_labels(spark: SparkSession, d: str) -> DataFrame:
    words = [*text.POSITION_LABELS, "left_ wing  back", " gk "]
    raw = F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    marked = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " /90").otherwise(""))
    return read(spark, d, "part").select("p_partkey", text.position_label(raw).alias("label"), text.without_rate_mark(marked).alias("plain"))


@query("""with r as (select *, rank() over (order by x desc) as x_rank, rank() over (order by y desc) as y_rank from (select p_partkey, p_size as x, p_retailprice as y, p_partkey % 3 as t from part))
    select p_partkey, x_rank, y_rank, x_rank + y_rank as rank_sum, row_number() over (order by x_rank + y_rank, t desc, y desc, x desc, p_partkey) as place from r""")
def scatter_places(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 3).alias("t"))
    return selection.scatter_places(points, "p_partkey", "x", "y", "t").select("p_partkey", "x_rank", "y_rank", "rank_sum", "place")


_MEMBER = """m as (select o_custkey as k, (['ENG1', 'GER1', 'NED1', 'UCL', 'ITA1'])[o_orderkey % 5 + 1] as competition, year(o_orderdate)::varchar as season, case when o_orderkey % 4 > 0 then (year(o_orderdate) - o_orderkey % 2)::varchar end as aggregate_season,
    case when o_orderkey % 5 = 3 then 'continental_cup' else 'domestic_league' end as competition_type, case when o_orderkey % 7 > 0 then o_orderkey % 7 > 1 end as in_aggregates from orders)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    code = F.element_at(F.array(*map(F.lit, ["ENG1", "GER1", "NED1", "UCL", "ITA1"])), (k % 5 + 1).cast("int"))
    return read(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), code.alias("competition"), year.cast("string").alias("season"), F.when(k % 4 > 0, (year - k % 2).cast("string")).alias("aggregate_season"),
        F.when(k % 5 == 3, "continental_cup").otherwise("domestic_league").alias("competition_type"), F.when(k % 7 > 0, k % 7 > 1).alias("in_aggregates"),
    )


_INLAND = "competition_type <> 'continental_cup' and coalesce(in_aggregates, true)"
_FIVE = _list(selection.FIVE_CODES)


@query(f"""with {_MEMBER} select k, min(case when competition = 'BIG5' and season = '1996' then 0 when coalesce(aggregate_season, season) = '1996' and {_INLAND} and competition in ({_FIVE}) then 1 when competition = 'BIG5' then 2 else 3 end) as in_five,
    min(case when competition = 'GER1' and season = '1996' then 0 when competition = 'GER1' then 2 else 3 end) as in_one from m group by 1""")
def membership_priority(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    five, one = selection.membership_priority(m, "k", "BIG5", "1996"), selection.membership_priority(m, "k", "GER1", "1996")
    return five.withColumnRenamed("priority", "in_five").join(one.withColumnRenamed("priority", "in_one"), "k")


@query("""select k, distance_multiplier, context from (select p_partkey as k, (['FWD', 'MID', 'DEF', 'UNK', 'GK'])[p_partkey % 5 + 1] as a, (['FWD', 'MID', 'DEF', 'UNK', 'GK'])[p_size % 5 + 1] as b, case when a = b and a in ('FWD', 'MID', 'DEF') then 1 when a || b in ('FWDMID', 'MIDFWD') then 1.08
    when a || b in ('MIDDEF', 'DEFMID') then 1.1 when a || b in ('FWDDEF', 'DEFFWD') then 1.18 else 1.25 end as distance_multiplier, case when a = b then 'same_position' when 'UNK' in (a, b) then 'unknown_position' when a || b in ('FWDDEF', 'DEFFWD') then 'cross_position' else 'adjacent_position' end as context from part)""")
def position_context(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.element_at(F.array(*map(F.lit, ["FWD", "MID", "DEF", "UNK", "GK"])), (F.col(c) % 5 + 1).cast("int"))
    a, b = at("p_partkey"), at("p_size")
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), archetypes.multiplier(a, b).alias("distance_multiplier"), archetypes.context(a, b).alias("context"))


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("slice"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    text_id = lambda m: F.concat(F.lit("t"), (F.col("k") - F.col("k") % m).cast("string"))
    now = s.select("slice", F.when(F.col("k") % 10 == 1, text_id(10)).otherwise(text_id(1)).alias("provider_id"), F.when(F.col("k") % 6 == 0, F.concat(F.lit("N"), F.col("slice").cast("string"))).otherwise(F.col("n")).alias("name"), F.when(F.col("k") % 7 > 0, F.col("k") - F.when(F.col("k") % 9 == 1, 1).otherwise(0)).alias("team"))
    before = s.where("k % 4 > 0").select("slice", F.when(F.col("k") % 5 == 0, F.concat(F.lit("old"), F.col("k").cast("string"))).otherwise(text_id(1)).alias("provider_id"), F.when(F.col("k") % 3 == 0, F.concat("n", F.lit(" FC"))).otherwise(F.col("n")).alias("name"), F.when(F.col("k") % 7 > 0, F.col("k")).alias("team"))
    return now, before


_ENTRIES = """s as (select s_nationkey as slice, s_suppkey as k, s_name as n from supplier),
    e as (select slice, 't' || case when k % 10 = 1 then k - k % 10 else k end as provider_id, case when k % 6 = 0 then 'N' || slice else n end as name, case when k % 7 > 0 then k - case when k % 9 = 1 then 1 else 0 end end as team from s),
    p as (select slice, case when k % 5 = 0 then 'old' || k else 't' || k end as provider_id, case when k % 3 = 0 then n || ' FC' else n end as name, case when k % 7 > 0 then k end as team from s where k % 4 > 0),
    ep as (select *, nullif(regexp_replace(lower(name), '[^0-9a-z]+', '', 'g'), '') as plain from e), pp as (select *, nullif(regexp_replace(lower(name), '[^0-9a-z]+', '', 'g'), '') as plain from p)"""


@query(f"""with {_ENTRIES}, old as (select e.slice, e.provider_id, coalesce(max(a.provider_id), max(b.provider_id)) as was from (select distinct * from ep) e left join pp a on a.slice = e.slice and a.team = e.team left join pp b on b.slice = e.slice and b.plain = e.plain
        where not exists (from pp x where x.slice = e.slice and x.provider_id = e.provider_id) group by e.slice, e.provider_id, e.team, e.name),
    f as (select slice, 'expected_team_count_mismatch' as code, count(*)::varchar as subject from ep group by 1 having count(*) <> 4
    union all select slice, 'unmatched_canonical_team', provider_id from ep where team is null
    union all select slice, 'provider_identity_requires_review', provider_id from ep where provider_id in (select 't' || (k * 8) from s)
    union all select slice, 'duplicate_provider_team_id', provider_id from ep group by 1, 3 having count(*) > 1
    union all select slice, 'duplicate_canonical_team', team::varchar from ep where team is not null group by 1, 3 having count(distinct provider_id) > 1
    union all select slice, 'duplicate_canonical_team_name', plain from ep where team is not null group by 1, 3 having count(distinct team) > 1
    union all select slice, 'unknown_provider_team_id', provider_id from ep where provider_id not in (select 't' || k from s where k % 12 <> 0)
    union all select ep.slice, 'provider_name_change', ep.provider_id from ep join pp using (slice, provider_id) where ep.plain <> pp.plain
    union all select slice, 'provider_id_change', provider_id from old where was <> provider_id
    union all select slice, 'multiple_domestic_competitions', team::varchar from (select slice, team, k % 2 as c from (select slice, k - k % 2 as team, k from s where k % 8 < 2)) group by slice, team having count(distinct c) > 1)
    select slice, code, subject, count(*) as n from f group by all""")
def rollover_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """All ten kinds of findings over made-up entries of two seasons."""
    now, before = _entries(spark, d)
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("slice"), F.col("s_suppkey").alias("k"))
    mapped = s.where("k % 12 <> 0").select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("provider_id"))
    review = now.select("slice").distinct().crossJoin(F.broadcast(s.agg(F.max("k").alias("most")))).select("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") * 8, F.lit(8).cast("long"))).alias("n")).select("slice", F.concat(F.lit("t"), F.col("n").cast("string")).alias("provider_id"))
    slices = now.select("slice").distinct().withColumn("expected", F.lit(4))
    memberships = s.where("k % 8 < 2").select("slice", (F.col("k") - F.col("k") % 2).alias("team"), F.lit("Land").alias("country"), (F.col("k") % 2).alias("competition"))
    found = rollover.anomalies(now, before, mapped, review, slices, memberships)
    return found.groupBy("slice", "code", "subject").agg(F.count("*").alias("n"))


@query("""with recursive m as (select s_suppkey as old, s_suppkey - s_suppkey % 3 as new from supplier where s_suppkey % 3 > 0 and s_suppkey > 3) select l_orderkey, l_linenumber, coalesce(new, l_suppkey) as l_suppkey from lineitem left join m on old = l_suppkey""")
def id_repointing(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with merged supplier ids replaced."""
    k = F.col("s_suppkey")
    merged = read(spark, d, "supplier").where((k % 3 > 0) & (k > 3)).select(k.alias("old"), (k - k % 3).alias("new"))
    return rollover.repointed(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), merged, ["l_suppkey"])


_TYPES = _list(sorted({m for m in ["accurate_crosses_per_90", "key_passes_per_90", "shots_per_90", "completed_passes_per_90", "aerial_duels_won_per_90", "ball_recoveries_per_90"]}))
_GROUPS = {"shots_per_90": "attacking_threat", "key_passes_per_90": "creation", "accurate_crosses_per_90": "creation", "completed_passes_per_90": "possession_buildup", "aerial_duels_won_per_90": "defending_duels", "ball_recoveries_per_90": "defending_duels"}


def _type_rows(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_brand").alias("family"), *(((F.col("p_partkey") * (i + 3)) % (7 + i)).cast("double").alias(m) for i, m in enumerate(sorted(_GROUPS))))
    return p.unpivot(["family"], sorted(_GROUPS), "metric", "value")


def _label_sql() -> str:
    def rule(group: str | None, some: list[str] | None) -> str:
        return " and ".join([*([f"first_group = '{group}'"] if group else []), *([f"list_has_any(features, [{_list(some)}])"] if some else [])]) or "true"

    by_position = " ".join(f"when '{p}' then case " + " ".join(f"when {rule(g, s)} then '{n}'" for g, s, n in rules) + " end" for p, rules in archetypes.LABELS.items())
    return f"case position {by_position} else '{archetypes.NO_LABEL}' end"


@query(f"""with r as (unpivot (select p_brand as family, {", ".join(f"((p_partkey * {i + 3}) % {7 + i})::double as {m}" for i, m in enumerate(sorted(_GROUPS)))} from part) on {", ".join(sorted(_GROUPS))} into name metric value v),
    m as (select family, metric, avg(v) as mean from r group by 1, 2), g as (select family, case metric {" ".join(f"when '{m}' then '{g}'" for m, g in _GROUPS.items())} end as grp, avg(mean) as mean from m group by 1, 2),
    l as (select family, max_by(grp, (round(mean, 9), grp)) as first_group from g group by 1), f as (select family, list(metric order by round(mean, 9) desc, metric)[:2] as features from m group by 1)
    select family, position, {_label_sql()} as label from l join f using (family), (values ('FWD'), ('MID'), ('DEF'), ('UNK')) t(position)""")
def archetype_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of player types from the leading group and top features of every brand, read as each position."""
    rows = _type_rows(spark, d).groupBy("family", "metric").agg(F.round(F.avg("value"), 9).alias("value"))
    made = archetypes.signatures(rows, ["family"], _GROUPS, top=2)
    position = F.explode(F.array(*map(F.lit, ["FWD", "MID", "DEF", "UNK"])))
    return made.select("family", "leading", "features", position.alias("position")).select("family", "position", archetypes.label(F.col("position"), F.col("leading"), F.col("features")).alias("label"))
