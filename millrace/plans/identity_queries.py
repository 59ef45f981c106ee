"""Names found in other lists, and rows of providers resolved to entities by a ladder with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import identity, names
from .registry import query, read

# The customers, seen by three providers. A and B have totals of their own, W has events only.
_TABLES = """c as (select c_custkey as k, 'L' || (c_nationkey % 5) as sl, lower(c_mktsegment) || ' ' || (c_custkey % 40) as alias from customer),
    r as (select 'A' as p, 'a' || k as id, sl, alias, ['t' || (k % 7)] as teams, true as needs from c where k % 2 = 0
        union all select 'B', 'b' || k, sl, alias, []::varchar[], false from c where k % 3 = 0
        union all select 'W', 'w' || k, sl, alias, case when k % 2 = 0 then ['t' || (k % 7)] else []::varchar[] end, k % 10 in (0, 1) from c where k % 5 < 2),
    m as (select 'A' as p, 'a' || k as id, 'e' || k as e, case when k % 4 = 0 then 'auto' else 'manual' end as how from c where k % 4 = 0 or k % 6 = 0
        union all select 'B', 'b' || k, 'e' || k, 'auto' from c where k % 9 = 0
        union all select 'B', 'b' || k, 'x' || k, 'auto' from c where k % 9 = 6 union all select 'W', 'w' || k, 'e' || k, 'manual' from c where k % 25 = 0),
    canon as (select 'e' || k as e, case when k % 16 = 0 then 'R' || k end as reg from c union all select 'x' || k, null from c where k % 9 = 6),
    reg as (select 'A' as p, 'a' || k as id, 'R' || k as reg, 'alt ' || (k % 40) as alias from c where k % 8 = 0 union all select 'W', 'w' || k, 'R' || k, 'alt ' || (k % 40) from c where k % 80 = 1),
    spells as (select sl, 'e' || k as e, 't' || ((k + 1) % 7) as team from c where k % 6 = 0)"""

_EVIDENCE = """said as (select r.sl, r.p, m.e, r.alias, unnest(case when len(teams) = 0 then [null] else teams end) as team from r join m using (p, id)),
    seen as (select distinct sl, p, e from said),
    ev as (select sl, p, e, coalesce(list(distinct alias) filter (alias is not null), []) as aliases, coalesce(list(distinct team) filter (team is not null), []) as teams from
        (select * from said union all select seen.*, reg.alias, null from seen join canon using (e) join reg on reg.reg = canon.reg union all select seen.*, null, team from seen join spells using (sl, e)) group by all)"""


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k = F.col("k")
    no_teams = F.array().cast("array<string>")
    team = F.array(F.concat(F.lit("t"), k % 7))
    ident = lambda letter: F.concat(F.lit(letter), k)
    # written as providers would: with marks, capitals and other signs
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("L"), F.col("c_nationkey") % 5).alias("slice"), F.concat(F.translate("c_mktsegment", "AEIOU", "ÁÈîöÜ"), F.lit(" - "), F.col("c_custkey") % 40).alias("name"))
    entity, register_id = ident("e").alias("entity"), ident("R").alias("register_id")

    def rows(provider: str, which: str, teams: Column, needs: Column) -> DataFrame:
        return c.where(which).select(F.lit(provider).alias("provider"), ident(provider.lower()).alias("provider_id"), "slice", "name", teams.alias("teams"), needs.alias("needs_team"))

    def mapped(provider: str, which: str, to: Column, how: Column) -> DataFrame:
        return c.where(which).select(F.lit(provider).alias("provider"), ident(provider.lower()).alias("provider_id"), to.alias("entity"), how.alias("method"))

    auto = F.lit("auto")
    listed = F.concat(F.lit("Alt. "), k % 40).alias("name")
    register = lambda p, which: c.where(which).select(F.lit(p).alias("provider"), ident(p.lower()).alias("provider_id"), register_id, listed)
    a, b = rows("A", "k % 2 = 0", team, F.lit(True)), rows("B", "k % 3 = 0", no_teams, F.lit(False))
    w = rows("W", "k % 5 < 2", F.when(k % 2 == 0, team).otherwise(no_teams), (k % 10).isin(0, 1))
    maps = mapped("A", "k % 4 = 0 or k % 6 = 0", ident("e"), F.when(k % 4 == 0, "auto").otherwise("manual")).unionByName(mapped("B", "k % 9 = 0", ident("e"), auto))
    maps = maps.unionByName(mapped("B", "k % 9 = 6", ident("x"), auto)).unionByName(mapped("W", "k % 25 = 0", ident("e"), F.lit("manual")))
    canonical = c.select(entity, F.when(k % 16 == 0, ident("R")).alias("register_id")).unionByName(c.where("k % 9 = 6").select(ident("x").alias("entity"), F.lit(None).cast("string").alias("register_id")))
    spells = c.where("k % 6 = 0").select("slice", entity, F.concat(F.lit("t"), (k + 1) % 7).alias("team"))
    return {"a": a, "b": b, "w": w, "mappings": maps, "canonical": canonical, "register": register("A", "k % 8 = 0").unionByName(register("W", "k % 80 = 1")), "spells": spells, "customers": c}


def _evidence(t: dict[str, DataFrame]) -> DataFrame:
    listed = t["register"].join(t["canonical"].hint("merge"), "register_id").select("entity", "name").distinct()
    return identity.evidence(t["a"].unionByName(t["b"]).unionByName(t["w"]), t["mappings"], listed, t["spells"])


@query(f"""with {_TABLES}, {_EVIDENCE} select sl as slice, p as provider, e as entity, list_sort(aliases) as aliases, list_sort(teams) as teams from ev""")
def candidate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What each provider's rows say of each entity of a slice: names, the register's too, and teams."""
    return _evidence(_tables(spark, d)).select("slice", "provider", "entity", F.array_sort("aliases").alias("aliases"), F.array_sort("teams").alias("teams"))


@query(f"""with {_TABLES}, {_EVIDENCE},
    base as (select r.*, m.e as mapped, m.how, g.entity as reg_e, coalesce(a.n = 1 and (canon.reg is null), false) as movable from r left join m using (p, id)
        left join (select p, id, coalesce(canon.e, 'r-' || min(reg.reg)) as entity from reg left join canon using (reg) group by p, id, canon.e) g using (p, id)
        left join (select e, count(*) as n from m group by 1) a on a.e = m.e left join canon on canon.e = m.e),
    one as (select *, case when mapped is not null and (p = 'W' or how <> 'auto' or (reg_e is null and not movable)) then mapped when reg_e is not null and (mapped is not null or p <> 'W') then reg_e end as e1,
        case when mapped is not null and (p = 'W' or how <> 'auto' or (reg_e is null and not movable)) then 'mapping' when reg_e is not null and (mapped is not null or p <> 'W') then 'register' end as rung1 from base),
    names as (select distinct sl, p, e, unnest(aliases) as alias from ev), sides as (select distinct sl, p, e, unnest(teams) as team from ev),
    found as (select o.p, o.id, n.e from one o join names n on o.sl = n.sl and o.alias = n.alias and n.p <> o.p where e1 is null and reg_e is null
        and (case when len(o.teams) = 0 then not o.needs else exists (select 1 from sides s where s.sl = o.sl and s.e = n.e and s.p <> o.p and list_contains(o.teams, s.team)) end)),
    cand as (select p, id, case when count(distinct e) = 1 then min(e) end as cand, count(distinct e) > 1 as ambiguous from found group by 1, 2)
    select p as provider, id as provider_id, sl as slice, case when rung1 is not null then e1 when mapped is not null then coalesce(cand, mapped) when cand is not null then cand when p = 'W' then null else 'n-' || p || '-' || id end as entity,
        case when rung1 is not null then rung1 when mapped is not null and coalesce(cand, mapped) = mapped then 'mapping' when mapped is not null then 'moved' when cand is not null then 'candidate' when p = 'W' then 'quarantine' else 'native' end as rung,
        coalesce(ambiguous, false) as ambiguous from one left join cand using (p, id)""")
def identity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """All rows of three providers by the ladder: mapped, listed by the register, moved, found by evidence, made anew, or in quarantine."""
    t = _tables(spark, d)
    rows = t["a"].unionByName(t["b"]).unionByName(t["w"])
    done = identity.resolve(rows, t["mappings"], t["canonical"], t["register"], _evidence(t), ["W"])
    return done.select("provider", "provider_id", "slice", "entity", "rung", "ambiguous")


_FORM = "trim(regexp_replace(replace(lower(strip_accents({})), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(rf"""with n as (select c_custkey as k, case c_custkey % 4 when 0 then 'Société ' || c_mktsegment when 1 then 'Мир ' || c_nationkey when 2 then 'Jürgen & ' || c_mktsegment else 'Øre FC ' || c_nationkey end as a,
        case c_custkey % 4 when 0 then 'SOCIETE ' || c_mktsegment when 1 then 'мир-' || (c_nationkey % 3) when 2 then c_mktsegment || ' and Jurgen' else 'øre ' || c_nationkey end as b from customer),
    f as (select k, {_FORM.format("a")} as a, {_FORM.format("b")} as b from n), w as (select *, list_filter(string_split(a, ' '), lambda x: x <> 'fc') as x, list_filter(string_split(b, ' '), lambda x: x <> 'fc') as y from f)
    select k, case when a = b then 1.0::double when length(a) >= 6 and length(b) >= 6 and (contains(a, b) or contains(b, a)) then 0.9 when list_has_all(x, y) and list_has_all(y, x) then 0.98 when len(x) >= 2 and list_has_all(y, x) then 0.92 when len(y) >= 2 and list_has_all(x, y) then 0.9
        when list_has_all(y, x) or list_has_all(x, y) then 0.82 when len(x) > 1 and len(y) > 1 and x[1] = y[1] and x[-1] = y[-1] then 0.95 end as step from w""")
def name_ladder_of_any_script(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the name likeness on names with marks, of other scripts, and with words that do not count."""
    c, k = read(spark, d, "customer"), F.col("c_custkey") % 4
    both = {
        "a": [F.concat(F.lit("Société "), "c_mktsegment"), F.concat(F.lit("Мир "), "c_nationkey"), F.concat(F.lit("Jürgen & "), "c_mktsegment"), F.concat(F.lit("Øre FC "), "c_nationkey")],
        "b": [F.concat(F.lit("SOCIETE "), "c_mktsegment"), F.concat(F.lit("мир-"), F.col("c_nationkey") % 3), F.concat("c_mktsegment", F.lit(" and Jurgen")), F.concat(F.lit("øre "), "c_nationkey")],
    }
    named = c.select(F.col("c_custkey").alias("k"), *(F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).otherwise(v[3]).alias(n) for n, v in both.items()))
    return named.select("k", text.name_steps(F.col("a"), F.col("b")).alias("step"))


@query(r"""with p as (select p_partkey as k, p_brand as scope, p_name as name, string_split(p_name, ' ') as w from part),
    s as (select a.k, b.k as c, case when a.name = b.name then 1.0::double when contains(a.name, b.name) or contains(b.name, a.name) then 0.9 when list_has_all(a.w, b.w) and list_has_all(b.w, a.w) then 0.98
        when len(a.w) >= 2 and list_has_all(b.w, a.w) then 0.92 when len(b.w) >= 2 and list_has_all(a.w, b.w) then 0.9 when a.w[1] = b.w[1] and a.w[-1] = b.w[-1] then 0.95 end as score from p a join p b on a.scope = b.scope and a.k % 2 = 0 and b.k % 2 = 1),
    t as (select k, max(score) as best from s where score is not null group by 1)
    select k as id, min(c) as candidate, best as score from s join t using (k) where score >= best - 0.03 group by k, best having count(distinct c) = 1""")
def roster_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts of even numbers found by name among those of odd ones of their brand; the SQL leaves letters in sequence out, which decide nothing here above 0.9."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("scope"), F.col("p_name").alias("name"))
    return names.best_matches(p.where("id % 2 = 0"), p.where("id % 2 = 1"), least=0.9)


@query(f"""with {_TABLES}, ev as (select 'w' || (o_custkey) as id, case when o_orderkey % 3 = 0 then 'wt' || (o_custkey % 7) end as tid, case when o_orderkey % 3 = 1 then 't' || (o_custkey % 7) end as team from orders where o_custkey % 5 < 2),
    tm as (select 'wt' || n as tid, 't' || n as team from range(5) x(n)),
    x as (select id, list_sort(list_distinct(list(coalesce(ev.team, tm.team)) filter (coalesce(ev.team, tm.team) is not null))) as teams, bool_or(tid is not null) as needs from ev left join tm using (tid) group by 1)
    select r.p as provider, r.id as provider_id, coalesce(x.teams, []) as teams, coalesce(x.needs, false) as needs_team from r left join x using (id) where r.p = 'W'""")
def quarantine_context(spark: SparkSession, d: str) -> DataFrame:
    """The teams that events name for rows in quarantine."""
    waiting = _tables(spark, d)["w"]
    found = identity.with_event_teams(waiting, _events(spark, d), _team_mappings(spark))
    return found.select("provider", "provider_id", F.array_sort("teams").alias("teams"), "needs_team")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events of the rows of W: a third names a provider's team, a third a canonical one."""
    o = read(spark, d, "orders").where("o_custkey % 5 < 2")
    slices = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("L"), F.col("c_nationkey") % 5).alias("slice"))
    third, team = F.col("o_orderkey") % 3, F.col("o_custkey") % 7
    return o.join(slices.hint("merge"), "o_custkey").select(F.lit("W").alias("provider"), F.concat(F.lit("w"), "o_custkey").alias("provider_id"), "slice", F.when(third == 0, F.concat(F.lit("wt"), team)).alias("provider_team_id"), F.when(third == 1, F.concat(F.lit("t"), team)).alias("team"))


def _team_mappings(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.lit("W").alias("provider"), F.concat(F.lit("wt"), "id").alias("provider_team_id"), F.concat(F.lit("t"), "id").alias("team"))


@query()
def quarantine_retry(spark: SparkSession, d: str) -> DataFrame:
    """Rows in quarantine tried again with the teams of their events, run by run, until none moves; then once more over what came of it, which moves nothing."""
    t = _tables(spark, d)
    others, waiting = t["a"].unionByName(t["b"]), t["w"].join(t["mappings"].hint("merge"), identity.KEY, "left_anti")
    same = [_events(spark, d), t["register"], _team_mappings(spark), t["spells"], ["W"]]
    state, mappings, canonical, runs = identity.settle(waiting, others, same[0], t["mappings"], t["canonical"], *same[1:])
    again, *_, more = identity.settle(waiting, others, same[0], mappings, canonical, *same[1:])
    moved = again.groupBy().agg(F.count_if(~F.col("rung").isin("mapping", "quarantine")).alias("moved_again"))  # one row
    out = state.select("provider", "provider_id", "slice", "entity", "rung", "run")
    return out.crossJoin(F.broadcast(moved)).withColumn("runs", F.lit(runs)).withColumn("runs_again", F.lit(more))
