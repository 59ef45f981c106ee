"""Sources and identity steps: files are written from the driver tables by one rule, read back through the sources, and resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rates
from ..operators import cohort, merge
from ..operators.distribution import with_percentiles
from ..sources import files
from . import season_metrics as sm
from . import season_queries
from .registry import query, read


def _register_file(spark: SparkSession, d: str) -> str:
    k = F.col("c_custkey")
    t = k.cast("string")
    rows = read(spark, d, "customer").select(
        F.when(k % 11 > 0, t).alias("id"), F.when(k % 3 == 0, "team").otherwise("player").alias("type"),
        F.when(k % 5 == 0, "—").when(k % 7 == 0, " NaN ").otherwise(F.concat(F.lit(" x"), t)).alias("x_id"),
        F.when(k % 2 == 0, F.concat(F.lit("y"), t)).alias("y_id"), F.col("c_name").alias("name"),
    )
    path = files.working_folder(spark)
    rows.write.csv(path, header=True)
    return path


def _register(spark: SparkSession, d: str, kind: str) -> DataFrame:
    over = read(spark, d, "customer").where("c_custkey % 13 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("o"), F.col("c_custkey").cast("string")).alias("x_id"))
    return files.read_register(spark, _register_file(spark, d), kind, "id", ["x_id", "y_id"], over).select("id", "x_id", "y_id", "name")


def _register_sql(kind: str) -> str:
    return f"""select * from (select id, case when id::bigint % 13 = 0 then 'o' || id else x_id end as x_id, y_id, name from (select case when c_custkey % 11 > 0 then c_custkey::varchar end as id, case when c_custkey % 3 = 0 then 'team' else 'player' end as type,
        case when c_custkey % 5 > 0 and c_custkey % 7 > 0 then 'x' || c_custkey end as x_id, case when c_custkey % 2 = 0 then 'y' || c_custkey end as y_id, c_name as name from customer) where type = '{kind}' and id is not null) where coalesce(x_id, y_id) is not null"""


@query(_register_sql("player"))
def register_people(spark: SparkSession, d: str) -> DataFrame:
    """People of a headered CSV with an id and a provider key, overrides applied."""
    return _register(spark, d, "player")


@query(_register_sql("team"))
def register_teams(spark: SparkSession, d: str) -> DataFrame:
    return _register(spark, d, "team")


@query("""with n as (select s_suppkey as id, upper(s_name) as name from supplier where s_suppkey % 3 = 0), b as (select s_suppkey as id, s_name as name from supplier where s_suppkey % 2 = 0)
    select id, name from n union all select id, name from b where id not in (select id from n)""")
def json_register_upsert(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents read one a file, and their rows put in the place of those with the same id."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    path = files.working_folder(spark)
    files.write_documents(s.where("id % 3 = 0").withColumn("name", F.upper("name")), path)
    return merge.upsert(s.where("id % 2 = 0"), files.read_documents(spark, path, "id long, name string"), ["id"])


@query("""with l as (select l_suppkey as player, l_linenumber as page, first(l_returnflag order by l_orderkey) as team, max(l_quantity) as q, max(l_discount) as x from lineitem group by 1, 2),
    f as (select player, arg_min(team, page) as team, arg_max(q, page) filter (page % 2 = 0) as even_q, max_by(x, page) as x from l group by 1)
    select player, team, coalesce(even_q, x) as picked, x as fallback from f""")
def paged_stats(spark: SparkSession, d: str) -> DataFrame:
    """Pages of group:key maps, written as JSON and merged: the first page's team, the last page's values, a group with a fallback."""
    by_page = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("player"), F.col("l_linenumber").alias("page")).agg(F.min_by("l_returnflag", "l_orderkey").alias("team"), F.max("l_quantity").cast("double").alias("q"), F.max("l_discount").cast("double").alias("x"))
    entries = F.map_filter(F.create_map(F.lit("attack:value"), F.when(F.col("page") % 2 == 0, F.col("q")), F.lit("league:value"), F.col("x")), lambda k, v: v.isNotNull())
    path = files.working_folder(spark)
    files.write_documents(by_page.select("player", "page", "team", entries.alias("stats")), path)
    pages = files.read_documents(spark, path, "player long, page int, team string, stats map<string,double>")
    merged = files.merged_pages(pages, ["player"], "page", ["team"], ["stats"])
    return merged.select("player", "team", files.pick(F.col("stats"), "attack", "value", "league").alias("picked"), F.col("stats")["league:value"].alias("fallback"))


@query("""select case when o_orderkey % 9 > 0 then o_orderkey end as match_id, case o_orderkey % 6 when 0 then 'completed' when 1 then 'completed' when 2 then 'scheduled' when 3 then 'postponed' when 4 then 'live' else 'unknown' end as status, case when o_orderkey % 10 > 0 then o_orderdate::date::varchar end as kickoff from orders""")
def match_schedule(spark: SparkSession, d: str) -> DataFrame:
    """A schedule of text cells, typed, with its statuses in one form."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["FT", " Finished", "fixture", "Postponed", "LIVE ", "void"])), (k % 6 + 1).cast("int"))
    rows = read(spark, d, "orders").select(F.when(k % 9 > 0, k.cast("string")).otherwise("n/a").alias("id"), status.alias("status"), F.when(k % 10 > 0, F.to_date("o_orderdate").cast("string")).otherwise("soon").alias("start"))
    path = files.working_folder(spark)
    files.write_documents(rows, path)
    found = files.schedule(files.read_documents(spark, path, "id string, status string, start string"))
    return found.select("match_id", "status", F.to_date("kickoff").cast("string").alias("kickoff"))


_SAID = ["AET", "pen", "HT", "cancelled", "Abandoned", "not started", "1h", "void", "FT", "Canceled"]


@query("""select o_orderkey as match_id, case when o_orderkey % 17 = 0 or o_orderkey % 10 in (0, 1, 8) then 'completed' when o_orderkey % 10 in (2, 6) then 'live' when o_orderkey % 10 in (3, 4, 9) then 'postponed' when o_orderkey % 10 = 5 then 'scheduled' when o_orderkey % 3 = 0 then 'completed' else 'unknown' end as status,
    case when o_orderkey % 3 < 2 then o_orderkey % 4 end as home_score, case when o_orderkey % 3 = 0 then o_orderkey % 5 end as away_score from orders""")
def match_schedule_results(spark: SparkSession, d: str) -> DataFrame:
    """Statuses after extra time, of cancelled and of running matches, results that say so, and scores without a status."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, _SAID)), (k % 10 + 1).cast("int"))
    scores = F.when(k % 3 == 0, F.array((k % 4).cast("string"), (k % 5).cast("string"))).when(k % 3 == 1, F.array((k % 4).cast("string"), F.lit("-")))
    rows = read(spark, d, "orders").select(F.concat(k, F.lit(".0")).alias("id"), status.alias("status"), F.lit("2024-01-01").alias("start"), (k % 17 == 0).alias("is_result"), scores.alias("scores"))
    path = files.working_folder(spark)
    files.write_documents(rows, path)
    found = files.schedule(files.read_documents(spark, path, "id string, status string, start string, is_result boolean, scores array<string>"))
    return found.select("match_id", "status", "home_score", "away_score")


@query("""select event_id, sha256('{"a":[' || event_id || ',{"c":"é","d":' || user_id || '}],"b":{"x":null,"y":' || event_id % 7 || '}}') as digest, event_id % 7 = user_id % 7 as same from events""")
def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    """Digests of nested documents whose keys come in any order, and whether typed columns of the same content agree."""
    k, u = F.col("event_id"), F.col("user_id")
    raw = F.when(k % 2 == 0, F.format_string('{"b": {"y": %d, "x": null}, "a": [%d, {"d": %d, "c": "\\u00e9"}]}', k % 7, k, u)).otherwise(F.format_string('{ "a":[%d,{"c":"é","d":%d}], "b":{"x":null,"y":%d}}', k, u, k % 7))
    one, other = F.struct((k % 7).alias("p"), F.lit(1).alias("q")), F.struct(F.lit(1).alias("q"), (u % 7).alias("p"))
    rows = read(spark, d, "events").select("event_id", raw.alias("raw"), one.alias("v"))
    again = read(spark, d, "events").select("event_id", other.alias("v"))
    both = rows.select("event_id", F.sha2(files.canonical_json("raw"), 256).alias("digest"), files.content_key(rows, "v").alias("l"))
    return both.join(again.select("event_id", files.content_key(again, "v").alias("r")), "event_id").select("event_id", "digest", (F.col("l") == F.col("r")).alias("same"))


@query("""select p_partkey, len(ids) as n, array_to_string(ids, ',') as ids from (select p_partkey, list_filter([p_size % 5, case when p_partkey % 4 > 0 then p_partkey % 5 end], lambda x: x is not null) as ids from part)""")
def comma_clubs(spark: SparkSession, d: str) -> DataFrame:
    """Clubs of a comma list looked up by name; unknown ones are left out."""
    ids = F.create_map(*(x for i in range(5) for x in (F.lit(f"club {i}"), F.lit(i))))
    second = F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit(" club "), (F.col("p_partkey") % 5).cast("string"))).otherwise("nobody")
    found = files.club_ids(F.concat(F.lit("club "), (F.col("p_size") % 5).cast("string"), F.lit(","), second), ids)
    return read(spark, d, "part").select("p_partkey", F.size(found).alias("n"), F.concat_ws(",", found.cast("array<string>")).alias("ids"))


@query("""select event_id, case when event_id % 4 = 1 then event_id * 2 end as a, case when event_id % 5 > 0 then event_id % 7 - 3 else event_id % 11 - event_id % 3 end as difference from events""")
def wrapped_versions(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of wrappers of the one right version, and a difference that falls back to its two sides."""
    k = F.col("event_id")
    wrapper = F.when(k % 4 == 0, "{no json").otherwise(F.format_string('{"version": %d, "payload": {"a": %d}}', k % 4, k * 2))
    given, sides = F.when(k % 5 > 0, k % 7 - 3), k % 11 - k % 3
    return read(spark, d, "events").select("event_id", files.unwrapped(wrapper, "struct<a:long>", 1)["a"].alias("a"), F.coalesce(given, sides).alias("difference"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then o_orderkey when 1 then o_orderkey end as whole, case when o_orderkey % 4 < 2 and o_orderkey % 3 > 0 then o_orderkey end as positive, case when o_orderkey % 2 > 0 then o_orderkey % 5 else o_orderkey % 7 end as picked from orders where o_orderkey % 5 > 0""")
def safe_readers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read from text without errors: whole ones, those not negative, and the first that is not 0."""
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".9"))).when(k % 4 == 2, "true")
    signed = rates.safe_int(F.concat(F.when(k % 3 == 0, "-").otherwise(""), t))
    return read(spark, d, "orders").where(k % 5 > 0).select("o_orderkey", rates.safe_int(t).alias("whole"), F.when(signed >= 0, signed).alias("positive"), rates.pick_nonzero(F.when(k % 2 > 0, k % 5), k % 7).alias("picked"))


_ASKED = ["xg_per_90", "tackles_per_90", "xg_per_90", "pass_accuracy"]


@query(f"""with {season_queries._METRICS}, {season_queries._FIT} select entity, position, {", ".join(f"round({m}, 6) as {m}, round(case when {m} is not null then (rank() over (partition by position order by {m} nulls last) - 1 + (count({m}) over (partition by position, {m})) / 2.0) / count({m}) over (partition by position) * 100 end, 6) as {m}_pct" for m in dict.fromkeys(_ASKED))} from eligible""")
def bounded_projection(spark: SparkSession, d: str) -> DataFrame:
    """Only the asked metrics, each once, with their percentiles, of a cohort that is within the limits."""
    rows, asked = cohort.guarded(season_queries.eligible(spark, d), _ASKED, set(sm.METRICS), most_rows=10**9, most_cells=10**9)
    rows = with_percentiles(rows, ["entity"], "position", {m: f"{m}_pct" for m in asked}, F.lit(True))
    return rows.select("entity", "position", *(F.round(c, 6).alias(c) for m in asked for c in (m, f"{m}_pct")))


@query("""select p_partkey as k, p_brand as s, p_brand not in (select p_brand from part where p_partkey % 50 = 0) as is_current from part union all select p_partkey + 1000000, p_brand, true from part where p_partkey % 50 = 0""")
def staged_switch(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("s"), F.lit(True).alias("is_current"))
    staged = base.where("k % 50 = 0").select((F.col("k") + 1_000_000).alias("k"), "s")
    return merge.switched(base, staged, "s")



@query("""with c as (select c_custkey as canonical_id, case when c_custkey % 3 = 0 then 'r' || c_custkey end as register_id, 'n' || (c_custkey % 40) as native_id from customer), p as (select o_orderkey as entity, case when o_orderkey % 2 = 0 then 'r' || o_custkey end as register_id, 'n' || (o_orderkey % 50) as native_id from orders),
    r as (select register_id, min(canonical_id) as r from c where register_id is not null and canonical_id % 5 > 0 group by 1), n as (select native_id, min(canonical_id) as n from c where register_id is null group by 1)
    select entity, case when r is not null then r::varchar when n is not null then n::varchar else 'new-' || substr(sha256(entity::varchar), 1, 16) end as canonical_id, case when r is not null then 'register' when n is not null then 'adopted' else 'created' end as how from p left join r using (register_id) left join n using (native_id)""")
def canonical_creation(spark: SparkSession, d: str) -> DataFrame:
    """Every provider row gets a canonical id: by the register, an adopted row, or a new one."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    word = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    canonical = read(spark, d, "customer").select(k.alias("canonical_id"), F.when(k % 3 == 0, word("r", k)).alias("register_id"), word("n", k % 40).alias("native_id"))
    provider = read(spark, d, "orders").select(o.alias("entity"), F.when(o % 2 == 0, word("r", F.col("o_custkey"))).alias("register_id"), word("n", o % 50).alias("native_id"))
    return merge.repaired(canonical, provider, canonical.where("canonical_id % 5 > 0 and register_id is not null"))


@query("""select c_custkey as k, case when m then 'GK' when a then 'DEF' when h then 'MID' when r then 'FWD' end as position, case when m then 'manual' when a then 'source' when h then 'roster' when r then 'history' end as source, case when m or a then 1.0 when h then 0.95 when r then 0.85 end as confidence
    from (select c_custkey, c_custkey % 17 = 0 as m, c_custkey % 2 = 0 as a, c_custkey % 5 = 0 as h, c_custkey % 3 = 0 as r from customer)""")
def position_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Positions from the surest source that has one; manual ones are never moved."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    of = lambda n, p: c.where(F.col("k") % n == 0).withColumn("position", F.lit(p))
    return merge.by_confidence(c, "k", [("history", of(3, "FWD"), 0.85), ("source", of(2, "DEF"), 1.0), ("roster", of(5, "MID"), 0.95)], "position", of(17, "GK"))


@query("""with r as (select s_suppkey as entity, 'a' || (s_suppkey % 70) as alias from supplier where s_suppkey % 2 = 0), o as (select s_suppkey as counterpart, 'a' || (s_suppkey % 90) as alias from supplier where s_suppkey % 3 > 0),
    u as (select alias, min(entity) as entity from r group by 1 having count(distinct entity) = 1), v as (select alias, min(counterpart) as counterpart from o group by 1 having count(distinct counterpart) = 1)
    select entity, counterpart from u join v using (alias) where counterpart % 7 > 0""")
def counterpart_adoption(spark: SparkSession, d: str) -> DataFrame:
    """The one row of the other provider with the same alias, unless something holds it in place."""
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier")
    alias = lambda n: F.concat(F.lit("a"), (k % n).cast("string")).alias("alias")
    others = s.where(k % 3 > 0).select(k.alias("counterpart"), alias(90))
    return merge.counterparts(s.where(k % 2 == 0).select(k.alias("entity"), alias(70)), others, others.where("counterpart % 7 = 0"))
