"""Which slices, matches, rows, labels, features and fits a request covers, over the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seasons, text
from ..operators import archetypes, cohort, distribution, names, regression, selection
from .registry import query, read

_CODES = [*selection.FIVE_CODES, "NED1", "UCL"]
_SLICES = f"""s as (select s_suppkey as id, ({_CODES!r})[s_suppkey % 7 + 1] as code, case when s_suppkey % 3 > 0 then '2024-25' else '2024' end as season, s_suppkey % 5 > 0 as is_active, s_suppkey % 4 > 0 as is_published,
    case when s_suppkey % 7 = 6 then 'continental_cup' else 'domestic_league' end as kind, s_suppkey % 11 > 0 as counts, 300 + s_suppkey % 400 as least from supplier)"""


def _slices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    code = F.element_at(F.array(*map(F.lit, _CODES)), (k % 7 + 1).cast("int"))
    return read(spark, d, "supplier").select(
        k.alias("id"), code.alias("code"), F.when(k % 3 > 0, "2024-25").otherwise("2024").alias("season"), (k % 5 > 0).alias("is_active"), (k % 4 > 0).alias("is_published"),
        F.when(k % 7 == 6, "continental_cup").otherwise("domestic_league").alias("competition_type"), (k % 11 > 0).alias("in_aggregates"), (300 + k % 400).alias("least_minutes"),
    )


@query(f"""with {_SLICES} select 'public' as scope, id from s where is_active and is_published union all select 'domestic', id from s where kind = 'domestic_league' and counts
    union all select 'ALL', id from s where is_active and is_published and kind = 'domestic_league' and counts and season = '2024-25' union all select 'BIG5', id from s where is_active and is_published and kind = 'domestic_league' and counts and season in ('2024-25', '2024') and code not in ('NED1', 'UCL')""")
def slice_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The slices of each predicate and scope."""
    s = _slices(spark, d)
    parts = {"public": selection.public_slices(s), "domestic": selection.domestic(s), "ALL": selection.scope(s, "all", ["2024-25"]), "BIG5": selection.scope(s, " big5 ", ["2024-25", "2024"])}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("scope"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_SLICES} select coalesce(min(least), 450) as least_minutes from s where is_active and is_published and code = 'GER1'")
def scope_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The smallest threshold of a scope's slices."""
    return selection.least_minutes(selection.public_slices(_slices(spark, d)).where("code = 'GER1'"))


@query("""with m as (select o_orderkey as match_id, o_orderdate as kickoff from orders where o_orderstatus = 'F')
    select 'last' as which, match_id from (select * from m order by kickoff desc, match_id desc limit 25) union all select 'days', match_id from m where kickoff::date between date '1995-01-01' and date '1995-02-15'
    union all select 'first', match_id from (select * from m where kickoff::date between date '1994-01-01' and date '1996-12-31' order by kickoff, match_id limit 10)""")
def chosen_matches(spark: SparkSession, d: str) -> DataFrame:
    """Completed matches: the last few, those of some days, and the first few of a range."""
    m = read(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.when(F.col("o_orderstatus") == "F", " Completed").otherwise("live").alias("status"), F.col("o_orderdate").cast("timestamp").alias("kickoff"))
    day = dt.date
    parts = {"last": selection.completed_matches(m, last=25), "days": selection.completed_matches(m, first_day=day(1995, 1, 1), last_day=day(1995, 2, 15)), "first": selection.completed_matches(m, first_day=day(1994, 1, 1), last_day=day(1996, 12, 31), limit=10)}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("which"), "match_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with p as (select p_partkey as k, p_size as x, p_retailprice as y from part), a as (select k from p order by y desc, k limit 3)
    select 'few' as what, s_suppkey as k from supplier where s_suppkey <= 15 union all select 'pinned', k from p where k % 100 = 7 union all select 'asked', k from p where k in (5, 6) union all select 'automatic', k from a""")
def points_with_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of few points and of many, asked pins among the points, and automatic ones where none is."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("y"))
    few = selection.labelled(read(spark, d, "supplier").where("s_suppkey <= 15").select(F.col("s_suppkey").alias("k"), F.lit(False).alias("pinned")), most=20)
    pinned = selection.labelled(p.withColumn("pinned", F.col("k") % 100 == 7), most=20)
    order = [F.desc("y"), F.asc("k")]
    asked = selection.pins_in_effect(p, spark.createDataFrame([(5,), (6,), (-1,)], "k long"), "k", order)
    automatic = selection.pins_in_effect(p, spark.createDataFrame([(-1,)], "k long"), "k", order)
    named = lambda df, what: df.select(F.lit(what).alias("what"), "k")
    return named(few, "few").unionByName(named(pinned, "pinned")).unionByName(asked.select(F.col("how").alias("what"), "k")).unionByName(automatic.select(F.col("how").alias("what"), "k"))


@query("""select n_nationkey, case n_name when 'CHINA' then 0 when 'PERU' then 1 when 'FRANCE' then 2 end as place from nation""")
def relevance_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of rows in a list of relevant ones."""
    return selection.by_relevance(read(spark, d, "nation"), "n_name", ["CHINA", "PERU", "CHINA", "FRANCE", "NOWHERE"]).select("n_nationkey", "place")


@query(r"""select p_partkey, list_filter(string_split(trim(regexp_replace(lower(strip_accents(t)), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x not in ('', 'fc', 'de', 'la', 'club', 'the')) as words from (select p_partkey, 'Clúb de la ' || p_name || ' Ж-Ü the FC' as t from part)""")
def counting_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of names that count, in any script."""
    name = F.concat(F.lit("Clúb de la "), "p_name", F.lit(" Ж-Ü the FC"))
    return read(spark, d, "part").select("p_partkey", text.name_form(name).alias("form")).select("p_partkey", text.name_words(F.col("form")).alias("words"))


_FEATURES = [f"f{i}" for i in range(14)]


@query("""with c as (select * from (select unnest(range(14)) as i) cross join (select count(*) as n from part)), v as (select i, n, (select count(*) from part where p_partkey % (i + 2) > 0) as have from c)
    select 'broad' as profile, list('f' || i order by 'f' || i) as features from v where have / n >= 0.8""")
def feature_profile(spark: SparkSession, d: str) -> DataFrame:
    """The feature profile that coverage allows: not every required feature is there often enough, but enough of the others are."""
    p = read(spark, d, "part")
    shares = p.agg(*((F.count_if(F.col("p_partkey") % (i + 2) > 0) / F.count("*")).alias(f) for i, f in enumerate(_FEATURES)))
    covered = shares.unpivot([], _FEATURES, "metric", "covered")
    return archetypes.profile(covered, [*_FEATURES[:3], "f9"], _FEATURES)


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), c as (select label, e from v qualify row_number() over (partition by label order by vec_id) = 1),
    d as (select vec_id, c.label, list_sum(list_transform(list_zip(v.e, c.e), lambda z: abs(z[1] - z[2]))) as d from v, c), s as (select label, median(d) as spread from d group by 1), r as (select *, row_number() over (partition by vec_id order by d, label) as n from d)
    select a.vec_id, a.label as "primary", round(greatest(0, least(1, 1 - a.d / (b.d + case when s.spread = 0 then 1 else s.spread end + 1e-9::double))), 6) as confidence from r a join r b on a.vec_id = b.vec_id and a.n = 1 and b.n = 2 join s on s.label = a.label""")
def type_confidence(spark: SparkSession, d: str) -> DataFrame:
    """How sure the nearest of given centres is, by the second nearest and the usual distance."""
    from ..operators.similarity import weighted_l1

    v = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    centres = v.groupBy("label").agg(F.min_by("e", "vec_id").alias("c"))  # one row a label
    held = centres.agg(F.collect_list(F.struct("label", "c")).alias("all"))
    ranked = F.array_sort(F.transform("all", lambda x: F.struct(weighted_l1(F.col("e"), x["c"]).alias("d"), x["label"].alias("label"))))
    met = v.crossJoin(F.broadcast(held)).withColumn("r", ranked)  # one row of centres
    told = met.select("vec_id", F.lit("all").alias("g"), F.col("r")[0]["label"].alias("primary"), F.col("r")[0]["d"].alias("d_primary"), F.col("r")[1]["d"].alias("d_secondary"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["label"], x["d"]))).alias("all_d"))
    return archetypes.confidence(told, ["g"]).select("vec_id", "primary", F.round("confidence", 6).alias("confidence"))


@query("""select count(*) as rows, count(*) filter (x is not null) as usable, count(*) filter (x is null) as dropped, ['close:a|b'] as warnings from (select case when l_linenumber % 4 > 0 then l_quantity end as x from lineitem)""")
def fit_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Rows a fit can use and what it warns of."""
    li = read(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity")).cast("double").alias("a"), (F.col("l_quantity") * 2 + F.col("l_linenumber") / 1000).cast("double").alias("b"), F.col("l_extendedprice").cast("double").alias("t"))
    return regression.fit_checks(li, ["a", "b"], "t", {"a", "b", "t"})


@query("""select doc_id, lower(lang) = 'en' as english, contains(lower(text), 'the ') as found from documents where lower(lang) = 'en' or contains(lower(source), 'rc1')""")
def text_filters(spark: SparkSession, d: str) -> DataFrame:
    """Equality and search without regard to case."""
    docs = read(spark, d, "documents")
    english = cohort.same_text(F.col("lang"), "EN")
    return docs.where(english | cohort.contains_text(F.col("source"), "RC1")).select("doc_id", english.alias("english"), cohort.contains_text(F.col("text"), "The ").alias("found"))


@query("""select event_id from events where event_id % 3 = 1 and user_id % 4 in (1, 2) and event_id % 5 = 2 and hour(ts) % 6 = 3""")
def scoped_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of a provider, some slices, a player and a team."""
    k = F.col("event_id")
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("p"), k % 3).alias("provider"), (F.col("user_id") % 4).alias("slice"), (k % 5).alias("player"), (F.hour("ts") % 6).alias("team"))
    return cohort.event_scope(e, "p1", spark.range(1, 3).select(F.col("id").alias("slice")), "slice", player=2, team=3).select("event_id")


@query("""select p_brand, count(*) as n, min(p_retailprice) as low, max(p_retailprice) as high, quantile_cont(p_retailprice, 0.5) as p50, len(list(distinct p_retailprice)) > 0 as some, case when min(p_retailprice) = max(p_retailprice) then 1 else least(16, count(*)) end as n_bins, count(*) as in_bins from part group by 1""")
def distribution_with_bins(spark: SparkSession, d: str) -> DataFrame:
    """Distribution rows with their bins: as many as asked for, which hold every row."""
    out = distribution.described(read(spark, d, "part"), ["p_brand"], "p_retailprice")
    held = F.aggregate("bins", F.lit(0).cast("long"), lambda s, n: s + n)
    return out.select("p_brand", "n", "low", "high", "p50", (F.size("bins") > 0).alias("some"), F.size("bins").alias("n_bins"), held.alias("in_bins"))


_ALIASES = {"SWE1|2024-25": "2024", "SWE1|24": "2024", "NOR1|2024-25": "2024"}


@query("""select s_suppkey, case s_suppkey % 4 when 0 then ['2024', '24', '2024-25'] when 1 then ['2024', '2024-25', '24'] when 2 then ['2024-25'] else ['2024', '2024-25'] end as labels from supplier""")
def season_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The labels under which a competition's season may be stored."""
    k = F.col("s_suppkey") % 4
    aliases = F.create_map(*(F.lit(x) for kv in _ALIASES.items() for x in kv))
    code = F.when(k < 2, " swe1").when(k == 2, "ENG1").otherwise("NOR1")
    label = F.when(k == 0, "24").otherwise("2024-25 ")
    return read(spark, d, "supplier").select("s_suppkey", seasons.candidate_labels(code, label, aliases).alias("labels"))


@query("""select c_custkey as id, case when c_custkey % 3 = 0 then true when c_custkey % 5 = 0 then true else c_custkey % 4 = 1 and c_custkey % 7 > 0 end as changed from customer""")
def resolution_changes(spark: SparkSession, d: str) -> DataFrame:
    """Which resolved rows are new or unlike those of the last run, where nulls are the same."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 1, F.when(k % 7 > 0, "x")).otherwise("DEF").alias("grp"), F.when(k % 5 == 0, 0.5).otherwise(1.0).alias("confidence"))
    old = read(spark, d, "customer").where("c_custkey % 3 > 0").select(k.alias("id"), F.when(k % 4 == 1, F.lit(None)).otherwise("DEF").cast("string").alias("grp"), F.lit(1.0).alias("confidence"))
    return names.with_changes(rows, old, "id", ["grp", "confidence"]).select("id", "changed")
