"""Search folding, reading time and article filters over documents and conversations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import articles
from .registry import query, read

_FOLD = f"replace(replace(replace(replace(translate(lower({{0}}), '{text.MARKED}', '{text.PLAIN}'), 'ø', 'o'), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss')"


@query(f"select doc_id, lang, strpos({_FOLD.format('text')}, 'entre ') as place from documents where contains({_FOLD.format('text')}, 'entre ')")
def fold_search(spark: SparkSession, d: str) -> DataFrame:
    folded = text.fold(F.col("text"))
    return read(spark, d, "documents").where(F.contains(folded, F.lit("entre "))).select("doc_id", "lang", F.instr(folded, "entre ").cast("long").alias("place"))


@query(r"select doc_id, greatest(1, ceil(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) / 220.0))::int as minutes from documents")
def reading_time(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.reading_minutes(F.col("text")).alias("minutes"))


@query("""select doc_id, source, n_chars from documents where lang in ('fr', 'de') and n_chars between 500 and 3000 and contains(lower(text), 'la') and len(list_intersect(string_split(source, 'c'), ['sr', '1', '2', '3'])) > 1""")
def article_filter(spark: SparkSession, d: str) -> DataFrame:
    topics = F.split("source", "c")
    wanted = F.array(*(F.lit(x) for x in ("1", "2", "3")))
    rows = read(spark, d, "documents").where(F.col("lang").isin("fr", "de") & F.col("n_chars").between(500, 3000) & F.contains(F.lower("text"), F.lit("la")) & F.arrays_overlap(topics, wanted))
    return rows.select("doc_id", "source", "n_chars")


@query("""select a.doc_id, b.doc_id as related from documents a join documents b on a.source = b.source and a.lang = b.lang and a.doc_id <> b.doc_id where a.doc_id % 20 = 0 qualify row_number() over (partition by a.doc_id order by abs(a.n_chars - b.n_chars), b.doc_id) <= 3""")
def related_articles(spark: SparkSession, d: str) -> DataFrame:
    """The related documents of all in the query set for searches, ids divisible by 20."""
    return related(read(spark, d, "documents"), "doc_id % 20 = 0")


@query("""select a.doc_id, b.doc_id as related from documents a join documents b on a.source = b.source and a.lang = b.lang and a.doc_id <> b.doc_id where a.doc_id % 20 = 0 qualify row_number() over (partition by a.doc_id order by abs(a.n_chars - b.n_chars), b.doc_id) <= 3""")
def related_articles_all(spark: SparkSession, d: str) -> DataFrame:
    """The same, under the name it had beside a narrower one."""
    return related(read(spark, d, "documents"), "doc_id % 20 = 0")


def related(documents: DataFrame, queries: str, n: int = 3) -> DataFrame:
    """doc_id, related: the n documents of the same source and language nearest in length to each chosen one, itself left out; those without a length come last.

    Of equal lengths the n + 1 smallest ids can count, and only the n lengths on either side, so a length's rows are put
    beside those of its neighbours once, and a document meets a few rows, not its whole group.  Lengths are at most as
    many as the longest text has letters.
    """
    from pyspark.sql import Window

    same, docs = ["source", "lang"], documents.select("doc_id", "source", "lang", "n_chars").where("source is not null and lang is not null")

    def smallest(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        """The n + 1 smallest ids of each group, with their lengths."""
        place = F.dense_rank().over(Window.partitionBy(*by).orderBy("doc_id"))
        return rows.withColumn("place", place).where(F.col("place") <= n + 1).groupBy(*by).agg(F.collect_list(F.struct(F.col("doc_id").alias("related"), F.col("n_chars").alias("length"))).alias(name))

    order = Window.partitionBy(*same).orderBy("n_chars")
    around = [step("own", i).over(order) for step in (F.lag, F.lead) for i in range(1, n + 1)]
    none = F.array().cast("array<struct<related:bigint,length:bigint>>")
    lengths = smallest(docs.where("n_chars is not null"), [*same, "n_chars"], "own")
    near = lengths.select(*same, "n_chars", F.concat("own", *(F.coalesce(c, none) for c in around)).alias("near"))
    bare = smallest(docs.where("n_chars is null"), same, "bare")
    asked = docs.where(queries)
    known = asked.where("n_chars is not null").join(near, [*same, "n_chars"]).join(bare, same, "left").select("doc_id", "n_chars", F.explode(F.concat("near", F.coalesce("bare", none))).alias("c"))
    others = asked.where("n_chars is null").join(smallest(docs, same, "first"), same).select("doc_id", "n_chars", F.explode("first").alias("c"))
    rows = known.unionByName(others).select("doc_id", "c.related", F.abs(F.col("n_chars") - F.col("c.length")).alias("gap")).where("doc_id <> related")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("gap").asc_nulls_last(), "related"))
    return rows.withColumn("place", place).where(F.col("place") <= n).select("doc_id", "related")


@query("""select conv_id, count(*) as turns, count(*) filter (role = 'user') as asked, list(distinct role order by role) as roles, max(length(text)) as longest from conversations group by 1""")
def conversation_facets(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").groupBy("conv_id")
    return c.agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.array_sort(F.collect_set("role")).alias("roles"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""select c_name, trim(regexp_replace(lower(c_name), '[^0-9a-z]+', ' ', 'g')) as canonical, regexp_replace(lower(c_name), '[^0-9a-z]+', '', 'g') as bare, coalesce(try_cast(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') as int), 999) as tier from customer""")
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_name", text.canonical_name(F.col("c_name")).alias("canonical"), text.alnum_name(F.col("c_name")).alias("bare"), text.trailing_number(F.col("c_name")).alias("tier"))


@query("""select n_nationkey, lower(replace(replace(replace(strip_accents(w), 'Ø', 'o'), 'ø', 'o'), 'ß', 'ss')) as folded from (select n_nationkey, n_name || ' Ṽệǻ ŐỮÝ øß Ø Йо Ώ ñ' || chr(769) as w from nation)""")
def fold_any_mark(spark: SparkSession, d: str) -> DataFrame:
    """Search forms of words with marks of many kinds."""
    return read(spark, d, "nation").select("n_nationkey", text.fold(F.concat("n_name", F.lit(" Ṽệǻ ŐỮÝ øß Ø Йо Ώ ñ\u0301"))).alias("folded"))


_POSITIONS = ["DR", "M(C)", "Attacking Midfielder", "GK", "goalkeeper (sub)", "D(LC)", "FWL", "Striker", "Mittelfeld", "Defensive", "F9", "x", "", "AM", "Dribbler", "S-MID"]
_IN = {g: ", ".join(f"'{w}'" for w in words) for g, words in text.POSITION_WORDS.items()}


@query(f"""with p as (select p_partkey, ({_POSITIONS!r})[1 + p_partkey % {len(_POSITIONS)}] as raw from part), w as (select *, upper(trim(raw)) as u, regexp_split_to_array(upper(trim(raw)), '[^A-Z]+') as ws from p)
    select p_partkey, case when u = '' then 'UNK' when u = 'G' or contains(u, 'GOALKEEPER') or list_contains(ws, 'GK') then 'GK' when list_has_any(ws, [{_IN["MID"]}]) then 'MID' when list_has_any(ws, [{_IN["DEF"]}]) then 'DEF' when list_has_any(ws, [{_IN["FWD"]}]) then 'FWD'
    when starts_with(u, 'D') or contains(u, 'DEF') then 'DEF' when starts_with(u, 'F') then 'FWD' when starts_with(u, 'M') or contains(u, 'MID') then 'MID' else 'UNK' end as grp from w""")
def position_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of native positions, by words and by how they begin."""
    raw = F.element_at(F.array(*map(F.lit, _POSITIONS)), (F.col("p_partkey") % len(_POSITIONS) + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", text.position_of(raw).alias("grp"))


_ARTICLES = """a as (select doc_id, 'Title ' || doc_id as title, source as author_id, text as body, ['T' || doc_id % 5, 'U' || doc_id % 3] as topics, case when doc_id % 4 > 0 then ['ENG' || doc_id % 2] else []::varchar[] end as competitions,
    case when doc_id % 2 = 0 then ['2024-25'] else ['2023-24'] end as seasons, timestamp '2024-01-01' + to_days((doc_id % 400)::int) as published_at from documents)"""


def _articles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    entity = lambda kind, n, relationship: F.struct(F.lit(kind).alias("kind"), (k % n).cast("long").alias("id"), relationship.alias("relationship"))
    return read(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("Title "), k).alias("title"), F.lit(None).cast("string").alias("subtitle"), F.col("source").alias("author_id"), F.lit("A. Uthor").alias("author_name"), F.lit("").alias("notes"), F.col("text").alias("body"),
        F.array(F.concat(F.lit("T"), k % 5), F.concat(F.lit("U"), k % 3)).alias("topics"), F.when(k % 4 > 0, F.array(F.concat(F.lit("ENG"), k % 2))).alias("competitions"), F.when(k % 2 == 0, F.array(F.lit("2024-25"))).otherwise(F.array(F.lit("2023-24"))).alias("seasons"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(k % 400).cast("int"))).alias("published_at"), F.array(entity("player", 11, F.when(k % 2 == 0, "subject").otherwise("mention")), entity("team", 7, F.lit("subject"))).alias("entities"),
    )


@query(f"""with {_ARTICLES} select 'words' as facet, doc_id from a where contains(lower(title || ' A. Uthor ' || coalesce(body, '') || ' ' || topics[1] || ' ' || topics[2]), 'que') and list_has_any(topics, ['T1', 'U2'])
    union all select 'place', doc_id from a where list_contains(competitions, 'ENG1') and list_contains(seasons, '2023-24') union all select 'author', doc_id from a where author_id = 'src1' and published_at::date between date '2024-02-01' and date '2024-12-24'
    union all select 'entity', doc_id from a where doc_id % 11 = 3 and doc_id % 2 = 0 and doc_id % 7 = 2""")
def article_facets(spark: SparkSession, d: str) -> DataFrame:
    """Articles by words and topics, competition and season, author and days, and the entities they are about."""
    a = _articles(spark, d)
    day = dt.date
    parts = {
        "words": articles.filtered(a, q=" QUE", topics=["t1", " U2 "]),
        "place": articles.filtered(a, competition="eng1", season="2023-24"),
        "author": articles.filtered(a, author="src1", first_day=day(2024, 2, 1), last_day=day(2024, 12, 24)),
        "entity": articles.filtered(a, player=3, team=2, relationship="subject"),
    }
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("facet"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out
