"""The registered forms: thin queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lines, minhash, mixing, neighbours, pair_sql, passages, pii, quality, repeat_sql, runs, secrets, token_counts, token_files, whitening
from .common import scratch_dir, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BUDGET = 512


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rake all documents towards the square roots of their source, language and topic totals, and draw."""
    rows = stored(mixing.weighed(table(spark, sf_dir, "documents")))
    drawn = mixing.sample(rows, mixing.probabilities(rows))
    return drawn.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "sampled")


def _mixing_sql() -> str:
    margins = ("source", "lang", "topic")
    steps = [
        r"""rows_ as materialized (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
            case when contains(t, ' | ') then 'table' when regexp_matches(t, '[0-9]') then 'figures' when contains(t, '!') then 'calls' else 'prose' end as topic,
            len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint as tokens
            from (select *, coalesce(text, '') as t from documents))""",
        "c0 as materialized (select source, lang, topic, sum(tokens)::double as tokens, sum(tokens)::double as fitted from rows_ group by 1, 2, 3)",
    ]
    for m in margins:
        steps.append(f"g_{m} as materialized (select {m}, sqrt(n) / sum(sqrt(n)) over () * sum(n) over () as goal from (select {m}, sum(tokens) as n from c0 group by 1) where n > 0)")
    n = 0
    for _ in range(mixing.ROUNDS):
        for m in margins:
            steps.append(f"c{n + 1} as materialized (select source, lang, topic, tokens, fitted * case when now > 0 then coalesce(goal, 0) / now else 1 end as fitted from (select *, sum(fitted) over (partition by {m}) as now from c{n}) left join g_{m} using ({m}))")
            n += 1
    steps.append(f"f as materialized (select *, case when tokens > 0 then fitted / tokens else 1 end as factor from c{n})")
    steps.append("p as (select *, least(1.0, factor / (select greatest(coalesce(max(factor) filter (tokens > 0), 1.0), 1.0) from f)) as probability from f)")
    return f"""with {", ".join(steps)} select doc_id, source, lang, topic, r.tokens, round(probability, 9) as probability,
        coalesce(('0x' || substr(md5('mix:' || doc_id), 1, 8))::bigint / 4294967296.0 < probability, false) as sampled
        from rows_ r join p using (source, lang, topic)"""


ORACLES["op1_mixing"] = _mixing_sql()


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a classifier learned from the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to every vector whose id is divisible by 100."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated runs of lines from all documents and describe what is left."""
    done = lines.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__chunks").alias("n_chunks"), F.col("__removed").alias("n_removed_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of similarity 0.85 and more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLES["op5_near_duplicates"] = pair_sql.NEAR_DUPLICATES


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search all documents for ten-word windows of all benchmark items."""
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op6_decontaminate"] = pair_sql.DECONTAMINATE


@query
def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove passages of twenty words that start earlier, over all documents."""
    done = passages.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op7_passages"] = pair_sql.PASSAGES


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bring a new ledger to two rule sets in turn, of which the second adds a rule, and list findings by document.

    The second run finds all blobs listed for the first rules and scans them for the added one only.
    """
    docs, ledger = table(spark, sf_dir, "documents"), scratch_dir(spark)
    for rules in (secrets.RULES[:2], secrets.RULES):
        secrets.update(docs, ledger, rules)
    listed = secrets.report(docs, ledger).withColumn("spans", secrets.listing())
    return listed.select(F.col("path").alias("doc_id"), *(F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in secrets.RULES), F.sha2("spans", 256).alias("base_sha256"), "spans")


def _secrets_sql() -> str:
    parts = []
    for nth, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''").replace("{24,}+", "{24,}")
        parts.append(f"""select doc_id, '{r.kind}' as kind, {nth} as nth, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
            s := list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
            n := length(m[i]), g := length(v[i])))) as x from (select doc_id, regexp_extract_all(t, '{pattern}', 0) as m, regexp_extract_all(t, '{pattern}', {r.group}) as v, string_split_regex(t, '{pattern}') as p from d)
            where len(m) > 0""")
    every = " union all ".join(f"select doc_id, kind, nth, x.s::bigint as s, (x.s + x.n)::bigint as e from ({p}) where x.g >= {r.least}" for p, r in zip(parts, secrets.RULES, strict=True))
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.RULES)
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), f as ({every}),
        g as (select doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' order by s, nth) as spans from f group by 1)
        select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.RULES)}, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""


ORACLES["op8_secrets"] = _secrets_sql()


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in all documents with a field fitted on some of them."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))

    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    nth = {k: i for i, k in enumerate(pii.KINDS)}
    order = F.create_map(*(F.lit(x) for kv in nth.items() for x in kv))
    placed = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, pii.KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(placed).alias("spans"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files, and describe each document from the files."""
    path = token_files.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    return token_files.token_index(spark, path)


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whiten all embeddings; the first four components of each."""
    return whitening.components(table(spark, sf_dir, "embeddings"), k=4)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by doc_id, made periodic from some word on; the others as they are."""
    code = F.crc32(F.col("doc_id").cast("string"))
    # only the texts of that tenth are cut into words
    rows = docs.select("doc_id", "text", F.floor(code / 10).alias("g"), F.when(code % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("ws"))
    rows = rows.withColumn("a", F.when(F.size("ws") > 0, F.col("g") % F.size("ws")).cast("int"))
    left = (F.size("ws") - F.col("a")).cast("int")
    period = (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int")
    rows = rows.select("doc_id", "text", "ws", "a", left.alias("left"), period.alias("p"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), F.ceil(F.col("left") / F.col("p")).cast("int"))), 1, F.col("left"))
    planted = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find the periodic runs of all documents, of which a tenth is made periodic first, and collapse them."""
    return runs.described(runs.find(with_planted_runs(table(spark, sf_dir, "documents"))))


ORACLES["op12_periodic_runs"] = repeat_sql.PERIODIC_RUNS


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the token counts of every prefix of all documents and answer from the table what passes the budget and where it must be cut."""
    path = token_counts.write_counts(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)
    found = token_counts.answers(token_counts.read_counts(spark, path), BUDGET)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > BUDGET).alias("over_limit"), "fits_chars")
