"""Secret scans over versions of texts, with a ledger of what has been scanned.

Every version of a path (here: the text of a document) is stored under its
content address, the SHA-256 of its bytes.  A ledger is a folder of two tables,
the pairs of blob and rule version that have been scanned, and the findings.  A
run (`update`) scans, for each rule, only blobs that the ledger does not pair
with the rule's version, one text per blob, and appends to both tables; `report`
joins the findings of the rules' versions back to all paths that hold the blob.
Everything on this path is DataFrame operations.

A rule's base pattern gives leftmost non-overlapping matches; `least` then drops
matches whose group is too short, without trying again.  Places come from running
sums over the lengths of the pieces between matches, in code points, ends
exclusive; neither they nor the ledger hold any part of a text.

Defined results: a null text is an empty one; texts of any length and number of
matches are scanned whole, in time in proportion to both; blobs are shared by any
number of paths; repeated rows of one path and text count as one version each;
rows without doc_id are scanned and listed as any other; an empty table gives an
empty result; further columns are ignored.  A run that ends between its two
appends leaves pairs unlisted: they are scanned again and reported once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored


@dataclass(frozen=True)
class Rule:
    """`group` of every match of `pattern` must have `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", 1, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", 1, r"AKIA([A-Z0-9]+)", 1, 16),
    # every hex run is a base match; shorter ones would be dropped, and none can start inside another
    Rule("hex", 1, r"([0-9a-f]{24,}+)", 1, 24),
)
FINDING = "array<struct<start:int,end:int>>"
PAIRS, FINDINGS = "blob string, kind string, version int", f"blob string, kind string, version int, spans {FINDING}"


def pieces(text: Column, rule: Rule) -> Column:
    """array<struct<gap, hit, long>> of a rule's matches in a text: lengths of what precedes a match and of itself, and whether it counts."""
    matches, groups = F.regexp_extract_all(text, F.lit(rule.pattern), 0), F.regexp_extract_all(text, F.lit(rule.pattern), rule.group)
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
    every = F.transform(F.arrays_zip(between.alias("gap"), matches.alias("hit"), groups.alias("value")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["value"]) >= rule.least).alias("long")))
    return F.when(text.rlike(rule.pattern), every).otherwise(F.array().cast("array<struct<gap:int,hit:int,long:boolean>>"))


def placed(cut: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, one column of FINDING for each rule) of the blobs with matches; cut: blob and pieces() by rule."""
    every = cut.select("blob", F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.col(r.kind).alias("pieces")) for r in rules))).alias("x")).where(F.size("x.pieces") > 0)
    each = every.select("blob", "x.kind", F.posexplode("x.pieces").alias("nth", "piece"))
    so_far = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.withColumn("end", F.sum(F.col("piece.gap") + F.col("piece.hit")).over(so_far).cast("int")).where("piece.long")
    span = F.struct((F.col("end") - F.col("piece.hit")).alias("start"), "end")
    return ends.groupBy("blob").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == r.kind, span))).alias(r.kind) for r in rules))


def versions(docs: DataFrame) -> DataFrame:
    """(path, blob): the content address of each row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, reader, rules): blobs with rule versions not in the ledger, and the path to read each from."""
    blobs = paths.groupBy("blob").agg(F.min("path").alias("reader"))
    known = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    if ledger is None:
        return blobs.withColumn("rules", known)
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    left = blobs.join(done, "blob", "left").withColumn("rules", F.array_except(known, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>"))))
    return left.where(F.size("rules") > 0).drop("done")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, entries): all versions, findings of this run by blob, and its new ledger rows.

    findings has blob and one column of spans for each rule (null if that rule
    version had seen the blob); entries has blob, kind, version.
    """
    paths = versions(docs)
    todo = unseen(paths, ledger, rules)
    text = docs.select(F.col("doc_id").cast("long").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("address", F.sha2(F.col("text").cast("binary"), 256))
    # a path, or the rows without one, may hold several versions; the address tells which one was asked for
    source = todo.join(text, (F.col("blob") == F.col("address")) & F.col("reader").eqNullSafe(F.col("path")))
    wanted = lambda r: F.exists("rules", lambda x: (x["kind"] == r.kind) & (x["version"] == r.version))
    cut = stored(source.select("blob", "rules", *(F.when(wanted(r), pieces(F.col("text"), r)).alias(r.kind) for r in rules)).dropDuplicates(["blob"]))
    some = placed(cut, rules).withColumnsRenamed({r.kind: f"found_{r.kind}" for r in rules})
    none = F.array().cast(FINDING)
    found = cut.join(some, "blob", "left").select("blob", "rules", *(F.when(wanted(r), F.coalesce(f"found_{r.kind}", none)).alias(r.kind) for r in rules))
    found = stored(found)
    entries = found.select("blob", F.explode("rules").alias("r")).select("blob", "r.kind", "r.version")
    return paths, found.drop("rules"), entries


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger (a folder) has not seen, append to it, and return the number of pairs scanned."""
    spark = docs.sparkSession
    known = _read(spark, f"{ledger}/pairs", PAIRS)
    _, found, entries = scan(docs, known, rules)
    each = F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules))).alias("x")
    found.select("blob", each).select("blob", "x.*").where(F.size("spans") > 0).write.mode("append").parquet(f"{ledger}/findings")
    entries.write.mode("append").parquet(f"{ledger}/pairs")
    return entries.count()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def report(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with the ledger's findings in its blob under the versions of `rules`."""
    rows = _read(docs.sparkSession, f"{ledger}/findings", FINDINGS)
    # one row for each blob, kind and version, or equal ones: whichever is taken is the same
    of_rule = lambda r: F.max(F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.col("spans")))
    return by_path(versions(docs), rows.groupBy("blob").agg(*(of_rule(r).alias(r.kind) for r in rules)), rules)


def by_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with the findings in its blob; blobs without any stay out of the join."""
    some = findings.where(sum((F.size(F.coalesce(F.col(r.kind), F.array().cast(FINDING))) for r in rules[1:]), F.size(F.coalesce(F.col(rules[0].kind), F.array().cast(FINDING)))) > 0)
    joined = paths.join(some, "blob", "left")
    return joined.select("path", "blob", *(F.coalesce(F.col(r.kind), F.array().cast(FINDING)).alias(r.kind) for r in rules))


def listing(rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all findings, by start, then kind as listed, comma-joined."""

    def numbered(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("nth"), s["end"].alias("end")))

    all_spans = F.array_sort(F.concat(*(numbered(i, r.kind) for i, r in enumerate(rules))))
    kind = lambda nth: F.element_at(F.array(*(F.lit(r.kind) for r in rules)), nth + 1)
    return F.concat_ws(",", F.transform(all_spans, lambda s: F.concat_ws(":", kind(s["nth"]), s["start"].cast("string"), s["end"].cast("string"))))
