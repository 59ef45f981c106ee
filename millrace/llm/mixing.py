"""Mixing sources to target weights by raking.

Documents fall into cells, one for each combination of source, language and
topic.  Iterative proportional fitting scales the cells' token totals until the
totals by source, by language and by topic agree with the targets; the factor
of a cell is the weight of each of its documents.  Documents are then sampled
without replacement by calibrated probabilities: factors times the largest rate
at which none exceeds one (or a given rate, above which probabilities stop at
one).  Whether a document is in depends on its doc_id and the seed alone.

Only the cell totals, as many as there are combinations and not documents, are
fitted, on Spark at every size: a grouped sum with partial sums before its
shuffle, so that a source with a third of all rows is no burden; then rounds of
sums over the classes of the cells, one written table for each round, until
every margin is within `tolerance` of its target or `rounds` are over.
`margins_reached` reports what was reached.

Defined results: null sources, languages and topics are classes of their own;
null and empty texts weigh 0 tokens and are drawn like the rest of their cell;
texts of any length are counted whole; rows of equal draws are in or out together;
cells of 0 tokens keep the factor 1; targets are shares by class, and classes
without a target keep their share of the tokens; repeated doc_ids are drawn
together; null doc_ids never enter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored, uniform

NONE = "(none)"
ROUNDS = 12
TOLERANCE = 1e-12


def words(text: Column) -> Column:
    """Number of runs of anything but blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form(text: Column) -> Column:
    """A topic that the text itself shows: tables, figures, calls, or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.rlike("[0-9]"), "figures").when(t.contains("!"), "calls").otherwise("prose")


def cell_columns(topic: Column | None = None) -> list[Column]:
    """doc_id and the three classes of a row."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return [F.col("doc_id").cast("long").alias("doc_id"), named("source"), named("lang"), F.coalesce(topic if topic is not None else form(F.col("text").cast("string")), F.lit(NONE)).alias("topic")]


def weighed(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every row."""
    return docs.select(*cell_columns(topic), words(F.col("text").cast("string")).alias("tokens"))


def totals(rows: DataFrame, margins: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*margins).agg(F.sum("tokens").cast("double").alias("tokens"))


def goals(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None, exponent: float) -> DataFrame:
    """(margin, goal in tokens) of the classes that have tokens.

    wanted: shares by class; a class without one keeps its own share, and the others
    are scaled to what is left.  Without any, shares are tempered: between what there
    is (exponent 1) and equal parts (0).
    """
    by = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).where("n > 0")
    whole = cells.agg(F.sum("tokens").alias("whole"))  # one row
    if wanted:
        listed = cells.sparkSession.createDataFrame(list(wanted.items()), f"`{margin}` string, share double")
        by = by.join(listed, margin, "left")
        ends = by.agg(F.sum(F.when(F.col("share").isNull(), F.col("n")).otherwise(0.0)).alias("rest"), F.sum("share").alias("asked"))
        goal = F.when(F.col("share").isNull(), F.col("n")).when(F.col("asked") > 0, F.col("share") * (F.col("whole") - F.col("rest")) / F.col("asked")).otherwise(0.0)
    else:
        ends = by.agg(F.sum(F.pow("n", F.lit(exponent))).alias("all"))
        goal = F.pow("n", F.lit(exponent)) / F.col("all") * F.col("whole")
    return by.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(ends)).select(margin, goal.alias("goal"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Iterative proportional fitting of cells (margins, tokens); adds fitted and factor (1 in cells without tokens).

    targets: for each margin a DataFrame (that column, goal in tokens).  A round reads the cells once and sums them over
    the classes of each margin in turn: joining the sums back would double its plan with every margin, and plans of many
    rounds fill the driver.
    """
    now = cells.withColumn("fitted", F.col("tokens"))
    for margin, goal in targets.items():
        now = now.join(goal.select(margin, F.col("goal").alias(f"__goal_{margin}")), margin, "left")
    now = stored(now)
    known = [f"__goal_{margin}" for margin in targets]
    for _ in range(rounds):
        off = []
        for margin in targets:
            total = F.sum("fitted").over(Window.partitionBy(margin))
            step = F.when(total > 0, F.coalesce(f"__goal_{margin}", F.lit(0.0)) / total).otherwise(1.0)
            now = now.withColumn(f"__{margin}", step).withColumn("fitted", F.col("fitted") * F.col(f"__{margin}"))
            off.append(F.abs(F.col(f"__{margin}") - 1.0))
        now = stored(now.withColumn("__off", F.greatest(F.lit(0.0), *off)).select(*cells.columns, *known, "fitted", "__off"))
        # every class was within the tolerance before its step, so no step moved anything
        if (now.where("fitted > 0").agg(F.max("__off")).first()[0] or 0.0) <= tolerance:
            break
    used = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0)
    return now.drop("__off", *known).withColumn("factor", used)


def margins_reached(raked: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """margin, class, tokens before, tokens fitted, goal and the relative difference, for every class."""
    out = None
    for margin, goal in targets.items():
        by = raked.groupBy(margin).agg(F.sum("tokens").alias("tokens"), F.sum("fitted").alias("fitted")).join(goal, margin, "left")
        one = by.select(F.lit(margin).alias("margin"), F.col(margin).alias("class"), "tokens", "fitted", F.coalesce("goal", F.lit(0.0)).alias("goal"), F.when(F.col("goal") > 0, F.abs(F.col("fitted") / F.col("goal") - 1)).alias("off"))
        out = one if out is None else out.unionByName(one)
    return out


def probabilities(rows: DataFrame, *, margins: tuple[str, ...] = ("source", "lang", "topic"), targets: Mapping[str, Mapping[str, float]] | None = None, exponent: float = 0.5, rate: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with tokens, factor and probability.

    targets: shares by class for a margin; margins without any are tempered by `exponent`.
    """
    cells = stored(totals(rows, margins))
    raked = rake(cells, {m: stored(goals(cells, m, (targets or {}).get(m), exponent)) for m in margins}, rounds, tolerance)
    top = raked.where("tokens > 0").agg(F.greatest(F.coalesce(F.max("factor"), F.lit(1.0)), F.lit(1.0)).alias("top"))  # one row
    scale = F.lit(float(rate)) if rate is not None else 1.0 / F.col("top")
    return stored(raked.crossJoin(F.broadcast(top)).withColumn("probability", F.least(F.lit(1.0), F.col("factor") * scale)).drop("top", "fitted"))


def sample(rows: DataFrame, cells: DataFrame, *, margins: tuple[str, ...] = ("source", "lang", "topic"), seed: str = "mix") -> DataFrame:
    """`rows` with factor, probability, draw and sampled."""
    prepare(rows.sparkSession)
    joined = rows.join(cells.select(*margins, "factor", "probability"), list(margins))
    return joined.withColumn("draw", uniform(F.col("doc_id"), seed)).withColumn("sampled", F.coalesce(F.col("draw") < F.col("probability"), F.lit(False)))


def mixed(docs: DataFrame, *, exponent: float = 0.5, rate: float | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, topic: Column | None = None, seed: str = "mix") -> DataFrame:
    """The rows of `docs` that are drawn, with their columns as they were."""
    cells = probabilities(weighed(docs, topic), exponent=exponent, rate=rate, targets=targets)
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)), F.struct(*cell_columns(topic)).alias("__w"))
    chances = cells.select(*(F.col(m).alias(f"__{m}") for m in ("source", "lang", "topic")), F.col("probability").alias("__p"))
    hit = own.join(chances, [F.col(f"__w.{m}") == F.col(f"__{m}") for m in ("source", "lang", "topic")])
    return hit.where(uniform(F.col("__w.doc_id"), seed) < F.col("__p")).select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(names)))
