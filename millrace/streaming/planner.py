"""A day's plan of items, worked off in ticks: claims with a lease, a cap on cost, retries, and a final verdict.

Each tick is one micro-batch: reports of workers and the time.  A tick makes the next state from the last one published
and is published under its own number (operators/sink.py), so a tick that comes again, or after a crash, makes the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sink
from .events import run_once

STATE = "plan string, item string, planned_order int, eta timestamp, status string, attempts int, claimed_until timestamp, cost long, finished_at timestamp"
REPORTS = "at timestamp, item string, attempt int, ok boolean, cost long"
FINAL = ["success", "failed", "skipped"]


def planned(items: DataFrame, plan: str, start: str, least_gap: int = 600, most_gap: int = 1500) -> DataFrame:
    """The first state: item and planned_order get a time each, after gaps between the bounds that hang on plan and item alone."""
    gap = F.when(F.col("planned_order") > 1, least_gap + F.pmod(F.xxhash64(F.lit(plan), "item"), F.lit(most_gap - least_gap + 1))).otherwise(0)
    so_far = F.sum(gap).over(Window.orderBy("planned_order").rowsBetween(Window.unboundedPreceding, 0))  # the items of one plan
    eta = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + so_far)
    null = F.lit(None).cast("timestamp")
    return items.select(F.lit(plan).alias("plan"), "item", F.col("planned_order").cast("int").alias("planned_order"), eta.alias("eta"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), null.alias("claimed_until"), F.lit(0).cast("long").alias("cost"), null.alias("finished_at"))


def tick(state: DataFrame, reports: DataFrame, *, slots: int, cap: int, lease_seconds: int, most_attempts: int) -> DataFrame:
    """The state after a tick.

    In this order: reports of the running attempt settle an item (later and foreign reports are ignored, but all costs count);
    failed and lapsed attempts wait again, or fail for good after `most_attempts`; once costs reach the cap, all that waits is
    skipped; then items whose time has come are claimed by planned order for as long as there are free slots.
    The time is that of the newest report of the tick; a tick without one changes nothing.
    """
    now = reports.agg(F.max("at").alias("__now"))  # one row
    costs = reports.where("item is not null").groupBy("item").agg(F.sum(F.coalesce("cost", F.lit(0))).alias("__cost"))
    verdicts = reports.where("item is not null").groupBy("item", F.col("attempt").alias("attempts")).agg(F.max("ok").alias("__ok"))
    s = state.crossJoin(F.broadcast(now)).join(costs, "item", "left").join(verdicts, ["item", "attempts"], "left")
    timed = F.col("__now").isNotNull()
    claimed = (F.col("status") == "claimed") & timed
    lost = claimed & (F.col("__ok").eqNullSafe(False) | (F.col("__ok").isNull() & (F.col("claimed_until") < F.col("__now"))))
    status = F.when(claimed & F.col("__ok").eqNullSafe(True), "success").when(lost & (F.col("attempts") >= most_attempts), "failed").when(lost, "pending").otherwise(F.col("status"))
    s = s.withColumn("cost", F.col("cost") + F.coalesce("__cost", F.lit(0))).withColumn("status", status)
    plan = Window.partitionBy("plan")  # a plan has some hundred items
    spent = F.sum("cost").over(plan) >= cap if cap > 0 else F.lit(False)
    s = s.withColumn("status", F.when(timed & spent & (F.col("status") == "pending"), "skipped").otherwise(F.col("status")))
    free = slots - F.count_if(F.col("status") == "claimed").over(plan)
    due = (F.col("status") == "pending") & timed & (F.col("eta") <= F.col("__now"))
    s = s.withColumns({"__free": free, "__due": F.coalesce(due, F.lit(False))})
    s = s.withColumn("__nth", F.row_number().over(Window.partitionBy("plan", "__due").orderBy("planned_order", "item")))
    takes = F.col("__due") & (F.col("__nth") <= F.col("__free"))
    ends = F.timestamp_seconds(F.unix_timestamp("__now") + lease_seconds)
    s = s.withColumns(
        {
            "attempts": F.when(takes, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "claimed_until": F.when(takes, ends).when(F.col("status") == "claimed", F.col("claimed_until")),
            "finished_at": F.coalesce("finished_at", F.when(F.col("status").isin(FINAL), F.col("__now"))),
            "status": F.when(takes, "claimed").otherwise(F.col("status")),
        }
    )
    return s.select(*(c.split()[0] for c in STATE.split(", ")))


def verdict(state: DataFrame) -> DataFrame:
    """plan, verdict and counts: open while an item is not final; then success, partial_success, failed, or skipped."""
    counts = state.groupBy("plan").agg(F.count("*").alias("items"), *(F.count_if(F.col("status") == x).alias(x) for x in FINAL))
    done = F.col("success") + F.col("failed") + F.col("skipped")
    out = F.when(done < F.col("items"), "open").when(F.col("success") == F.col("items"), "success").when(F.col("success") > 0, "partial_success").when(F.col("failed") > 0, "failed").otherwise("skipped")
    return counts.select("plan", "items", *FINAL, out.alias("verdict"))


def state_of(spark: SparkSession, folder: str, without: str | None = None) -> DataFrame:
    return sink.current(spark, folder, "plan", STATE, without)


def begin(first: DataFrame, folder: str) -> None:
    """Publish the first state, if the plan has none yet."""
    run = "000000000000-begin"
    if sink.manifest(first.sparkSession, folder).where(F.col("run") == run).isEmpty():
        sink.stage(first, folder, run, "plan")
        sink.commit(first.sparkSession, folder, run, "plan")


def work(reports: DataFrame, folder: str, checkpoint: str, **limits: int) -> DataFrame:
    """Tick through a stream of reports; returns the last state."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, f"{batch_id + 1:012d}-tick"
        sink.stage(tick(state_of(spark, folder, without=run), batch, **limits), folder, run, "plan")
        sink.commit(spark, folder, run, "plan")

    run_once(reports, one, checkpoint)
    return state_of(reports.sparkSession, folder)
