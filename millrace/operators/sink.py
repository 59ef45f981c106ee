"""Slices published behind a gate: staged, listed by a marker, and switched by it.

A published table is a folder with `data/run=<run>/` and `manifest/run=<run>/`.  A run writes its rows first and then
one manifest file that says which slices of it count.  That file appears in one step, so a reader sees a slice as it was
or as it is; a run that dies before leaves data that nothing lists, and the same run done again writes over it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import gate

MANIFEST = "slice string, seq long, n long, run string"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def manifest(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """slice, seq, n, run of all that was ever committed."""
    path = f"{root}/manifest"
    rows = spark.read.schema(MANIFEST).parquet(path) if _there(spark, path) else spark.createDataFrame([], MANIFEST)
    return rows.where(F.col("run") != without) if without is not None else rows


def stage(rows: DataFrame, root: str, run: str, slice_key: str) -> None:
    """Write a run's rows where nothing reads them yet; rows of one slice are a few files."""
    dealt = rows.repartition(slice_key, F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
    dealt.write.mode("overwrite").parquet(f"{root}/data/run={run}")


def commit(spark: SparkSession, root: str, run: str, slice_key: str, passed: DataFrame | None = None) -> None:
    """List the staged slices of a run, or those of them in `passed`, as the current ones.

    A run keeps its place: done again, it does not go ahead of later ones.
    """
    staged = spark.read.parquet(f"{root}/data/run={run}").groupBy(F.col(slice_key).cast("string").alias("slice")).agg(F.count("*").alias("n"))
    if passed is not None:
        staged = staged.join(passed.select(F.col(slice_key).cast("string").alias("slice")).distinct(), "slice", "left_semi")
    place = manifest(spark, root).agg(F.max(F.when(F.col("run") == run, F.col("seq"))).alias("own"), F.max("seq").alias("last")).first()
    seq = place["own"] if place["own"] is not None else (place["last"] or 0) + 1
    # one row a slice, in one file
    staged.select("slice", F.lit(seq).cast("long").alias("seq"), "n").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/run={run}")


def current(spark: SparkSession, root: str, slice_key: str, schema: str, without: str | None = None) -> DataFrame:
    """The rows of each slice by the last run that listed it; `without` leaves a run out, as if it had not been."""
    last = manifest(spark, root, without).groupBy(F.col("slice").alias("__slice")).agg(F.max_by("run", "seq").alias("run"))
    if not _there(spark, f"{root}/data"):
        return spark.createDataFrame([], schema)
    data = spark.read.schema(f"{schema}, run string").parquet(f"{root}/data").withColumn("__slice", F.col(slice_key).cast("string"))
    return data.join(last, ["__slice", "run"], "left_semi").drop("__slice", "run")


def publish(
    rows: DataFrame, root: str, run: str, slice_key: str, *, measures: dict[str, Column], checks: dict[str, Column], allowed: DataFrame | None = None, restricted: Column | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Restrict, gate, stage and switch; returns the gate's report (slice, measures, failed, passed).

    allowed: slice and id columns of the rows that slices under `restricted` may hold.  The gate sees what is left;
    slices that fail are not staged, and their current rows stay.  `resolve` adds ids to the rows that go on.
    """
    if allowed is not None:
        on = allowed.columns
        held = rows.join(allowed.distinct(), on, "left_semi")
        rows = rows.where(~F.coalesce(restricted, F.lit(False))).unionByName(held.where(restricted)) if restricted is not None else held
    report = gate(rows, [slice_key], measures, checks)
    good = rows.join(report.where("passed").select(slice_key), slice_key, "left_semi")
    stage(resolve(good) if resolve else good, root, run, slice_key)
    commit(rows.sparkSession, root, run, slice_key)
    return report

