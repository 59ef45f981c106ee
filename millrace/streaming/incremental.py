"""Aggregates of entities kept up to date batch by batch, by computing anew only the entities that a batch touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sink
from .events import affected, run_once

Profile = Callable[[DataFrame], DataFrame]


def bucket_of(entity: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(entity).cast("long")), F.lit(buckets)).cast("int")


def apply(batch: DataFrame, batch_id: int, folder: str, entity: str, profile: Profile, schema: str, buckets: int = 32) -> None:
    """Add a batch's events and publish the buckets of the entities it touches.

    Events lie in folders by bucket and batch, so a batch that comes again writes over itself and only the touched buckets
    are read.  An entity's row is made from all its events, never added to, so a batch applied twice changes nothing.
    The buckets are switched by one marker (operators/sink.py).
    """
    spark = batch.sparkSession
    run = f"{batch_id:012d}"
    given = batch.where(F.col(entity).isNotNull()).withColumns({"bucket": bucket_of(entity, buckets), "batch": F.lit(run)})
    given.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{folder}/events")
    touched = affected(batch, [entity]).withColumn("bucket", bucket_of("entity", buckets))
    touched.write.mode("overwrite").parquet(f"{folder}/touched/{run}")
    touched = spark.read.parquet(f"{folder}/touched/{run}")
    hit = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most `buckets` numbers
    events = spark.read.schema(f"{_ddl(batch)}, bucket int, batch string").parquet(f"{folder}/events").where(F.col("bucket").isin(hit) & (F.col("batch") <= run)).drop("bucket", "batch")
    fresh = profile(events.join(touched.select(F.col("entity").alias(entity)), entity, "left_semi")).withColumn("bucket", bucket_of(entity, buckets))
    old = sink.current(spark, f"{folder}/profiles", "bucket", f"{schema}, bucket int", without=run).where(F.col("bucket").isin(hit))
    kept = old.join(touched.select(F.col("entity").alias(entity)), entity, "left_anti")
    sink.stage(kept.unionByName(fresh.select(*kept.columns)), f"{folder}/profiles", run, "bucket")
    sink.commit(spark, f"{folder}/profiles", run, "bucket")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def keep(stream: DataFrame, folder: str, entity: str, profile: Profile, schema: str, buckets: int = 32) -> DataFrame:
    """Bring the profiles below `folder` up to date with all that the stream holds, and return them."""
    run_once(stream, lambda batch, batch_id: apply(batch, batch_id, folder, entity, profile, schema, buckets), f"{folder}/checkpoint")
    return profiles(stream.sparkSession, folder, schema)


def profiles(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return sink.current(spark, f"{folder}/profiles", "bucket", f"{schema}, bucket int").drop("bucket")


def differences(kept: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that one of two tables of profiles has and the other has not, with the side that has them."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    rebuilt = rebuilt.select(*kept.columns)
    return only(kept, rebuilt, "kept").unionByName(only(rebuilt, kept, "rebuilt"))
