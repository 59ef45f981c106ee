"""Readers and writers for headered CSV, JSON documents and sliced tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, MapType, StringType, StructType, VariantType

from ..functions.text import first_known


def read_register(spark: SparkSession, path: str, kind: str, id_column: str, provider_columns: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """Rows of one kind from a headered CSV that have an id and a provider key; overrides win, column by column."""
    raw = spark.read.csv(path, header=True)
    clean = raw.select(*(first_known(F.col(c)).alias(c) for c in raw.columns))
    rows = clean.where((F.col("type") == kind) & F.col(id_column).isNotNull())
    if overrides is not None:
        shared = [c for c in overrides.columns if c in rows.columns and c != id_column]
        o = overrides.select(F.col(id_column), *(F.col(c).alias(f"__{c}") for c in shared))
        rows = rows.join(o, id_column, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in rows.columns))
    return rows.where(F.coalesce(*provider_columns).isNotNull())


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents, one for each line, at any depth below the path."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)


def merged_pages(pages: DataFrame, keys: list[str], number: str, first: list[str], maps: list[str]) -> DataFrame:
    """Pages of one entity as a row: the first page's value for `first`, the last page's for each map key."""
    ends = pages.groupBy(*keys).agg(*(F.min_by(c, number).alias(c) for c in first))
    for m in maps:
        entries = pages.select(*keys, number, F.explode(m).alias("__key", "__value")).groupBy(*keys, "__key").agg(F.max_by("__value", number).alias("__value"))
        ends = ends.join(entries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__key", "__value")))).alias(m)), keys, "left")
    return ends


def pick(stats: Column, group: str, key: str, fallback: str) -> Column:
    """stats["group:key"], else stats["fallback:key"]."""
    return F.coalesce(stats[f"{group}:{key}"], stats[f"{fallback}:{key}"])


def write_slices(df: DataFrame, path: str, slice_key: str) -> None:
    """Replace the slices that `df` holds and leave all others; one shuffle, so a slice is not many small files."""
    df.repartition(slice_key, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slice_key).parquet(path)


@pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON documents in their one form: keys in order at every depth, no blanks, letters as they are; null for what is no JSON or holds NaN."""

    def one(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, allow_nan=False, separators=(",", ":"), sort_keys=True)
        except ValueError:
            return None

    known = {t: one(t) for t in texts.dropna().unique()}
    return texts.map(known).astype(object).where(texts.notna(), None)


def canonical(df: DataFrame, columns: list[str]) -> Column:
    """A row's columns as one JSON text that does not hang on the order of columns, of fields or of map entries.

    Flat columns are put in order in the JVM; nested ones go through canonical_json().
    """
    row = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    nested = any(isinstance(df.schema[c].dataType, (StructType, MapType, ArrayType, VariantType)) for c in columns)
    return canonical_json(row) if nested else row


def content_key(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of canonical()."""
    return F.sha2(canonical(df, list(columns)), 256)


def working_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; only a local session may do without that setting."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}"
    return f"{top.rstrip('/')}/millrace-files/{uuid.uuid4().hex}"


def write_documents(rows: DataFrame, path: str, rows_a_file: int = 20_000) -> None:
    """Rows as JSON documents, one for each row, in files of so many rows at most."""
    rows.write.option("maxRecordsPerFile", rows_a_file).json(path)


# What a schedule says of a match, and the status it stands for.
STATUSES = {
    "completed": ["aet", "completed", "finished", "ft", "pen"],
    "live": ["1h", "2h", "ht", "in progress", "inprogress", "live"],
    "postponed": ["abandoned", "canceled", "cancelled", "postponed"],
    "scheduled": ["fixture", "not started", "notstarted", "scheduled"],
}


def whole_number(cell: Column) -> Column:
    """A number's whole part ("5.0" is 5); null for what is none."""
    return cell.cast("string").try_cast("double").try_cast("long")


def schedule(rows: DataFrame) -> DataFrame:
    """match_id, status, kickoff, home_score, away_score of schedule rows: id, status, start, and if there status_code, is_result, home_score, away_score, scores (home, away).

    A result is completed whatever its status says; without a known status a match with both scores is completed,
    any other unknown. Bad numbers and times are null.
    """
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    home, away = (F.coalesce(whole_number(have(f"{side}_score", "string")), whole_number(F.get(have("scores", "array<string>"), F.lit(i)))) for i, side in enumerate(("home", "away")))
    said = F.lower(F.trim(F.coalesce(have("status_code", "string"), F.col("status"), F.lit(""))))
    status = F.when(F.coalesce(have("is_result", "boolean"), F.lit(False)), "completed")
    for name, words in STATUSES.items():
        status = status.when(said.isin(words), name)
    status = status.when(home.isNotNull() & away.isNotNull(), "completed").otherwise("unknown")
    return rows.select(whole_number(F.col("id")).alias("match_id"), status.alias("status"), F.col("start").try_cast("timestamp").alias("kickoff"), home.alias("home_score"), away.alias("away_score"))


def club_ids(clubs: Column, ids: Column) -> Column:
    """Ids of the clubs in a comma list, in its order, by a map from name to id; names without one are left out."""
    names = F.transform(F.split(clubs, ","), lambda x: F.trim(x))
    return F.filter(F.transform(names, lambda x: F.try_element_at(ids, x)), lambda x: x.isNotNull())


def unwrapped(text: Column, schema: str, version: int) -> Column:
    """The payload of a JSON wrapper {version, payload}; null for another version, without one, or for what is no JSON."""
    whole = F.from_json(text, f"version int, payload {schema}", {"mode": "PERMISSIVE"})
    return F.when(whole["version"] == version, whole["payload"])
