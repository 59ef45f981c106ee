"""What looks wrong when a slice's teams follow those of the season before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes and their severity.
SEVERITY = {
    "expected_team_count_mismatch": "error", "unmatched_canonical_team": "error", "provider_identity_requires_review": "review", "duplicate_provider_team_id": "error", "duplicate_canonical_team": "error",
    "duplicate_canonical_team_name": "error", "unknown_provider_team_id": "review", "provider_name_change": "review", "provider_id_change": "review", "multiple_domestic_competitions": "error",
}


def plain_name(name: Column) -> Column:
    """Letters and digits in lower case, null if none are left."""
    return F.nullif(F.regexp_replace(F.lower(name), "[^0-9a-z]+", ""), F.lit(""))


def anomalies(entries: DataFrame, previous: DataFrame, mapped: DataFrame, review: DataFrame, slices: DataFrame, memberships: DataFrame) -> DataFrame:
    """slice, code, severity, subject: one row for each finding.

    entries: slice, provider_id, name, team (canonical, may be null); previous: the same columns for the season before,
    under the present slice; mapped: provider_id; review: slice, provider_id; slices: slice, expected;
    memberships: slice, team, country, competition of all current domestic rows of the slices' seasons.
    """
    e = entries.withColumn("plain", plain_name(F.col("name")))
    p = previous.select("slice", F.col("provider_id").alias("old_id"), plain_name(F.col("name")).alias("old_name"), F.col("team").alias("old_team"))

    def found(code: str, rows: DataFrame, subject: Column | str) -> DataFrame:
        return rows.select("slice", F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"))

    def several(code: str, key: str, members: Column) -> DataFrame:
        return found(code, e.where(F.col(key).isNotNull()).groupBy("slice", key).agg(members.alias("n")).where("n > 1"), key)

    counts = slices.join(e.groupBy("slice").agg(F.count("*").alias("n")), "slice", "left").where(F.coalesce("n", F.lit(0)) != F.col("expected"))
    by_id = e.join(p.select("slice", F.col("old_id").alias("provider_id"), F.col("old_name").alias("name_before")), ["slice", "provider_id"], "left").withColumn("had_id", F.col("name_before").isNotNull())
    renamed = by_id.where(F.col("plain") != F.col("name_before"))
    known = p.where("old_id is not null").select("slice", F.col("old_id").alias("provider_id")).distinct()
    new = e.join(known, ["slice", "provider_id"], "left_anti")
    by_team = p.where("old_team is not null").groupBy("slice", F.col("old_team").alias("team")).agg(F.max("old_id").alias("id_by_team"))
    by_name = p.where("old_name is not null").groupBy("slice", F.col("old_name").alias("plain")).agg(F.max("old_id").alias("id_by_name"))
    moved = new.join(by_team, ["slice", "team"], "left").join(by_name, ["slice", "plain"], "left").where(~F.coalesce("id_by_team", "id_by_name").eqNullSafe(F.col("provider_id")) & F.coalesce("id_by_team", "id_by_name").isNotNull())
    countries = memberships.where("country > ''").groupBy("slice", "team", F.lower("country").alias("country")).agg(F.countDistinct("competition").alias("n")).where("n > 1")
    parts = [
        found("expected_team_count_mismatch", counts, F.coalesce("n", F.lit(0))),
        found("unmatched_canonical_team", e.where("team is null"), "provider_id"),
        found("provider_identity_requires_review", e.join(review.distinct(), ["slice", "provider_id"], "left_semi"), "provider_id"),
        several("duplicate_provider_team_id", "provider_id", F.count("*")),
        several("duplicate_canonical_team", "team", F.countDistinct("provider_id")),
        found("duplicate_canonical_team_name", e.where("team is not null and plain is not null").groupBy("slice", "plain").agg(F.countDistinct("team").alias("n")).where("n > 1"), "plain"),
        found("unknown_provider_team_id", e.where("provider_id is not null").join(mapped.distinct(), "provider_id", "left_anti"), "provider_id"),
        found("provider_name_change", renamed, "provider_id"),
        found("provider_id_change", moved, "provider_id"),
        found("multiple_domestic_competitions", countries, "team"),
    ]
    return reduce(DataFrame.unionByName, parts)


def ready(slices: DataFrame, found: DataFrame) -> DataFrame:
    """slice, ready: a slice is ready only without any finding, reviews included."""
    some = found.select("slice").distinct().withColumn("__some", F.lit(True))
    return slices.join(some, "slice", "left").select("slice", F.col("__some").isNull().alias("ready"))


def repointed(rows: DataFrame, merged: DataFrame, columns: list[str]) -> DataFrame:
    """rows with ids replaced where `merged` (old, new) names them; chains of merges must be settled before."""
    out = rows
    for c in columns:
        m = merged.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        out = out.join(m, F.col(c) == F.col("__old"), "left").withColumn(c, F.coalesce("__new", c)).drop("__old", "__new")
    return out
