"""Which rows of which slices may be compared: two rounds of least sizes, with a ledger of what went in which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archetypes import BROAD_COVERAGE, LEAST_FAMILY, LEAST_PLAYERS
from .steps import stored

FAMILIES = ["DEF", "MID", "FWD"]


def _entry(df: DataFrame, nth: int, reason: str) -> DataFrame:
    """Rows of the ledger; columns that `df` lacks are null."""
    have = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    return df.select(F.lit(nth).alias("round"), "slice", have("family", "string"), have("entity", "string"), F.lit(reason).alias("reason"), have("n", "long"), have("low_features", "array<string>"))


def _split(rows: DataFrame, keys: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups with `least` rows or more, keys and n of the others)."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return rows.join(counted.where(F.col("n") >= least).select(*keys), keys, "left_semi"), counted.where(F.col("n") < least)


def eligible(rows: DataFrame, least_minutes: DataFrame, features: list[str], required: list[str], sourced: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, ledger).

    rows: slice, entity, family, minutes, has_source, features.  least_minutes: slice and least.
    Round 1 takes rows of the three families with enough minutes and drops slices of fewer than LEAST_PLAYERS.
    Round 2 drops rows without the source, then again slices that are too small, then families of fewer than
    LEAST_FAMILY rows in a slice, then families that lack a required feature in BROAD_COVERAGE of their rows;
    features in `sourced` count as absent without the source.
    """
    gone = []
    asked = rows.join(least_minutes, "slice").where(F.col("family").isin(FAMILIES) & (F.col("minutes") >= F.col("least"))).drop("least")
    kept, small = _split(stored(asked), ["slice"], LEAST_PLAYERS)
    gone.append(_entry(small, 1, "insufficient_eligible_players"))
    source = F.coalesce("has_source", F.lit(False))
    gone.append(_entry(kept.where(~source), 2, "missing_source"))
    kept, small = _split(stored(kept.where(source)), ["slice"], LEAST_PLAYERS)
    gone.append(_entry(small, 2, "insufficient_eligible_players_after_source_gate"))
    kept = kept.withColumns({f: F.when(source, F.col(f)) for f in sourced})
    kept, small = _split(stored(kept), ["slice", "family"], LEAST_FAMILY)
    gone.append(_entry(small, 2, "insufficient_position_family_players"))
    share = kept.groupBy("slice", "family").agg(F.count("*").alias("n"), *(F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in required))
    low = F.array_compact(F.array(*(F.when(F.col(f) < BROAD_COVERAGE, F.lit(f)) for f in required)))
    thin = stored(share.select("slice", "family", "n", low.alias("low_features")).where(F.size("low_features") > 0))
    gone.append(_entry(thin.drop("n"), 2, "low_broad_profile_coverage"))
    accepted = kept.join(thin.select("slice", "family"), ["slice", "family"], "left_anti").select("slice", "entity", "family", "minutes", *features)
    out = gone[0]
    for g in gone[1:]:
        out = out.unionByName(g)
    return accepted, out
