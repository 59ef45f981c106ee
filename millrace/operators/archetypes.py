"""Feature weights, profiles and labels of player types, and places of rows between landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import join_same, quantiles
from .similarity import nearest

# How far positions lie apart, least sizes and shares, and the names of types.
MULTIPLIERS = {("FWD", "FWD"): 1.00, ("MID", "MID"): 1.00, ("DEF", "DEF"): 1.00, ("FWD", "MID"): 1.08, ("MID", "FWD"): 1.08, ("MID", "DEF"): 1.10, ("DEF", "MID"): 1.10, ("FWD", "DEF"): 1.18, ("DEF", "FWD"): 1.18}
OTHER_MULTIPLIER = 1.25
GROUP_WEIGHTS = {"attacking_threat": 0.20, "creation": 0.20, "possession_buildup": 0.22, "carrying": 0.12, "defending_duels": 0.22, "discipline_errors": 0.04}
FLAG_SHARE = 0.25
CORE_COVERAGE, BROAD_COVERAGE = 0.8, 0.6
LEAST_BROAD_FEATURES, LEAST_PLAYERS, LEAST_FAMILY, LEAST_CLUSTER = 8, 10, 3, 12
#: by position: (leading group or none, one of these features or none, label), the first that fits; the last label stands alone
LABELS = {
    "FWD": [
        ("creation", ["accurate_crosses_per_90", "key_passes_per_90"], "Wide Creator"), ("carrying", None, "Direct Runner"), ("defending_duels", None, "Pressing Forward"),
        ("possession_buildup", None, "Linking Forward"), (None, ["shots_per_90", "npxg_per_90"], "Shot-Heavy Forward"), (None, None, "Box Threat"),
    ],
    "MID": [
        ("defending_duels", None, "Ball-Winning Midfielder"), ("possession_buildup", ["completed_passes_per_90", "accurate_long_balls_per_90"], "Deep Progressor"), ("possession_buildup", None, "Tempo Controller"),
        ("attacking_threat", None, "Final-Third Midfielder"), ("carrying", None, "Box-to-Box Midfielder"), (None, None, "Advanced Creator"),
    ],
    "DEF": [
        ("creation", ["accurate_crosses_per_90", "key_passes_per_90"], "Crossing Fullback"), ("creation", None, "Attacking Fullback"), ("carrying", None, "Attacking Fullback"), ("possession_buildup", None, "Build-Up Defender"),
        (None, ["aerial_duels_won_per_90"], "Aerial Defender"), (None, ["ball_recoveries_per_90"], "Recovery Defender"), (None, None, "Defensive Stopper"),
    ],
}
NO_LABEL = "Outfielder"


def multiplier(a: Column, b: Column) -> Column:
    """How much further apart two positions make two rows."""
    out = F.lit(OTHER_MULTIPLIER)
    for (x, y), m in MULTIPLIERS.items():
        out = F.when((a == x) & (b == y), m).otherwise(out)
    return out


def context(a: Column, b: Column) -> Column:
    """same_position, unknown_position, cross_position or adjacent_position."""
    far = F.array_sort(F.array(a, b)) == F.array(F.lit("DEF"), F.lit("FWD"))
    return F.when(a == b, "same_position").when((a == "UNK") | (b == "UNK"), "unknown_position").when(far, "cross_position").otherwise("adjacent_position")


def feature_weights(groups: dict[str, str], group_weights: dict[str, float] = GROUP_WEIGHTS, flags: list[str] = []) -> dict[str, float]:  # noqa: B006
    """Each group's weight shared by its features; a flag of missing values has FLAG_SHARE of its feature's; all add up to 1."""
    size: dict[str, int] = {}
    for g in groups.values():
        size[g] = size.get(g, 0) + 1
    base = {f: group_weights.get(g, 0.0) / size[g] for f, g in groups.items() if group_weights.get(g, 0.0) > 0}
    total = sum(base.values()) or 1.0
    base = {f: w / total for f, w in base.items()}
    every = base | {f"{f}__missing": base.get(f, 0.0) * FLAG_SHARE for f in flags}
    total = sum(every.values()) or 1.0
    return {f: w / total for f, w in every.items()}


def profile(covered: DataFrame, required: list[str], broad: list[str]) -> DataFrame:
    """One row: profile (full, broad or none) and its features; covered: metric, covered.

    Full needs every required feature covered by CORE_COVERAGE; broad takes those features that are, if they are enough.
    """
    fits = F.col("covered") >= CORE_COVERAGE
    counts = covered.agg(
        F.count_if(fits & F.col("metric").isin(*required)).alias("n"),
        F.array_sort(F.collect_list(F.when(fits & F.col("metric").isin(*broad), F.col("metric")))).alias("some"),
    )
    full, enough = F.col("n") == len(set(required)), F.size("some") >= LEAST_BROAD_FEATURES
    kind = F.when(full, "full").when(enough, "broad").otherwise("none")
    features = F.when(full, F.array_sort(F.array(*map(F.lit, sorted(required))))).when(enough, F.col("some")).otherwise(F.array().cast("array<string>"))
    return counts.select(kind.alias("profile"), features.alias("features"))


def landmarks(rows: DataFrame, key: str, n: int, seed: str = "landmarks") -> DataFrame:
    """A draw of n rows without replacement that hangs on keys and seed only."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def interpolated(rows: DataFrame, marks: DataFrame, key: str, vector: str, point: str, k: int = 8) -> DataFrame:
    """key, point of every row: a landmark keeps its own, others lie between their k nearest (L1), by inverse distance.

    marks: key, vector and point (an array) of the landmarks.
    """
    own = marks.select(key, point)
    rest = rows.join(own.select(key), key, "left_anti")
    near = nearest(rest, marks, key, vector, k).join(own.select(F.col(key).alias("neighbour"), F.col(point).alias("p")), "neighbour")
    parts = near.withColumn("w", 1.0 / F.greatest("distance", F.lit(1e-6))).select("query", "rank", "w", F.posexplode("p").alias("axis", "v"))
    # added up by rank, so that sums do not hang on the order of rows
    ordered = F.array_sort(F.collect_list(F.struct("rank", (F.col("w") * F.col("v")).alias("wv"), "w")))
    total = lambda field: F.aggregate("terms", F.lit(0.0), lambda s, x: s + x[field])
    axes = parts.groupBy("query", "axis").agg(ordered.alias("terms")).select("query", "axis", (total("wv") / total("w")).alias("v"))
    placed = axes.groupBy(F.col("query").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "v"))), lambda x: x["v"]).alias(point))
    return own.unionByName(placed)


def label(position: Column, leading: Column, features: Column) -> Column:
    """The name of a type: by its position, leading group and top features."""
    out = F.lit(NO_LABEL)
    for at, rules in LABELS.items():
        named = F.lit(rules[-1][2])
        for group, some, name in reversed(rules[:-1]):
            fits = F.lit(True) if group is None else leading == group
            fits = fits & F.arrays_overlap(features, F.array(*map(F.lit, some))) if some else fits
            named = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(named)
        out = F.when(position == at, named).otherwise(out)
    return out


def signatures(rows: DataFrame, keys: list[str], groups: dict[str, str], top: int = 6) -> DataFrame:
    """keys, leading (group with the largest mean) and features (the largest means) of long rows (keys, metric, value)."""
    means = rows.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"))
    named = means.join(F.broadcast(rows.sparkSession.createDataFrame(list(groups.items()), "metric string, group string")), "metric")  # one row a feature
    by_group = named.groupBy(*keys, "group").agg(F.avg("mean").alias("mean")).groupBy(*keys).agg(F.max_by("group", F.struct("mean", "group")).alias("leading"))
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), "metric"))), lambda x: x["metric"]), 1, top)
    return join_same(by_group, named.groupBy(*keys).agg(first.alias("features")), keys)


def confidence(members: DataFrame, group: list[str]) -> DataFrame:
    """Adds confidence, from d_primary and d_secondary and the median distance of the rows to each primary centre.

    members: group, primary, d_primary, d_secondary, and all_d: distances to every centre as a map from its label.
    """
    spread = members.select(*group, F.explode("all_d").alias("centre", "d"))
    middle = quantiles(spread, [*group, "centre"], "d", {"spread": 0.5})
    joined = join_same(members, middle.withColumnRenamed("centre", "primary"), [*group, "primary"], "left")
    width = F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread"))
    sure = 1.0 - F.col("d_primary") / (F.col("d_secondary") + width + 1e-9)
    return joined.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).drop("spread")


def cluster_sizes(n: int, position: str) -> list[int]:
    """Numbers of clusters to try for n rows; none where the family is too small."""
    most = 6 if position == "MID" else 5
    return [k for k in range(3, most + 1) if n >= 2 * LEAST_CLUSTER and n // k >= LEAST_CLUSTER]


def explanation(deltas: DataFrame, keys: list[str], alike: int = 3, unlike: int = 2, top: int = 8) -> DataFrame:
    """keys, shared (groups that differ least), different (most) and features (largest weighted deltas).

    deltas: keys, metric, group, delta (absolute), weight.  Ties go by name.
    """
    by_group = deltas.groupBy(*keys, "group").agg((F.sum(F.col("delta") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0))).alias("d")).withColumn("d", F.round("d", 12))
    names = lambda array, n: F.slice(F.transform(array, lambda x: x["group"]), 1, n)
    sides = by_group.groupBy(*keys).agg(
        names(F.array_sort(F.collect_list(F.struct("d", "group"))), alike).alias("shared"),
        names(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "group"))), unlike).alias("different"),
    )
    heavy = F.round(-F.col("delta") * F.col("weight"), 12).alias("w")
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct(heavy, "metric"))), lambda x: x["metric"]), 1, top)
    return join_same(sides, deltas.groupBy(*keys).agg(first.alias("features")), keys)
