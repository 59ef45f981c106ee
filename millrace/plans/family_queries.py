"""Types of vectors by family, their representatives, and places between landmarks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archetypes, families
from ..operators.steps import stored
from .registry import query, read


def _rows(spark: SparkSession, d: str) -> DataFrame:
    family = F.element_at(F.array(*map(F.lit, ["DEF", "MID", "FWD"])), (F.col("label") % 3 + 1).cast("int"))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), family.alias("family"), F.col("embedding").cast("array<double>").alias("v"))


@query()
def family_types(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's type within its family by its first three entries, with the second nearest, the margin and how sure it is: ten starts for every number of clusters, chosen by silhouette."""
    rows = _rows(spark, d).withColumn("v", F.slice("v", 1, 3))  # all dimensions of such vectors together show no types
    rows = stored(families.rooted(rows, "family", "v", {"DEF": [1.0, 2.0, 3.0], "MID": [3.0, 1.0, 2.0], "FWD": [1.0, 1.0, 1.0]}))
    found = {f: m.centres for f, m in families.chosen(rows).items() if m is not None}
    told = stored(families.members(rows, found))
    return archetypes.confidence(told, ["family"]).select(F.col("key").alias("vec_id"), "family", "primary", "secondary", F.round(F.col("d_secondary") - F.col("d_primary"), 6).alias("margin"), F.round("confidence", 6).alias("confidence"))


@query("""with v as (select vec_id, ['DEF', 'MID', 'FWD'][label % 3 + 1] as family, list_transform(embedding, lambda x: x::double) as e from embeddings), c as (select family, (row_number() over (partition by family order by vec_id) - 1)::varchar as "primary", e from v qualify row_number() over (partition by family order by vec_id) <= 3),
    d as (select v.family, vec_id, c."primary", sqrt(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d from v join c using (family)), n as (select * from d qualify row_number() over (partition by vec_id order by d, "primary") = 1)
    select family, "primary", row_number() over (partition by family, "primary" order by d, vec_id) as rank, vec_id as key, round(d, 6) as d_primary from n qualify rank <= 5""")
def type_representatives(spark: SparkSession, d: str) -> DataFrame:
    """The five members nearest to each of given centres, the first three vectors of each family."""
    rows = _rows(spark, d)
    ends = {f: rows.where(F.col("family") == f).orderBy("key").limit(3).select("v").toPandas()["v"] for f in ("DEF", "MID", "FWD")}
    centres = {f: np.stack(v.to_numpy()) for f, v in ends.items() if len(v)}
    return families.representatives(families.members(rows, centres)).withColumn("d_primary", F.round("d_primary", 6))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), m as (select * from v where vec_id % 8 = 0),
    d as (select v.vec_id, m.vec_id as mark, m.e[1:3] as p, list_sum(list_transform(list_zip(v.e, m.e), lambda z: abs(z[1] - z[2]))) as d from v, m where v.vec_id % 8 > 0),
    n as (select *, 1 / greatest(d, 1e-6::double) as w from d qualify row_number() over (partition by vec_id order by d, mark) <= 8)
    select vec_id, round(sum(w * p[1]) / sum(w), 6) as a, round(sum(w * p[2]) / sum(w), 6) as b, round(sum(w * p[3]) / sum(w), 6) as c from n group by 1 union all select vec_id, round(e[1], 6), round(e[2], 6), round(e[3], 6) from m""")
def landmark_places(spark: SparkSession, d: str) -> DataFrame:
    """All vectors placed between their eight nearest landmarks, which have given places."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    placed = families.between(v, v.where("vec_id % 8 = 0").withColumn("point", F.slice("e", 1, 3)), "vec_id", "e", "point")
    return placed.select("vec_id", *(F.round(F.col("point")[i], 6).alias(n) for i, n in enumerate("abc")))


@query()
def landmark_projection(spark: SparkSession, d: str) -> DataFrame:
    """All vectors in three dimensions, by way of 64 landmarks as there are more than 200."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return families.projection(v, "vec_id", "embedding", full_rows=200, landmarks=64)[0]
