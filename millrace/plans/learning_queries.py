"""Neighbours, scaling, centroids, clusters, projections and fits over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import distribution, ranking, regression, similarity
from ..operators.steps import stored
from .registry import query, read

_KNN = """with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
    d as (select q.vec_id as query, p.vec_id as neighbour, list_sum(list_transform(list_zip(q.e, p.e), lambda z: abs(z[1] - z[2]))) * case when q.label = p.label then 1 else 1.25::double end as distance
          from v q join v p on q.vec_id <> p.vec_id where q.vec_id % 20 = 0),
    r as (select query, neighbour, round(distance, 6) as distance, row_number() over (partition by query order by round(distance, 6), neighbour) as rank from d qualify rank <= 15)"""


def _knn(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return similarity.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 15, group="label", digits=6)


@query(_KNN + " select query, neighbour, distance, rank from r")
def knn_weighted_l1_top15(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d)


@query(_KNN + """, s as (select 4 * median(distance) as scale from r where rank <= 5), n as (select count(*) - 1 as n from embeddings)
    select query, neighbour, rank, round(least(c, a), 6) as score, round(a, 6) < round(c - 10, 6) as weak from (select *, 100.0::double * (1 - (rank - 1) / (n.n - 1)) as c, 100.0::double * exp(-distance / s.scale) as a from r, s, n)""")
def similarity_scores(spark: SparkSession, d: str) -> DataFrame:
    near = stored(_knn(spark, d))  # read twice, and a search for five would not be shared with one for fifteen
    scale = ranking.quantiles(near.where("rank <= 5"), [], "distance", {"middle": 0.5}).select((F.col("middle") * 4).alias("scale"))
    n = read(spark, d, "embeddings").agg((F.count("*") - 1).alias("candidates"))
    out = similarity.scored(near.crossJoin(F.broadcast(scale)).crossJoin(F.broadcast(n)), F.col("candidates"), F.col("scale"))  # one row each
    return out.select("query", "neighbour", "rank", F.round("score", 6).alias("score"), (F.round("absolute_score", 6) < F.round(F.col("candidate_score") - 10, 6)).alias("weak"))


@query("""with s as (select p_brand, median(p_retailprice) as m, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) as iqr, stddev_pop(p_retailprice) as dev from (select p_brand, case when p_size % 7 > 0 then p_retailprice end as p_retailprice from part) group by 1)
    select p_partkey, round(greatest(-5, least(5, (coalesce(case when p_size % 7 > 0 then p_retailprice end, m) - m) / case when iqr > 0 then iqr when dev > 0 then dev else 1 end)), 6) as scaled from part join s using (p_brand)""")
def robust_scale_impute(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice")).alias("price"))
    return distribution.robust_scaled(rows, ["p_brand"], "price", "scaled").select("p_partkey", F.round("scaled", 6).alias("scaled"))


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), c as (select label, e from v qualify row_number() over (partition by label order by vec_id) = 1),
    d as (select vec_id, c.label, list_sum(list_transform(list_zip(v.e, c.e), lambda z: abs(z[1] - z[2]))) as d from v, c), r as (select *, row_number() over (partition by vec_id order by d, label) as n from d)
    select a.vec_id, a.label as "primary", b.label as secondary, round(b.d - a.d, 6) as margin from r a join r b on a.vec_id = b.vec_id and a.n = 1 and b.n = 2""")
def nearest_two_centroids(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    first = Window.partitionBy("label").orderBy("vec_id")
    c = v.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return similarity.two_nearest(v, c, "vec_id", "e", "label", similarity.weighted_l1).select("vec_id", "primary", "secondary", F.round("margin", 6).alias("margin"))


@query()
def kmeans_archetypes(spark: SparkSession, d: str) -> DataFrame:
    return similarity.clustered(read(spark, d, "embeddings"), "vec_id", "embedding", range(3, 7), starts=10, least=6)


@query()
def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    return similarity.projected(read(spark, d, "embeddings"), "vec_id", "embedding")


@query("""select l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(corr(l_quantity, l_extendedprice), 9) as r, round(regr_r2(l_extendedprice, l_quantity), 9) as r2 from lineitem group by 1, 2""")
def ols_trend(spark: SparkSession, d: str) -> DataFrame:
    t = regression.trend(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return t.select("l_returnflag", "l_linestatus", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 9).alias("r"), F.round("r2", 9).alias("r2"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 9) as r from lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return regression.correlations(read(spark, d, "lineitem"), _CORR).select("a", "b", F.round("r", 9).alias("r"))


@query()
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated ridge of price on quantity, discount and tax; one row for each coefficient."""
    fit = regression.ridge(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", key=F.concat_ws(":", "l_orderkey", "l_linenumber"))
    rows = [(k, v, fit["alpha"], fit["r2"], fit["n"]) for k, v in {"intercept": fit["intercept"], **fit["coefficients"]}.items()]
    return spark.createDataFrame(rows, "term string, weight double, alpha double, r2 double, n long")


_FOLDS = """s as (select *, l_orderkey % 5 as f, l_quantity::double as x, l_extendedprice::double as y from lineitem), g as (select f, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from s group by 1),
    o as (select a.f, sum(b.n) as n, sum(b.sx) / sum(b.n) as mx, sum(b.sy) / sum(b.n) as my, sum(b.sxx) as sxx, sum(b.sxy) as sxy from g a join g b on a.f <> b.f group by 1),
    w as (select f, mx, my, (sxy - n * mx * my) / ((sxx - n * mx * mx) * (1 + 10.0::double / n)) as w from o), p as (select l_orderkey, l_linenumber, y, my + w * (x - mx) as predicted from s join w using (f))"""


def _out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    return regression.out_of_fold(rows, ["l_quantity"], "l_extendedprice", fold=F.col("l_orderkey") % 5, alpha=10.0)


@query(f"with {_FOLDS} select l_orderkey, l_linenumber, round(predicted, 4) as predicted, round(y - predicted, 4) as residual from p")
def ridge_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    """Every line's price predicted by a ridge fit on the other four folds."""
    return _out_of_fold(spark, d).select("l_orderkey", "l_linenumber", F.round("predicted", 4).alias("predicted"), F.round("residual", 4).alias("residual"))


@query(f"with {_FOLDS} select count(*) as n, round(1 - sum((y - predicted) ** 2) / (var_pop(y) * count(*)), 9) as r2, round(avg(abs(y - predicted)), 6) as mae, round(sqrt(avg((y - predicted) ** 2)), 6) as rmse from p")
def ridge_quality(spark: SparkSession, d: str) -> DataFrame:
    q = regression.fit_quality(_out_of_fold(spark, d), "l_extendedprice")
    return q.select("n", F.round("r2", 9).alias("r2"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))
