"""Linear fits from sums of products: one distributed pass, then a small system of equations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trend(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r, r2 by group."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_r2(y, x).alias("r2"))


def correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """a, b, r for all pairs of columns with |r| of at least `least`; one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")).select("x.*")
    return long.where(F.abs("r") >= least)


def _gram(df: DataFrame, predictors: list[str], target: str, fold: str) -> dict[int, np.ndarray]:
    """Sums of products of (1, predictors, target) by fold: a matrix of fixed size for each."""
    names = [F.lit(1.0), *(F.col(p).cast("double") for p in predictors), F.col(target).cast("double")]
    n = len(names)
    sums = [F.sum(names[i] * names[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]
    out = {}
    for row in df.dropna(subset=[*predictors, target]).groupBy(fold).agg(*sums).collect():
        m = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                m[i, j] = m[j, i] = row[f"s{i}_{j}"]
        out[row[fold]] = m
    return out


def _solve(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge on standardised predictors, intercept free; coefficients on the original scale, intercept first."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1] / n, 0))
    scale[scale == 0] = 1.0
    w = np.linalg.solve(cov[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(len(scale)), cov[:-1, -1] / scale) / scale
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


def _squared_error(gram: np.ndarray, w: np.ndarray) -> float:
    v = np.concatenate([w, [-1.0]])
    return float(v @ gram @ v)


def ridge(df: DataFrame, predictors: list[str], target: str, *, key: Column, folds: int = 5, alphas: np.ndarray | None = None) -> dict:
    """Cross-validated ridge; folds by a hash of `key`.  Returns alpha, coefficients, r2 and rmse out of fold, n."""
    alphas = np.logspace(-2, 4, 22) if alphas is None else alphas
    grams = _gram(df.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds))), predictors, target, "__fold")
    whole = sum(grams.values())
    n = int(whole[0, 0])
    if n < 30:
        raise ValueError("fewer than 30 usable rows")
    errors = [sum(_squared_error(g, _solve(whole - g, a)) for g in grams.values()) for a in alphas]
    best = int(np.argmin(errors))
    spread = whole[-1, -1] - whole[0, -1] ** 2 / n
    w = _solve(whole, float(alphas[best]))
    return {"alpha": float(alphas[best]), "intercept": float(w[0]), "coefficients": dict(zip(predictors, map(float, w[1:]), strict=True)), "r2": float(1 - errors[best] / spread) if spread else None, "rmse": float((errors[best] / n) ** 0.5), "n": n}


# Sizes from which a fit is allowed and from which it needs no warning.
LEAST_ROWS, FEW_ROWS, MANY_PREDICTORS, CLOSE = 30, 50, 6, 0.9


def out_of_fold(df: DataFrame, predictors: list[str], target: str, *, fold: Column, alpha: float) -> DataFrame:
    """Usable rows with predicted (by a fit without their fold) and residual.

    Only the folds' sums of products come to the driver, and only one set of
    coefficients for each fold goes back.
    """
    rows = df.dropna(subset=[*predictors, target]).withColumn("__fold", fold.cast("long"))
    grams = _gram(rows, predictors, target, "__fold")
    whole = sum(grams.values())
    fits = [(f, *map(float, _solve(whole - g, alpha))) for f, g in grams.items()]
    names = [f"__w{i}" for i in range(len(predictors) + 1)]
    table = df.sparkSession.createDataFrame(fits, ", ".join(["__fold long", *(f"{n} double" for n in names)]))
    value = F.col("__w0")
    for n, p in zip(names[1:], predictors, strict=True):
        value = value + F.col(n) * F.col(p)
    out = rows.join(F.broadcast(table), "__fold").withColumn("predicted", value)  # one row a fold
    return out.withColumn("residual", F.col(target) - F.col("predicted")).drop("__fold", *names)


def fit_quality(predicted: DataFrame, target: str) -> DataFrame:
    """One row: n, r2, mae and rmse of out_of_fold() rows."""
    square = F.col("residual") * F.col("residual")
    return predicted.agg(F.count("*").alias("n"), (1 - F.sum(square) / F.nullif(F.var_pop(target) * F.count("*"), F.lit(0.0))).alias("r2"), F.avg(F.abs("residual")).alias("mae"), F.sqrt(F.avg(square)).alias("rmse"))


def fit_checks(df: DataFrame, predictors: list[str], target: str, known: set[str]) -> DataFrame:
    """One row: rows, usable, dropped and warnings; unknown or repeated predictors, the target among them, or too few usable rows are errors."""
    if not predictors or len(set(predictors)) < len(predictors) or target in predictors or {target, *predictors} - known:
        raise ValueError("predictors must be known, different, and not the target")
    usable = F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in [*predictors, target])) == 0) if len(predictors) else F.count("*")
    counts = df.agg(F.count("*").alias("rows"), usable.alias("usable")).withColumn("dropped", F.col("rows") - F.col("usable"))
    n = counts.first()["usable"]
    if n < LEAST_ROWS:
        raise ValueError(f"fewer than {LEAST_ROWS} usable rows: {n}")
    close = [f"close:{r['a']}|{r['b']}" for r in correlations(df.dropna(subset=[*predictors, target]), predictors, CLOSE).collect()] if len(predictors) > 1 else []
    said = [*(["few_rows"] if n < FEW_ROWS else []), *(["many_predictors"] if len(predictors) > MANY_PREDICTORS else []), *close]
    return counts.withColumn("warnings", F.array(*map(F.lit, said)).cast("array<string>"))
