"""Least squares from sums, and the weighted logistic fit of the dispatcher."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.scalar import log10_floor1
from tripleloom.plans.dispatch import Formula


def line_fit(points: DataFrame, y: Column, x: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, slope, intercept, r2, points)`` of a straight line."""
    return points.select(*by, y.alias("y"), x.alias("x")).groupBy(*by).agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.regr_count("y", "x").alias("points"),
    )


def crossover(slope: Column, intercept: Column) -> Column:
    """Where a fitted log ratio is 0, on the original scale; NULL for a flat line."""
    return F.when(F.abs(slope) > 1e-6, F.exp(-intercept / slope))


def plane_fit(points: DataFrame, y: Column, x1: Column, x2: Column) -> DataFrame:
    """``(b1, b2, b0, r2)`` of ``y = b1 x1 + b2 x2 + b0`` from centred second moments."""
    p = points.select(y.alias("y"), x1.alias("a"), x2.alias("b"))
    m = p.agg(
        *[F.avg(c).alias(f"m{c}") for c in "yab"],
        F.covar_pop("a", "a").alias("aa"), F.covar_pop("b", "b").alias("bb"), F.covar_pop("a", "b").alias("ab"),
        F.covar_pop("a", "y").alias("ay"), F.covar_pop("b", "y").alias("by"), F.covar_pop("y", "y").alias("yy"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    b1 = F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det)
    b2 = F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det)
    fit = m.withColumn("b1", b1).withColumn("b2", b2)
    explained = F.col("b1") * F.col("ay") + F.col("b2") * F.col("by")
    return fit.select(
        "b1", "b2", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("b0"),
        F.try_divide(explained, F.col("yy")).alias("r2"),
    )


def least_squares(points: DataFrame, y: Column, xs: list[Column]) -> tuple[list[float], float]:
    """Coefficients and R² for any number of regressors.

    One aggregation makes the normal equations; only ``len(xs)**2`` sums reach
    the driver.
    """
    names = [f"x{n}" for n in range(len(xs))]
    p = points.select(y.alias("y"), *[x.alias(n) for x, n in zip(xs, names)])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = p.agg(
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs],
        *[F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in names],
        F.sum(F.col("y") * F.col("y")).alias("yy"), F.avg("y").alias("mean"), F.count("y").alias("n"),
    ).first()
    gram = np.array([[row[f"{min(a, b)}_{max(a, b)}"] for b in names] for a in names])
    moment = np.array([row[f"{a}_y"] for a in names])
    # Columns of very unequal size are brought to unit length, so that none falls below the rank cut-off.
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    beta = np.linalg.lstsq(gram / np.outer(scale, scale), moment / scale, rcond=None)[0] / scale
    residual = row["yy"] - 2 * beta @ moment + beta @ gram @ beta
    spread = row["yy"] - row["n"] * row["mean"] ** 2
    return [float(b) for b in beta], float(1 - residual / spread) if spread else float("nan")


def fit_dispatcher(timings: DataFrame, iterations: int = 200) -> Formula:
    """Logistic fit of "hash is faster", weighted by the time at stake, without regularisation.

    The sign is turned so that a score below 0 means hash.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_weighted(timings))
    model = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=iterations).fit(points)
    return Formula(*(-float(w) for w in model.coefficients), -float(model.intercept))


FEATURES = ["lfp", "ln", "lmr", "lsk"]


def _weighted(timings: DataFrame) -> DataFrame:
    return timings.where("hash_ms IS NOT NULL AND merge3_ms IS NOT NULL").select(
        log10_floor1(F.col("flop")).alias("lfp"),
        F.log10(F.col("n").cast("double")).alias("ln"),
        log10_floor1(F.col("maxrow")).alias("lmr"),
        log10_floor1(F.col("skew")).alias("lsk"),
        (F.col("hash_ms") < F.col("merge3_ms")).cast("double").alias("label"),
        F.greatest(F.abs(F.col("hash_ms") - F.col("merge3_ms")), F.lit(1e-6)).alias("weight"),
    )


def fit_gradient(timings: DataFrame, fit: Formula) -> DataFrame:
    """One row: cases, and the slope of the weighted log-likelihood along each unit-deviation feature and the constant, per weight.

    It is zero at the best fit, as the likelihood is concave.
    """
    data = _weighted(timings)
    spread = data.agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES], *[F.avg(c).alias(f"m_{c}") for c in FEATURES]).first()
    score = F.lit(fit.constant)
    for weight, c in zip((fit.products, fit.rows, fit.longest, fit.skew), FEATURES):
        score = score + F.lit(weight) * F.col(c)
    # The sign is turned: below 0 means hash, whose label is 1.
    missing = (F.col("label") - 1 / (1 + F.exp(score))) * F.col("weight")
    unit = [((F.col(c) - F.lit(spread[f"m_{c}"])) / F.lit(spread[f"s_{c}"] or 1.0)).alias(c) for c in FEATURES]
    parts = data.select("weight", missing.alias("r"), *unit)
    slopes = [(F.sum(F.col("r") * F.col(c)) / F.sum("weight")).alias(c) for c in FEATURES]
    return parts.agg(F.count(F.lit(1)).alias("cases"), *slopes, (F.sum("r") / F.sum("weight")).alias("constant"))
