"""Fitting by sums: ridge regressions from one pass, grids scored in one pass, residual anchors, horizon curves, boosting by quantile trees."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.distribution import QS, quantiles_of


def ridge(train: DataFrame, features: Sequence[str], label: str, penalty: float = 0.0, weight: Column | None = None) -> tuple[float, list[float]]:
    """Intercept and slopes that minimise the weighted squared error plus ``penalty`` times the squared slopes; the intercept is free.

    Sums of products come from one pass over the rows (those with a null are left
    out); the system that is solved has one line a feature.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    whole = train.where(F.col(label).isNotNull())
    for f in features:
        whole = whole.where(F.col(f).isNotNull())
    cols = [F.col(f).cast("double") for f in features] + [F.col(label).cast("double")]
    n = len(cols)
    means = whole.agg(F.sum(w), *[F.sum(w * c) for c in cols]).first()
    if not means[0]:
        raise ValueError("no rows to fit")
    mean = [means[i + 1] / means[0] for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = whole.agg(*[F.sum(w * (cols[i] - mean[i]) * (cols[j] - mean[j])) for i, j in pairs]).first()
    at = {p: s for p, s in zip(pairs, sums, strict=True)}
    k = n - 1
    gram = np.array([[at[min(i, j), max(i, j)] for j in range(k)] for i in range(k)]) + penalty * np.eye(k)
    slopes = np.linalg.lstsq(gram, np.array([at[i, k] for i in range(k)]), rcond=None)[0].tolist() if k else []
    return mean[k] - sum(b * m for b, m in zip(slopes, mean, strict=False)), slopes


def linear(model: tuple[float, Sequence[float]], features: Sequence[str]) -> Column:
    """The prediction of :func:`ridge` as an expression."""
    out = F.lit(model[0])
    for b, f in zip(model[1], features, strict=True):
        out = out + F.lit(b) * F.col(f)
    return out


def grid_scores(df: DataFrame, grid: Sequence[Mapping[str, float]], loss: Column, day: str) -> DataFrame:
    """The grid's parameters with the mean over days of the day's mean loss; ``loss`` may use them as columns.

    Every row meets every point of the grid, which is as long as it is written;
    sums are combined before anything is shuffled.
    """
    names = list(grid[0])
    points = F.array(*[F.struct(*[F.lit(float(g[n])).alias(n) for n in names]) for g in grid])
    met = df.select("*", F.inline(points)).withColumn("_l", loss)
    return met.groupBy(*names, day).agg(F.avg("_l").alias("_l")).groupBy(*names).agg(F.avg("_l").alias("score"))


def best_point(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """The point of least score; of equal ones (to nine places) the one whose parameters come first."""
    return scores.agg(F.min(F.struct(F.round("score", 9).alias("score"), *names)).alias("b")).select(*[f"b.{n}" for n in names], "b.score")


def residual_anchor(train: DataFrame, y: str, p: str, vol: str, support: int) -> tuple[float | None, list[float | None]]:
    """Median error of a forecast and the quantiles of what is left in volatilities; None with less than ``support`` rows."""
    rows = train.where((F.col(vol) > 0) & F.col(y).isNotNull() & F.col(p).isNotNull())
    if rows.count() < support:
        return None, [None] * len(QS)
    location = quantiles_of(rows.withColumn("_e", F.col(y) - F.col(p)), "_e", (0.5,))[0]
    return location, quantiles_of(rows.withColumn("_z", (F.col(y) - F.col(p) - location) / F.col(vol)), "_z", QS)


def between_horizons(tau: float, known: Mapping[int, Column]) -> Column:
    """A value at horizon ``tau``, linear in ``log(1 + tau)`` between the horizons that are known, the nearest one outside."""
    taus = sorted(known)
    if tau <= taus[0]:
        return known[taus[0]]
    if tau >= taus[-1]:
        return known[taus[-1]]
    b = next(t for t in taus if t >= tau)
    a = max(t for t in taus if t <= tau)
    share = 0.0 if a == b else (math.log1p(tau) - math.log1p(a)) / (math.log1p(b) - math.log1p(a))
    return known[a] + share * (known[b] - known[a])


def boosted_quantile(train: DataFrame, test: DataFrame, features: Sequence[str], y: str, level: float, keep: Sequence[str], rounds: int = 6, rate: float = 0.4, depth: int = 3) -> DataFrame:
    """``keep`` and ``quantile``: a quantile by functional boosting.

    Each round fits a tree to which side of the forecast the outcome lies on, then
    moves every leaf by ``rate`` times the quantile of what is left there.  Leaves
    are as few as the tree has; their quantiles are exact.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from tidemark.session import stored

    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    start = quantiles_of(train, y, (level,))[0]
    known = stored(assembler.transform(train.select(*features, y)).withColumn("_f", F.lit(start)), "boost")
    asked = assembler.transform(test.select(*dict.fromkeys([*keep, *features]))).withColumn("_f", F.lit(start))
    for i in range(rounds):
        side = known.withColumn("_g", F.lit(level) - (F.col(y) < F.col("_f")).cast("double"))
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_g", maxDepth=depth, leafCol="_leaf", predictionCol="_p", seed=i).fit(side)
        placed = tree.transform(side)
        steps = placed.groupBy("_leaf").agg((rate * F.percentile(F.col(y) - F.col("_f"), F.lit(level))).alias("_s")).collect()  # one row a leaf
        move = F.lit(0.0)
        for r in steps:
            move = F.when(F.col("_leaf") == r["_leaf"], r["_s"]).otherwise(move)
        known = stored(placed.withColumn("_f", F.col("_f") + move).select(*features, y, "_x", "_f"), "boost")
        asked = tree.transform(asked).withColumn("_f", F.col("_f") + move).drop("_leaf", "_p")
    return asked.select(*keep, F.col("_f").alias("quantile"))
