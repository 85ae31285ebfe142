"""Learners on Spark ML and by sums: isotonic calibration, additive ridge, quantiles over a forest's trees, boosted chances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.selection import linear, ridge
from tidemark.session import stored


def isotonic(train: DataFrame, test: DataFrame, score: str, label: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``calibrated`` of the test rows; fits on the training rows, in place."""
    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(train.select(score, label))
    return model.transform(test).select(*keep, F.col("prediction").alias("calibrated"))


def additive_ridge(df: DataFrame, train: str, parts: Sequence[tuple[str, Sequence[str]]], keep: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """``keep`` and ``predicted``: the sum of one ridge regression for each ``(label, features)``, fitted by sums where ``train`` holds."""
    known = stored(df.where(train).select(*dict.fromkeys(c for label, features in parts for c in (label, *features))), "ridge")
    total = F.lit(0.0)
    for label, features in parts:
        total = total + linear(ridge(known, features, label, penalty), features)
    return df.where(f"not ({train})").select(*keep, total.alias("predicted"))


def quantile_forest(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, keep: Sequence[str], trees: int = 16, depth: int = 5, quantiles: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """``keep``, interpolated quantiles of what a forest's trees predict for the row, and the share of trees above zero."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    model = RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=5).fit(assembler.transform(train.select(*features, label)))
    rows = assembler.transform(test.select(*dict.fromkeys([*keep, *features])))
    for i, tree in enumerate(model.trees):
        rows = tree.setFeaturesCol("_x").setPredictionCol(f"_t{i}").transform(rows)
    said = F.array_sort(F.array(*[f"_t{i}" for i in range(trees)]))

    def at(q: float) -> Column:
        place = q * (trees - 1)
        low = int(place)
        below, above = F.get("_said", F.lit(low)), F.get("_said", F.lit(min(low + 1, trees - 1)))
        return below + (place - low) * (above - below)

    return rows.withColumn("_said", said).select(
        *keep, *[at(q).alias(f"q{int(q * 100):02d}") for q in quantiles], (F.size(F.filter("_said", lambda x: x > 0)) / trees).alias("p_pos")
    )


def boosted_chance(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, keep: Sequence[str], weight: str | None = None, rounds: int = 8, depth: int = 3) -> DataFrame:
    """``keep`` and ``chance``: the chance of ``label`` 1 by boosted trees with optional row weights; the base rate where one outcome is all there is."""
    whole = train.where(F.col(label).isNotNull())
    least, most, rate = whole.agg(F.min(label), F.max(label), F.avg(label)).first()
    if least == most:
        return test.select(*keep, F.lit(rate).alias("chance"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=7, weightCol=weight)
    fitted = model.fit(assembler.transform(whole.select(*features, label, *([weight] if weight else []))))
    out = fitted.transform(assembler.transform(test.select(*dict.fromkeys([*keep, *features]))))
    return out.select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("chance"))


def forest_parts(train: DataFrame, test: DataFrame, market: Sequence[str], own: Sequence[str], y: str, keep: Sequence[str], trees: int = 12, depth: int = 4) -> DataFrame:
    """``keep`` and the predictions ``market``, ``own``, and ``residual``: the market's plus a forest on what the market leaves.

    The residual forest learns from errors on rows that the market forest has not
    seen: each half of the training rows is predicted by a forest of the other half.
    """
    known = stored(train.where(F.col(y).isNotNull()).select(*dict.fromkeys([*market, *own, y])).withColumn("_half", F.pmod(F.xxhash64(*market, *own, y), F.lit(2))), "forest")
    asked = test.select(*dict.fromkeys([*keep, *market, *own]))

    def fitted(rows: DataFrame, features: Sequence[str], label: str, seed: int):  # noqa: ANN202
        x = VectorAssembler(inputCols=list(features), outputCol="_x")
        model = RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, predictionCol="_p").fit(x.transform(rows))
        return lambda df, name: model.transform(x.transform(df)).withColumnRenamed("_p", name).drop("_x")

    halves = [fitted(known.where(F.col("_half") != h), market, y, 1)(known.where(F.col("_half") == h), "_m") for h in (0, 1)]
    left = stored(halves[0].unionByName(halves[1]).withColumn("_left", F.col(y) - F.col("_m")), "forest")
    out = fitted(known, market, y, 1)(asked, "market")
    out = fitted(known, [*market, *own], y, 2)(out, "own")
    out = fitted(left, own, "_left", 3)(out, "_r")
    return out.select(*keep, "market", "own", (F.col("market") + F.col("_r")).alias("residual"))
