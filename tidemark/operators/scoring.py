"""Losses, coverage, information coefficients, two-level averages, bootstraps, concentration."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import hash_bucket
from tidemark.operators.windows import percent_rank_ties

QUANTILES = (5, 25, 50, 75, 95)


def pinball(y: Column, q: Column, level: float) -> Column:
    e = y - q
    return F.greatest(level * e, (level - 1) * e)


def mean_pinball(y: str, quantiles: Sequence[int] = QUANTILES, prefix: str = "q") -> Column:
    losses = [pinball(F.col(y), F.col(f"{prefix}{p:02d}"), p / 100) for p in quantiles]
    return sum(losses[1:], losses[0]) / len(losses)


def point_metrics(y: str, p: str) -> list[Column]:
    """Absolute and squared errors, bias, R squared against the mean, and the share of right signs (zeros are wrong)."""
    e = F.col(p) - F.col(y)
    return [
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_ae"), F.avg(e).alias("bias"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(((F.col(p) * F.col(y)) > 0).cast("double")).alias("direction"),
    ]


def distribution_metrics(y: str, p_pos: str) -> list[Column]:
    """Brier score, base rate, central coverage and width, and the calibration error over all quantiles."""
    up = (F.col(y) > 0).cast("double")
    inside = lambda lo, hi: F.avg(((F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi))).cast("double"))
    off = [F.abs(F.avg((F.col(y) <= F.col(f"q{q:02d}")).cast("double")) - q / 100) for q in QUANTILES]
    return [
        F.avg((F.col(p_pos) - up) * (F.col(p_pos) - up)).alias("brier"), F.avg(up).alias("base_rate"), inside("q25", "q75").alias("coverage_50"), inside("q05", "q95").alias("coverage_90"),
        F.avg(F.col("q95") - F.col("q05")).alias("width_90"), (sum(off[1:], off[0]) / len(off)).alias("calibration_error"),
    ]


def equal_by(df: DataFrame, levels: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Mean of means: averages within the first level's groups, then within each coarser one's."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(value).alias(value))
    return df


def information_coefficients(df: DataFrame, day: str, y: str, p: str, least: int = 30) -> DataFrame:
    """Pearson and Spearman correlation of prediction and outcome per day, for days of ``least`` rows."""
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    ranked = both.withColumn("_ry", percent_rank_ties(y, day)).withColumn("_rp", percent_rank_ties(p, day))
    return ranked.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.corr(y, p).alias("pearson"), F.corr("_ry", "_rp").alias("spearman")).where(F.col("n") >= least)


def block_start(rep: Column, block: Column, n: int, size: int, seed: int) -> Column:
    """Start of a non-circular block of ``size`` among ``n`` positions, from a hash of the repetition and the block's number."""
    return hash_bucket(F.concat_ws("-", F.lit(seed).cast("string"), rep.cast("string"), block.cast("string")), n - size + 1)


def block_bootstrap(daily: DataFrame, day: str, value: str, block: int, reps: int, seed: int = 0) -> DataFrame:
    """``rep, mean``: means of the daily values under moving-block resampling.

    Runs one count; starts come from a hash, are exploded to positions and joined
    to the days by place.  Days are few, so one ordered pass over them is fine.
    """
    spark = daily.sparkSession
    placed = daily.where(F.col(value).isNotNull()).withColumn("_i", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)) - 1).cast("long"))
    n = placed.count()
    if not n:
        return spark.createDataFrame([], "rep long, mean double")
    if block < 1:
        raise ValueError("a block holds at least one day")
    block = min(block, n)
    grid = spark.range(reps * -(-n // block)).select(F.floor(F.col("id") / -(-n // block)).alias("rep"), (F.col("id") % -(-n // block)).alias("b"))
    grid = grid.withColumn("start", block_start(F.col("rep"), F.col("b"), n, block, seed))
    picks = grid.select("rep", "b", F.posexplode(F.sequence("start", F.col("start") + block - 1)).alias("j", "_i"))
    picks = picks.where(F.col("b") * block + F.col("j") < n)  # the last block is cut to size
    return picks.join(placed.select("_i", value), "_i").groupBy("rep").agg(F.avg(value).alias("mean"))


def interval(boot: DataFrame, value: str = "mean") -> DataFrame:
    return boot.agg(F.percentile(value, F.lit(0.025)).alias("low"), F.avg(value).alias("middle"), F.percentile(value, F.lit(0.975)).alias("high"))


def concentration(df: DataFrame, day: str, group: str, value: str) -> DataFrame:
    """What each group adds to the day-equal mean, its share of all absolute additions, and the running share from the top.

    Groups are as many as a report has lines; ties go by the group's name.
    """
    n_days = df.agg(F.countDistinct(day)).scalar()
    per = df.withColumn("_c", F.col(value) / F.count(value).over(Window.partitionBy(day))).groupBy(group).agg((F.sum("_c") / n_days).alias("contribution"))
    total = F.sum(F.abs("contribution")).over(Window.partitionBy(F.lit(0)))
    out = per.withColumn("abs_share", F.try_divide(F.abs("contribution"), total))
    top = Window.partitionBy(F.lit(0)).orderBy(F.col("abs_share").desc(), group).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cum_share", F.sum("abs_share").over(top))


def without_each_group(df: DataFrame, day: str, group: str, value: str) -> DataFrame:
    """The day-equal mean of all rows but those of one group, for every group, from sums and counts alone."""
    cell = df.groupBy(day, group).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    total = cell.groupBy(day).agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    n = total.where("tc > 0").agg(F.count(F.lit(1))).scalar()
    full = total.where("tc > 0").agg(F.sum(F.col("ts") / F.col("tc"))).scalar()
    rest = F.try_divide(F.col("ts") - F.col("s"), F.col("tc") - F.col("c"))
    joined = cell.where("c > 0").join(total, day).withColumn("gone", F.col("ts") / F.col("tc")).withColumn("rest", rest)
    return joined.groupBy(group).agg(
        ((full - F.sum("gone") + F.coalesce(F.sum("rest"), F.lit(0.0))) / F.nullif(n - F.count_if(F.col("rest").isNull()), F.lit(0))).alias("mean_without")
    )


def autocorrelation(daily: DataFrame, day: str, value: str, lags: Sequence[int]) -> DataFrame:
    """``lag, corr`` of a daily series."""
    order = Window.partitionBy(F.lit(0)).orderBy(day)
    df = daily.select(F.col(value).alias("x"), *[F.lag(value, k).over(order).alias(f"l{k}") for k in lags])
    made = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"c{k}").alias("corr")) for k in lags])
    return df.agg(*[F.corr("x", f"l{k}").alias(f"c{k}") for k in lags]).select(F.inline(made))


def poisson_weight(*parts: Column) -> Column:
    """A whole weight of mean one from a hash of the parts: the same one wherever and whenever it is drawn."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    out, below, p = F.lit(9), 0.0, math.exp(-1.0)
    levels = []
    for k in range(9):
        below += p
        levels.append((k, below))
        p /= k + 1
    for k, level in reversed(levels):
        out = F.when(u < level, k).otherwise(out)
    return out


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, reps: int, seed: int = 0) -> DataFrame:
    """``rep, mean``: means under resampling of whole clusters, each drawn a Poisson number of times.

    Clusters are summed first; every repetition is a weighted sum over them, so
    nothing is numbered, sorted or brought to one place.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("k")).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    drawn = per.select("s", "c", "k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = drawn.withColumn("w", poisson_weight(F.lit(seed), F.col("rep"), F.col("k")))
    return drawn.groupBy("rep").agg(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum(F.col("c") * F.col("w"))).alias("mean"))


def expanding_predictions(df: DataFrame, folds: DataFrame, day: str, target_day: str, group: str, y: str) -> DataFrame:
    """Rows tested in a fold with the mean of their group over all rows whose target lies before the fold, everyone's for a new group.

    ``folds`` has ``fold, first_day, last_day`` and is as long as a person would
    plan; all folds are fitted in one pass.
    """
    f = F.broadcast(folds)
    known = df.where(F.col(y).isNotNull()).join(f, F.col(target_day) < F.col("first_day"))
    own = known.groupBy("fold", group).agg(F.avg(y).alias("_own"))
    every = F.broadcast(known.groupBy("fold").agg(F.avg(y).alias("_all")))
    test = df.join(f, (F.col(day) >= F.col("first_day")) & (F.col(day) <= F.col("last_day")))
    return test.join(own, ["fold", group], "left").join(every, "fold", "left").withColumn("prediction", F.coalesce("_own", "_all")).drop("_own", "_all", "first_day", "last_day")


def walked(df: DataFrame, folds: Sequence[tuple[int, object, object]], day: str, target_day: str, fit: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """Predictions of caller's own functions along folds: ``fit`` gets the rows whose target lies before a fold, ``predict`` its model and the fold's rows."""
    out = None
    for fold, first, last in folds:
        model = fit(df.where(F.col(target_day) < F.lit(first)))
        part = predict(model, df.where(F.col(day).between(F.lit(first), F.lit(last)))).withColumn("fold", F.lit(fold).cast("long"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no folds")
    return out
