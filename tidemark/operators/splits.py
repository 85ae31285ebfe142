"""Splits in time that leak nothing: purged folds, group folds, walk-forward, shared-group purging."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.distribution import smallest_reaching


def day_folds(df: DataFrame, day: str, folds: int) -> DataFrame:
    """``fold, first_day, last_day``: the distinct days cut into chunks of equal count, larger ones first.

    Days are few, so the one ordered pass over them is bounded by the calendar.
    """
    days = df.where(F.col(day).isNotNull()).select(F.col(day).alias("d")).distinct()
    chunk = F.ntile(folds).over(Window.partitionBy(F.lit(0)).orderBy("d"))
    return days.withColumn("fold", chunk.cast("long")).groupBy("fold").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))


def purged_folds(df: DataFrame, day: str, target_day: str, folds: int) -> DataFrame:
    """Rows with every fold they belong to, as ``test`` or as ``train``.

    The first chunk only trains.  A row trains a fold if its *target* lies before
    the fold's first test day, so no label reaches into the test.
    """
    chunks = F.broadcast(day_folds(df, day, folds).where("fold > 1"))  # one row a fold
    test = (F.col(day) >= F.col("first_day")) & (F.col(day) <= F.col("last_day"))
    train = F.col(target_day) < F.col("first_day")
    return df.join(chunks, test | train).withColumn("role", F.when(test, "test").otherwise("train"))


def group_folds(df: DataFrame, group: str, day: str, target_day: str, folds: int) -> DataFrame:
    """The same with whole groups, placed by their first day; a group trains only if all its targets lie before the test."""
    groups = df.groupBy(group).agg(F.min(day).alias("anchor"), F.max(target_day).alias("reach"))
    roles = purged_folds(groups, "anchor", "reach", folds).select(group, "fold", "role")
    return df.join(roles, group)


def time_split(df: DataFrame, at: str, share: float) -> DataFrame:
    """``train`` for the first ``share`` of the distinct times, ``test`` for the rest; a null time comes first.

    The time at the cut is found by counting distinct times in buckets, so they are
    never sorted in one place, and rows are only compared with it.
    """
    at_us = F.unix_micros(F.col(at).cast("timestamp"))
    times = df.select(at_us.alias("t")).distinct()
    n, nulls = times.agg(F.count(F.lit(1)), F.count_if(F.col("t").isNull())).first()
    rank = math.floor(n * share) - nulls
    cut = smallest_reaching(times, "t", (float(rank),))[float(rank)] if rank > 0 else None
    first = F.col(at).isNull() if cut is None else F.col(at).isNull() | (at_us <= F.lit(int(cut)))
    return df.withColumn("role", F.when(first, "train").otherwise("test"))


def purge_shared(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Training rows that share none of the keys' values with a test row; nulls are shared with nothing."""
    out = train
    for key in keys:
        out = out.join(test.select(key).distinct(), key, "left_anti")
    return out


def walk_forward(df: DataFrame, key: Sequence[str], order: Sequence[str], first: int, step: int) -> DataFrame:
    """Number of the step in which each row is tested, in windows of ``step`` rows after the first ``first``; 0 before."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("step", F.when(rn <= first, F.lit(0)).otherwise(F.floor((rn - first - 1) / step) + 1).cast("long"))


def inner_split(df: DataFrame, day: str, parts: int, target_day: str | None = None) -> DataFrame:
    """``inner_test`` for the last of ``parts`` chunks of the days, ``inner_train`` before it, ``purged`` where a target reaches into the test."""
    first = day_folds(df, day, parts).where(F.col("fold") == parts).agg(F.min("first_day").alias("_cut"))
    early = F.col(target_day or day) < F.col("_cut")
    role = F.when(F.col(day) >= F.col("_cut"), "inner_test").when(early, "inner_train").otherwise("purged")
    return df.join(F.broadcast(first)).withColumn("role", role).drop("_cut")  # one row
