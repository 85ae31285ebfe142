"""Audits: named rules over rows, profiles of tables, coverage, gaps, duplicate keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, n_rows, n_violations, status`` of each rule in one pass; a rule that is null for a row is not violated."""
    counts = [F.count_if(~F.coalesce(ok, F.lit(True))).alias(f"_{i}") for i, ok in enumerate(rules.values())]
    made = [F.struct(F.lit(name).alias("rule"), F.col("_n").alias("n_rows"), F.col(f"_{i}").alias("n_violations")) for i, name in enumerate(rules)]
    out = df.agg(F.count(F.lit(1)).alias("_n"), *counts).select(F.inline(F.array(*made)))
    return out.withColumn("status", F.when(F.col("n_violations") == 0, "pass").otherwise("fail"))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, n_rows, n_null, n_distinct, least, most`` of each column, from one pass; least and most as text."""
    names = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(names):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"_z{i}"), F.count_distinct(c).alias(f"_d{i}"), F.min(c).cast("string").alias(f"_a{i}"), F.max(c).cast("string").alias(f"_b{i}")]
    made = [
        F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(f"_z{i}").alias("n_null"), F.col(f"_d{i}").alias("n_distinct"), F.col(f"_a{i}").alias("least"), F.col(f"_b{i}").alias("most"))
        for i, c in enumerate(names)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*made)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that come more than once and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage(df: DataFrame, by: Sequence[str], resolved: Column) -> DataFrame:
    """Rows, resolved ones and their share per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(resolved).alias("n_resolved"), F.try_divide(F.count_if(resolved).cast("double"), F.count(F.lit(1))).alias("share"))


def gaps(df: DataFrame, key: str, at: str) -> DataFrame:
    """Per key: distinct times, the median step between them and the longest, in seconds."""
    times = df.where(F.col(at).isNotNull()).select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("t")).distinct()
    step = (F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t"))) / 1e6
    return times.withColumn("step", step).groupBy(key).agg(F.count(F.lit(1)).alias("n_times"), F.percentile("step", F.lit(0.5)).alias("median_step"), F.max("step").alias("longest_step"))


def missing_sessions(have: DataFrame, expected: DataFrame, key: str, day: str) -> DataFrame:
    """Expected days of each key, between its first and last one, on which it has no row."""
    span = have.where(F.col(day).isNotNull()).groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    # calendar days of each span, of which only expected ones are due; spans are as long as the calendar
    every = span.select(key, F.explode(F.sequence("_lo", "_hi")).alias(day))
    due = every.join(expected.select(day).distinct(), day, "left_semi").select(key, day)
    return due.join(have.select(key, day).distinct(), [key, day], "left_anti")


def size_classes(df: DataFrame, by: str) -> DataFrame:
    """How many groups have 1, 2, 3-5, 6-10 or more rows."""
    n = F.col("count")
    size = F.when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise(">10")
    return df.groupBy(by).count().select(size.alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def columns_like(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """The columns whose names begin with one of the prefixes, in their order."""
    return df.select(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def allow_list(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """``column, status`` of every column: ``allowed``, ``refused``, or ``absent`` where an allowed one is missing."""
    rows = [(c, "allowed" if c in allowed else "refused") for c in df.columns] + [(c, "absent") for c in allowed if c not in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, status string")
