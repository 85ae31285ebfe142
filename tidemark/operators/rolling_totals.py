"""Totals and averages per entity over trailing calendar periods, idle days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_daily_value(
    df: DataFrame, entity: str, day: str, sequence: str, value: str, usable: Column | None = None
) -> DataFrame:
    """``entity, day, value`` of the highest ``sequence`` of each entity and day.

    A revision that withdraws the value (null, or not ``usable``) leaves the day
    without a row: an older revision does not come back.  ``usable`` is a
    condition on the column ``value``; by default every non-null value counts.
    Rows whose entity or day is null are left out, and so are exact copies.
    """
    ok = F.col("value").isNotNull() if usable is None else usable
    return (
        df.select(
            F.col(entity).alias("entity"), F.col(day).cast("date").alias("day"),
            F.col(sequence).alias("seq"), F.col(value).cast("double").alias("value"),
        )
        .where("entity is not null and day is not null")
        .groupBy("entity", "day")
        .agg(F.max_by("value", F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63)))).alias("value"))
        .where(F.coalesce(ok, F.lit(False)))
    )


def rolling_totals(
    daily: DataFrame,
    entity: str = "entity",
    day: str = "day",
    value: str = "value",
    windows: Sequence[int] = (7, 30),
    block_days: int = 256,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Trailing totals for every entity and calendar day between its first and last active day.

    With ``calendar``, rows of ``entity`` and ``day`` columns of the same names,
    the days run from its first to its last row of each entity instead, also
    for entities that are never active; it must hold all days of ``daily``.
    ``daily`` may hold several rows an entity and day; null entities, days and
    values are left out.  Returns ``entity, calendar_day`` and, for each window
    of ``w`` days (the day and the ``w - 1`` before it), ``total_w``,
    ``active_days_w``, ``avg_day_w`` (total over ``w`` days, idle ones as zero)
    and ``avg_active_w`` (null where the window holds no activity).  An empty
    input gives an empty result.  Sums keep the type of ``value``; integers and
    decimals are exact in whatever order the rows meet.

    Each daily total is exploded onto every date it influences, the pieces are
    summed by entity and date, and the calendar is joined for the zeros.  Rows
    are first placed by entity and block of ``block_days`` days, so that nearly
    all pieces meet before the shuffle and even one entity that holds most rows
    is spread over many tasks.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must be positive numbers of days")
    longest = max(windows)
    totals = (
        daily.select(F.col(entity).alias("e"), F.col(day).cast("date").alias("d"), F.col(value).alias("v"))
        .where("e is not null and d is not null and v is not null")
        .groupBy("e", "d")
        .agg(F.sum("v").alias("v"))
    )
    placed = totals.repartition("e", F.floor(F.unix_date("d") / block_days))
    pieces = placed.select("e", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("off"))
    sums = []
    for w in windows:
        inside = F.col("off") < w
        sums += [F.sum(F.when(inside, F.col("v"))).alias(f"t{w}"), F.count(F.when(inside, 1)).alias(f"n{w}")]
    summed = pieces.groupBy("e", F.date_add("d", F.col("off")).alias("c")).agg(*sums)
    asked = totals
    if calendar is not None:
        asked = calendar.select(F.col(entity).alias("e"), F.col(day).cast("date").alias("d")).where("e is not null and d is not null")
    spans = asked.groupBy("e").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = spans.select("e", F.explode(F.sequence("lo", "hi")).alias("c"))
    out = days.join(summed, ["e", "c"], "left")
    cols = [F.col("e").alias("entity"), F.col("c").alias("calendar_day")]
    for w in windows:
        total, n = F.coalesce(f"t{w}", F.lit(0)), F.coalesce(f"n{w}", F.lit(0))
        cols += [
            total.alias(f"total_{w}"), n.cast("long").alias(f"active_days_{w}"),
            (total / F.lit(float(w))).alias(f"avg_day_{w}"),
            F.when(n > 0, total / n).alias(f"avg_active_{w}"),
        ]
    return out.select(*cols)
