"""Proxy views over the driver's tables: the same shapes as market panels, built twice, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import divided
from tidemark.session import table


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Several observations of an asset and day in the order they were appended."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("day"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 1).alias("seq"), "l_partkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("volume"),
        (F.col("l_linestatus") == "F").cast("int").alias("checked"), "l_returnflag", "l_linenumber", "l_discount",
    )


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sector"))
    return table(spark, sf, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("asset_id"), "sector")


def _panel(spark: SparkSession, sf: str, day) -> DataFrame:
    bars = observations(spark, sf).groupBy("asset_id", day.alias("day")).agg(
        (F.sum(F.col("value").cast("decimal(14,2)")).cast("double") / F.sum("volume")).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("volume").alias("volume")
    )
    return bars.join(sectors(spark, sf), "asset_id")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """asset_id, day, close, high, low, volume, sector."""
    return _panel(spark, sf, F.col("day"))


def closes(spark: SparkSession, sf: str) -> DataFrame:
    """asset_id, day, close of :func:`daily`, placed by asset: what follows along an asset's days needs no second shuffle.

    Division is that of doubles in SQL (infinite or NaN by zero). Assets come with or
    without a sector; :func:`sectors` tells which have one.
    """
    li = table(spark, sf, "lineitem").where("l_suppkey is not null")
    rows = li.select(F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("volume"))
    bars = rows.repartition("asset_id").groupBy("asset_id", "day").agg(F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("value"), F.sum("volume").alias("volume"))
    return bars.select("asset_id", "day", divided("value", "volume").alias("close"))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """The same at month grain, where the cross-section is dense."""
    return _panel(spark, sf, F.trunc("day", "month"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse set of asset days."""
    return observations(spark, sf).where("l_returnflag = 'R' and l_linenumber = 1 and l_discount >= 0.09").select("asset_id", "day").distinct()


def events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


OBS_SQL = """obs as (select l_suppkey asset_id, l_shipdate::date as day, l_orderkey * 1000 + l_linenumber seq, l_partkey, l_extendedprice / l_quantity price, l_extendedprice l_value,
    l_quantity volume, (l_linestatus = 'F')::int checked, l_returnflag, l_linenumber, l_discount from lineitem),
sectors as (select s_suppkey asset_id, n_regionkey sector from supplier join nation on s_nationkey = n_nationkey)"""
_BARS = "select asset_id, {day} as day, sum(l_value::decimal(14,2))::double / sum(volume) as close, max(price) as high, min(price) as low, sum(volume) as volume, min(sector) as sector from obs join sectors using (asset_id) group by 1, 2"
DAILY_SQL = f"{OBS_SQL}, daily as ({_BARS.format(day='day')})"
MONTHLY_SQL = f"{OBS_SQL}, monthly as ({_BARS.format(day="date_trunc('month', day)::date")})"
ACTIONS_SQL = "actions as (select distinct asset_id, day from obs where l_returnflag = 'R' and l_linenumber = 1 and l_discount >= 0.09)"
EVENTS_SQL = "ev as (select event_id, ts, user_id, event_type, value, props from events)"
