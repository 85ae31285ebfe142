"""K-slack reordering of events that arrive late, for batches; its twin on streams is ``streams.k_slack_buffer``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import micros

HOUR = 3_600_000_000


def k_slack(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    event_time: str,
    arrival: str,
    bound_micros: int = 48 * HOUR,
    block: int = 1 << 16,
) -> DataFrame:
    """Replay the arrivals of each key through a buffer of ``bound_micros`` of event time.

    Returns ``*keys, row_id, t, arrival, high, behind, outcome, buffered``.  ``high``
    is the latest event time that arrived before (null for none), ``behind``
    is how far the event lies behind the latest event time that arrived before it
    (rows of the same ``arrival`` arrive together); ``outcome`` is ``in_order``
    where that is not positive, ``corrected`` where the buffer can still put the
    row in its place, ``dropped`` beyond the bound.  ``buffered`` says that the
    buffer still held the row when the input ended, so what it counts for is
    provisional.  Copies give one row; a null time is ``untimed`` and moves
    nothing; null keys are values like others; a null arrival arrives first.

    The latest time before a row is a running maximum.  It is taken inside blocks
    of ``block`` arrivals and carried from block to block, so one key with a third
    of all rows is worked on by many tasks.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.col(row_id).alias("id"), micros(event_time).alias("t"),
        F.coalesce(F.col(arrival).cast("long"), F.lit(-(2**62))).alias("a"),
    ).distinct().withColumn("b", F.floor(F.col("a") / F.lit(block)))
    tops = rows.groupBy(*names, "b").agg(F.max("t").alias("top"))
    order = Window.partitionBy(*names).orderBy("b")
    carried = tops.select(
        *names, "b", F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.max("top").over(Window.partitionBy(*names)).alias("final"),
    )
    same = reduce(lambda x, y: x & y, [F.col(f"r.{n}").eqNullSafe(F.col(f"c.{n}")) for n in names])
    joined = rows.alias("r").join(carried.alias("c"), same & (F.col("r.b") == F.col("c.b"))).select("r.*", "carry", "final")
    inside = Window.partitionBy(*names, "b").orderBy("a").rangeBetween(Window.unboundedPreceding, -1)
    high = F.greatest("carry", F.max("t").over(inside))
    behind = F.col("high") - F.col("t")
    outcome = (
        F.when(F.col("t").isNull(), "untimed")
        .when(F.col("high").isNull() | (behind <= 0), "in_order")
        .when(behind <= bound_micros, "corrected")
        .otherwise("dropped")
    )
    return joined.withColumn("high", high).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)],
        F.col("id").alias(row_id), "t", F.col("a").alias("arrival"), "high", F.greatest(behind, F.lit(0)).alias("behind"),
        outcome.alias("outcome"),
        F.coalesce((outcome != "dropped") & (F.col("t") > F.col("final") - bound_micros), F.lit(False)).alias("buffered"),
    )


def released(slack: DataFrame, keys: Sequence[str], row_id: str, bound_micros: int = 48 * HOUR, width: int = 32 * 24 * HOUR) -> DataFrame:
    """The rows that the buffer takes, with ``released_at`` and ``since``: when each leaves it, and how long after the one before.

    The buffer is full of what arrived and not yet sure to be next: a row leaves it
    with the first arrival after which the latest time lies ``bound_micros`` or more
    ahead of it, null while none has come.  Rows leave in the order of event time,
    arrival and id; ``since`` is the step of event time from the row that left
    before (null for the first).  Whatever arrives later and would have to go before
    a row that has left was ``dropped`` by :func:`k_slack`, so the order is final.

    Rows and the steps of the latest time are merged in buckets of ``width``, with
    what follows from other buckets carried, so one hot key is many tasks.
    """
    same = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]
    key = F.xxhash64(*same).alias("k"), F.struct(*keys).alias("key")
    kept = slack.where(F.col("outcome").isin("in_order", "corrected"))
    steps = slack.groupBy(*keys, "arrival").agg(F.greatest(F.max("high"), F.max("t")).alias("v")).where("v is not null")
    kind = dict(slack.dtypes)[row_id]
    s = steps.select(*key, "v", F.col("arrival").alias("a"), F.lit(0).alias("probe"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("own"), F.lit(None).cast(kind).alias("id"))
    p = kept.select(*key, (F.col("t") + bound_micros).alias("v"), F.lit(None).cast("long").alias("a"), F.lit(1).alias("probe"), "t", F.col("arrival").alias("own"), F.col(row_id).alias("id"))
    both = s.unionByName(p).withColumn("b", F.floor(F.col("v") / width))
    ends = both.groupBy("key", "b").agg(F.min("a").alias("a"), F.max(F.struct("t", "own", "id")).alias("last"))
    across = Window.partitionBy("key").orderBy("b")
    carried = ends.select(
        "key", "b", F.min("a").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
        F.last(F.when(F.col("last.t").isNotNull(), F.col("last")), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    joined = both.alias("x").join(carried.alias("c"), F.col("x.key").eqNullSafe(F.col("c.key")) & (F.col("x.b") == F.col("c.b"))).select("x.*", "later", "before")
    inside = Window.partitionBy("key", "b").orderBy(F.col("v").desc(), "probe").rowsBetween(Window.unboundedPreceding, 0)
    first = F.least(F.min("a").over(inside), F.col("later"))
    # a row that comes exactly at the bound leaves as it comes
    done = joined.withColumn("released_at", F.when(first.isNotNull(), F.greatest(first, F.col("own")))).where("probe = 1")
    order = Window.partitionBy("key", "b").orderBy("t", "own", "id")
    since = F.col("t") - F.coalesce(F.lag("t").over(order), F.col("before.t"))
    return done.select("key.*", F.col("id").alias(row_id), "t", F.col("own").alias("arrival"), "released_at", since.alias("since"))


def timeline(out: DataFrame, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """After every arrival of a key with rows that count: ``n_provisional`` of all that count by then, ``n_final`` of those released.

    ``out`` is what :func:`released` returns.  The difference of both is what the
    buffer holds; provisional values are published from it while it waits.
    """
    came = out.select(*keys, F.col("arrival").alias("a"), F.lit(1).alias("p"), F.lit(0).alias("f"))
    left = out.where("released_at is not null").select(*keys, F.col("released_at").alias("a"), F.lit(0).alias("p"), F.lit(1).alias("f"))
    per = came.unionByName(left).groupBy(F.struct(*keys).alias("key"), "a").agg(F.sum("p").alias("p"), F.sum("f").alias("f")).withColumn("b", F.floor(F.col("a") / block))
    sums = per.groupBy("key", "b").agg(F.sum("p").alias("p"), F.sum("f").alias("f"))
    before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("key", "b", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("cp"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("cf"))
    joined = per.alias("x").join(carried.alias("c"), F.col("x.key").eqNullSafe(F.col("c.key")) & (F.col("x.b") == F.col("c.b"))).select("x.*", "cp", "cf")
    upto = Window.partitionBy("key", "b").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("key.*", F.col("a").alias("arrival"), (F.sum("p").over(upto) + F.col("cp")).alias("n_provisional"), (F.sum("f").over(upto) + F.col("cf")).alias("n_final"))


def released_counts(slack: DataFrame, out: DataFrame, by: Sequence[str], row_id: str) -> DataFrame:
    """Per ``by``: what arrived, what counts once the buffer is drained, what came too late, and what depends on the order.

    ``slack`` is of :func:`k_slack`, ``out`` of :func:`released`.  ``n_provisional`` of
    the ``n_final`` rows are still in the buffer.  ``first_id``, ``last_id`` and
    ``longest_step`` (micros between rows of one key that leave one after the other)
    are of the released order.
    """
    came = slack.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_arrived"),
        F.count_if(F.col("outcome") == "in_order").alias("n_in_order"),
        F.count_if(F.col("outcome") == "corrected").alias("n_corrected"),
        F.count_if(F.col("outcome") == "dropped").alias("n_dropped"),
    )
    place = F.struct("t", "arrival", F.col(row_id))
    went = out.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_final"), F.count_if(F.col("released_at").isNull()).alias("n_provisional"),
        F.min(place)[row_id].alias("first_id"), F.max(place)[row_id].alias("last_id"), F.max("since").alias("longest_step"),
    ).select(*[F.col(b).alias(f"_{b}") for b in by], "n_final", "n_provisional", "first_id", "last_id", "longest_step")
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    joined = came.join(went, same, "left").drop(*[f"_{b}" for b in by])
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_final", "n_provisional")})
