"""Versions as they were known: disjoint current-version regions, a grid over them, and point location.

The plane has valid time on one axis and recorded time on the other.  A version
takes the region recorded at or after its own recording in which no better
version (a later valid day, then a higher sequence) is recorded yet.  For events
that ask for the latest valid state, that is the upper strip of the plane; cut at
the version's recording and at the next better one it becomes rectangles which
are disjoint and together cover all recorded time from the first recording on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import micros

DAY = 86_400_000_000


def _facts(facts: DataFrame, key: str, recorded_at: str, order: Sequence[str], payload: str, cell: int) -> DataFrame:
    return (
        facts.select(
            F.col(key).alias("k"), micros(recorded_at).alias("r"),
            F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(payload).alias("id")).alias("ver"),
        )
        .where("k is not null and r is not null")
        .withColumn("cell", F.floor(F.col("r") / F.lit(cell)))
    )


def version_rectangles(
    facts: DataFrame,
    key: str,
    recorded_at: str,
    order: Sequence[str],
    payload: str,
    cells: DataFrame | None = None,
    cell_days: int = 16,
) -> DataFrame:
    """Disjoint rectangles of the version current at each recorded time, clipped to the cells of a grid.

    ``order`` lists what makes a version better, most important first; its first
    column is the valid day.  Ties in all of it go to the higher ``payload``.
    ``cells`` (columns ``k, cell``) names further cells that must be covered; a
    cell without new recordings then gets the rectangle carried into it.
    Returns ``k, cell, rec_from, rec_to`` (micros, half open), ``valid_from`` and
    ``ver``.  Rows with a null key or recording never were known and are left out.

    A key with very many versions is split by cell: only one best version a cell
    passes through the per-key window.
    """
    width = cell_days * DAY
    rows = _facts(facts, key, recorded_at, order, payload, width).groupBy("k", "cell", "r").agg(F.max("ver").alias("ver"))
    best = rows.groupBy("k", "cell").agg(F.max("ver").alias("ver"))
    if cells is not None:
        empty = F.lit(None).cast(best.schema["ver"].dataType).alias("ver")
        best = best.unionByName(cells.select("k", "cell", empty)).groupBy("k", "cell").agg(F.max("ver").alias("ver"))
    before = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = best.select("k", "cell", F.max("ver").over(before).alias("ver")).where("ver is not null")
    carried = carried.select("k", "cell", (F.col("cell") * F.lit(width) - 1).alias("r"), "ver")
    in_cell = Window.partitionBy("k", "cell").orderBy("r")
    beaten = F.max("ver").over(in_cell.rowsBetween(Window.unboundedPreceding, -1))
    kept = (
        rows.unionByName(carried)
        .withColumn("beaten", beaten)
        .where(F.col("beaten").isNull() | (F.col("ver") > F.col("beaten")))
    )
    end = (F.col("cell") + 1) * F.lit(width)
    return kept.select(
        "k", "cell", F.greatest("r", F.col("cell") * F.lit(width)).alias("rec_from"),
        F.coalesce(F.lead("r").over(in_cell), end).alias("rec_to"),
        F.col("ver.o0").alias("valid_from"), "ver",
    ).where("rec_from < rec_to")


def as_known(
    events: DataFrame,
    facts: DataFrame,
    event_id: str,
    event_key: str,
    event_time: str,
    key: str,
    recorded_at: str,
    order: Sequence[str],
    payload: str,
    cell_days: int = 16,
    valid_at: str | None = None,
) -> DataFrame:
    """``event_id, known_id``: the version of the event's key current at the event's time.

    With ``valid_at``, the day for which the event asks, the version is the one
    valid then as it was known at the event's time: of the versions recorded by
    then whose valid day is not later, the one of the latest valid day, then best
    in the rest of ``order``.  Without it events ask for the latest day known.

    What was recorded at exactly the event's time is known.  Events with a null
    key or time, or before the first recording, get a null ``known_id``.  Exact
    copies of an event give one row; other columns play no part.

    Each event point falls into one grid cell and there into one rectangle; both
    are sorted together, so the cost is linear however many meet in a cell.
    """
    if valid_at is not None:
        return _valid_and_known(events, facts, event_id, event_key, event_time, key, recorded_at, order, payload, cell_days, valid_at)
    width = cell_days * DAY
    points = (
        events.select(F.col(event_id).alias("e"), F.col(event_key).alias("k"), micros(event_time).alias("t"))
        .distinct()
        .withColumn("cell", F.floor(F.col("t") / F.lit(width)))
    )
    placed = points.where("k is not null and t is not null")
    # several events of a key in a cell are one cell to cover
    rects = version_rectangles(facts, key, recorded_at, order, payload, placed.select("k", "cell").distinct(), cell_days)
    kind = dict(rects.dtypes)["ver"]
    e_type = dict(points.dtypes)["e"]
    both = rects.select(
        "k", "cell", F.col("rec_from").alias("t"), F.lit(0).alias("is_event"), "ver", F.lit(None).cast(e_type).alias("e")
    ).unionByName(placed.select("k", "cell", "t", F.lit(1).alias("is_event"), F.lit(None).cast(kind).alias("ver"), "e"))
    upto = Window.partitionBy("k", "cell").orderBy("t", "is_event").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("ver", F.last("ver", ignorenulls=True).over(upto)).where("is_event = 1")
    unplaced = points.where("k is null or t is null").select("e", F.lit(None).cast(kind).alias("ver"))
    return found.select("e", "ver").unionByName(unplaced).select(F.col("e").alias(event_id), F.col("ver.id").alias("known_id"))


def _valid_and_known(
    events: DataFrame, facts: DataFrame, event_id: str, event_key: str, event_time: str, key: str, recorded_at: str, order: Sequence[str], payload: str, cell_days: int, valid_at: str
) -> DataFrame:
    """Point location on both axes: valid time is cut into ranges that halve from level to level, recorded time into cells.

    A version lies in one range of every level, and within a range the region in
    which it is the best one recorded is a rectangle.  The days up to the one an
    event asks for are at most one range a level, so an event is located in a few
    rectangles, of which the one of the latest valid day counts.  There are as many
    levels as the span of valid days has binary digits.
    """
    day = F.unix_date(F.col(order[0]).cast("date"))
    least, most = facts.agg(F.min(day), F.max(day)).first()
    none = events.select(F.col(event_id).alias("e")).distinct()
    if least is None:
        return none.select(F.col("e").alias(event_id), F.lit(None).cast(dict(facts.dtypes)[payload]).alias("known_id"))
    levels = max(1, (most - least + 1).bit_length())
    each = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    inside = facts.where(F.col(key).isNotNull() & day.isNotNull()).withColumn("_v", day - least).withColumn("_level", each)
    inside = inside.withColumn("_k", F.struct(F.col(key).alias("key"), "_level", F.expr("shiftright(_v, _level)").alias("range")))
    # the days 0..u are one range for every binary digit of u + 1
    wanted = F.unix_date(F.col(valid_at).cast("date"))
    upto = F.when(wanted.isNotNull(), F.least(wanted, F.lit(most)) - least + 1)
    asked = events.select(F.col(event_id).alias("e"), F.col(event_key).alias("key"), F.col(event_time).alias("at"), upto.alias("u")).distinct()
    asked = asked.where("key is not null and at is not null and u > 0").withColumn("_level", each).where("shiftright(u, _level) & 1 = 1")
    kind = dict(inside.dtypes)["_k"]
    asked = asked.select("e", "at", F.struct("key", "_level", F.expr("shiftright(u, _level) - 1").alias("range")).cast(kind).alias("_k"))
    best = F.struct(*order, payload)
    near = as_known(asked.withColumn("_p", F.struct("e", "_k")), inside.withColumn("_best", best), "_p", "_k", "at", "_k", recorded_at, order, "_best", cell_days)
    found = near.where("known_id is not null").groupBy(F.col("_p.e").alias("e")).agg(F.max("known_id")[payload].alias("known_id"))
    return none.join(found, "e", "left").select(F.col("e").alias(event_id), "known_id")
