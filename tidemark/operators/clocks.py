"""Who knew what when: revisions, as-of joins in both directions, validity, session calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_by(df: DataFrame, available_at: str, cutoff: Column, verified: str | None = None) -> DataFrame:
    """Rows available at or before ``cutoff``; with ``verified``, only those proven point in time."""
    kept = df.where(F.col(available_at) <= cutoff)
    return kept.where(F.col(verified) == 1) if verified else kept


def latest_revision(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in ``order`` (best first, with all tie-breakers)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def latest_struct(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The same by a partial aggregate, for keys that may be hot: maximum of ``order``, ties by ``payload``."""
    best = F.max(F.struct(*order, *payload)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *payload]])


def revision_kinds(df: DataFrame, keys: Sequence[str], order: Sequence[str], version: str) -> DataFrame:
    """Number and kind of every observation: ``initial``, ``unchanged``, ``revision`` or ``reversion``.

    A reversion brings back a version seen before the last change.  The kind
    compares null versions as values.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(version).over(w)
    first_seen = F.min("observation_number").over(Window.partitionBy(*keys, version))
    n = F.col("observation_number")
    kind = (
        F.when(n == 1, "initial").when(F.col(version).eqNullSafe(F.col("_before")), "unchanged")
        .when(F.col("_first") < n, "reversion").otherwise("revision")
    )
    out = df.withColumn("observation_number", F.row_number().over(w)).withColumn("_before", before).withColumn("_first", first_seen)
    return out.withColumn("kind", kind).drop("_before", "_first")


def asof_backward(probes: DataFrame, facts: DataFrame, key: str, at: str, payload: Sequence[str]) -> DataFrame:
    """Each probe with the ``payload`` of the latest fact of its key at or before its time.

    Facts and probes are sorted together once within cells of time, so no probe
    meets more than one fact and no key is one task.  Facts of equal time are told
    apart by their payload, last wins.  A probe without a key or time gets nulls.
    """
    return _asof(probes, facts, key, at, payload, forward=False)


def asof_forward_strict(probes: DataFrame, facts: DataFrame, key: str, at: str, payload: Sequence[str]) -> DataFrame:
    """Each probe with the first fact of its key strictly after its time."""
    return _asof(probes, facts, key, at, payload, forward=True)


def _asof(probes: DataFrame, facts: DataFrame, key: str, at: str, payload: Sequence[str], forward: bool, cell_days: int = 8) -> DataFrame:
    clash = set(probes.columns) & set(payload)
    if clash:
        raise ValueError(f"payload columns {sorted(clash)} also are columns of the probes")
    found = F.struct(F.col(at).alias("_at"), *payload)
    kind = facts.select(found.alias("f")).schema["f"].dataType
    row = F.struct(*probes.columns)
    probe_kind = probes.select(row.alias("p")).schema["p"].dataType
    p = probes.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_tie"), row.alias("_p"), F.lit(None).cast(kind).alias("_f"))
    f = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_tie"), F.lit(None).cast(probe_kind).alias("_p"), found.alias("_f")
    )
    # a key is cut into cells of time, so that one with many rows is many tasks; what a cell begins with is carried into it
    cell = F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / F.lit(cell_days * 86_400_000_000))
    rows = p.unionByName(f).withColumn("_c", cell)
    edge = (F.min if forward else F.max)(F.when(F.col("_tie") == 0, F.col("_f"))).alias("_f")
    cells = rows.groupBy("_k", "_c").agg(edge)
    before = Window.partitionBy("_k").orderBy(F.col("_c").desc() if forward else "_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("_k", "_c", F.last("_f", ignorenulls=True).over(before).alias("_f")).where("_f is not null and _c is not null")
    carried = carried.select("_k", F.col("_f._at").alias("_t"), F.lit(0).alias("_tie"), F.lit(None).cast(probe_kind).alias("_p"), "_f", "_c")
    # backward: facts before probes of equal time; forward and strict: read from the end, facts of equal time after probes
    order = [F.col("_t").desc(), F.col("_tie").desc(), F.col("_f").desc()] if forward else ["_t", "_tie", "_f"]
    w = Window.partitionBy("_k", "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.unionByName(carried).withColumn("_f", F.last("_f", ignorenulls=True).over(w)).where("_tie = 1")
    return joined.select("_p.*", *[F.col(f"_f.{c}").alias(c) for c in payload], F.col("_f._at").alias("fact_at"))


def within_validity(at: Column, valid_from: Column, valid_to: Column, closed: bool = False) -> Column:
    """Half-open validity with open ends where null; ``closed`` includes the end."""
    after = valid_from.isNull() | (valid_from <= at)
    return after & (valid_to.isNull() | ((at <= valid_to) if closed else (at < valid_to)))


def interval_membership(points: DataFrame, spans: DataFrame, key: str, at: str, valid_from: str, valid_to: str, payload: Sequence[str]) -> DataFrame:
    """Points with every span of their key that holds them, half open.

    An equi-join on the key with the range as a condition; where one key has very
    many spans, give it a time bucket as part of the key first.
    """
    s = spans.select(F.col(key).alias("_k"), F.col(valid_from).alias("_lo"), F.col(valid_to).alias("_hi"), *payload)
    cond = (F.col(key) == F.col("_k")) & within_validity(F.col(at), F.col("_lo"), F.col("_hi"))
    return points.join(s, cond).drop("_k", "_lo", "_hi")


def session_calendar(days: DataFrame, sessions: DataFrame, day: str = "day") -> DataFrame:
    """Every calendar day with its own session, if it is one, and the next later session."""
    spine = days.select(day).distinct().withColumn("_s", F.lit(0)).unionByName(sessions.select(day).distinct().withColumn("_s", F.lit(1)))
    marked = spine.groupBy(day).agg(F.max("_s").alias("is_session"), F.max(F.lit(1) - F.col("_s")).alias("asked"))
    # days are few (a century has 36,525), so one ordered pass is fine
    after = Window.partitionBy(F.lit(0)).orderBy(day).rowsBetween(1, Window.unboundedFollowing)
    session = F.when(F.col("is_session") == 1, F.col(day))
    return marked.select(day, session.alias("same_session"), F.min(session).over(after).alias("next_session"), "asked").where("asked = 1").drop("asked")


def known_history(
    probes: DataFrame, facts: DataFrame, probe_id: str, key: str, at: str, day: str, available_at: str, order: Sequence[str], value: str, sessions: int, horizon_days: int
) -> DataFrame:
    """For every probe, the last ``sessions`` days of its key as they were known at its own time.

    Of each day the latest revision known then counts.  Days of the last
    ``horizon_days`` are looked up first, which bounds what most probes meet; only
    probes with fewer than ``sessions`` days there meet the older ones too.
    """
    f = facts.select(F.col(key).alias("_k"), F.col(day).alias("_d"), F.col(available_at).alias("_a"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).alias("_v"))
    known = (F.col(key) == F.col("_k")) & (F.col("_a") <= F.col(at)) & (F.col("_d") <= F.to_date(at))
    recent = F.col("_d") > F.date_sub(F.to_date(at), horizon_days)

    def days(asking: DataFrame, within: Column) -> DataFrame:
        met = asking.join(f, known & within)
        return met.groupBy(probe_id, "_d").agg(F.max_by("_v", F.struct(*[f"_o{i}" for i in range(len(order))], "_v")).alias("value"))

    asking = probes.select(probe_id, key, at)
    near = days(asking, recent)
    full = near.groupBy(probe_id).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= sessions).select(probe_id)
    per_day = near.unionByName(days(asking.join(full, probe_id, "left_anti"), ~recent))
    rn = F.row_number().over(Window.partitionBy(probe_id).orderBy(F.col("_d").desc()))
    return per_day.withColumn("back", rn).where(F.col("back") <= sessions).withColumnRenamed("_d", "day")


def ingested(existing: DataFrame, batch: DataFrame, keys: Sequence[str], content: Sequence[str], order: Sequence[str], ident: str) -> DataFrame:
    """``ident, *keys, version, sequence, kind`` of a batch's observations that are not there yet, numbered on from those that are.

    The version is a hash of the content, so equal content is one version however
    often it is seen; kinds are those of :func:`revision_kinds` over old and new.
    """
    version = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    cols = [ident, *keys, *order]
    both = existing.select(*cols, version.alias("version"), F.lit(0).alias("_new")).unionByName(
        batch.dropDuplicates([ident]).join(existing.select(ident), ident, "left_anti").select(*cols, version.alias("version"), F.lit(1).alias("_new"))
    )
    kinds = revision_kinds(both, keys, ["_new", *order, ident], "version")
    return kinds.where("_new = 1").select(ident, *keys, "version", F.col("observation_number").cast("long").alias("sequence"), "kind")


def reaction_origins(events: DataFrame, closes: DataFrame, key: str, at: str, close_at: str, position: str) -> DataFrame:
    """Events with the last session of their key that was complete by then: its ``position`` and close time as ``origin_*``; null before the first."""
    facts = closes.select(key, F.col(close_at).alias(at), F.col(position).alias("origin_position"))
    return asof_backward(events, facts, key, at, ["origin_position"]).withColumnRenamed("fact_at", "origin_at")
