"""Structured Streaming: deduplicated arrivals, windowed counts with late data, and K-slack reordering with state."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(stream: DataFrame, at: str, key: str, late: str = "48 hours") -> DataFrame:
    """Each content id once, as long as copies come within ``late`` of event time."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: Sequence[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts per window and group, corrected by rows up to ``late`` behind the latest time seen."""
    win = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(win, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after ``gap`` without rows."""
    win = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(win, key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def k_slack_stream(stream: DataFrame, key: str, row_id: str, at: str, arrival: str, bound_micros: int) -> DataFrame:
    """Rows of each key with what reordering makes of them: ``in_order``, ``corrected`` or ``dropped``.

    The state of a key is the latest event time that has arrived; rows of one batch
    are taken by ``arrival``, those of equal arrival together.  One key is one task
    a batch, so a hot key wants a finer key (as source, symbol and day are).
    """
    narrow = stream.select(F.col(key).cast("string").alias("key"), F.col(row_id).cast("string").alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(arrival).cast("long").alias("a"))

    def run(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["a", "id"], kind="stable")
        out = []
        for _, same in rows.groupby("a", sort=True):
            for r in same.itertuples():
                if pd.isna(r.t):
                    out.append((group[0], r.id, None, "untimed"))
                    continue
                behind = 0 if high is None else max(0, high - int(r.t))
                out.append((group[0], r.id, behind, "in_order" if behind == 0 else "corrected" if behind <= bound_micros else "dropped"))
            best = same["t"].max()
            if not pd.isna(best):
                high = int(best) if high is None else max(high, int(best))
        if high is not None:
            state.update((high,))
        frame = pd.DataFrame(out, columns=["key", "id", "behind", "outcome"])
        frame["behind"] = frame["behind"].astype("Int64")
        yield frame

    return narrow.groupBy("key").applyInPandasWithState(run, "key string, id string, behind long, outcome string", "high long", "append", GroupStateTimeout.NoTimeout)


def k_slack_buffer(stream: DataFrame, keys: Sequence[str], row_id: str, at: str, arrival: str, bound_micros: int, idle: str = "30 days") -> DataFrame:
    """Rows in the order of event time, held back until nothing that still counts can come before them.

    The state of a key is its latest event time and a buffer.  Rows of a batch are
    taken by ``arrival``, those of equal arrival together.  Emitted are
    ``*keys, kind, id, t, arrival, released_at, n`` with the kinds ``released`` (in
    order, with the arrival that released them), ``dropped`` (more than
    ``bound_micros`` behind), ``untimed`` (no event time) and, after every batch of a
    key, ``provisional``: ``n`` rows released and held so far.  A key that falls
    silent keeps its buffer until the stream's latest time is ``idle`` and the bound
    ahead; then a timer ends it and the rows are ``flushed``.  Rows that far behind
    all keys are beyond the stream's reach.  One key is one task a batch, so a hot
    key wants a finer one (as source, symbol and day are).
    """
    names = [f"k{i}" for i in range(len(keys))]
    ts = F.col(at).cast("timestamp")
    narrow = stream.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)], F.col(row_id).cast("string").alias("id"), ts.alias("ts"), F.unix_micros(ts).alias("t"), F.col(arrival).cast("long").alias("a"))
    kinds = [*[(n, "string") for n in names], ("kind", "string"), ("id", "string"), ("t", "long"), ("arrival", "long"), ("released_at", "long"), ("n", "long")]

    def run(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, n_out, held = state.get if state.exists else (None, 0, "[]")
        buffer = [tuple(x) for x in json.loads(held)]  # event time, arrival, id
        made: list[tuple] = []  # kind, id, t, arrival, released_at, n
        if state.hasTimedOut:
            upto = state.getCurrentWatermarkMs() * 1000 - bound_micros
            made += [("flushed", i, t, a, None, None) for t, a, i in sorted(x for x in buffer if x[0] <= upto)]
            n_out += len(made)
            buffer = [x for x in buffer if x[0] > upto]
        else:
            # most keys have few rows a batch, for which lists are faster than frames
            rows = sorted((int(a), i, None if pd.isna(t) else int(t)) for pdf in pdfs for a, i, t in zip(pdf["a"], pdf["id"], pdf["t"], strict=True))
            for a, same in groupby(rows, key=lambda r: r[0]):
                now = list(same)
                made += [("untimed", i, None, a, None, None) for _, i, t in now if t is None]
                timed = [(t, a, i) for _, i, t in now if t is not None]
                late = [x for x in timed if high is not None and high - x[0] > bound_micros]
                made += [("dropped", i, t, a, None, None) for t, a, i in late]
                buffer += [x for x in timed if high is None or high - x[0] <= bound_micros]
                high = max([t for t, _, _ in timed] + ([] if high is None else [high]), default=None)
                free = [] if high is None else sorted(x for x in buffer if x[0] + bound_micros <= high)
                made += [("released", i, t, own, a, None) for t, own, i in free]
                n_out += len(free)
                if free:
                    buffer = [x for x in buffer if x[0] + bound_micros > high]
        made.append(("provisional", None, None, None, None, n_out + len(buffer)))
        if buffer or high is not None and not state.hasTimedOut:
            state.update((high, n_out, json.dumps(buffer)))
            if buffer:
                state.setTimeoutTimestamp(max((min(buffer)[0] + bound_micros) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        columns = zip(*made, strict=True)
        yield pd.DataFrame({n: pd.Series(list(v), dtype=object) for n, v in zip([n for n, _ in kinds], [*([g] * len(made) for g in group), *columns], strict=True)})

    grouped = narrow.withWatermark("ts", idle).groupBy(*names)
    out = grouped.applyInPandasWithState(run, ", ".join(f"{n} {k}" for n, k in kinds), "high long, n_out long, held string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "kind", F.col("id").alias(row_id), "t", "arrival", "released_at", "n")


def joined_within(later: DataFrame, earlier: DataFrame, key: str, at: str, within: str, late: str) -> DataFrame:
    """Rows of one stream with those of another of their key that came up to ``within`` before, both up to ``late`` out of order.

    The other stream's columns bear ``earlier_`` before their names.  Watermarks on
    both sides bound the state.
    """
    a = later.withWatermark(at, late)
    b = earlier.select(*[F.col(c).alias(f"earlier_{c}") for c in earlier.columns]).withWatermark(f"earlier_{at}", late)
    near = (F.col(f"earlier_{at}") <= F.col(at)) & (F.col(f"earlier_{at}") >= F.col(at) - F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col(f"earlier_{key}")) & near)
