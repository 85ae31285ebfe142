"""Trailing totals, as-known versions, orphans and K-slack against brute force on small, dirty inputs."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.bitemporal import as_known, version_rectangles
from tidemark.operators.kslack import HOUR, k_slack, released, released_counts, timeline
from tidemark.operators.orphans import encode_keys, key_bitmaps, orphan_references, packed, packed_and_not, unpacked
from tidemark.operators.rolling_totals import latest_daily_value, rolling_totals
from tidemark.plans import pipeline
from tidemark.streaming.streams import k_slack_buffer

D0 = date(2024, 1, 1)
T0 = datetime(2024, 1, 1)


def test_rolling_totals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), D0 + timedelta(days=rng.randrange(0, 400)) if rng.random() > 0.05 else None, rng.choice([None, 0, 5, 7])) for _ in range(300)]
    df = spark.createDataFrame(rows, "entity long, day date, value long")
    got = {(r.entity, r.calendar_day): r for r in rolling_totals(df, windows=(7, 30), block_days=16).collect()}
    daily = {}
    for e, d, v in rows:
        if None not in (e, d, v):
            daily.setdefault(e, {}).setdefault(d, 0)
            daily[e][d] += v
    want = 0
    for e, days in daily.items():
        d = min(days)
        while d <= max(days):
            r = got[e, d]
            for w in (7, 30):
                inside = [days[d - timedelta(days=i)] for i in range(w) if d - timedelta(days=i) in days]
                assert (r[f"total_{w}"], r[f"active_days_{w}"]) == (sum(inside), len(inside))
                assert r[f"avg_day_{w}"] == pytest.approx(sum(inside) / w)
                assert r[f"avg_active_{w}"] == (pytest.approx(sum(inside) / len(inside)) if inside else None)
            d += timedelta(days=1)
            want += 1
    assert want == len(got)


def test_rolling_totals_edges(spark):
    empty = spark.createDataFrame([], "entity long, day date, value double, c int, e int, v int")
    assert rolling_totals(empty).count() == 0
    with pytest.raises(ValueError):
        rolling_totals(empty, windows=(0,))
    points = spark.createDataFrame(
        [(1, D0, 1, 5.0), (1, D0, 1, 5.0), (1, D0, 2, None), (1, D0 + timedelta(1), 1, 0.0), (1, D0 + timedelta(2), 1, 3.0), (None, D0, 1, 1.0)],
        "a long, d date, s int, x double",
    )
    got = latest_daily_value(points, "a", "d", "s", "x", F.col("value") > 0).collect()
    assert [(r.entity, r.day, r.value) for r in got] == [(1, D0 + timedelta(2), 3.0)]  # a withdrawn close does not come back


def test_p1_totals_days_without_usable_close(spark, tmp_path):
    day = lambda i: D0 + timedelta(i)
    rows = [(1, day(0), 1, None), (1, day(2), 1, 4.0), (1, day(4), 1, 2.0), (1, day(6), 1, 9.0), (1, day(6), 2, None), (1, day(12), 1, 0.0), (2, day(3), 1, 0.0), (2, day(4), 1, None), (None, day(0), 1, 1.0)]
    spark.createDataFrame(rows, "asset_id long, trading_day date, observation_sequence int, raw_close double").write.parquet(f"{tmp_path}/temporal_price_points.parquet")
    got = {(r.asset_id, r.calendar_day): r for r in pipeline.p1_totals(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, str(day(i))) for i in range(13)} | {(2, str(day(i))) for i in (3, 4)}
    closes = {2: 4.0, 4: 2.0}
    for (asset, d), r in got.items():
        at = (date.fromisoformat(d) - D0).days
        for w in (7, 30):
            inside = [v for i, v in closes.items() if asset == 1 and at - w < i <= at]
            want = (sum(inside), len(inside), sum(inside) / w, sum(inside) / len(inside) if inside else None)
            assert (r[f"total_{w}"], r[f"active_days_{w}"], r[f"avg_day_{w}"], r[f"avg_active_{w}"]) == pytest.approx(want)
    # p1_found keeps to the span of usable days
    assert pipeline.p1_found(spark, str(tmp_path)).count() == 0


def _facts(rng, n):
    return [(rng.choice(["a", "a", "a", "b", None]), T0 + timedelta(hours=rng.randrange(0, 2000)) if rng.random() > 0.1 else None, D0 + timedelta(days=rng.randrange(0, 40)), rng.randrange(0, 3), f"v{i:04d}") for i in range(n)]


def test_as_known_brute_force(spark):
    rng = random.Random(2)
    facts = _facts(rng, 200)
    events = [(f"e{i}", rng.choice(["a", "b", "c", None]), T0 + timedelta(hours=rng.randrange(-10, 2200)) if rng.random() > 0.1 else None) for i in range(120)]
    f = spark.createDataFrame(facts + facts[:20], "k string, r timestamp_ntz, day date, seq int, id string")
    e = spark.createDataFrame(events + events[:5], "e string, k string, t timestamp_ntz")
    got = {r.e: r.known_id for r in as_known(e, f, "e", "k", "t", "k", "r", ("day", "seq"), "id", cell_days=3).collect()}
    assert len(got) == len(events)
    for name, k, t in events:
        known = [(d, s, i) for fk, r, d, s, i in facts if fk == k and k is not None and r is not None and t is not None and r <= t]
        assert got[name] == (max(known)[2] if known else None)


def test_rectangles_are_disjoint_and_cover(spark):
    f = spark.createDataFrame(_facts(random.Random(3), 150), "k string, r timestamp_ntz, day date, seq int, id string")
    rows = version_rectangles(f, "k", "r", ("day", "seq"), "id", cell_days=5).collect()
    by_cell = {}
    for r in rows:
        assert r.rec_from < r.rec_to
        by_cell.setdefault((r.k, r.cell), []).append((r.rec_from, r.rec_to))
    for spans in by_cell.values():
        spans.sort()
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert as_known(f.select("id", "k", "r").limit(0), f, "id", "k", "r", "k", "r", ("day",), "id").count() == 0


def test_orphans_brute_force(spark):
    rng = random.Random(4)
    keys = [-1, 0, 5, 70000, 70001, 2**40, None]
    spans = []
    for _ in range(25):
        lo = T0 + timedelta(days=rng.randrange(0, 300), hours=rng.randrange(24))
        spans.append((rng.choice(keys), lo, lo + timedelta(days=rng.randrange(1, 200)) if rng.random() > 0.3 else None))
    spans.append((5, T0, None))
    refs = [(f"r{i}", rng.choice(keys), T0 + timedelta(days=rng.randrange(-20, 500), hours=rng.randrange(24)) if rng.random() > 0.1 else None) for i in range(300)]
    p = spark.createDataFrame(spans, "key long, lo timestamp_ntz, hi timestamp_ntz")
    r = spark.createDataFrame(refs + refs[:10], "id string, key long, at timestamp_ntz")
    got = {x.ref_id for x in orphan_references(r, "id", "key", "at", p, "key", "lo", "hi").collect()}
    want = set()
    for name, k, at in refs:
        own = [(lo, hi) for pk, lo, hi in spans if pk == k]
        ok = bool(own) if at is None else any(lo <= at and (hi is None or at < hi) for lo, hi in own)
        if k is not None and not ok:
            want.add(name)
    assert got == want
    assert orphan_references(r.limit(0), "id", "key", "at", p, "key", "lo", "hi").count() == 0
    assert orphan_references(r, "id", "key", "at", p.limit(0), "key", "lo", "hi").count() == sum(k is not None for _, k, _ in refs)


def test_key_dictionary_and_bitmaps(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "k string")
    codes = {r.key: r.code for r in encode_keys(a, a, "k", "k", buckets=1).collect()}
    assert set(codes) == {"x", "y"} and len(set(codes.values())) == 2
    bits = key_bitmaps(spark.createDataFrame([(-1,), (-1,), (32767,), (32768,)], "k long"), "k").collect()
    assert sorted(r.range for r in bits) == [-1, 0, 1]


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_k_slack_brute_force(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice(["s", "t", None]), f"o{i}", T0 + timedelta(hours=rng.randrange(0, 200)) if rng.random() > 0.1 else None, rng.randrange(0, 60)) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:9], "k string, id string, t timestamp_ntz, seq int")
    got = {r.id: (r.outcome, r.behind) for r in k_slack(df, ["k"], "id", "t", "seq", 48 * HOUR, block).collect()}
    assert len(got) == len(rows)
    for k, i, t, s in rows:
        before = [u for kk, _, u, ss in rows if kk == k and ss < s and u is not None]
        if t is None:
            assert got[i][0] == "untimed"
            continue
        late = max(before) - t if before else timedelta(0)
        want = "in_order" if late <= timedelta(0) else "corrected" if late <= timedelta(hours=48) else "dropped"
        assert got[i][0] == want


def test_released_counts(spark):
    rows = [("k", "a", T0, 1), ("k", "b", T0 + timedelta(hours=60), 2), ("k", "c", T0 + timedelta(hours=30), 3), ("k", "d", T0 + timedelta(hours=1), 4)]
    df = spark.createDataFrame(rows, "k string, id string, t timestamp_ntz, seq int")
    slack = k_slack(df, ["k"], "id", "t", "seq")
    r = released_counts(slack, released(slack, ["k"], "id"), ["k"], "id").collect()[0]
    assert (r.n_arrived, r.n_in_order, r.n_corrected, r.n_dropped, r.n_final, r.n_provisional) == (4, 2, 1, 1, 3, 2)
    assert (r.first_id, r.last_id, r.longest_step) == ("a", "b", 30 * HOUR)
    none = slack.limit(0)
    assert released_counts(none, released(none, ["k"], "id"), ["k"], "id").count() == 0 and timeline(released(none, ["k"], "id"), ["k"]).count() == 0


def _replay(rows, bound):
    """A buffer by hand: id -> (arrival that releases it, event time before it), and counts after each arrival of a key."""
    out, line = {}, {}
    for key in {r[0] for r in rows}:
        high, held, gone, mine = None, [], [], [r for r in rows if r[0] == key]
        kept = 0
        for a in sorted({r[3] for r in mine}):
            now = [r for r in mine if r[3] == a and r[2] is not None]
            fresh = [(t, a, i) for _, i, t, _ in now if high is None or high - t <= bound]
            held, kept = held + fresh, kept + len(fresh)
            high = max([t for _, _, t, _ in now] + ([high] if high is not None else []), default=None)
            free = sorted(x for x in held if high is not None and high - x[0] >= bound)
            for x in free:
                out[x[2]] = (a, x[0] - gone[-1][0] if gone else None)
                gone.append(x)
            held = [x for x in held if x not in free]
            if fresh or free:
                line[key, a] = (kept, len(gone))
        for x in sorted(held):
            out[x[2]] = (None, x[0] - gone[-1][0] if gone else None)
            gone.append(x)
    return out, line


@pytest.mark.parametrize("width", [HOUR, 32 * 24 * HOUR])
def test_released_brute_force(spark, width):
    rng = random.Random(6)
    hours = [(rng.choice(["s", "t", None]), f"o{i:03d}", rng.randrange(0, 300) if rng.random() > 0.1 else None, rng.randrange(0, 80)) for i in range(240)]
    rows = [(k, i, None if h is None else T0 + timedelta(hours=h), a) for k, i, h, a in hours]
    slack = k_slack(spark.createDataFrame(rows + rows[:5], "k string, id string, t timestamp_ntz, seq int"), ["k"], "id", "t", "seq")
    out = released(slack, ["k"], "id", width=width)
    want, line = _replay(hours, 48)
    assert {r.id: (r.released_at, None if r.since is None else r.since // HOUR) for r in out.collect()} == want
    got = {(r.k, r.arrival): (r.n_provisional, r.n_final) for r in timeline(out, ["k"], block=7 if width == HOUR else 1 << 16).collect()}
    assert got == line


def test_k_slack_buffer_stream(spark, tmp_path):
    """The stream releases what the batch releases, over several batches with state, and flushes silent keys."""
    rng = random.Random(7)
    hours = sorted(((rng.choice(["s", "t"]), f"o{i:03d}", rng.randrange(0, 300) if rng.random() > 0.1 else None, i) for i in range(120)), key=lambda r: r[3])
    hours += [("late", "z", 5000, 1000)]
    rows = [(k, i, None if h is None else T0 + timedelta(hours=h), a) for k, i, h, a in hours]
    schema = "k string, id string, t timestamp_ntz, a int"
    for n, part in enumerate((rows[:50], rows[50:90], rows[90:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = k_slack_buffer(stream, ["k"], "id", "t", "a", 48 * HOUR).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want, _ = _replay(hours, 48)
    assert {r.id: r.released_at for r in got if r.kind == "released"} == {i: a for i, (a, _) in want.items() if a is not None}
    assert {r.id for r in got if r.kind == "flushed"} == {i for i, (a, _) in want.items() if a is None and i != "z"}
    assert {r.id for r in got if r.kind == "dropped"} == {i for _, i, h, _ in hours if h is not None} - set(want)
    assert {r.id for r in got if r.kind == "untimed"} == {i for _, i, h, _ in hours if h is None}
    assert max(r.n for r in got if r.kind == "provisional" and r.k == "s") == sum(k == "s" and i in want for k, i, _, _ in hours)


def test_valid_and_known_brute_force(spark):
    rng = random.Random(8)
    facts = [(rng.choice([1, 2, None]), D0 + timedelta(days=rng.randrange(0, 60)) if rng.random() > 0.05 else None, rng.randrange(1, 4), T0 + timedelta(days=rng.randrange(0, 90), hours=rng.randrange(24)) if rng.random() > 0.05 else None, f"f{i:03d}") for i in range(150)]
    events = [(f"e{i}", rng.choice([1, 2, 3, None]), T0 + timedelta(days=rng.randrange(-5, 100)), D0 + timedelta(days=rng.randrange(-10, 80)) if rng.random() > 0.1 else None) for i in range(120)]
    f = spark.createDataFrame(facts + facts[:7], "k long, d date, s int, r timestamp_ntz, id string").withColumn("e", F.lit(1)).withColumn("u", F.lit(2))
    e = spark.createDataFrame(events + events[:5], "e string, k long, t timestamp_ntz, v date")
    got = {r.e: r.known_id for r in as_known(e, f, "e", "k", "t", "k", "r", ("d", "s"), "id", valid_at="v").collect()}
    for name, k, t, v in events:
        known = [(d, s, i) for kk, d, s, r, i in facts if k is not None and v is not None and kk == k and d is not None and r is not None and r <= t and d <= v]
        assert got[name] == (max(known)[2] if known else None)
    assert as_known(e, f.limit(0), "e", "k", "t", "k", "r", ("d", "s"), "id", valid_at="v").where("known_id is null").count() == len(events)


def test_containers():
    rng = np.random.default_rng(2)
    sets = [np.array([], int), np.array([0]), np.array([32767]), np.arange(32768), np.arange(5, 900), np.flatnonzero(rng.random(32768) < 0.5), np.sort(rng.choice(32768, 40, replace=False)), np.concatenate([np.arange(10), np.arange(20, 4000)])]
    kinds = set()
    for a in sets:
        kinds.add(packed(a)[0])
        assert unpacked(packed(a)).tolist() == a.tolist()
        assert packed_and_not(packed(a), None).tolist() == a.tolist()
        for b in sets:
            assert packed_and_not(packed(a), packed(b)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert kinds == {0, 1, 2} and len(packed(np.arange(32768))) == 5


def test_orphans_with_text_keys(spark):
    r = spark.createDataFrame([("1", "äb", T0), ("2", "c", T0), ("3", "äb", T0 + timedelta(days=400)), ("4", None, T0), ("5", "äb", None), ("6", "zz", None)], "id string, key string, at timestamp_ntz")
    p = spark.createDataFrame([("äb", T0 - timedelta(days=90), T0 + timedelta(days=90), 1)], "key string, lo timestamp_ntz, hi timestamp_ntz, id int")
    assert {x.ref_id for x in orphan_references(r, "id", "key", "at", p, "key", "lo", "hi").collect()} == {"2", "3", "6"}
