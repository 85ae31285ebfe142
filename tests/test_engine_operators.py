"""Operators that SQL can't check: clusters, publishing, registries, bootstraps, sources, streams; and dirty inputs."""

import gzip
import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as text_fns
from tidemark.operators import audit, clocks, distribution, documents, graph, lake, panel, registry, scoring, splits
from tidemark.sources import readers
from tidemark.streaming import streams

T0 = datetime(2024, 1, 1)


def test_causal_clusters_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        if rng.random() < 0.6 and len(words) > 8:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words) if rng.random() > 0.05 else rng.choice([None, "", " "]), rng.choice([1, 1, 2, None]), T0 + timedelta(hours=rng.randrange(0, 400)) if rng.random() > 0.05 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, asset_id long, at timestamp_ntz").withColumn("root", F.lit("clash"))
    got = {r.doc: (r.cluster, r.reason) for r in documents.causal_clusters(df, "doc_id", "text", "asset_id", "at").collect()}

    def sh(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {}
    done = sorted((r for r in rows if r[3] is not None and r[2] is not None), key=lambda r: (r[3], r[0]))
    for i, t, a, at in rows:
        want[i] = (i, "anchor")
    for k, (i, t, a, at) in enumerate(done):
        n = len((t or "").split())
        if n < 8:
            continue
        before = [r for r in done[:k] if r[2] == a and len((r[1] or "").split()) >= 8]
        same = [r for r in before if r[1] == t]
        if same and at - same[-1][3] <= timedelta(days=7):
            want[i] = (want[same[-1][0]][0], "exact")
            continue
        near = [(len(sh(t) & sh(r[1])) / len(sh(t) | sh(r[1])), -r[3].timestamp(), r[0]) for r in before if at - r[3] <= timedelta(days=3)]
        near = [x for x in near if x[0] >= 0.8]
        if near:
            want[i] = (want[max(near)[2]][0], "near")
    assert got == want
    assert documents.causal_clusters(df.limit(0), "doc_id", "text", "asset_id", "at").count() == 0


def test_revision_kinds(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", "b", "a", None, None])], "k int, s int, v string")
    got = [r.kind for r in clocks.revision_kinds(df, ["k"], ["s"], "v").orderBy("s").collect()]
    assert got == ["initial", "unchanged", "revision", "reversion", "revision", "unchanged"]


def test_asof_edges(spark):
    probes = spark.createDataFrame([("a", T0, 1), ("a", None, 2), (None, T0, 3), ("b", T0, 4)], "k string, t timestamp, id int")
    facts = spark.createDataFrame([("a", T0, "same"), ("a", T0 + timedelta(1), "later"), (None, T0, "none"), ("a", None, "untimed")], "k string, t timestamp, v string")
    back = {r.id: r.v for r in clocks.asof_backward(probes, facts, "k", "t", ["v"]).collect()}
    ahead = {r.id: r.v for r in clocks.asof_forward_strict(probes, facts, "k", "t", ["v"]).collect()}
    assert back[1] == "same" and back[3] is None and back[4] is None and ahead[1] == "later"
    with pytest.raises(ValueError):
        clocks.asof_backward(probes, facts.withColumn("id", F.lit(1)), "k", "t", ["id"])


@pytest.mark.parametrize("horizon", [1, 15, 400])
def test_known_history_brute_force(spark, horizon):
    rng = random.Random(9)
    d0 = date(2024, 1, 1)
    facts = []
    for k in (1, 2, 3):
        for i in range(0, 120):
            if 40 <= i < 90 and k == 1 or rng.random() < 0.3:
                continue  # a break longer than the horizon
            day = d0 + timedelta(i)
            for seq in range(rng.choice([1, 1, 2])):
                known = datetime(day.year, day.month, day.day, 21) + timedelta(days=rng.choice([0, 0, 1, 50]))
                facts.append((k, day, seq, None if rng.random() < 0.1 else known, None if rng.random() < 0.1 else float(rng.randrange(1, 99))))
    probes = [(f"p{i}", rng.choice([1, 1, 2, 3, 4, None]), datetime(2024, 1, 1, 12) + timedelta(days=rng.randrange(-2, 130))) for i in range(40)]
    f = spark.createDataFrame(facts, "k long, d date, s int, a timestamp_ntz, v double")
    p = spark.createDataFrame(probes, "id string, k long, at timestamp_ntz")
    got = {(r.id, r.back): (r.day, r.value) for r in clocks.known_history(p, f, "id", "k", "at", "d", "a", ["s"], "v", 5, horizon).collect()}
    want = {}
    for pid, k, at in probes:
        days = {}
        for fk, day, seq, a, v in sorted(facts, key=lambda x: x[2]):
            if fk == k and a is not None and a <= at and day <= at.date():
                days[day] = v
        for back, day in enumerate(sorted(days, reverse=True)[:5], 1):
            want[pid, back] = (day, days[day])
    assert got == want and any(back == 5 for _, back in want)


def test_peer_median(spark):
    rng = random.Random(2)
    for n in range(1, 8):
        vals = [rng.choice([1.0, 2.0, 2.0, 5.0, 9.0]) for _ in range(n)]
        df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vals)] + [(99, 1, None)], "asset_id int, d int, x double")
        got = {r.asset_id: r.peer_median for r in panel.peer_median(df, "x", ["d"]).collect()}
        for i in range(n):
            rest = sorted(vals[:i] + vals[i + 1 :])
            m = len(rest)
            assert got[i] == (None if not rest else (rest[(m - 1) // 2] + rest[m // 2]) / 2)


def test_publish_and_seal(spark, tmp_path):
    df = spark.range(20).withColumn("p", F.col("id") % 3)
    path = f"{tmp_path}/artifact"
    assert lake.publish(df, path, ["p"], ["id"]) == "written"
    assert lake.publish(df.orderBy(F.col("id").desc()), path, ["p"], ["id"]) == "reused"
    assert spark.read.parquet(path).count() == 20
    with pytest.raises(ValueError):
        lake.publish(df.where("id > 3"), path, ["p"])
    with pytest.raises(ValueError):
        lake.assert_unique(df, ["p"])


def test_registry(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, p string")
    new = spark.createDataFrame([("a", "1"), ("c", "3"), ("c", "3")], "k string, p string")
    assert sorted(r.k for r in registry.append_sealed(old, new, "k", "p").collect()) == ["a", "b", "c"]
    assert registry.new_rows(old, new, "k").count() == 1
    with pytest.raises(ValueError):
        registry.append_sealed(old, spark.createDataFrame([("b", "9")], "k string, p string"), "k", "p")


def test_bootstrap(spark):
    starts = [r[0] for r in spark.range(800).select(scoring.block_start(F.floor(F.col("id") / 4), F.col("id") % 4, 10, 3, 0)).collect()]
    assert set(starts) == set(range(8)) and max(starts.count(s) for s in range(8)) < 200
    daily = spark.createDataFrame([(date(2024, 1, 1) + timedelta(i), 5.0) for i in range(10)], "day date, x double")
    assert {r.mean for r in scoring.block_bootstrap(daily, "day", "x", 3, 20).collect()} == {5.0}
    assert scoring.block_bootstrap(daily.limit(0), "day", "x", 3, 20).count() == 0


def test_derangement_and_folds(spark):
    df = spark.createDataFrame([(d, k, float(k)) for d in range(5) for k in range(d + 1)], "day int, k int, x double")
    for r in distribution.day_donor(df, "day", "k", "x", 3).collect():
        assert (r.donor is None) == (r.day == 0) and r.donor != r.x
    rows = spark.createDataFrame([(date(2024, 1, 1) + timedelta(i), date(2024, 1, 1) + timedelta(i + 2)) for i in range(20)], "day date, target date")
    for r in splits.purged_folds(rows, "day", "target", 4).collect():
        assert r.target < r.first_day if r.role == "train" else r.first_day <= r.day <= r.last_day


def test_text_functions(spark):
    df = spark.createDataFrame([("HTTPS://Www.Example.COM/A?utm_source=x&b=2&A=1#frag",), (None,), ("",)], "u string")
    got = df.select(text_fns.canonical_url("u").alias("c"), text_fns.domain("u").alias("d")).collect()
    assert got[0].c == "https://www.example.com/A?b=2&A=1" and got[0].d == "example.com" and got[1].c is None
    times = spark.createDataFrame([("1704067200",), ("1704067200000",), ("2024-01-01T01:00:00+01:00",), ("2024-01-01",), ("20240101T000000",), ("x",), (None,)], "t string")
    secs = [r.s for r in times.select(F.unix_seconds(text_fns.as_timestamp("t")).alias("s")).collect()]
    assert secs == [1704067200] * 5 + [None, None]
    sims = spark.createDataFrame([(["ff" * 8, "ff" * 8, "00" * 8],), ([],)], "h array<string>").select(F.hex(text_fns.simhash64("h")).alias("x")).collect()
    assert [r.x for r in sims] == ["FF" * 8, "0"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Close,Last\n2024-01-02,1.5,\n2024-01-03,bad,\n2023-01-01,bad,\nnonsense,2,\n")
    got = readers.csv_window(spark, f"{tmp_path}/a.csv", "Date", "2024-01-01", "2025-01-01", ["Close"], {"px": ["Last"]}).collect()
    assert sorted((str(r.Date), r.Close, r.problem) for r in got) == [("2024-01-02", 1.5, None), ("2024-01-03", None, "Close"), ("None", 2.0, "Date")]
    (tmp_path / "b.jsonl").write_text('{"a": 1, "b": "x"}\n\n[1]\n{"a": \n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows = readers.json_lines(spark, f"{tmp_path}/b.jsonl", schema).collect()
    assert [(r.a, r.b) for r in rows if r.corrupt is None] == [(1, "x")] and len(rows) == 3
    (tmp_path / "c.json").write_text(json.dumps({"filings": {"n": [1, 2, 3], "s": ["a"]}}))
    assert [(r.n, r.s) for r in readers.columnar_json(spark, f"{tmp_path}/c.json", {"n": "long", "s": "string"}, "filings").collect()] == [(1, "a"), (2, None), (3, None)]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "x.txt").write_bytes(b"plain")
    (raw / "y.gz").write_bytes(gzip.compress(b"packed"))
    (raw / "z.bin").write_bytes(b"\x00\x01")
    assert sorted(str(r.text) for r in readers.raw_documents(spark, str(raw)).collect()) == ["None", "packed", "plain"]
    nested = spark.createDataFrame([('{"a": [{"v": 1}], "b": {"c": [{"v": 2}]}}',)], "p string")
    assert sorted(r.v for r in readers.nested_lists(nested, "p", ["$.a", "$.b.c", "$.none"], "v int").collect()) == [1, 2]
    assert readers.evenly_spaced(spark.range(100), ["id"], 5).count() == 5 and readers.evenly_spaced(spark.range(3), ["id"], 5).count() == 3
    assert readers.weekday_sessions(spark, "2024-01-01", "2024-01-07", ["2024-01-01"]).count() == 4


def test_raw_documents_gzip_members(spark, tmp_path):
    one, two = gzip.compress(b"first "), gzip.compress("zwölf".encode())
    noise = gzip.compress(random.Random(3).randbytes(3000).hex().encode())
    files = {
        "two": one + two, "padded": one + b"\0" * 8 + two + b"\0" * 3, "cut": noise[: len(noise) // 2], "cut_second": one + two[:-4], "junk": one + b"junk", "large": gzip.compress(b"x" * 9000),
        "large_by_two": gzip.compress(b"x" * 7000) + gzip.compress(b"x" * 7000), "binary": b"a\0b", "plain": b"text",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.read) for r in readers.raw_documents(spark, str(tmp_path), 8000).collect()}
    assert got == {
        "two": ("first zwölf", True), "padded": ("first zwölf", True), "cut": (None, False), "cut_second": (None, False), "junk": (None, False), "large": (None, False),
        "large_by_two": (None, False), "binary": (None, True), "plain": ("text", True),
    }


def test_audits_on_empty_and_null(spark):
    empty = spark.createDataFrame([], "k string, v double, at timestamp")
    assert [r.status for r in audit.check_rules(empty, {"r": F.col("v") > 0}).collect()] == ["pass"]
    assert audit.profile(empty).count() == 3 and audit.gaps(empty, "k", "at").count() == 0
    assert graph.evidence_states(empty, "k", "at", "k", ("a",), "k").count() == 0


def test_k_slack_stream(spark, tmp_path):
    src, schema = tmp_path / "in", "k string, id string, t timestamp, a long"
    for i, rows in enumerate([[("k", "a", T0, 1), ("k", "b", T0 + timedelta(hours=60), 2)], [("k", "c", T0 + timedelta(hours=30), 3), ("k", "d", T0 + timedelta(hours=1), 4), ("k", "e", None, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = streams.k_slack_stream(stream, "k", "id", "t", "a", 48 * 3_600_000_000)
    q = out.writeStream.format("memory").queryName("kslack").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.outcome for r in spark.table("kslack").collect()} == {"a": "in_order", "b": "in_order", "c": "corrected", "d": "dropped", "e": "untimed"}
