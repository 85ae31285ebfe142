"""Order statistics by counting, markup, chunks, Unicode, selection, clusters with accessions, folders: against Python on small inputs."""

import random
import re
import unicodedata
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import markup
from tidemark.functions import text as T
from tidemark.operators import clocks, distribution, documents, learners, scoring, selection, splits
from tidemark.sources import readers

T0 = datetime(2024, 1, 1)


def test_smallest_reaching_and_quantiles(spark):
    rng = random.Random(1)
    xs = [rng.choice([0.0, -0.0, 1e-300, 5.0, rng.gauss(0, 1e6), rng.random()]) for _ in range(400)] + [1e308, -1e308]
    df = spark.createDataFrame([(x, float(rng.randrange(0, 4))) for x in xs] + [(None, 1.0), (float("nan"), 1.0)], "x double, w double")
    levels = (0.0, 0.1, 0.5, 0.77, 1.0)
    assert distribution.quantiles_of(df, "x", levels) == pytest.approx(np.quantile(xs, levels).tolist(), rel=1e-9)
    rows = [(r.x, r.w) for r in df.collect() if r.x is not None and r.x == r.x and r.w > 0]
    for t in (1.0, 37.0, sum(w for _, w in rows)):
        run, want = 0.0, None
        for x, w in sorted(rows):
            run += w
            if want is None and run >= t:
                want = x
        assert distribution.smallest_reaching(df, "x", (t,), "w", parts=4)[t] == want
    assert distribution.quantiles_of(df.limit(0), "x", (0.5,)) == [None]
    assert distribution.weighted_quantile(df.limit(0), "x", "w", 0.5).count() == 0
    same = spark.createDataFrame([(7.0,)] * 50, "x double")
    assert distribution.quantiles_of(same, "x", (0.2, 0.9)) == [7.0, 7.0]


def test_time_split_and_day_weights(spark):
    df = spark.createDataFrame([(T0 + timedelta(hours=i // 3),) for i in range(30)] + [(None,)], "at timestamp_ntz")
    got = {r["at"]: r.role for r in splits.time_split(df, "at", 0.5).collect()}
    times = sorted(t for t in got if t is not None)
    assert got[None] == "train" and [got[t] for t in times] == ["train"] * 4 + ["test"] * 6
    assert splits.time_split(df.limit(0), "at", 0.5).count() == 0
    w = distribution.day_weights(spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "day int"), "day").collect()
    assert sorted((r.day, round(r.wt, 6)) for r in w) == [(1, 0.666667)] * 3 + [(2, 2.0)]


def test_asof_cells_with_hot_keys_and_ties(spark):
    rng = random.Random(2)
    facts = [(rng.choice(["a", "b", None]), T0 + timedelta(days=rng.randrange(0, 60)) if rng.random() > 0.1 else None, i) for i in range(120)]
    probes = [(i, rng.choice(["a", "b", "c", None]), T0 + timedelta(days=rng.randrange(-3, 63)) if rng.random() > 0.1 else None) for i in range(90)]
    f, p = spark.createDataFrame(facts, "k string, t timestamp_ntz, v long"), spark.createDataFrame(probes, "id long, k string, t timestamp_ntz")
    back = {r.id: r.v for r in clocks.asof_backward(p, f, "k", "t", ["v"]).collect()}
    ahead = {r.id: r.v for r in clocks.asof_forward_strict(p, f, "k", "t", ["v"]).collect()}
    for i, k, t in probes:
        mine = [(ft, v) for fk, ft, v in facts if fk == k and k is not None and ft is not None and t is not None]
        before, after = [x for x in mine if x[0] <= t], [x for x in mine if x[0] > t]
        assert back[i] == (max(before)[1] if before else None)
        assert ahead[i] == (min(after)[1] if after else None)


def test_markup(spark):
    html = "<html><head><title>T</title><style>x{}</style></head><body><p>a &amp; b<br>c<script>no</script></p><div>d  e<noscript>n</noscript></div></body></html>"
    assert markup.seen_text(html) == "T\na & b\nc\nd e"
    assert markup.seen_text("") == "" and markup.seen_text("<p>open") == "open"
    pages = spark.createDataFrame([(1, "<table><tr><th>Name</th><th>State</th></tr><tr><td>A<td>B <a href='x'>y</a></tr></table><table><tr><td colspan=2>C</td></tr></table>", 9), (2, None, 9), (3, "", 9), (4, "<table><tr><td>in<table><tr><td>deep</table></td></tr>", 9)], "id long, html string, cells int")
    rows = {(r.id, r.table_index, r.row_index): (r.header, r.cells, r.href) for r in markup.table_rows(pages, "id", "html").collect()}
    assert rows == {(1, 0, 0): (True, ["Name", "State"], None), (1, 0, 1): (False, ["A", "B y"], "x"), (1, 1, 0): (False, ["C", ""], None), (4, 0, 0): (False, ["in"], None), (4, 1, 0): (False, ["deep"], None)}
    got = markup.typed_rows(markup.table_rows(pages, "id", "html"), "id", {"name": ("name",), "state": ("state", "jurisdiction")}).collect()
    assert sorted((r.id, r.schema_kind, r.name, r.state) for r in got if r.id == 1) == [(1, "explicit", "A", "B y"), (1, "inherited", "C", None)]
    assert markup.table_rows(pages.limit(0), "id", "html").count() == 0


def test_chunks_round_trip(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .\nü") for _ in range(n)) for n in (1, 5, 79, 80, 81, 400, 3000)] + ["x" * 500, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pieces = markup.chunked(df, "id", "text", 80, 15)
    for r in pieces.collect():
        assert len(r.piece) <= 80 and texts[r.id][r.start : r.start + len(r.piece)] == r.piece
    got = {r.id: (r.text, r.consistent) for r in markup.reassembled(pieces, "id").collect()}
    assert got == {i: (t, True) for i, t in enumerate(texts) if t}
    torn = pieces.withColumn("piece", F.when((F.col("id") == 6) & (F.col("chunk") == 2), F.lit("?")).otherwise(F.col("piece")))
    assert {r.id for r in markup.reassembled(torn, "id").where("not consistent").collect()} == {6}
    with pytest.raises(ValueError):
        markup.chunks_of("abc", 10, 6)


def test_unicode_tokens_items_and_footnotes(spark):
    texts = ["Ｆｕｌｌ width ﬁne", "O'Neil’s co-op -x-", "Straße ИЖ 東京 2x_y", "", None, "…"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    token = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
    for r in df.select("text", T.unicode_tokens("text").alias("t")).collect():
        assert r.t == (None if r.text is None else token.findall(unicodedata.normalize("NFKC", r.text).casefold()))
    raw = spark.createDataFrame([('["Item 2.02","9.01"]',), ('{"7.01": "x"}',), ("Item 1.01; item 1.01, 5",), ("[broken",), ("",), (None,)], "r string")
    assert [r[0] for r in raw.select(T.items_of("r")).collect()] == [["2.02", "9.01"], ["7.01"], ["1.01", "5"], [], [], None]
    names = spark.createDataFrame([("Alpha LLC (1)(b)",), ("Beta*",), ("Gamma (Delta) Inc",), (None,)], "n string")
    assert [(r[0], r[1]) for r in names.select(T.footnotes("n").alias("f")).select("f.stem", "f.refs").collect()] == [("Alpha LLC", ["1", "b"]), ("Beta", ["*"]), ("Gamma (Delta) Inc", []), (None, [])]
    hashes = spark.createDataFrame([(0x1234567890ABCDEF,), (-1,)], "h long")
    assert hashes.select(T.band_keys("h")).collect()[0][0] == ["0:cdef", "1:90ab", "2:5678", "3:1234"]


def test_ridge_and_boosting(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    c, slopes = selection.ridge(df, ["a", "b"], "y", 5.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(2), xc.T @ yc)
    assert slopes == pytest.approx(want.tolist()) and c == pytest.approx(y.mean() - want @ x.mean(0))
    with pytest.raises(ValueError):
        selection.ridge(df.limit(0), ["a"], "y")
    noisy = spark.createDataFrame([(float(v), float(v * abs(e))) for v, e in zip(rng.uniform(0, 4, 1200), rng.normal(size=1200), strict=True)], "a double, y double")
    train, test = noisy.where("a < 2 or a > 2.2"), noisy
    got = selection.boosted_quantile(train, test, ["a"], "y", 0.9, ["a", "y"])
    flat = distribution.quantiles_of(train, "y", (0.9,))[0]
    loss = got.agg(F.avg(scoring.pinball(F.col("y"), F.col("quantile"), 0.9)), F.avg(scoring.pinball(F.col("y"), F.lit(flat), 0.9))).first()
    assert loss[0] < 0.8 * loss[1]
    up = noisy.withColumn("up", (F.col("y") > 1.5).cast("double")).withColumn("wt", F.lit(1.0))
    chance = learners.boosted_chance(up.where("a < 3.5"), up, ["a"], "up", ["a", "up"], "wt")
    brier = chance.agg(F.avg((F.col("chance") - F.col("up")) ** 2), F.var_pop("up")).first()
    assert brier[0] < 0.9 * brier[1]
    assert learners.boosted_chance(up.withColumn("up", F.lit(1.0)), up.limit(3), ["a"], "up", ["a"]).select("chance").first()[0] == 1.0
    forest = learners.quantile_forest(noisy, noisy.limit(20), ["a"], "y", ["a"]).collect()
    assert len(forest) == 20 and all(r.q05 <= r.q50 <= r.q95 and 0 <= r.p_pos <= 1 for r in forest)


def test_forest_parts(spark):
    rng = np.random.default_rng(6)
    m, a = rng.normal(size=600), rng.normal(size=600)
    df = spark.createDataFrame([(i, float(x), float(z), float(2 * x + 3 * z)) for i, (x, z) in enumerate(zip(m, a, strict=True))], "i long, m double, a double, y double")
    got = learners.forest_parts(df.where("i < 400"), df, ["m"], ["a"], "y", ["i"]).join(df, "i").where("i >= 400")
    r = got.agg(*[F.avg((F.col(c) - F.col("y")) ** 2).alias(c) for c in ("market", "own", "residual")], F.var_pop("y").alias("v")).first()
    assert r.market < r.v and r.own < 0.6 * r.v and r.residual < 0.4 * r.v


def test_cluster_bootstrap_and_walk(spark):
    df = spark.createDataFrame([(i % 40, float(i % 7)) for i in range(400)], "c long, x double")
    means = [r["mean"] for r in scoring.cluster_bootstrap(df, "c", "x", 60, 1).collect()]
    assert len(means) == 60 and abs(np.mean(means) - 2.99) < 0.1 and np.std(means) > 0.02
    w = [r[0] for r in spark.range(4000).select(scoring.poisson_weight(F.col("id"))).collect()]
    assert abs(np.mean(w) - 1) < 0.06 and abs(np.var(w) - 1) < 0.12
    with pytest.raises(ValueError):
        scoring.walked(df, [], "c", "c", None, None)


def test_clusters_with_accessions(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "a", T0, "f1"), (2, "other words altogether here and now it is so", "a", T0 + timedelta(days=90), "f1"), (3, text, "a", T0 + timedelta(days=1), None), (4, text, "a", T0 + timedelta(days=30), None), (5, text + " thirteen", "a", T0 + timedelta(days=2), None), (6, "", "a", T0, None), (7, None, "a", T0, None), (8, text, None, T0, None)]
    df = spark.createDataFrame(rows, "id long, text string, asset string, at timestamp_ntz, acc string")
    got = {r.doc: (r.cluster, r.reason) for r in documents.causal_clusters(df, "id", "text", "asset", "at", "acc").collect()}
    assert got == {1: (1, "anchor"), 2: (1, "accession"), 3: (1, "exact"), 4: (4, "anchor"), 5: (1, "near"), 6: (6, "anchor"), 7: (7, "anchor"), 8: (8, "anchor")}


def test_near_copies_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(3)) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(60)] = "zz" + str(rng.randrange(50))
        rows.append((i, " ".join(words), rng.choice(["a", "b", None]), rng.randrange(0, 9)))
    docs = spark.createDataFrame(rows, "id long, text string, asset string, d int")
    fp = documents.fingerprints(docs, "id", "text").join(docs.select(F.col("id").alias("doc"), "asset", (F.col("d") * documents.DAY).alias("at")), "doc")
    sets = {r.doc: (set(r.shingles), r.asset, r["at"]) for r in fp.collect()}
    got = {(r.doc, r.other) for r in documents.earlier_near_copies(fp, 0.8, 3).collect()}
    want = {(x, y) for x, (a, p, t) in sets.items() for y, (b, q, u) in sets.items() if p is not None and p == q and (u, y) < (t, x) and t - u <= 3 * documents.DAY and len(a & b) >= 0.8 * len(a | b)}
    assert got == want and want


def test_attached_tables_and_release(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/db/one.parquet")
    assert readers.attach(spark, "t", f"{tmp_path}/db") == ["t_one"]
    with pytest.raises(Exception, match="(?i)insert"):
        spark.sql("insert into t_one select * from t_one")
    assert spark.table("t_one").count() == 3
    before = session.release(spark)
    kept = session.stored(spark.range(5), "kept")
    assert before >= 0 and kept.count() == 5 and session.release(spark) == 1
    day = spark.createDataFrame([(date(2024, 1, 1), 1)], "day date, k int")
    assert day.count() == 1
