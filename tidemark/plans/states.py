"""Queries over states, steps, labels and samples of panels and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import audit, clocks, panel
from tidemark.operators import windows as w
from tidemark.plans import views
from tidemark.plans.registry import Registry, plain, rows_n
from tidemark.plans.views import ACTIONS_SQL, DAILY_SQL, MONTHLY_SQL, OBS_SQL
from tidemark.session import table
from tidemark.sources import readers

entry = Registry()
QUERIES, ORACLE = entry.queries, entry.oracle
K, O = "asset_id", "day"
_DAY = "strftime(day, '%Y-%m-%d') as day"
_A = "(partition by asset_id order by day)"


def _w(n: int) -> str:
    return f"over (partition by asset_id order by day rows between {n - 1} preceding and current row)"


def _roll(fn: str, v: str, n: int, least: int | None = None) -> str:
    return f"case when count({v}) {_w(n)} >= {least or n} then {fn}({v}) {_w(n)} end"


def _ret(n: int) -> str:
    return f"100 * (close / nullif(lag(close, {n}) over {_A}, 0) - 1)"


@entry("L05_present_actions", f"""with {OBS_SQL}, l as (select asset_id, day, l_returnflag kind, arg_max(l_discount >= 0.05, (seq, l_partkey, l_discount)) present from obs group by 1, 2, 3) select asset_id, {_DAY}, kind from l where present""")
def l05_present_actions(spark, sf):
    """Of each asset, day and kind the latest version decides whether the action exists."""
    obs = views.observations(spark, sf).select(K, O, F.col("l_returnflag").alias("kind"), "seq", "l_partkey", "l_discount")
    last = clocks.latest_struct(obs, [K, O, "kind"], ["seq", "l_partkey"], ["l_discount"])
    return last.where("l_discount >= 0.05").select(K, F.col(O).cast("string").alias(O), "kind")


_SERIES = {1: "alpha", 2: "beta", 3: "gamma"}
_METRICS = ("return_1", "return_3", "volatility_6", "from_high")


@entry("L08_series_state", f"""with {MONTHLY_SQL}, a as (select *, {_ret(1)} r from monthly where asset_id in (1, 2, 3)), b as (select *, {_ret(1)} return_1, {_ret(3)} return_3, {_roll('stddev_pop', 'r', 6)} volatility_6, 100 * (close / max(close) {_w(12)} - 1) from_high from a)
    select {_DAY}, """.replace("strftime(day", "strftime(b.day") + ", ".join(f"round(max({m}) filter (asset_id = {i}), 6) {n}_{m}" for i, n in _SERIES.items() for m in _METRICS) + " from b group by b.day")
def l08_series_state(spark, sf):
    return plain(panel.series_state(views.monthly(spark, sf), _SERIES, (1, 3), 6))


@entry("L09_conditions", f"""with {MONTHLY_SQL}, a as (select *, {_ret(1)} / 100 r, ln(1 + {_ret(1)} / 100) l from monthly where asset_id in (1, 2, 3)), b as (select *, exp({_roll('sum', 'l', 3)}) - 1 comp, lag(close) over {_A} before from a),
    d as (select day, max(comp) filter (asset_id = 1) - max(comp) filter (asset_id = 2) spread, max(before) filter (asset_id = 3) lagged from b group by 1),
    z as (select *, avg(spread) over k m, stddev_pop(spread) over k s, count(spread) over k c from d window k as (order by day rows between 11 preceding and current row))
    select {_DAY}, round(spread, 6) spread, round(lagged, 6) lagged, round(case when c >= 12 and s > 1e-12 then (spread - m) / s end, 6) spread_z from z""")
def l09_conditions(spark, sf):
    """A spread of compounded returns of two series, its z-score, and a third series as it was a session before."""
    df = views.monthly(spark, sf).where(F.col(K).isin(1, 2, 3)).withColumn("r", w.lag_return("close", 1, K, O) / 100)
    df = df.select(K, O, w.compound("r", 3, K, O).alias("comp"), F.lag("close").over(w.ordered(K, O)).alias("before"))
    pick = lambda i, c: F.max(F.when(F.col(K) == i, F.col(c)))
    day = df.groupBy(O).agg((pick(1, "comp") - pick(2, "comp")).alias("spread"), pick(3, "before").alias("lagged")).withColumn("one", F.lit(0))
    return plain(day.select(O, "spread", "lagged", w.zscore("spread", 12, "one", O).alias("spread_z")))  # one series of days


_STATE = f"""a as (select *, row_number() over {_A}::double pos, lag(close) over {_A} prev from {{src}}), b as (select *, case when close > 0 and prev > 0 then ln(close / prev) end lr, case when prev is null then high - low else greatest(high - low, abs(high - prev), abs(low - prev)) end tr,
    case when prev is not null then greatest(close - prev, 0.0) end g, case when prev is not null then greatest(prev - close, 0.0) end l from a),
    c as (select *, {', '.join(f'{_ret(n)} return_{n}' for n in (1, 5, 15, 30, 60))}, {', '.join(f"100 * case when count(close) {_w(n)} >= {n} then regr_slope(close, pos) {_w(n)} end / nullif(close, 0) slope_{n}" for n in (30, 60))},
    {', '.join(f"100 * (close / nullif({_roll('avg', 'close', n)}, 0) - 1) ma_distance_{n}" for n in (15, 60))}, {', '.join(f"100 * {_roll('stddev_samp', 'lr', n)} volatility_{n}" for n in (30, 60))}, 100 * {_roll('avg', 'tr', 14)} / nullif(close, 0) atr_14, {_roll('avg', 'g', 14)} ag, {_roll('avg', 'l', 14)} al,
    100 * (close / nullif(max(high) {_w(60)}, 0) - 1) drawdown_60, 100 * (close / nullif(min(low) {_w(60)}, 0) - 1) from_low_60, volume / nullif({_roll('avg', 'volume', 60, 20)}, 0) relative_volume, 100 * (high - low) / nullif(close, 0) bar_range, (close - low) / nullif(high - low, 0) close_location from b),
    state as (select *, case when al > 0 then 100 - 100 / (1 + ag / al) end rsi_14 from c)"""
_STATE_COLS = ("return_1", "return_5", "return_15", "return_30", "return_60", "slope_30", "slope_60", "ma_distance_15", "ma_distance_60", "volatility_30", "volatility_60", "atr_14", "rsi_14", "drawdown_60", "from_low_60", "relative_volume", "bar_range", "close_location")


@entry("L10_intraday_state", f"with {DAILY_SQL}, {_STATE.format(src='daily')} select asset_id, {_DAY}, " + ", ".join(f"round({c}, 4) {c}" for c in _STATE_COLS) + " from state")
def l10_intraday_state(spark, sf):
    """The state of bars; the daily bars stand for those of minutes."""
    df = panel.intraday_state(views.daily(spark, sf), K, O)
    return df.select(K, F.col(O).cast("string").alias(O), *[F.round(c, 4).alias(c) for c in _STATE_COLS])


def _pct(v: str) -> str:
    return f"case when {v} is not null then (rank() over (partition by day order by {v}) + (count(*) over (partition by day, {v}) - 1) / 2.0) / count({v}) over (partition by day) end"


@entry("L11_cross_section_state", f"""with {MONTHLY_SQL}, {_STATE.format(src='monthly')}, x as (select *, avg(return_1) over (partition by day) m1, avg(return_1) over (partition by day, sector) s1, {_pct('return_1')} p1, avg(return_5) over (partition by day) m5, avg(return_5) over (partition by day, sector) s5, {_pct('return_5')} p5, avg((return_5 > 0)::int) over (partition by day) b5 from state where return_5 is not null)
    select asset_id, {_DAY}, round(m1, 4) market_1, round(return_1 - m1, 4) minus_market_1, round(return_1 - s1, 4) minus_sector_1, round(p1, 4) percentile_1, round(m5, 4) market_5, round(return_5 - m5, 4) minus_market_5, round(return_5 - s5, 4) minus_sector_5, round(p5, 4) percentile_5, round(b5, 4) breadth_5 from x""")
def l11_cross_section_state(spark, sf):
    df = panel.intraday_state(views.monthly(spark, sf), K, O).dropna(subset=["return_5"])
    out = panel.cross_section_state(df.select(K, O, "sector", "return_1", "return_5"), O, "sector", ("return_1", "return_5"), ("return_5",))
    named = {f"{a}_{n}": c for n in (1, 5) for a, c in (("market", f"market_return_{n}"), ("minus_market", f"return_{n}_minus_market"), ("minus_sector", f"return_{n}_minus_sector"), ("percentile", f"return_{n}_percentile"))}
    return out.select(K, F.col(O).cast("string").alias(O), *[F.round(c, 4).alias(n) for n, c in (named | {"breadth_5": "breadth_return_5"}).items()])


@entry("L12_session_of_bar", """with c as (select d::date as day, d + interval '14 hours 30 minutes' as o, d + interval 21 hours as e from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) d) where isodow(d) < 6 and d <> timestamp '2024-01-15')
    select event_id, strftime(c.day, '%Y-%m-%d') as session from events left join c on c.day = ts::date and ts >= o and ts < e""")
def l12_session_of_bar(spark, sf):
    """The session that holds a bar's time, its opening included and its close not; by day first, so nothing is crossed."""
    cal = readers.weekday_sessions(spark, "2024-01-01", "2024-01-31", ("2024-01-15",)).select(F.col("day").alias("_d"), "opens", "closes")
    ev = views.events(spark, sf)
    joined = ev.join(cal, (F.to_date("ts") == F.col("_d")) & (F.col("ts") >= F.col("opens")) & (F.col("ts") < F.col("closes")), "left")
    return joined.select("event_id", F.col("_d").cast("string").alias("session"))


_SESS = """p as (select asset_id, trading_day d, arg_max(struct_pack(v := raw_close), observation_sequence).v c, max(bar_end_utc) e from temporal_price_points where asset_id is not null and trading_day is not null group by 1, 2),
    s as (select asset_id, d, c, e, row_number() over (partition by asset_id order by d) i from p where c > 0 and e is not null), cl as (select distinct evidence_claim_id, registrant_asset_id asset_id, evidence_available_at t from evidence_claims)"""


def _sessions(spark, sf):
    pts = table(spark, sf, "temporal_price_points").where("asset_id is not null and trading_day is not null")
    last = pts.groupBy("asset_id", "trading_day").agg(F.max_by(F.struct("raw_close"), "observation_sequence")["raw_close"].alias("close"), F.max("bar_end_utc").cast("timestamp").alias("closed_at"))
    last = last.where("close > 0 and closed_at is not null")
    return last.withColumn("i", F.row_number().over(w.ordered("asset_id", "trading_day")).cast("long"))


def _claims(spark, sf):
    return table(spark, sf, "evidence_claims").select("evidence_claim_id", F.col("registrant_asset_id").alias("asset_id"), F.col("evidence_available_at").cast("timestamp").alias("at")).distinct()


@entry("L16_reaction_labels", f"""with {_SESS}, o as (select cl.*, s.i, s.e from cl asof left join s on s.asset_id = cl.asset_id and s.e <= cl.t)
    select evidence_claim_id, case when o.i is null then 'no_session' when hour(o.t) * 60 + minute(o.t) between 870 and 1259 then 'within_session' when b.c is null then 'insufficient_future' else 'usable' end status, case when o.i is not null and not hour(o.t) * 60 + minute(o.t) between 870 and 1259 then round(100 * (b.c / a.c - 1), 6) end reaction
    from o left join s a on a.asset_id = o.asset_id and a.i = o.i left join s b on b.asset_id = o.asset_id and b.i = o.i + 5""")
def l16_reaction_labels(spark, sf):
    """From the last session complete before an event to the fifth after it; none for events while a session runs."""
    s = _sessions(spark, sf)
    o = clocks.reaction_origins(_claims(spark, sf), s, "asset_id", "at", "closed_at", "i")
    close = lambda n: s.select(F.col("asset_id").alias(f"k{n}"), F.col("i").alias(f"i{n}"), F.col("close").alias(f"c{n}"))
    j = o.join(close(0), (F.col("asset_id") == F.col("k0")) & (F.col("origin_position") == F.col("i0")), "left").join(close(1), (F.col("asset_id") == F.col("k1")) & (F.col("origin_position") + 5 == F.col("i1")), "left")
    minute = F.hour("at") * 60 + F.minute("at")
    within = minute.between(870, 1259)
    status = F.when(F.col("origin_position").isNull(), "no_session").when(within, "within_session").when(F.col("c1").isNull(), "insufficient_future").otherwise("usable")
    return plain(j.select("evidence_claim_id", status.alias("status"), F.when(F.col("origin_position").isNotNull() & ~within, 100 * (F.col("c1") / F.col("c0") - 1)).alias("reaction")))


@entry("L20_step_classes", f"""with {DAILY_SQL}, cash as (select asset_id, day, max(price) / 40 cash from obs where l_returnflag = 'R' and l_discount >= 0.09 group by 1, 2), a as (select daily.*, coalesce(cash, 0) cash, lag(close) over (partition by asset_id order by daily.day) prev from daily left join cash using (asset_id, day)),
    b as (select *, (close + cash) / nullif(prev, 0) e, close / nullif(prev - cash, 0) p from a) select case when e is null then 'first' when not (e > 0.2 and e < 5) then 'quarantine' when cash = 0 then 'plain' when abs(e / nullif(p, 0) - 1) <= 0.005 then 'agrees' else 'differs' end step_class, count(*) n, round(avg(e), 6) mean_step from b group by 1""")
def l20_step_classes(spark, sf):
    obs = views.observations(spark, sf)
    cash = obs.where("l_returnflag = 'R' and l_discount >= 0.09").groupBy(K, O).agg((F.max("price") / 40).alias("cash"))
    df = views.daily(spark, sf).join(cash, [K, O], "left").withColumn("cash", F.coalesce("cash", F.lit(0.0))).withColumn("prev", F.lag("close").over(w.ordered(K, O)))
    return plain(panel.step_classes(df).groupBy("step_class").agg(rows_n(), F.avg("economic").alias("mean_step")))


@entry("L22_repaired_bars", f"""with {DAILY_SQL}, b as (select asset_id, day, close as o, close, high * case when asset_id % 3 = 0 then 0.98 else 1 end h, low * case when asset_id % 4 = 0 then 1.2 else 1 end l from daily), m as (select *, greatest(h, o, close) th, least(l, o, close) tl, greatest(greatest(h, o, close) - h, l - least(l, o, close)) mv from b),
    r as (select *, coalesce(mv / nullif(close, 0) <= 0.05, false) ok from m) select asset_id, {_DAY}, round(case when ok then th else h end, 8) high, round(case when ok then tl else l end, 8) low, case when mv is null then 'incomplete' when mv = 0 then 'whole' when ok then 'repaired' else 'refused' end status from r""")
def l22_repaired_bars(spark, sf):
    df = views.daily(spark, sf).withColumn("open", F.col("close")).withColumn("high", F.col("high") * F.when(F.col(K) % 3 == 0, 0.98).otherwise(1.0)).withColumn("low", F.col("low") * F.when(F.col(K) % 4 == 0, 1.2).otherwise(1.0))
    return plain(panel.repair_envelope(df, 0.05).select(K, O, "high", "low", "status"), 8)


@entry("L23_ingested_observations", """with r as (select distinct observation_id id, source_id, symbol, trading_day d, version_id v, observation_sequence s from global_reference_observations), b as (select *, (s > 1)::int fresh from r),
    n as (select *, row_number() over k num, lag(v) over k before, count(*) over k c from b window k as (partition by source_id, symbol, d order by fresh, s, id)), f as (select *, min(num) over (partition by source_id, symbol, d, v) first_seen from n)
    select id as observation_id, num as sequence, case when num = 1 then 'initial' when v is not distinct from before then 'unchanged' when first_seen < num then 'reversion' else 'revision' end kind from f where fresh = 1""")
def l23_ingested_observations(spark, sf):
    """A batch of observations beside those that were there: new ones only, numbered on, by content."""
    r = table(spark, sf, "global_reference_observations").select("observation_id", "source_id", "symbol", "trading_day", "version_id", "observation_sequence").distinct()
    out = clocks.ingested(r.where("observation_sequence <= 1"), r, ["source_id", "symbol", "trading_day"], ["version_id"], ["observation_sequence"], "observation_id")
    return out.select("observation_id", "sequence", "kind")


_L24 = {"excursions hold the return": "mfe >= ret and ret >= mae", "target after origin": "target_day > day", "usable has a return": "status <> 'usable' or ret is not null", "deviation not negative": "path_vol >= 0"}


@entry("L24_outcome_rules", f"""with {DAILY_SQL}, x as (select *, lead(close, 5) over {_A} f, lead(day, 5) over {_A} t from daily) """ + " union all ".join(f"select '{n}' as rule, (select count(*) from x) n_rows, 0::bigint n_violations, 'pass' status" for n in _L24))
def l24_outcome_rules(spark, sf):
    """What must hold of every outcome, whatever made it."""
    labels = panel.forward_labels(views.daily(spark, sf), views.actions(spark, sf), (5,))
    return audit.check_rules(labels, {n: F.expr(rule) for n, rule in _L24.items()})


@entry("L25_supervised_rows", f"""with {MONTHLY_SQL}, r as (select *, {_ret(1)} ret_1, {_ret(3)} ret_3, {_ret(12)} ret_12, lead(close) over {_A} / close - 1 y from monthly), c as (select *, ((ret_1 is not null)::int + (ret_3 is not null)::int + (ret_12 is not null)::int + 1) / 4.0 cov from r)
    select asset_id, {_DAY}, round(volume, 6) volume, round(ret_1, 6) ret_1, round(ret_3, 6) ret_3, round(ret_12, 6) ret_12, round(cov, 6) coverage, round(y, 6) y from c where cov >= 0.75 and y is not null""")
def l25_supervised_rows(spark, sf):
    """Features from name and value back to columns, rows of enough of them joined with their outcomes."""
    df = views.monthly(spark, sf)
    names = ("volume", "ret_1", "ret_3", "ret_12")
    df = df.withColumns({f"ret_{n}": w.lag_return("close", n, K, O) for n in (1, 3, 12)}).withColumn("y", F.lead("close").over(w.ordered(K, O)) / F.col("close") - 1)
    long = df.select(K, O, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in names]))).where("x is not null")
    wide = long.groupBy(K, O).pivot("name", list(names)).max("x")
    share = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) / len(names)
    return plain(wide.withColumn("coverage", share).where("coverage >= 0.75").join(df.select(K, O, "y").where("y is not null"), [K, O]).select(K, O, *names, "coverage", "y"))


@entry("L26_merged_frame", f"""with {MONTHLY_SQL}, r as (select *, {_ret(1)} ret from monthly), d as (select day, avg(ret) m, stddev_pop(ret) s from r where sector <> 2 group by 1 having count(ret) >= 40)
    select asset_id, strftime(r.day, '%Y-%m-%d') as day, round(m, 6) market, round(s, 6) dispersion, (ret is not null and m is not null and s is not null)::int complete from r left join d using (day)""")
def l26_merged_frame(spark, sf):
    """Rows with the state of their day, and whether all of it is there."""
    r = views.monthly(spark, sf).withColumn("ret", w.lag_return("close", 1, K, O))
    d = r.where("sector <> 2").groupBy(O).agg(F.avg("ret").alias("market"), F.stddev_pop("ret").alias("dispersion"), F.count("ret").alias("c")).where("c >= 40").drop("c")
    return plain(r.join(d, O, "left").select(K, O, "market", "dispersion", panel.finite(["ret", "market", "dispersion"]).cast("int").alias("complete")))


@entry("L27_event_context", f"""with c as (select distinct evidence_claim_id, registrant_asset_id asset_id, evidence_available_at at_ from evidence_claims), m as (select c.evidence_claim_id, p.trading_day d, arg_max(struct_pack(v := p.raw_close), p.observation_sequence).v v from c join temporal_price_points p on p.asset_id = c.asset_id and p.causal_available_at <= c.at_ and p.trading_day <= c.at_::date group by 1, 2),
    r as (select *, row_number() over (partition by evidence_claim_id order by d desc) back from m), x as (select evidence_claim_id, round(avg(v), 4) level from r where back <= 5 group by 1 having avg(v) is not null), y as (select x.*, date_trunc('month', at_)::date mo from x join c using (evidence_claim_id))
    select a.evidence_claim_id, a.level, round(median(b.level), 3) peer_level from y a left join y b on a.mo = b.mo and a.evidence_claim_id <> b.evidence_claim_id group by 1, 2""")
def l27_event_context(spark, sf):
    """Each event with the mean of its last five known sessions, and the median of the other events of its month."""
    claims = _claims(spark, sf).withColumn("at", F.col("at").cast("timestamp_ntz"))
    pts = table(spark, sf, "temporal_price_points").distinct()
    hist = clocks.known_history(claims, pts, "evidence_claim_id", "asset_id", "at", "trading_day", "causal_available_at", ["observation_sequence"], "raw_close", 5, 30)
    own = hist.groupBy("evidence_claim_id").agg(F.round(F.avg("value"), 4).alias("level")).where("level is not null")
    own = own.join(claims.select("evidence_claim_id", F.trunc("at", "month").alias("month")), "evidence_claim_id")
    return panel.peer_median(own, "level", ["month"], "evidence_claim_id").select("evidence_claim_id", "level", F.round("peer_median", 3).alias("peer_level"))


@entry("L28_close_aligned", f"""with {_SESS}, v as (select cl.*, dl, t + dl * interval 1 minute x from cl, (select unnest([0, 15, 1440]) dl)), o as (select v.evidence_claim_id, v.asset_id, v.t, dl, s.i from v asof join s on s.asset_id = v.asset_id and s.e > v.x)
    select dl as "delay", asset_id, i as session_position, arg_max(evidence_claim_id, (t, evidence_claim_id)) evidence_claim_id, count(*) n_superseded_and_last from o group by 1, 2, 3""")
def l28_close_aligned(spark, sf):
    """Events moved by delays to the first close after them; of several at one close the last one stands."""
    s = _sessions(spark, sf).select("asset_id", F.col("closed_at").alias("probe_at"), F.col("i").alias("session_position"))
    probes = _claims(spark, sf).select("*", F.explode(F.array(*[F.lit(d) for d in (0, 15, 1440)])).alias("delay")).withColumn("probe_at", F.col("at") + F.make_dt_interval(mins=F.col("delay")))
    found = clocks.asof_forward_strict(probes, s, "asset_id", "probe_at", ["session_position"]).where("session_position is not null")
    return found.groupBy("delay", "asset_id", "session_position").agg(F.max(F.struct("at", "evidence_claim_id"))["evidence_claim_id"].alias("evidence_claim_id"), F.count(F.lit(1)).alias("n_superseded_and_last"))


@entry("L29_recomputed", f"""with {MONTHLY_SQL}, a as (select *, 100 * (lead(close) over {_A} / close - 1) truth from monthly), b as (select *, truth + case when asset_id % 11 = 0 then 0.5 when asset_id % 13 = 0 then 1e-10 else 0 end stored from a)
    select case when truth is null then 'no_outcome' when abs(stored - truth) <= 1e-8 then 'agrees' else 'differs' end status, count(*) n from b group by 1""")
def l29_recomputed(spark, sf):
    """Stored outcomes beside those computed again from the bars."""
    truth = 100 * (F.lead("close").over(w.ordered(K, O)) / F.col("close") - 1)
    off = F.when(F.col(K) % 11 == 0, 0.5).when(F.col(K) % 13 == 0, 1e-10).otherwise(0.0)
    df = views.monthly(spark, sf).withColumn("truth", truth).withColumn("stored", F.col("truth") + off)
    status = F.when(F.col("truth").isNull(), "no_outcome").when(F.abs(F.col("stored") - F.col("truth")) <= 1e-8, "agrees").otherwise("differs")
    return df.groupBy(status.alias("status")).agg(rows_n())


@entry("L30_selection_mask", f"""with {DAILY_SQL}, {ACTIONS_SQL}, i as (select asset_id, day, row_number() over {_A} n, lead(day, 10) over {_A} t from daily), x as (select i.asset_id, i.day, count(s.day) c from i left join actions s on s.asset_id = i.asset_id and s.day > i.day and s.day <= i.t where i.t is not null group by 1, 2)
    select asset_id, strftime(x.day, '%Y-%m-%d') as day, (c = 0)::int selected from x""")
def l30_selection_mask(spark, sf):
    """Origins whose ten rows ahead hold no action; actions between bars count for the next bar."""
    labels = panel.forward_labels(views.daily(spark, sf), views.actions(spark, sf), (10,)).where("status <> 'insufficient_future'")
    return labels.select(K, F.col(O).cast("string").alias(O), (F.col("status") == "usable").cast("int").alias("selected"))
