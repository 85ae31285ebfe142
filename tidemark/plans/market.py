"""Queries over the asset panel: windows, peers, factors, labels, total return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import panel
from tidemark.operators import windows as w
from tidemark.plans import views
from tidemark.plans.views import ACTIONS_SQL, DAILY_SQL, EVENTS_SQL, MONTHLY_SQL

K, O = "asset_id", "day"


def _out(df: DataFrame, *cols) -> DataFrame:
    """Asset, day as text, and the named columns rounded to six places."""
    kinds = dict(df.dtypes)
    return df.select(K, F.col(O).cast("string").alias(O), *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in cols])


def l02_own_state(spark: SparkSession, sf: str) -> DataFrame:
    df = panel.own_state(views.daily(spark, sf))
    return _out(df, "history", "ret_1", "ret_20", "ret_63", "vol_5", "vol_20", "vol_63", "volume_ratio", "drawdown_63", "from_low_63", "range_share", "ready")


def w09_sample_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Sample deviation of log returns, from a third of the window on, scaled to the window."""
    df = views.daily(spark, sf).withColumn("lr", F.ln(F.try_divide(F.col("close"), F.lag("close").over(w.ordered(K, O)))))
    df = df.withColumn("vol_30", w.trailing(F.stddev_samp, "lr", 30, K, O, least=10) * (30**0.5))
    return _out(df, "vol_30")


def w10_moving_averages(spark: SparkSession, sf: str) -> DataFrame:
    df = views.daily(spark, sf)
    for n in (15, 60):
        df = df.withColumn(f"ma_dist_{n}", 100 * (F.try_divide(F.col("close"), w.trailing(F.avg, "close", n, K, O)) - 1))
    df = df.withColumn("volume_mean_20", w.trailing(F.avg, "volume", 20, K, O, least=10))
    return _out(df, "ma_dist_15", "ma_dist_60", "volume_mean_20")


def w13_rolling_slope(spark: SparkSession, sf: str) -> DataFrame:
    df = views.daily(spark, sf).withColumn("pos", F.row_number().over(w.ordered(K, O)).cast("double"))
    df = df.withColumn("slope_30", F.try_divide(w.slope("close", "pos", 30, K, O), F.col("close")))
    return _out(df, "slope_30")


def w14_atr_rsi(spark: SparkSession, sf: str) -> DataFrame:
    df = views.daily(spark, sf).withColumn("tr", w.true_range("high", "low", "close", K, O))
    df = df.withColumn("step", F.col("close") - F.lag("close").over(w.ordered(K, O)))
    df = df.withColumn("atr_14", w.trailing(F.avg, "tr", 14, K, O)).withColumn("rsi_14", w.rsi("step", 14, K, O))
    return _out(df, "atr_14", "rsi_14")


def w16_rolling_beta(spark: SparkSession, sf: str) -> DataFrame:
    df = _monthly_returns(spark, sf)
    return _out(panel.factor_state(df, "ret"), "market", "sector_rel", "beta")


def _monthly_returns(spark: SparkSession, sf: str) -> DataFrame:
    return views.monthly(spark, sf).withColumn("ret", w.lag_return("close", 1, K, O))


def w18_compound(spark: SparkSession, sf: str) -> DataFrame:
    df = _monthly_returns(spark, sf).withColumn("r", F.col("ret") / 100)
    for n in (5, 20):
        df = df.withColumn(f"comp_{n}", w.compound("r", n, K, O))
    return _out(df, "comp_5", "comp_20")


def w19_drawdown_index(spark: SparkSession, sf: str) -> DataFrame:
    df = _monthly_returns(spark, sf).where("ret is not null")
    df = df.withColumn("index", F.exp(F.sum(F.ln(1 + F.col("ret") / 100)).over(w.ordered(K, O).rowsBetween(Window.unboundedPreceding, 0))))
    df = df.withColumn("drawdown", F.col("index") / F.max("index").over(w.ordered(K, O).rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return _out(df, "index", "drawdown")


def w20_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return _out(views.daily(spark, sf).withColumn("z_63", w.zscore("close", 63, K, O)), "z_63")


def w22_percent_rank(spark: SparkSession, sf: str) -> DataFrame:
    df = views.monthly(spark, sf)
    df = df.withColumn("volume_rank", w.percent_rank_ties("volume", O)).withColumn("minus_mean", F.col("volume") - F.avg("volume").over(Window.partitionBy(O)))
    return _out(df, "volume_rank", "minus_mean")


def l03_peer_context(spark: SparkSession, sf: str) -> DataFrame:
    df = panel.peer_context(_monthly_returns(spark, sf), "ret", O, "sector")
    return _out(df, "market_peers", "market_mean", "market_std", "market_breadth", "sector_peers", "sector_mean", "sector_std", "sector_breadth")


def a26_peer_median(spark: SparkSession, sf: str) -> DataFrame:
    return _out(panel.peer_median(views.monthly(spark, sf), "close", [O, "sector"]), "peer_median")


def l06_factor_state(spark: SparkSession, sf: str) -> DataFrame:
    return _out(panel.factor_state(_monthly_returns(spark, sf), "ret", 12), "beta", "gamma", "own", "own_vol")


def l07_decompose(spark: SparkSession, sf: str) -> DataFrame:
    df = panel.decompose(_monthly_returns(spark, sf).where("ret is not null"), "ret")
    return _out(df, "market_part", "sector_part", "asset_part")


def l04_forward_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = panel.forward_labels(views.daily(spark, sf), views.actions(spark, sf), (1, 5, 10))
    return _out(df.withColumn("target_day", F.col("target_day").cast("string")), "horizon", "target_day", "status", "ret", "mfe", "mae", "path_vol")


def j16_action_overlap(spark: SparkSession, sf: str) -> DataFrame:
    df = panel.forward_labels(views.daily(spark, sf), views.actions(spark, sf), (5, 20))
    return df.groupBy("horizon", "status").agg(F.count(F.lit(1)).alias("n"))


def l21_total_return(spark: SparkSession, sf: str) -> DataFrame:
    obs = views.observations(spark, sf)
    cash = obs.where("l_returnflag = 'R' and l_discount >= 0.09").groupBy(K, O).agg(F.max("price").alias("p")).select(K, O, (F.col("p") / 100).alias("cash"))
    steps = panel.total_return_steps(views.daily(spark, sf), cash)
    return _out(panel.total_return_outcomes(steps, (1, 5, 21)), "tau", "status", "total_return")


def l15_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The next five closes of each row as one list."""
    df = views.daily(spark, sf).withColumn("path", F.collect_list("volume").over(w.ordered(K, O).rowsBetween(1, 5)))
    return df.select(K, F.col(O).cast("string").alias(O), F.array_join(F.transform("path", lambda x: x.cast("long").cast("string")), ",").alias("path"))


def l13_session_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Return to the third next event of the user's day, which must lie in the same day; excursions on the way."""
    ev = views.events(spark, sf).withColumn("session", F.to_date("ts"))
    k, o = ["user_id", "session"], ["ts", "event_id"]
    target = F.lead("value", 3).over(w.ordered(k, o))
    return ev.select(
        "event_id", F.round(target - F.col("value"), 6).alias("move"), F.round(w.forward(F.max, "value", 3, k, o) - F.col("value"), 6).alias("up"),
        F.round(w.forward(F.min, "value", 3, k, o) - F.col("value"), 6).alias("down"),
        F.when(target.isNull(), "leaves_session").otherwise("usable").alias("status"),
    )


def l14_overnight(spark: SparkSession, sf: str) -> DataFrame:
    """From the last value of a user's day to the first of the next day with events."""
    ev = views.events(spark, sf).withColumn("session", F.to_date("ts"))
    per = ev.groupBy("user_id", "session").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    nxt = F.lead("first").over(w.ordered("user_id", "session"))
    return per.select("user_id", F.col("session").cast("string").alias("session"), F.round(nxt - F.col("last"), 6).alias("overnight"), F.lead("session").over(w.ordered("user_id", "session")).cast("string").alias("next_session"))


def p13_regimes(spark: SparkSession, sf: str) -> DataFrame:
    df = panel.own_state(views.daily(spark, sf), returns=(1, 5), vols=(20,)).withColumn("pos", F.row_number().over(w.ordered(K, O)).cast("double"))
    slope = F.try_divide(w.slope("close", "pos", 20, K, O), F.col("close"))
    vol = F.when(F.col("vol_20").isNull(), "unknown").when(F.col("vol_20") >= 50, "wild").otherwise("calm")
    trend = F.when(slope.isNull(), "unknown").when(slope >= 0.01, "up").when(slope <= -0.01, "down").otherwise("flat")
    return df.select(vol.alias("volatility"), trend.alias("trend")).groupBy("volatility", "trend").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "L02_own_state": l02_own_state, "W09_sample_volatility": w09_sample_volatility, "W10_moving_averages": w10_moving_averages, "W13_rolling_slope": w13_rolling_slope,
    "W14_atr_rsi": w14_atr_rsi, "W16_rolling_beta": w16_rolling_beta, "W18_compound": w18_compound, "W19_drawdown_index": w19_drawdown_index, "W20_zscore": w20_zscore,
    "W22_percent_rank": w22_percent_rank, "L03_peer_context": l03_peer_context, "A26_peer_median": a26_peer_median, "L06_factor_state": l06_factor_state,
    "L07_decompose": l07_decompose, "L04_forward_labels": l04_forward_labels, "J16_action_overlap": j16_action_overlap, "L21_total_return": l21_total_return,
    "L15_paths": l15_paths, "L13_session_outcomes": l13_session_outcomes, "L14_overnight": l14_overnight, "P13_regimes": p13_regimes,
}


def _w(n: int) -> str:
    return f"over (partition by asset_id order by day rows between {n - 1} preceding and current row)"


def _roll(fn: str, v: str, n: int, least: int | None = None) -> str:
    return f"case when count({v}) {_w(n)} >= {least or n} then {fn}({v}) {_w(n)} end"


_LAG = "lag({v}, {n}) over (partition by asset_id order by day)"


def _ret(n: int, v: str = "close") -> str:
    return f"100 * ({v} / nullif({_LAG.format(v=v, n=n)}, 0) - 1)"


_D = "strftime(day, '%Y-%m-%d') as day"
_R = f"rets as (select *, {_ret(1)} ret from monthly)"
_FACT = f"""{_R}, m as (select *, avg(ret) over (partition by day) market, avg(ret) over (partition by day, sector) - avg(ret) over (partition by day) sector_rel from rets)"""


def _beta(y: str, x: str, n: int) -> str:
    wn = _w(n)
    both = f"{y} is not null and {x} is not null"
    return f"""case when count(case when {both} then 1 end) {wn} >= {n} and var_samp(case when {both} then {x} end) {wn} > 1e-12
        then covar_samp(case when {both} then {y} end, case when {both} then {x} end) {wn} / var_samp(case when {both} then {x} end) {wn} end"""


def _labels(h: int) -> str:
    nxt = f"over (partition by asset_id order by day rows between 1 following and {h} following)"
    lead = f"over (partition by asset_id order by day)"
    return f"""select asset_id, day, {h}::bigint horizon, lead(day, {h}) {lead} target_day,
        case when lead(close, {h}) {lead} is null then 'insufficient_future' when lead(cum, {h}) {lead} > cum then 'action_overlap' else 'usable' end status,
        100 * (lead(close, {h}) {lead} / close - 1) ret,
        case when count(high) {nxt} = {h} then greatest(100 * (max(high) {nxt} / close - 1), 100 * (lead(close, {h}) {lead} / close - 1)) end mfe,
        case when count(low) {nxt} = {h} then least(100 * (min(low) {nxt} / close - 1), 100 * (lead(close, {h}) {lead} / close - 1)) end mae,
        case when count(r1) {nxt} = {h} then stddev_pop(r1) {nxt} end path_vol from base"""


_BASE = f"""base as (select d.*, (select count(*) from actions a where a.asset_id = d.asset_id and a.day <= d.day) cum, {_ret(1)} r1 from daily d)"""
_TAU = """select asset_id, day, {t}::bigint tau, case when lead(close, {t}) over o is null then 'insufficient_future' when lead(cum_bad, {t}) over o > cum_bad then 'quarantine' else 'usable' end status,
    case when lead(cum_bad, {t}) over o = cum_bad then 100 * (exp(lead(cum_log, {t}) over o - cum_log) - 1) end total_return from s window o as (partition by asset_id order by day)"""

ORACLE = {
    "L02_own_state": f"""with {DAILY_SQL}, a as (select *, row_number() over (partition by asset_id order by day) history, {', '.join(f'{_ret(n)} ret_{n}' for n in (1, 3, 5, 10, 20, 63))} from daily),
        b as (select *, {', '.join(f"{_roll('stddev_pop', 'ret_1', n)} vol_{n}" for n in (5, 20, 63))}, volume / nullif({_roll('avg', 'volume', 20)}, 0) volume_ratio,
            100 * (close / nullif({_roll('max', 'close', 63)}, 0) - 1) drawdown_63, 100 * (close / nullif({_roll('min', 'close', 63)}, 0) - 1) from_low_63, (high - low) / nullif(close, 0) range_share from a)
        select asset_id, {_D}, history, {', '.join(f'round({c}, 6) {c}' for c in ('ret_1', 'ret_20', 'ret_63', 'vol_5', 'vol_20', 'vol_63', 'volume_ratio', 'drawdown_63', 'from_low_63', 'range_share'))},
            (history >= 100 and ret_63 is not null and vol_63 is not null and volume_ratio is not null and drawdown_63 is not null)::int ready from b""",
    "W09_sample_volatility": f"with {DAILY_SQL}, a as (select *, ln(close / nullif({_LAG.format(v='close', n=1)}, 0)) lr from daily) select asset_id, {_D}, round({_roll('stddev_samp', 'lr', 30, 10)} * sqrt(30), 6) vol_30 from a",
    "W10_moving_averages": f"with {DAILY_SQL} select asset_id, strftime(daily.day, '%Y-%m-%d') as day, " + ", ".join(
        f"round(100 * (close / nullif({_roll('avg', 'close', n).replace('by day', 'by daily.day')}, 0) - 1), 6) ma_dist_{n}" for n in (15, 60)) + f", round({_roll('avg', 'volume', 20, 10).replace('by day', 'by daily.day')}, 6) volume_mean_20 from daily",
    "W13_rolling_slope": f"with {DAILY_SQL}, a as (select *, row_number() over (partition by asset_id order by day)::double pos from daily), b as (select *, case when count(close) {_w(30)} >= 30 then regr_slope(close, pos) {_w(30)} end / nullif(close, 0) s from a) select asset_id, {_D}, round(s, 6) slope_30 from b",
    "W14_atr_rsi": f"""with {DAILY_SQL}, a as (select *, {_LAG.format(v='close', n=1)} prev from daily), b as (select *, case when prev is null then high - low else greatest(high - low, abs(high - prev), abs(low - prev)) end tr, close - prev step from a),
        c as (select *, {_roll('avg', 'tr', 14)} atr, case when step is not null then greatest(step, 0.0) end g, case when step is not null then greatest(-step, 0.0) end l from b),
        e as (select *, {_roll('avg', 'g', 14)} ag, {_roll('avg', 'l', 14)} al from c) select asset_id, {_D}, round(atr, 6) atr_14, round(case when al > 0 then 100 - 100 / (1 + ag / al) end, 6) rsi_14 from e""",
    "W16_rolling_beta": f"with {MONTHLY_SQL}, {_FACT}, b as (select *, {_beta('ret', 'market', 24)} beta from m) select asset_id, {_D}, round(market, 6) market, round(sector_rel, 6) sector_rel, round(beta, 6) beta from b",
    "W18_compound": f"with {MONTHLY_SQL}, {_R}, a as (select *, ln(1 + ret / 100) l from rets), b as (select *, exp({_roll('sum', 'l', 5)}) - 1 c5, exp({_roll('sum', 'l', 20)}) - 1 c20 from a) select asset_id, {_D}, round(c5, 6) comp_5, round(c20, 6) comp_20 from b",
    "W19_drawdown_index": f"with {MONTHLY_SQL}, {_R}, a as (select *, exp(sum(ln(1 + ret / 100)) over (partition by asset_id order by day)) ix from rets where ret is not null), b as (select *, ix / max(ix) over (partition by asset_id order by day) - 1 dd from a) select asset_id, {_D}, round(ix, 6) \"index\", round(dd, 6) drawdown from b",
    "W20_zscore": f"with {DAILY_SQL}, a as (select *, {_roll('avg', 'close', 63)} m, {_roll('stddev_pop', 'close', 63)} s from daily) select asset_id, {_D}, round(case when s > 1e-12 then (close - m) / s end, 6) z_63 from a",
    "W22_percent_rank": f"""with {MONTHLY_SQL}, a as (select *, (rank() over (partition by day order by volume) + (count(*) over (partition by day, volume) - 1) / 2.0) / count(volume) over (partition by day) vr,
        volume - avg(volume) over (partition by day) mm from monthly) select asset_id, {_D}, round(vr, 6) volume_rank, round(mm, 6) minus_mean from a""",
    "L03_peer_context": f"""with {MONTHLY_SQL}, {_R}, a as (select *, (ret > 0)::int::double up from rets),
        b as (select *, count(ret) over d - 1 mp, sum(ret) over d - ret ms, sum(ret * ret) over d - ret * ret mq, sum(up) over d - up mu, count(ret) over s - 1 sp, sum(ret) over s - ret ss, sum(ret * ret) over s - ret * ret sq, sum(up) over s - up su
            from a window d as (partition by day), s as (partition by day, sector))
        select asset_id, {_D}, mp market_peers, case when mp >= 50 then round(ms / nullif(mp, 0), 6) end market_mean, case when mp >= 50 then round(sqrt(greatest(0, mq / nullif(mp, 0) - (ms / nullif(mp, 0)) ** 2)), 6) end market_std,
            case when mp >= 50 then round(mu / nullif(mp, 0), 6) end market_breadth, sp sector_peers, case when sp >= 3 then round(ss / nullif(sp, 0), 6) end sector_mean,
            case when sp >= 3 then round(sqrt(greatest(0, sq / nullif(sp, 0) - (ss / nullif(sp, 0)) ** 2)), 6) end sector_std, case when sp >= 3 then round(su / nullif(sp, 0), 6) end sector_breadth from b""",
    "A26_peer_median": f"with {MONTHLY_SQL} select a.asset_id, strftime(a.day, '%Y-%m-%d') as day, round(median(b.close), 6) peer_median from monthly a left join monthly b on a.day = b.day and a.sector = b.sector and a.asset_id <> b.asset_id group by a.asset_id, a.day",
    "L06_factor_state": f"""with {MONTHLY_SQL}, {_FACT}, b as (select *, {_beta('ret', 'market', 12)} beta from m), c as (select *, ret - beta * market residual from b), e as (select *, {_beta('residual', 'sector_rel', 12)} gamma from c),
        f as (select *, residual - gamma * sector_rel own from e), g as (select *, {_roll('stddev_pop', 'own', 12)} ov from f) select asset_id, {_D}, round(beta, 6) beta, round(gamma, 6) gamma, round(own, 6) own, round(ov, 6) own_vol from g""",
    "L07_decompose": f"with {MONTHLY_SQL}, {_R}, a as (select *, avg(ret) over (partition by day) m, avg(ret) over (partition by day, sector) s from rets where ret is not null) select asset_id, {_D}, round(m, 6) market_part, round(s - m, 6) sector_part, round(ret - s, 6) asset_part from a",
    "L04_forward_labels": f"with {DAILY_SQL}, {ACTIONS_SQL}, {_BASE}, l as ({' union all '.join(_labels(h) for h in (1, 5, 10))}) select asset_id, {_D}, horizon, strftime(target_day, '%Y-%m-%d') target_day, status, round(ret, 6) ret, round(mfe, 6) mfe, round(mae, 6) mae, round(path_vol, 6) path_vol from l",
    "J16_action_overlap": f"with {DAILY_SQL}, {ACTIONS_SQL}, {_BASE}, l as ({' union all '.join(_labels(h) for h in (5, 20))}) select horizon, status, count(*) n from l group by 1, 2",
    "L21_total_return": f"""with {DAILY_SQL}, cash as (select asset_id, day, max(price) / 100 cash from obs where l_returnflag = 'R' and l_discount >= 0.09 group by 1, 2),
        a as (select daily.*, coalesce(cash, 0) cash, (close + coalesce(cash, 0)) / nullif({_LAG.format(v='close', n=1)}, 0) step from daily left join cash using (asset_id, day)),
        b as (select *, case when step is null or not (step > 0.2 and step < 5) then 0 else ln(step) end ls, coalesce(not (step > 0.2 and step < 5), false)::int bad from a),
        s as (select *, sum(ls) over (partition by asset_id order by day) cum_log, sum(bad) over (partition by asset_id order by day) cum_bad from b),
        t as ({' union all '.join(_TAU.format(t=t) for t in (1, 5, 21))}) select asset_id, {_D}, tau, status, round(total_return, 6) total_return from t""",
    "L15_paths": f"with {DAILY_SQL}, a as (select *, list(volume::bigint) over (partition by asset_id order by day rows between 1 following and 5 following) p from daily) select asset_id, {_D}, coalesce(array_to_string(p, ','), '') path from a",
    "L13_session_outcomes": f"""with {EVENTS_SQL}, a as (select *, lead(value, 3) over k t, count(value) over f c, max(value) over f mx, min(value) over f mn from ev
        window k as (partition by user_id, ts::date order by ts, event_id), f as (partition by user_id, ts::date order by ts, event_id rows between 1 following and 3 following))
        select event_id, round(t - value, 6) move, case when c = 3 then round(mx - value, 6) end up, case when c = 3 then round(mn - value, 6) end down, case when t is null then 'leaves_session' else 'usable' end status from a""",
    "L14_overnight": f"""with {EVENTS_SQL}, p as (select user_id, ts::date as sess, arg_min(value, (ts, event_id)) f, arg_max(value, (ts, event_id)) l from ev group by 1, 2)
        select user_id, strftime(sess, '%Y-%m-%d') as session, round(lead(f) over k - l, 6) overnight, strftime(lead(sess) over k, '%Y-%m-%d') next_session from p window k as (partition by user_id order by sess)""",
    "P13_regimes": f"""with {DAILY_SQL}, a as (select *, {_ret(1)} r, row_number() over (partition by asset_id order by day)::double pos from daily), b as (select *, {_roll('stddev_pop', 'r', 20)} v, case when count(close) {_w(20)} >= 20 then regr_slope(close, pos) {_w(20)} end / nullif(close, 0) s from a)
        select case when v is null then 'unknown' when v >= 50 then 'wild' else 'calm' end volatility, case when s is null then 'unknown' when s >= 0.01 then 'up' when s <= -0.01 then 'down' else 'flat' end trend, count(*) n from b group by 1, 2""",
}
