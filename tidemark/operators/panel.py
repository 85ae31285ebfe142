"""State and labels of an asset panel: own history, peers, factors, forward windows, total return."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as w

KEY, ORDER = "asset_id", "day"


def own_state(bars: DataFrame, returns: Sequence[int] = (1, 3, 5, 10, 20, 63), vols: Sequence[int] = (5, 20, 63), warm_up: int = 100) -> DataFrame:
    """Returns, volatilities, distances and ratios of each asset's own history; ``ready`` after ``warm_up`` rows with all of them."""
    k, o = KEY, ORDER
    df = bars.withColumn("history", F.row_number().over(w.ordered(k, o)).cast("long"))
    for n in returns:
        df = df.withColumn(f"ret_{n}", w.lag_return("close", n, k, o))
    for n in vols:
        df = df.withColumn(f"vol_{n}", w.trailing(F.stddev_pop, "ret_1", n, k, o))
    df = df.withColumn("volume_ratio", F.try_divide(F.col("volume"), w.trailing(F.avg, "volume", 20, k, o)))
    df = df.withColumn("drawdown_63", 100 * (F.try_divide(F.col("close"), w.trailing(F.max, "close", 63, k, o)) - 1))
    df = df.withColumn("from_low_63", 100 * (F.try_divide(F.col("close"), w.trailing(F.min, "close", 63, k, o)) - 1))
    df = df.withColumn("range_share", F.try_divide(F.col("high") - F.col("low"), F.col("close")))
    names = [c for c in df.columns if c.startswith(("ret_", "vol_", "drawdown", "from_low", "volume_ratio", "range"))]
    return df.withColumn("ready", ((F.col("history") >= warm_up) & finite(names)).cast("int"))


def finite(names: Sequence[str]) -> Column:
    """All of the columns present and no NaN."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in names])


def peer_context(df: DataFrame, value: str, day: str, sector: str, market_least: int = 50, sector_least: int = 3) -> DataFrame:
    """Mean, deviation and breadth of the other assets of the day and of the day's sector; null with too few peers."""
    out = df
    for name, by, least in (("market", [day], market_least), ("sector", [day, sector], sector_least)):
        n = w.peers(value, by)
        up = (F.col(value) > 0).cast("double")
        out = out.withColumn(f"{name}_peers", n)
        for what, c in (("mean", w.leave_one_out_mean(value, by)), ("std", w.leave_one_out_std(value, by)), ("breadth", w.leave_one_out_mean(up, by))):
            out = out.withColumn(f"{name}_{what}", F.when(n >= least, c))
    return out


def peer_median(df: DataFrame, value: str, by: Sequence[str], key: str = KEY) -> DataFrame:
    """Median of the others of the group, exactly.

    The others' median follows from the group's sorted values and the row's own
    place among them, so nothing is paired: with place ``i`` of ``n`` values, the
    middle of the rest is one step on wherever the row stands at or before it.
    """
    v = F.col(value)
    grp = Window.partitionBy(*by)
    place = F.row_number().over(grp.orderBy(v, key))
    ranked = df.where(v.isNotNull()).withColumn("_i", place).withColumn("_n", F.count(F.lit(1)).over(grp))
    low, high = F.floor((F.col("_n") - 2) / 2) + 1, F.floor((F.col("_n") - 1) / 2) + 1  # places in the rest
    for name, at in (("_lo", low), ("_hi", high)):
        ranked = ranked.withColumn(name, at + (F.col("_i") <= at).cast("long"))
    picks = {}
    # four values around the middle are enough for every row of a group
    for d in (0, 1, 2):
        m = F.floor((F.col("_n") - 2) / 2) + 1 + d
        picks[d] = F.max(F.when(F.col("_i") == m, v)).over(grp)
    base = F.floor((F.col("_n") - 2) / 2) + 1
    at = lambda c: F.when(c == base, picks[0]).when(c == base + 1, picks[1]).otherwise(picks[2])
    return ranked.withColumn("peer_median", F.when(F.col("_n") > 1, (at(F.col("_lo")) + at(F.col("_hi"))) / 2)).drop("_i", "_n", "_lo", "_hi")


def factor_state(df: DataFrame, ret: str, n: int = 24) -> DataFrame:
    """Market and sector means, market beta, the sector part beyond it, and what is the asset's own."""
    market = F.avg(ret).over(Window.partitionBy(ORDER))
    sector = F.avg(ret).over(Window.partitionBy(ORDER, "sector"))
    out = df.withColumn("market", market).withColumn("sector_rel", sector - F.col("market"))
    out = out.withColumn("beta", w.beta(ret, "market", n, KEY, ORDER))
    out = out.withColumn("residual", F.col(ret) - F.col("beta") * F.col("market"))
    out = out.withColumn("gamma", w.beta("residual", "sector_rel", n, KEY, ORDER))
    out = out.withColumn("own", F.col("residual") - F.col("gamma") * F.col("sector_rel"))
    return out.withColumn("own_vol", w.trailing(F.stddev_pop, "own", n, KEY, ORDER))


def decompose(df: DataFrame, value: str) -> DataFrame:
    """Market, sector and asset parts that add up to the value."""
    market = F.avg(value).over(Window.partitionBy(ORDER))
    sector = F.avg(value).over(Window.partitionBy(ORDER, "sector"))
    return df.select("*", market.alias("market_part"), (sector - market).alias("sector_part"), (F.col(value) - sector).alias("asset_part"))


def forward_labels(bars: DataFrame, actions: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Per row and horizon: return, best and worst excursion, path volatility, and why a label is missing.

    Excursions come from the highs and lows of the next ``h`` rows.  A label whose
    window ``(origin, target]`` holds an action is ``action_overlap``; actions on
    days without a bar count for the next bar.  Too short a future comes first.
    """
    k, o = KEY, ORDER
    # actions stand among the bars, before the one of their day, until they are counted; one shuffle and one sort serve all windows
    spine = bars.withColumn("_act", F.lit(0)).unionByName(actions.select(k, o).withColumn("_act", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(k).orderBy(F.col(o), F.col("_act").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = spine.withColumn("_cum", F.sum("_act").over(upto)).where("_act = 0").drop("_act").withColumn("_ret", w.lag_return("close", 1, k, o))
    made = []
    for h in horizons:
        target = F.lead("close", h).over(w.ordered(k, o))
        ret = 100 * (F.try_divide(target, F.col("close")) - 1)
        mfe = F.greatest(100 * (F.try_divide(w.forward(F.max, "high", h, k, o), F.col("close")) - 1), ret)
        mae = F.least(100 * (F.try_divide(w.forward(F.min, "low", h, k, o), F.col("close")) - 1), ret)
        vol = w.forward(F.stddev_pop, "_ret", h, k, o)
        overlap = F.lead("_cum", h).over(w.ordered(k, o)) > F.col("_cum")
        status = F.when(target.isNull(), "insufficient_future").when(overlap, "action_overlap").otherwise("usable")
        made.append(F.struct(
            F.lit(h).cast("long").alias("horizon"), F.lead(o, h).over(w.ordered(k, o)).alias("target_day"), status.alias("status"),
            ret.alias("ret"), mfe.alias("mfe"), mae.alias("mae"), vol.alias("path_vol"),
        ))
    return df.select(k, o, F.array(*made).alias("_l")).select(k, o, F.inline("_l"))


def forward_returns(bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """``asset_id, day, horizon, ret``: the change in percent to the close ``h`` rows ahead, null where the future is too short.

    The return of :func:`forward_labels` alone, in one sort of the closes.  A bar
    without a day comes last.
    """
    k, o = KEY, ORDER
    order = Window.partitionBy(k).orderBy(F.col(o).asc_nulls_last())
    ahead = bars.select(k, o, "close", *[F.lead("close", h).over(order).alias(f"_c{h}") for h in horizons])
    made = [F.struct(F.lit(h).cast("long").alias("horizon"), (100 * (w.divided(f"_c{h}", "close") - 1)).alias("ret")) for h in horizons]
    return ahead.select(k, o, F.inline(F.array(*made)))


def total_return_steps(bars: DataFrame, cash: DataFrame) -> DataFrame:
    """Each row's step ``(close + cash) / previous close``, its logarithm, and running sums of good and bad steps."""
    k, o = KEY, ORDER
    df = bars.join(cash, [k, o], "left").withColumn("cash", F.coalesce("cash", F.lit(0.0)))
    df = df.withColumn("step", F.try_divide(F.col("close") + F.col("cash"), F.lag("close").over(w.ordered(k, o))))
    bad = F.col("step").isNotNull() & ~((F.col("step") > 0.2) & (F.col("step") < 5.0))
    df = df.withColumn("log_step", F.when(bad | F.col("step").isNull(), 0.0).otherwise(F.ln("step"))).withColumn("bad", F.coalesce(bad, F.lit(False)).cast("long"))
    upto = w.ordered(k, o).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum_log", F.sum("log_step").over(upto)).withColumn("cum_bad", F.sum("bad").over(upto)).withColumn("position", F.row_number().over(w.ordered(k, o)))


def total_return_outcomes(steps: DataFrame, taus: Sequence[int]) -> DataFrame:
    """Outcomes for each horizon from differences of running sums: no path is walked."""
    k, o = KEY, ORDER
    made = []
    for tau in taus:
        ahead = lambda c, tau=tau: F.lead(c, tau).over(w.ordered(k, o))
        gone = ahead("cum_bad") - F.col("cum_bad")
        status = F.when(ahead("close").isNull(), "insufficient_future").when(gone > 0, "quarantine").otherwise("usable")
        made.append(F.struct(F.lit(tau).cast("long").alias("tau"), status.alias("status"), F.when(gone == 0, 100 * F.expm1(ahead("cum_log") - F.col("cum_log"))).alias("total_return")))
    return steps.select(k, o, F.array(*made).alias("_t")).select(k, o, F.inline("_t"))


def intraday_state(bars: DataFrame, key: str, at: str, returns: Sequence[int] = (1, 5, 15, 30, 60), spans: Sequence[int] = (30, 60), means: Sequence[int] = (15, 60), long: int = 60) -> DataFrame:
    """The state of each bar from its own past: returns, trend slopes, distances from means, volatilities, true range, strength, extremes, volume, candle.

    Sample deviations of log returns, simple means for range and strength, all in
    percent; extremes from the first bar on, relative volume from a third of the
    window on.  What has too short a past is null.
    """
    k, o, pct = key, at, lambda x, base: 100 * (F.try_divide(x, base) - 1)
    order = w.ordered(k, o)
    prev = F.lag("close").over(order)
    df = bars.withColumn("_pos", F.row_number().over(order).cast("double")).withColumn("_lr", F.ln(F.when((F.col("close") > 0) & (prev > 0), F.col("close") / prev)))
    df = df.withColumn("_tr", w.true_range("high", "low", "close", k, o)).withColumn("_step", F.col("close") - prev)
    high, low = w.trailing(F.max, "high", long, k, o, least=1), w.trailing(F.min, "low", long, k, o, least=1)
    made = {f"return_{n}": w.lag_return("close", n, k, o) for n in returns}
    made |= {f"slope_{n}": 100 * F.try_divide(w.slope("close", "_pos", n, k, o), F.col("close")) for n in spans}
    made |= {f"ma_distance_{n}": pct(F.col("close"), w.trailing(F.avg, "close", n, k, o)) for n in means}
    made |= {f"volatility_{n}": 100 * w.trailing(F.stddev_samp, "_lr", n, k, o) for n in spans}
    made |= {
        "atr_14": 100 * F.try_divide(w.trailing(F.avg, "_tr", 14, k, o), F.col("close")), "rsi_14": w.rsi("_step", 14, k, o),
        f"drawdown_{long}": pct(F.col("close"), high), f"from_low_{long}": pct(F.col("close"), low),
        "relative_volume": F.try_divide(F.col("volume"), w.trailing(F.avg, "volume", long, k, o, least=long // 3)),
        "bar_range": 100 * F.try_divide(F.col("high") - F.col("low"), F.col("close")), "close_location": F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
    }
    return df.select(*bars.columns, *[c.alias(n) for n, c in made.items()])


def cross_section_state(states: DataFrame, at: str, sector: str, ranked: Sequence[str], breadth: Sequence[str]) -> DataFrame:
    """Each state beside those of its time: market and sector means, what differs from them, percentile ranks, share of positives."""
    now, near = Window.partitionBy(at), Window.partitionBy(at, sector)
    made = []
    for c in ranked:
        market = F.avg(c).over(now)
        made += [market.alias(f"market_{c}"), (F.col(c) - market).alias(f"{c}_minus_market"), (F.col(c) - F.avg(c).over(near)).alias(f"{c}_minus_sector"), w.percent_rank_ties(c, at).alias(f"{c}_percentile")]
    made += [F.avg((F.col(c) > 0).cast("double")).over(now).alias(f"breadth_{c}") for c in breadth]
    return states.select("*", *made)


def series_state(bars: DataFrame, names: dict[int, str], returns: Sequence[int], vol: int) -> DataFrame:
    """One row a day with the returns, volatility and distance from the year's high of a few named series (indices, rates).

    Each series is read along its own days first, then all are set side by side.
    """
    k, o = KEY, ORDER
    own = bars.where(F.col(k).isin(list(names))).withColumn("_r", w.lag_return("close", 1, k, o))
    metrics = {f"return_{n}": w.lag_return("close", n, k, o) for n in returns} | {f"volatility_{vol}": w.trailing(F.stddev_pop, "_r", vol, k, o), "from_high": 100 * (F.try_divide(F.col("close"), w.trailing(F.max, "close", 12, k, o, least=1)) - 1)}
    df = own.select(k, o, *[c.alias(n) for n, c in metrics.items()])
    return df.groupBy(o).agg(*[F.max(F.when(F.col(k) == i, F.col(m))).alias(f"{name}_{m}") for i, name in names.items() for m in metrics])


def step_classes(steps: DataFrame, tolerance: float = 0.005, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """``close, prev, cash`` with the economic step ``(close + cash) / prev``, the provider's ``close / (prev - cash)``, and what to make of the row.

    ``first`` without a previous close, ``quarantine`` outside ``low..high``, ``plain``
    without cash, ``agrees`` or ``differs`` by the relative difference of both steps.
    """
    economic = F.try_divide(F.col("close") + F.col("cash"), F.col("prev"))
    provider = F.try_divide(F.col("close"), F.col("prev") - F.col("cash"))
    off = F.abs(F.try_divide(economic, provider) - 1)
    kind = (
        F.when(economic.isNull(), "first").when(~((economic > low) & (economic < high)), "quarantine").when(F.col("cash") == 0, "plain")
        .when(off <= tolerance, "agrees").otherwise("differs")
    )
    return steps.select("*", economic.alias("economic"), provider.alias("provider"), kind.alias("step_class"))


def repair_envelope(bars: DataFrame, most: float) -> DataFrame:
    """Bars whose high and low hold their open and close: moved by at most the share ``most`` of the close, else ``status`` is ``refused`` and they stay."""
    top, floor = F.greatest("high", "open", "close"), F.least("low", "open", "close")
    moved = F.greatest(top - F.col("high"), F.col("low") - floor)
    share = F.try_divide(moved, F.col("close"))
    status = F.when(moved.isNull(), "incomplete").when(moved == 0, "whole").when(share <= most, "repaired").otherwise("refused")
    ok = F.coalesce(share <= most, F.lit(False))
    return bars.withColumns({"high": F.when(ok, top).otherwise(F.col("high")), "low": F.when(ok, floor).otherwise(F.col("low")), "status": status})
