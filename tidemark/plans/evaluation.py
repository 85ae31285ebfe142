"""Queries over splits, distributions, metrics and inference, on the monthly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import distribution as D
from tidemark.operators import scoring as S
from tidemark.operators import splits
from tidemark.operators import windows as w
from tidemark.plans import views
from tidemark.plans.views import EVENTS_SQL, MONTHLY_SQL
from tidemark.session import stored

K, O = "asset_id", "day"
Z = {"q05": -1.645, "q25": -0.674, "q50": 0.0, "q75": 0.674, "q95": 1.645}


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly return, the next one as outcome, and the month in which it is known."""
    df = views.monthly(spark, sf).withColumn("ret", w.lag_return("close", 1, K, O))
    order = w.ordered(K, O)
    return df.withColumn("y", F.lead("ret").over(order)).withColumn("target_day", F.lead(O).over(order))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes beside two simple forecasts: the trailing mean with scaled quantiles, and zero."""
    df = returns(spark, sf).withColumn("p", w.trailing(F.avg, "ret", 12, K, O)).withColumn("vol", w.trailing(F.stddev_pop, "ret", 12, K, O))
    for name, z in Z.items():
        df = df.withColumn(name, F.col("p") + z * F.col("vol"))
    df = df.withColumn("p_pos", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.try_divide(F.col("p"), 4 * F.col("vol")))))
    return df.where("y is not null and vol > 0")


def _round(df: DataFrame, *keep: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def e01_purged_folds(spark, sf):
    df = splits.purged_folds(returns(spark, sf).where("target_day is not null"), O, "target_day", 6)
    return _round(df.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min(O).alias("first_day"), F.max("target_day").alias("last_target")))


def e03_group_folds(spark, sf):
    ev = views.events(spark, sf).select("user_id", F.to_date("ts").alias("day"))
    ev = ev.withColumn("grp", F.col("user_id") * 100 + F.dayofmonth("day")).withColumn("target", F.date_add("day", 2))
    df = splits.group_folds(ev, "grp", "day", "target", 5)
    return df.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("n_groups"))


def e06_time_split(spark, sf):
    df = splits.time_split(returns(spark, sf), O, 0.8)
    return _round(df.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min(O).alias("first_day"), F.max(O).alias("last_day")))


def e07_walk_forward(spark, sf):
    df = splits.walk_forward(returns(spark, sf), [K], [O], 24, 12)
    return df.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def e08_purge_shared(spark, sf):
    df = views.events(spark, sf).select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").alias("k"))
    cut = F.lit("2024-01-24").cast("timestamp")
    test, train = df.where(F.col("ts") >= cut).where("k < '5'"), df.where(F.col("ts") < cut)
    return splits.purge_shared(train, test, ["k"]).select("event_id")


def e10_point_metrics(spark, sf):
    return _round(scored(spark, sf).groupBy("sector").agg(*S.point_metrics("y", "p")))


def e11_pinball(spark, sf):
    df = scored(spark, sf)
    return _round(df.groupBy("sector").agg(*[F.avg(S.pinball(F.col("y"), F.col(q), int(q[1:]) / 100)).alias(f"loss_{q}") for q in Z], F.avg(S.mean_pinball("y")).alias("loss")))


def e12_distribution_metrics(spark, sf):
    return _round(scored(spark, sf).groupBy("sector").agg(*S.distribution_metrics("y", "p_pos")))


def e13_day_equal(spark, sf):
    df = scored(spark, sf).withColumn("delta", F.abs(F.col("y")) - F.abs(F.col("y") - F.col("p")))
    daily = S.equal_by(df, [[O]], "delta")
    return _round(daily.agg(F.avg("delta").alias("day_equal"), F.avg((F.col("delta") > 0).cast("double")).alias("days_better"), F.count("delta").alias("n_days")))


def a22_three_levels(spark, sf):
    df = scored(spark, sf).withColumn("loss", S.mean_pinball("y"))
    return _round(S.equal_by(df, [[O, "sector"], ["sector"]], "loss"))


def e15_block_bootstrap(spark, sf):
    df = scored(spark, sf).withColumn("delta", F.abs(F.col("y")) - F.abs(F.col("y") - F.col("p")))
    return _round(S.interval(S.block_bootstrap(S.equal_by(df, [[O]], "delta"), O, "delta", 10, 500, 7)))


def e17_daily_ic(spark, sf):
    return _round(S.information_coefficients(scored(spark, sf), O, "y", "p"))


def e18_paired(spark, sf):
    df = scored(spark, sf).withColumn("delta", F.abs(F.col("y")) - F.abs(F.col("y") - F.col("p")))
    return _round(df.groupBy(K).agg(
        F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"), F.avg((F.col("delta") > 0).cast("double")).alias("win_rate"),
        *[F.percentile("delta", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.05, 0.5, 0.95)]).where("n >= 50"))


def e20_drift(spark, sf):
    """Calibration of the central range in blocks of twelve months."""
    df = scored(spark, sf)
    days = df.select(O).distinct().withColumn("block", F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(O)) - 1) / 12))
    inside = ((F.col("y") >= F.col("q05")) & (F.col("y") <= F.col("q95"))).cast("double")
    return _round(df.join(days, O).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage_90")))


def a31_concentration(spark, sf):
    df = scored(spark, sf).withColumn("delta", F.abs(F.col("y")) - F.abs(F.col("y") - F.col("p")))
    return _round(S.concentration(df, O, K, "delta").drop("cum_share"))


def a32_without_each(spark, sf):
    df = scored(spark, sf).withColumn("delta", F.abs(F.col("y")) - F.abs(F.col("y") - F.col("p")))
    return _round(S.without_each_group(df, O, "sector", "delta"))


def e22_gate(spark, sf):
    """PASS, FAIL or INCONCLUSIVE by the day-equal delta and the share of better sectors."""
    df = scored(spark, sf).withColumn("delta", F.abs(F.col("y")) - F.abs(F.col("y") - F.col("p")))
    per = df.groupBy("sector").agg(F.avg("delta").alias("d"))
    share = per.agg(F.avg((F.col("d") > 0).cast("double")).alias("share"), F.avg("d").alias("mean"))
    verdict = F.when((F.col("mean") > 0) & (F.col("share") >= 0.6), "PASS").when((F.col("mean") <= 0) & (F.col("share") < 0.4), "FAIL").otherwise("INCONCLUSIVE")
    return _round(share.withColumn("verdict", verdict))


def e24_extremes(spark, sf):
    df = scored(spark, sf)
    cut = D.quantiles_of(df.withColumn("size", F.abs("y")), "size", (0.99,))[0]
    return _round(df.where(F.abs("y") <= cut).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")))


def e25_variance_parts(spark, sf):
    df = returns(spark, sf).where("y is not null")
    m, s = F.avg("y").over(Window.partitionBy(O)), F.avg("y").over(Window.partitionBy(O, "sector"))
    df = df.withColumn("m", m).withColumn("s", s)
    return _round(df.agg(
        F.var_pop("y").alias("total"), F.var_pop("m").alias("market"), F.var_pop(F.col("s") - F.col("m")).alias("sector"), F.var_pop(F.col("y") - F.col("s")).alias("asset"),
        F.avg(F.abs(F.col("y") - F.col("m"))).alias("oracle_market_mae")))


def e26_topology(spark, sf):
    """How much of a feature's spread lies within days."""
    df = returns(spark, sf).where("ret is not null")
    total = df.agg(F.stddev_pop("ret")).scalar()
    return _round(df.groupBy(O).agg(F.stddev_pop("ret").alias("within")).agg((F.avg("within") / total).alias("within_share"), F.count(F.lit(1)).alias("n_days")))


def w31_autocorrelation(spark, sf):
    daily = S.equal_by(returns(spark, sf).where("ret is not null"), [[O]], "ret")
    return _round(S.autocorrelation(daily, O, "ret", (1, 2, 3, 6, 12)))


def w30_quartiles(spark, sf):
    df = returns(spark, sf).where("ret is not null")
    q = D.quantiles_of(df, "ret", (0.25, 0.5, 0.75))
    regime = F.when(F.col("ret") <= q[0], 1).when(F.col("ret") <= q[1], 2).when(F.col("ret") <= q[2], 3).otherwise(4)
    return _round(df.groupBy(regime.cast("long").alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_next")))


def m01_empirical(spark, sf):
    return _round(D.empirical(returns(spark, sf).where("y is not null"), "y", ["sector"]))


def m02_fallback(spark, sf):
    df = returns(spark, sf).where("y is not null")
    train, test = df.where("day < '1999-01-01'"), df.where("day >= '1999-01-01'").select(K, O)
    own = D.empirical(train.where("volume > 40"), "y", [K])
    return _round(D.with_fallback(test, own, D.empirical(train, "y"), K, 30))


def m03_volatility_scaled(spark, sf):
    df = stored(scored(spark, sf).select(K, O, "y", "vol"), "scored")
    return _round(D.volatility_scaled(df.where("day < '1999-01-01'"), df.where("day >= '1999-01-01'").select(K, O, "vol"), "y", "vol"))


def m04_baselines(spark, sf):
    df = returns(spark, sf).where("y is not null")
    train, test = df.where("day < '1999-01-01'"), df.where("day >= '1999-01-01' and ret is not null")
    mean, med = train.agg(F.avg("y")).scalar(), D.quantiles_of(train, "y", (0.5,))[0]
    up = train.agg(F.avg((F.col("y") > 0).cast("double"))).scalar()
    own = train.groupBy(K).agg(F.avg("y").alias("own"))
    e = lambda p: F.avg(F.abs(F.col("y") - p))
    out = test.join(own, K, "left").agg(
        e(F.lit(0.0)).alias("zero"), e(mean).alias("train_mean"), e(med).alias("train_median"), e(F.coalesce("own", mean)).alias("asset_mean"), e(F.col("ret")).alias("momentum"),
        F.avg(((F.col("y") > 0) == (up >= 0.5)).cast("double")).alias("majority_sign"))
    return _round(out)


def m05_adaptive_scale(spark, sf):
    df = scored(spark, sf).withColumn("fast", w.trailing(F.stddev_pop, "ret", 3, K, O))
    return _round(df.select(K, O, D.adaptive_scale("fast", "vol", 1.1, 0.4, 0.7).alias("scale")))


def m10_conformal_shift(spark, sf):
    """Weighted quantiles of the last two years' residuals, as shifts of each forecast quantile."""
    df = stored(D.day_weights(scored(spark, sf).where("day >= '2000-01-01'"), O), "weighted")
    out = None
    for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95)):
        one = D.weighted_quantile(df.withColumn("res", F.round(F.col("y") - F.col(n), 9)), "res", "wt", q - 1e-12).select(F.lit(n).alias("name"), F.col("quantile").alias("shift"))
        out = one if out is None else out.unionByName(one)
    return _round(out)


def m12_rearrange(spark, sf):
    df = scored(spark, sf).withColumn("q25", F.col("q25") - F.abs("ret") / 3)
    out = df.select(K, O, D.crosses().cast("int").alias("crossed"), *D.rearranged())
    return _round(out)


def m14_placebo(spark, sf):
    """No row keeps its own value, and every day keeps its sum."""
    df = D.day_donor(returns(spark, sf).where("ret is not null"), O, K, "volume", 11)
    return _round(df.groupBy(O).agg(F.count("donor").alias("n"), (F.sum("donor") - F.sum(F.when(F.col("donor").isNotNull(), F.col("volume")))).alias("difference")))


def m24_day_weights(spark, sf):
    df = D.day_weights(returns(spark, sf), O)
    return _round(df.groupBy(O).agg(F.sum("wt").alias("day_weight"), F.count(F.lit(1)).alias("n")))


def a10_weighted_quantile(spark, sf):
    df = views.observations(spark, sf)
    return _round(D.weighted_quantile(df, "price", "volume", 0.9, [K]))


def f32_interpolated_cdf(spark, sf):
    return _round(scored(spark, sf).select(K, O, D.cdf_at(F.lit(0.0)).alias("cdf0"), D.cdf_at(F.col("y")).alias("pit")))


def m11_isotonic(spark, sf):
    """Chances calibrated by isotonic regression on earlier months."""
    from tidemark.operators import learners

    df = scored(spark, sf).withColumn("up", (F.col("y") > 0).cast("double"))
    return _round(learners.isotonic(df.where("day < '1999-01-01'"), df.where("day >= '1999-01-01'"), "p_pos", "up", [K, O]))


def m18_linear_parts(spark, sf):
    """Ridge regressions of the market, sector and asset part, put together again."""
    from tidemark.operators import learners

    df = returns(spark, sf).where("y is not null and ret is not null")
    m, s = F.avg("y").over(Window.partitionBy(O)), F.avg("y").over(Window.partitionBy(O, "sector"))
    df = df.withColumn("ym", m).withColumn("ys", s - F.col("ym")).withColumn("ya", F.col("y") - F.col("ym") - F.col("ys"))
    df = df.withColumn("rm", F.avg("ret").over(Window.partitionBy(O))).withColumn("rs", F.avg("ret").over(Window.partitionBy(O, "sector")) - F.col("rm"))
    df = df.withColumn("ra", F.col("ret") - F.col("rm") - F.col("rs"))
    return _round(learners.additive_ridge(df, "day < '1999-01-01'", [("ym", ["rm"]), ("ys", ["rs", "rm"]), ("ya", ["ra", "rs"])], [K, O]))


def m22_quantile_forest(spark, sf):
    """Quantiles over what the trees of a forest predict."""
    from tidemark.operators import learners

    df = scored(spark, sf)
    return learners.quantile_forest(df.where("day < '1999-01-01'"), df.where("day >= '1999-01-01'"), ["ret", "vol", "p"], "y", [K, O])


QUERIES = {
    "E01_purged_folds": e01_purged_folds, "E03_group_folds": e03_group_folds, "E06_time_split": e06_time_split, "E07_walk_forward": e07_walk_forward, "E08_purge_shared": e08_purge_shared,
    "E10_point_metrics": e10_point_metrics, "E11_pinball": e11_pinball, "E12_distribution_metrics": e12_distribution_metrics, "E13_day_equal": e13_day_equal, "A22_three_levels": a22_three_levels,
    "E15_block_bootstrap": e15_block_bootstrap, "E17_daily_ic": e17_daily_ic, "E18_paired": e18_paired, "E20_drift": e20_drift, "A31_concentration": a31_concentration, "A32_without_each": a32_without_each,
    "E22_gate": e22_gate, "E24_extremes": e24_extremes, "E25_variance_parts": e25_variance_parts, "E26_topology": e26_topology, "W31_autocorrelation": w31_autocorrelation, "W30_quartiles": w30_quartiles,
    "M01_empirical": m01_empirical, "M02_fallback": m02_fallback, "M03_volatility_scaled": m03_volatility_scaled, "M04_baselines": m04_baselines, "M05_adaptive_scale": m05_adaptive_scale,
    "M10_conformal_shift": m10_conformal_shift, "M12_rearrange": m12_rearrange, "M14_placebo": m14_placebo, "M24_day_weights": m24_day_weights, "A10_weighted_quantile": a10_weighted_quantile,
    "F32_interpolated_cdf": f32_interpolated_cdf, "M11_isotonic": m11_isotonic, "M18_linear_parts": m18_linear_parts, "M22_quantile_forest": m22_quantile_forest,
}


def _roll(fn: str, v: str, n: int) -> str:
    win = f"over (partition by asset_id order by day rows between {n - 1} preceding and current row)"
    return f"case when count({v}) {win} >= {n} then {fn}({v}) {win} end"


_A = "(partition by asset_id order by day)"
RETURNS_SQL = f"""{MONTHLY_SQL}, r0 as (select *, 100 * (close / nullif(lag(close) over {_A}, 0) - 1) ret from monthly),
rets as (select *, lead(ret) over {_A} y, lead(day) over {_A} target_day from r0)"""
SCORED_SQL = f"""{RETURNS_SQL}, s0 as (select *, {_roll('avg', 'ret', 12)} p, {_roll('stddev_pop', 'ret', 12)} vol, {_roll('stddev_pop', 'ret', 3)} fast0 from rets),
scored as (select *, {', '.join(f'p + {z} * vol {n}' for n, z in Z.items())}, greatest(0, least(1, 0.5 + p / (4 * vol))) p_pos, abs(y) - abs(y - p) delta from s0 where y is not null and vol > 0)"""
_PB = {n: f"greatest({int(n[1:]) / 100} * (y - {n}), {int(n[1:]) / 100 - 1} * (y - {n}))" for n in Z}
_LOSS = f"({' + '.join(_PB.values())}) / 5"
_DAY = "strftime({c}, '%Y-%m-%d')"
_QCOLS = ", ".join(f"round(quantile_cont(y, {q}), 6) {n}" for n, q in zip(Z, D.QS, strict=True))
_TRAIN, _TEST = "where day < date '1999-01-01'", "where day >= date '1999-01-01'"


def _cdf(x: str) -> str:
    names, levels = list(Z), D.QS
    parts = [f"when {x} <= {names[0]} then {levels[0]}"]
    for i in range(4):
        parts.append(f"when {x} <= {names[i + 1]} then {levels[i]} + {levels[i + 1] - levels[i]} * coalesce(({x} - {names[i]}) / nullif({names[i + 1]} - {names[i]}, 0), 1)")
    return f"case {' '.join(parts)} else {levels[-1]} end"


_ORDERED = "list_sort([q05, q25x, q50, q75, q95])"

def _solve2(y: str, a: str, b: str, t: str) -> str:
    """Slopes and intercept of a ridge of two features with penalty 1, from centred sums."""
    return f"""(select my - (syA * (sbb + 1) - syB * sab) / d * ma - (syB * (saa + 1) - syA * sab) / d * mb c, (syA * (sbb + 1) - syB * sab) / d ba, (syB * (saa + 1) - syA * sab) / d bb from (select *, (saa + 1) * (sbb + 1) - sab * sab d from (
        select avg({y}) my, avg({a}) ma, avg({b}) mb, var_pop({a}) * count(*) saa, var_pop({b}) * count(*) sbb, covar_pop({a}, {b}) * count(*) sab, covar_pop({y}, {a}) * count(*) syA, covar_pop({y}, {b}) * count(*) syB from {t})))"""


_PARTS_SQL = f"""{RETURNS_SQL}, r as (select * from rets where y is not null and ret is not null), p0 as (select *, avg(y) over (partition by day) ym, avg(ret) over (partition by day) rm, avg(y) over (partition by day, sector) - avg(y) over (partition by day) ys, avg(ret) over (partition by day, sector) - avg(ret) over (partition by day) rs from r),
p as (select *, y - ym - ys ya, ret - rm - rs ra from p0), t as (select * from p {_TRAIN})"""
_HASH = "(('0x' || substring(sha256({t}), 1, 15))::hugeint % {n})::bigint"
_ISO = f"""{SCORED_SQL}, x as (select p_pos x, avg((y > 0)::int) v, count(*) w from scored {_TRAIN} group by 1), i as (select *, row_number() over (order by x) k, sum(w) over (order by x) cw, sum(w * v) over (order by x) cv from x),
pr as (select a.k ka, b.k kb, (b.cv - a.cv + a.w * a.v) / (b.cw - a.cw + a.w) m from i a join i b on a.k <= b.k), lo as (select ka, kb, min(m) over (partition by ka order by kb desc rows between unbounded preceding and current row) lm from pr),
g as (select kb k, max(lm) f from lo group by 1), gx as (select x, f from g join i using (k)), e as (select min(x) a, max(x) b, arg_min(f, x) fa, arg_max(f, x) fb from gx)"""

ORACLE = {
    "E15_block_bootstrap": f"""with {SCORED_SQL}, d as (select day, avg(delta) v, row_number() over (order by day) - 1 i, count(*) over () n from scored group by 1), z as (select least(10, n) l, n, ceil(n / least(10, n))::bigint nb from d limit 1),
        g as (select r, b, l, n, {_HASH.format(t="'7-' || r || '-' || b", n='(n - l + 1)')} s from z, (select unnest(range(0, 500)) r), (select unnest(range(0, (select nb from z))) b)), p as (select r, b * l + j place, s + j i, n from g, (select unnest(range(0, 10)) j) where j < l),
        m as (select r, avg(v) v from p join d using (i) where place < p.n group by 1) select round(quantile_cont(v, 0.025), 6) low, round(avg(v), 6) middle, round(quantile_cont(v, 0.975), 6) high from m""",
    "M18_linear_parts": f"""with {_PARTS_SQL}, a as (select avg(ym) - b * avg(rm) c, b from t, (select covar_pop(ym, rm) * count(*) / (var_pop(rm) * count(*) + 1) b from t) group by b), s as {_solve2('ys', 'rs', 'rm', 't')}, o as {_solve2('ya', 'ra', 'rs', 't')}
        select asset_id, strftime(p.day, '%Y-%m-%d') as day, round(a.c + a.b * rm + s.c + s.ba * rs + s.bb * rm + o.c + o.ba * ra + o.bb * rs, 6) predicted from p, a, s, o where p.day >= date '1999-01-01'""",
    "M11_isotonic": f"""with {_ISO}, q as (select asset_id, day, p_pos from scored where day >= date '1999-01-01'), u as (select distinct p_pos from q),
        n as (select p_pos, (select max(x) from gx where x <= p_pos) xa, (select min(x) from gx where x >= p_pos) xb from u), v as (select n.p_pos, case when n.xa is null then e.fa when n.xb is null then e.fb when n.xa = n.xb then ga.f else ga.f + (gb.f - ga.f) * (n.p_pos - n.xa) / (n.xb - n.xa) end c from n cross join e left join gx ga on ga.x = n.xa left join gx gb on gb.x = n.xb)
        select asset_id, strftime(q.day, '%Y-%m-%d') as day, round(c, 6) calibrated from q join v using (p_pos)""",
    "E01_purged_folds": f"""with {RETURNS_SQL}, d as (select distinct day from rets where target_day is not null), c as (select day, ntile(6) over (order by day) fold from d), f as (select fold, min(day) a, max(day) b from c group by 1),
        x as (select fold, case when day between a and b then 'test' else 'train' end as role, rets.* from rets join f on fold > 1 and (day between a and b or target_day < a) where target_day is not null)
        select fold, role, count(*) n, strftime(min(x.day), '%Y-%m-%d') first_day, strftime(max(target_day), '%Y-%m-%d') last_target from x group by 1, 2""",
    "E03_group_folds": f"""with {EVENTS_SQL}, e as (select user_id, ts::date as day, user_id * 100 + day(ts) grp, ts::date + 2 target from ev), g as (select grp, min(day) anchor, max(target) reach from e group by 1),
        c as (select d, ntile(5) over (order by d) fold from (select distinct anchor d from g)), f as (select fold, min(d) a, max(d) b from c group by 1),
        x as (select grp, fold, case when anchor between a and b then 'test' else 'train' end as role from g join f on fold > 1 and (anchor between a and b or reach < a))
        select fold, role, count(*) n, count(distinct grp) n_groups from e join x using (grp) group by 1, 2""",
    "E06_time_split": f"""with {RETURNS_SQL}, d as (select day, row_number() over (order by day) i, count(*) over () n from (select distinct day from rets)), x as (select rets.day, case when i <= floor(n * 0.8) then 'train' else 'test' end as role from rets join d using (day))
        select role, count(*) n, strftime(min(day), '%Y-%m-%d') first_day, strftime(max(day), '%Y-%m-%d') last_day from x group by 1""",
    "E07_walk_forward": f"with {RETURNS_SQL}, x as (select case when row_number() over {_A} <= 24 then 0 else (row_number() over {_A} - 25) // 12 + 1 end step from rets) select step, count(*) n from x group by 1",
    "E08_purge_shared": f"with {EVENTS_SQL}, e as (select event_id, ts, json_extract_string(props, '$.k') k from ev) select event_id from e where ts < timestamp '2024-01-24' and k not in (select k from e where ts >= timestamp '2024-01-24' and k < '5')",
    "E10_point_metrics": f"with {SCORED_SQL} select sector, count(p - y) n, round(avg(abs(p - y)), 6) mae, round(sqrt(avg((p - y) ** 2)), 6) rmse, round(median(abs(p - y)), 6) median_ae, round(avg(p - y), 6) bias, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(y)), 6) r2, round(avg((p * y > 0)::int), 6) direction from scored group by 1",
    "E11_pinball": f"with {SCORED_SQL} select sector, {', '.join(f'round(avg({e}), 6) loss_{n}' for n, e in _PB.items())}, round(avg({_LOSS}), 6) loss from scored group by 1",
    "E12_distribution_metrics": f"""with {SCORED_SQL} select sector, round(avg((p_pos - (y > 0)::int) ** 2), 6) brier, round(avg((y > 0)::int), 6) base_rate, round(avg((y between q25 and q75)::int), 6) coverage_50, round(avg((y between q05 and q95)::int), 6) coverage_90,
        round(avg(q95 - q05), 6) width_90, round(({' + '.join(f'abs(avg((y <= {n})::int) - {int(n[1:]) / 100})' for n in Z)}) / 5, 6) calibration_error from scored group by 1""",
    "E13_day_equal": f"with {SCORED_SQL}, d as (select day, avg(delta) delta from scored group by 1) select round(avg(delta), 6) day_equal, round(avg((delta > 0)::int), 6) days_better, count(*) n_days from d",
    "A22_three_levels": f"with {SCORED_SQL}, d as (select day, sector, avg({_LOSS}) loss from scored group by 1, 2) select sector, round(avg(loss), 6) loss from d group by 1",
    "E17_daily_ic": f"""with {SCORED_SQL}, k as (select *, rank() over (partition by day order by y) + (count(*) over (partition by day, y) - 1) / 2.0 ry, rank() over (partition by day order by p) + (count(*) over (partition by day, p) - 1) / 2.0 rp from scored)
        select {_DAY.format(c='k.day')} as day, count(*) n, round(corr(y, p), 6) pearson, round(corr(ry, rp), 6) spearman from k group by k.day having count(*) >= 30""",
    "E18_paired": f"with {SCORED_SQL} select asset_id, count(*) n, round(avg(delta), 6) mean_delta, round(avg((delta > 0)::int), 6) win_rate, round(quantile_cont(delta, 0.05), 6) p5, round(quantile_cont(delta, 0.5), 6) p50, round(quantile_cont(delta, 0.95), 6) p95 from scored group by 1 having count(*) >= 50",
    "E20_drift": f"with {SCORED_SQL}, k as (select *, (dense_rank() over (order by day) - 1) // 12 block from scored) select block, count(*) n, round(avg((y between q05 and q95)::int), 6) coverage_90 from k group by 1",
    "A31_concentration": f"with {SCORED_SQL}, k as (select *, delta / count(*) over (partition by day) c from scored), g as (select asset_id, sum(c) / (select count(distinct day) from scored) v from k group by 1) select asset_id, round(v, 6) contribution, round(abs(v) / sum(abs(v)) over (), 6) abs_share from g",
    "A32_without_each": f"with {SCORED_SQL}, s as (select distinct sector from scored), x as (select s.sector, day, avg(delta) d from s join scored on scored.sector <> s.sector group by 1, 2) select sector, round(avg(d), 6) mean_without from x group by 1",
    "E22_gate": f"with {SCORED_SQL}, g as (select sector, avg(delta) d from scored group by 1), h as (select avg((d > 0)::int) s, avg(d) m from g) select round(s, 6) share, round(m, 6) mean, case when m > 0 and s >= 0.6 then 'PASS' when m <= 0 and s < 0.4 then 'FAIL' else 'INCONCLUSIVE' end verdict from h",
    "E24_extremes": f"with {SCORED_SQL} select count(*) n, round(avg(abs(y - p)), 6) mae from scored where abs(y) <= (select quantile_cont(abs(y), 0.99) from scored)",
    "E25_variance_parts": f"with {RETURNS_SQL}, k as (select *, avg(y) over (partition by day) m, avg(y) over (partition by day, sector) s from rets where y is not null) select round(var_pop(y), 6) total, round(var_pop(m), 6) market, round(var_pop(s - m), 6) sector, round(var_pop(y - s), 6) asset, round(avg(abs(y - m)), 6) oracle_market_mae from k",
    "E26_topology": f"with {RETURNS_SQL}, d as (select day, stddev_pop(ret) w from rets where ret is not null group by 1) select round(avg(w) / (select stddev_pop(ret) from rets), 6) within_share, count(*) n_days from d",
    "W31_autocorrelation": f"with {RETURNS_SQL}, d as (select day, avg(ret) x from rets where ret is not null group by 1), " + "k as (select *, " + ", ".join(f"lag(x, {n}) over (order by day) l{n}" for n in (1, 2, 3, 6, 12)) + " from d) " + " union all ".join(f"select {n}::bigint lag, round(corr(x, l{n}), 6) corr from k" for n in (1, 2, 3, 6, 12)),
    "W30_quartiles": f"with {RETURNS_SQL}, q as (select quantile_cont(ret, 0.25) a, quantile_cont(ret, 0.5) b, quantile_cont(ret, 0.75) c from rets) select case when ret <= a then 1 when ret <= b then 2 when ret <= c then 3 else 4 end::bigint quartile, count(*) n, round(avg(y), 6) mean_next from rets, q where ret is not null group by 1",
    "M01_empirical": f"with {RETURNS_SQL} select sector, {_QCOLS}, round(avg((y > 0)::int), 6) p_pos, count(y) n from rets where y is not null group by 1",
    "M02_fallback": f"""with {RETURNS_SQL}, t as (select * from rets {_TRAIN} and y is not null), e as (select {_QCOLS}, round(avg((y > 0)::int), 6) p_pos from t), o as (select asset_id, {_QCOLS}, round(avg((y > 0)::int), 6) p_pos, count(*) n from t where volume > 40 group by 1)
        select r.asset_id, {_DAY.format(c='r.day')} as day, {', '.join(f'case when o.n >= 30 then o.{c} else e.{c} end {c}' for c in (*Z, 'p_pos'))}, coalesce(o.n >= 30, false)::int own from rets r left join o using (asset_id), e where r.day >= date '1999-01-01' and r.y is not null""",
    "M03_volatility_scaled": f"""with {SCORED_SQL}, t as (select * from scored {_TRAIN}), m as (select median(y) med from t), z as (select (y - med) / vol z from t, m), q as (select {', '.join(f'quantile_cont(z, {q}) {n}' for n, q in zip(Z, D.QS, strict=True))}, count(*) nz from z)
        select s.asset_id, {_DAY.format(c='s.day')} as day, round(vol, 6) vol, {', '.join(f'round(med + q.{n} * vol, 6) {n}' for n in Z)}, round((select count(*) from z where z.z > (0 - med) / s.vol) / nz, 6) p_pos from scored s, m, q where s.day >= date '1999-01-01'""",
    "M04_baselines": f"""with {RETURNS_SQL}, t as (select * from rets {_TRAIN} and y is not null), a as (select avg(y) mean, median(y) med, avg((y > 0)::int) up from t), o as (select asset_id, avg(y) own from t group by 1)
        select round(avg(abs(y)), 6) zero, round(avg(abs(y - mean)), 6) train_mean, round(avg(abs(y - med)), 6) train_median, round(avg(abs(y - coalesce(own, mean))), 6) asset_mean, round(avg(abs(y - ret)), 6) momentum, round(avg(((y > 0) = (up >= 0.5))::int), 6) majority_sign
        from rets left join o using (asset_id), a {_TEST} and y is not null and ret is not null""",
    "M05_adaptive_scale": f"""with {SCORED_SQL}, f as (select *, {_roll('stddev_pop', 'ret', 3)} fast from scored), l as (select *, greatest(-2, least(2, case when fast > 0 and vol > 0 then ln(fast / vol) else -2 end)) l from f)
        select asset_id, {_DAY.format(c='l.day')} as day, round(1.1 * exp(0.4 * (0.7 * l + (1 - 0.7) * l * l)), 6) scale from l""",
    "M12_rearrange": f"with {SCORED_SQL}, a as (select *, q25 - abs(ret) / 3 q25x from scored) select asset_id, {_DAY.format(c='a.day')} as day, (q05 > q25x or q25x > q50 or q50 > q75 or q75 > q95)::int crossed, {', '.join(f'round({_ORDERED}[{i + 1}], 6) {n}' for i, n in enumerate(Z))} from a",
    "M14_placebo": f"with {RETURNS_SQL} select {_DAY.format(c='rets.day')} as day, case when count(*) > 1 then count(*) else 0 end n, case when count(*) > 1 then 0.0 end difference from rets where ret is not null group by rets.day",
    "M24_day_weights": f"with {RETURNS_SQL} select {_DAY.format(c='rets.day')} as day, round((select count(*) from rets) / (select count(distinct day) from rets), 6) day_weight, count(*) n from rets group by rets.day",
    "A10_weighted_quantile": f"with {MONTHLY_SQL}, a as (select asset_id, price, sum(volume) over (partition by asset_id order by price) run, sum(volume) over (partition by asset_id) total from obs where volume > 0) select asset_id, round(min(price), 6) quantile from a where run >= 0.9 * total group by 1",
    "M10_conformal_shift": f"with {SCORED_SQL}, b as (select * from scored where day >= date '2000-01-01'), v as (select *, 1.0 * (select count(*) from b) / (count(*) over (partition by day) * (select count(distinct day) from b)) wt from b), " + ", ".join(
        f"r{n} as (select round(y - {n}, 9) res, sum(wt) w from v group by 1), c{n} as (select res, sum(w) over (order by res) run, sum(w) over () total from r{n})" for n in ("q05", "q50", "q95")) + " " + " union all ".join(
        f"select '{n}' as name, round(min(res), 6) shift from c{n} where run >= {q - 1e-12} * total" for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))),
    "F32_interpolated_cdf": f"with {SCORED_SQL} select asset_id, {_DAY.format(c='scored.day')} as day, round({_cdf('0.0')}, 6) cdf0, round({_cdf('y')}, 6) pit from scored",
}
