"""Queries over clocks and revisions: gates, latest and first revisions, as-of joins, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import clocks
from tidemark.plans import views
from tidemark.plans.views import DAILY_SQL, EVENTS_SQL, OBS_SQL
from tidemark.session import table

CUTOFF = "2023-06-30 12:00:00"


def p01_causal_gate(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "global_reference_observations")
    known = clocks.known_by(refs, "available_at", F.lit(CUTOFF).cast("timestamp_ntz"))
    return known.groupBy("source_id").agg(F.countDistinct("observation_id").alias("n"), F.unix_micros(F.max("available_at").cast("timestamp")).alias("latest"))


def p02_strict_gate(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "global_reference_observations")
    known = clocks.known_by(refs, "available_at", F.lit(CUTOFF).cast("timestamp_ntz"), "point_in_time_verified")
    return known.groupBy("source_id").agg(F.countDistinct("observation_id").alias("n"))


def p03_dual_gate(spark: SparkSession, sf: str) -> DataFrame:
    pts = table(spark, sf, "temporal_price_points")
    at = F.lit(CUTOFF).cast("timestamp_ntz")
    kept = pts.where((F.col("bar_end_utc") <= at) & (F.col("causal_available_at") <= at))
    return kept.groupBy("asset_id").agg(F.countDistinct("price_observation_id").alias("n"))


def w01_latest_revision(spark: SparkSession, sf: str) -> DataFrame:
    obs = views.observations(spark, sf)
    best = clocks.latest_revision(obs, ["asset_id", "day"], [F.col("seq").desc(), F.col("l_partkey").desc()])
    return best.select("asset_id", F.col("day").cast("string").alias("day"), "seq", "price")


def w02_first_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The first observation of each day that passed its check; later ones keep their own clock."""
    obs = views.observations(spark, sf).where("checked = 1")
    rn = F.row_number().over(Window.partitionBy("asset_id", "day").orderBy("seq", "l_partkey"))
    ranked = obs.withColumn("rn", rn)
    return ranked.select(
        "asset_id", F.col("day").cast("string").alias("day"), "seq", F.col("rn").cast("long").alias("rn"),
        F.when(F.col("rn") == 1, F.col("day")).otherwise(F.date_add("day", 1)).cast("string").alias("usable_from"),
    )


def j09_price_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Latest known observation of every asset and day at a cut-off."""
    pts = table(spark, sf, "temporal_price_points")
    known = clocks.known_by(pts, "causal_available_at", F.lit(CUTOFF).cast("timestamp_ntz"))
    best = clocks.latest_struct(known, ["asset_id", "trading_day"], ["observation_sequence"], ["price_observation_id", "raw_close"])
    return best.select("asset_id", F.col("trading_day").cast("string").alias("day"), "observation_sequence", "price_observation_id", "raw_close")


def l01_projection_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The three readings of a day's close side by side: final, as known at a cut-off, and known for certain."""
    pts = table(spark, sf, "temporal_price_points")
    at = F.lit(CUTOFF).cast("timestamp_ntz")
    seq = F.struct("observation_sequence", "price_observation_id")
    known = F.col("causal_available_at") <= at
    sure = known & (F.col("observed_at") <= at)
    return pts.groupBy("asset_id", F.col("trading_day").cast("string").alias("day")).agg(
        F.max(seq)["price_observation_id"].alias("final_id"),
        F.max(F.when(known, seq))["price_observation_id"].alias("asof_id"),
        F.max(F.when(sure, seq))["price_observation_id"].alias("strict_id"),
    )


def j10_known_history(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "evidence_claims").select("evidence_claim_id", F.col("registrant_asset_id").alias("asset_id"), F.col("evidence_available_at").alias("at")).distinct()
    pts = table(spark, sf, "temporal_price_points").distinct()
    hist = clocks.known_history(claims, pts, "evidence_claim_id", "asset_id", "at", "trading_day", "causal_available_at", ["observation_sequence"], "raw_close", 21, 60)
    return hist.groupBy("evidence_claim_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        F.max(F.when(F.col("back") == 1, F.col("value"))).alias("last_close"), F.round(F.avg("value"), 4).alias("mean_close"),
    )


def _probes(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return views.events(spark, sf).where(F.col("event_type") == kind)


def j11_asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    probes = _probes(spark, sf, "purchase").select("event_id", "user_id", "ts")
    facts = _probes(spark, sf, "view").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return clocks.asof_backward(probes, facts, "user_id", "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value", F.unix_micros("fact_at").alias("fact_us"))


def j13_asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    probes = _probes(spark, sf, "purchase").select("event_id", "user_id", "ts")
    facts = _probes(spark, sf, "click").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return clocks.asof_forward_strict(probes, facts, "user_id", "ts", ["click_id"]).select("event_id", "click_id", F.unix_micros("fact_at").alias("fact_us"))


def j14_next_session(spark: SparkSession, sf: str) -> DataFrame:
    sessions = views.observations(spark, sf).select("day")
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    out = clocks.session_calendar(days, sessions)
    return out.select(*[F.col(c).cast("string").alias(c) for c in out.columns])


def j08_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with the registration spans of their registrant that hold their time."""
    claims = table(spark, sf, "evidence_claims").select("evidence_claim_id", F.col("registrant_entity_id").alias("entity_id"), "evidence_available_at").distinct()
    spans = table(spark, sf, "asset_entities").distinct()
    out = clocks.interval_membership(claims, spans, "entity_id", "evidence_available_at", "registered_at", "removed_at", [F.col("asset_id").alias("span_asset_id")])
    return out.select("evidence_claim_id", "entity_id", "span_asset_id")


def p04_validity(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "asset_entities").distinct()
    at = F.lit(CUTOFF).cast("timestamp_ntz")
    return spans.where(clocks.within_validity(at, F.col("registered_at"), F.col("removed_at"))).select("asset_id", "entity_id")


def p05_closed_validity(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    at = F.lit("1998-03-01").cast("timestamp_ntz")
    end = F.col("o_orderdate") + F.expr("interval 90 days")
    return orders.where(clocks.within_validity(at, F.col("o_orderdate"), end, closed=True)).select("o_orderkey")


def p06_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Asset days with a checked observation and none at a discount of ten percent."""
    obs = views.observations(spark, sf)
    days = obs.select("asset_id", "day").distinct()
    ok = obs.where("checked = 1").select("asset_id", "day").distinct()
    bad = obs.where("l_discount >= 0.1").select("asset_id", "day").distinct()
    return days.join(ok, ["asset_id", "day"], "left_semi").join(bad, ["asset_id", "day"], "left_anti").select("asset_id", F.col("day").cast("string").alias("day"))


def p07_having_gate(spark: SparkSession, sf: str) -> DataFrame:
    obs = views.observations(spark, sf)
    per = obs.groupBy("asset_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("checked").alias("passed"))
    return per.where("n > 1 and passed = n").select("asset_id", F.col("day").cast("string").alias("day"), "n")


def w32_revision_kinds(spark: SparkSession, sf: str) -> DataFrame:
    obs = views.observations(spark, sf).withColumn("version", F.col("l_returnflag"))
    out = clocks.revision_kinds(obs, ["asset_id", "day"], ["seq", "l_partkey"], "version")
    return out.groupBy("kind", "observation_number").agg(F.count(F.lit(1)).alias("n")).withColumn("observation_number", F.col("observation_number").cast("long"))


def w03_two_level_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Latest observation of each day, then the last five days of each asset."""
    obs = views.observations(spark, sf)
    best = clocks.latest_revision(obs, ["asset_id", "day"], [F.col("seq").desc(), F.col("l_partkey").desc()])
    rn = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.col("day").desc()))
    return best.withColumn("back", rn.cast("long")).where("back <= 5").select("asset_id", F.col("day").cast("string").alias("day"), "seq", "back")


def w33_warm_up(spark: SparkSession, sf: str) -> DataFrame:
    """Assets with their hundredth day and the days from then on."""
    days = views.observations(spark, sf).select("asset_id", "day").distinct()
    seq = F.row_number().over(Window.partitionBy("asset_id").orderBy("day"))
    ready = F.max(F.when(F.col("seq") == 100, F.col("day"))).over(Window.partitionBy("asset_id"))
    out = days.withColumn("seq", seq).withColumn("ready", ready).where("day >= ready")
    return out.groupBy("asset_id").agg(F.min("ready").cast("string").alias("ready_day"), F.count(F.lit(1)).alias("n_ready"), F.max("day").cast("string").alias("last_day"))


def j12_last_observation(spark: SparkSession, sf: str) -> DataFrame:
    ref = table(spark, sf, "global_reference_observations")
    best = F.max(F.struct("trading_day", "observation_sequence", "observation_id"))
    return ref.where("symbol is not null").groupBy("symbol").agg(best["observation_id"].alias("observation_id"))


def j22_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the latest order date of each customer, ties kept."""
    orders = table(spark, sf, "orders")
    rank = F.rank().over(Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate").desc()))
    return orders.withColumn("r", rank).where("r = 1").select("o_custkey", "o_orderkey")


QUERIES = {
    "P01_causal_gate": p01_causal_gate, "P02_strict_gate": p02_strict_gate, "P03_dual_gate": p03_dual_gate, "P04_validity": p04_validity,
    "P05_closed_validity": p05_closed_validity, "P06_quality_gate": p06_quality_gate, "P07_having_gate": p07_having_gate,
    "W01_latest_revision": w01_latest_revision, "W02_first_checked": w02_first_checked, "W03_two_level_rank": w03_two_level_rank,
    "W32_revision_kinds": w32_revision_kinds, "W33_warm_up": w33_warm_up, "J08_membership": j08_membership, "J09_price_asof": j09_price_asof,
    "J10_known_history": j10_known_history, "J11_asof_backward": j11_asof_backward, "J12_last_observation": j12_last_observation,
    "J13_asof_forward": j13_asof_forward, "J14_next_session": j14_next_session, "J22_latest_run": j22_latest_run, "L01_projection_modes": l01_projection_modes,
}

ORACLE = {
    "P01_causal_gate": f"select source_id, count(distinct observation_id) n, epoch_us(max(available_at)) latest from global_reference_observations where available_at <= timestamp '{CUTOFF}' group by 1",
    "P02_strict_gate": f"select source_id, count(distinct observation_id) n from global_reference_observations where available_at <= timestamp '{CUTOFF}' and point_in_time_verified = 1 group by 1",
    "P03_dual_gate": f"select asset_id, count(distinct price_observation_id) n from temporal_price_points where bar_end_utc <= timestamp '{CUTOFF}' and causal_available_at <= timestamp '{CUTOFF}' group by 1",
    "P04_validity": f"select distinct asset_id, entity_id from asset_entities where registered_at <= timestamp '{CUTOFF}' and (removed_at is null or removed_at > timestamp '{CUTOFF}')",
    "P05_closed_validity": "select o_orderkey from orders where o_orderdate <= timestamp '1998-03-01' and o_orderdate + interval 90 days >= timestamp '1998-03-01'",
    "P06_quality_gate": f"with {OBS_SQL} select distinct asset_id, strftime(day, '%Y-%m-%d') as day from obs o where exists (select 1 from obs p where p.asset_id = o.asset_id and p.day = o.day and p.checked = 1) and not exists (select 1 from obs p where p.asset_id = o.asset_id and p.day = o.day and p.l_discount >= 0.1)",
    "P07_having_gate": f"with {OBS_SQL} select asset_id, strftime(day, '%Y-%m-%d') as day, count(*) n from obs group by asset_id, obs.day having count(*) > 1 and min(checked) = 1",
    "W01_latest_revision": f"with {OBS_SQL} select asset_id, strftime(day, '%Y-%m-%d') as day, seq, price from obs qualify row_number() over (partition by asset_id, obs.day order by seq desc, l_partkey desc) = 1",
    "W02_first_checked": f"with {OBS_SQL}, r as (select *, row_number() over (partition by asset_id, day order by seq, l_partkey) rn from obs where checked = 1) select asset_id, strftime(day, '%Y-%m-%d') as day, seq, rn, strftime(case when rn = 1 then r.day else r.day + 1 end, '%Y-%m-%d') usable_from from r",
    "W03_two_level_rank": f"with {OBS_SQL}, b as (select * from obs qualify row_number() over (partition by asset_id, day order by seq desc, l_partkey desc) = 1), r as (select *, row_number() over (partition by asset_id order by day desc) back from b) select asset_id, strftime(r.day, '%Y-%m-%d') as day, seq, back from r where back <= 5",
    "W32_revision_kinds": f"""with {OBS_SQL}, r as (select *, row_number() over w observation_number, lag(l_returnflag) over w before from obs window w as (partition by asset_id, day order by seq, l_partkey)),
        f as (select *, min(observation_number) over (partition by asset_id, day, l_returnflag) first_seen from r)
        select case when observation_number = 1 then 'initial' when l_returnflag = before then 'unchanged' when first_seen < observation_number then 'reversion' else 'revision' end kind, observation_number, count(*) n from f group by all""",
    "W33_warm_up": f"""with {OBS_SQL}, d as (select distinct asset_id, day from obs), s as (select *, row_number() over (partition by asset_id order by day) seq from d),
        r as (select asset_id, max(day) filter (seq = 100) ready from s group by 1) select asset_id, strftime(min(ready), '%Y-%m-%d') ready_day, count(*) n_ready, strftime(max(s.day), '%Y-%m-%d') last_day from s join r using (asset_id) where s.day >= ready group by 1""",
    "J08_membership": "select distinct c.evidence_claim_id, c.registrant_entity_id entity_id, s.asset_id span_asset_id, s.registered_at rr, s.removed_at ro from evidence_claims c join asset_entities s on s.entity_id = c.registrant_entity_id and s.registered_at <= c.evidence_available_at and (s.removed_at is null or c.evidence_available_at < s.removed_at)",
    "J09_price_asof": f"select distinct asset_id, strftime(trading_day, '%Y-%m-%d') as day, observation_sequence, price_observation_id, raw_close from temporal_price_points where causal_available_at <= timestamp '{CUTOFF}' qualify rank() over (partition by asset_id, trading_day order by observation_sequence desc) = 1",
    "J10_known_history": """with c as (select distinct evidence_claim_id, registrant_asset_id asset_id, evidence_available_at at_ from evidence_claims),
        m as (select c.evidence_claim_id, p.trading_day d, arg_max(struct_pack(v := p.raw_close), p.observation_sequence).v v from c join temporal_price_points p on p.asset_id = c.asset_id and p.causal_available_at <= c.at_
            and p.trading_day <= c.at_::date group by 1, 2),
        r as (select *, row_number() over (partition by evidence_claim_id order by d desc) back from m)
        select evidence_claim_id, count(*) n_days, strftime(min(d), '%Y-%m-%d') first_day, strftime(max(d), '%Y-%m-%d') last_day, max(v) filter (back = 1) last_close, round(avg(v), 4) mean_close from r where back <= 21 group by 1""",
    "J11_asof_backward": f"with {EVENTS_SQL} select p.event_id, v.event_id view_id, v.value view_value, epoch_us(v.ts) fact_us from (select * from ev where event_type = 'purchase') p asof left join (select * from ev where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts",
    "J12_last_observation": "select symbol, arg_max(observation_id, (trading_day, observation_sequence, observation_id)) observation_id from global_reference_observations where symbol is not null group by 1",
    "J13_asof_forward": f"with {EVENTS_SQL} select p.event_id, v.event_id click_id, epoch_us(v.ts) fact_us from (select * from ev where event_type = 'purchase') p asof left join (select * from ev where event_type = 'click') v on p.user_id = v.user_id and p.ts < v.ts",
    "J14_next_session": f"with {OBS_SQL}, s as (select distinct day from obs), q as (select distinct o_orderdate::date as day from orders) select strftime(q.day, '%Y-%m-%d') as day, strftime((select max(s.day) from s where s.day = q.day), '%Y-%m-%d') same_session, strftime((select min(s.day) from s where s.day > q.day), '%Y-%m-%d') next_session from q",
    "J22_latest_run": "select o_custkey, o_orderkey from orders qualify rank() over (partition by o_custkey order by o_orderdate::date desc) = 1",
    "L01_projection_modes": f"""select asset_id, strftime(trading_day, '%Y-%m-%d') as day, arg_max(price_observation_id, (observation_sequence, price_observation_id)) final_id,
        arg_max(price_observation_id, (observation_sequence, price_observation_id)) filter (causal_available_at <= timestamp '{CUTOFF}') asof_id,
        arg_max(price_observation_id, (observation_sequence, price_observation_id)) filter (causal_available_at <= timestamp '{CUTOFF}' and observed_at <= timestamp '{CUTOFF}') strict_id from temporal_price_points group by asset_id, trading_day""",
}
ORACLE["J08_membership"] = f"select evidence_claim_id, entity_id, span_asset_id from ({ORACLE['J08_membership']})"
