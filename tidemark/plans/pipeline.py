"""Queries p1, p2, p3 and p5, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bitemporal import as_known
from tidemark.operators.kslack import HOUR, k_slack, released, released_counts, timeline
from tidemark.operators.orphans import orphan_references
from tidemark.operators.rolling_totals import latest_daily_value, rolling_totals
from tidemark.session import stored, table
from tidemark.streaming.streams import k_slack_buffer

WINDOWS = (7, 30)
SLACK_KEYS = ("source_id", "symbol", "trading_day")
UNIT = 10_000  # closes are summed as integers of 1/UNIT, so that totals don't depend on the order of rows


def _closes(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "temporal_price_points")
    usable = (F.col("value") > 0) & ~F.isnan("value")
    return latest_daily_value(points, "asset_id", "trading_day", "observation_sequence", "raw_close", usable)


def p1_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and averages of the usable closes of every asset and calendar day over 7 and 30 days.

    The days of an asset run from its first to its last row, with a usable close or without.
    """
    closes = _closes(spark, sf).withColumn("value", F.round(F.col("value") * UNIT).cast("long"))
    rows = table(spark, sf, "temporal_price_points").select(F.col("asset_id").alias("entity"), F.col("trading_day").alias("day"))
    out = rolling_totals(closes, "entity", "day", "value", WINDOWS, calendar=rows)
    cols = [F.col("entity").alias("asset_id"), F.date_format("calendar_day", "yyyy-MM-dd").alias("calendar_day")]
    for w in WINDOWS:
        cols += [(F.col(c) / UNIT).alias(c) for c in (f"total_{w}", f"avg_day_{w}", f"avg_active_{w}")] + [F.col(f"active_days_{w}")]
    return out.select(*cols)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    out = rolling_totals(_closes(spark, sf), "entity", "day", "value", WINDOWS)
    return out.where("active_days_7 = 0").select(
        F.col("entity").alias("asset_id"), F.date_format("calendar_day", "yyyy-MM-dd").alias("calendar_day")
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "evidence_claims")
    out = None
    for name, event_key, key, recorded_at, payload in (
        ("temporal_price_points", "registrant_asset_id", "asset_id", "causal_available_at", "price_observation_id"),
        ("global_reference_observations", "registrant_ticker", "symbol", "available_at", "observation_id"),
    ):
        found = as_known(
            claims, table(spark, sf, name), "evidence_claim_id", event_key, "evidence_available_at",
            key, recorded_at, ("trading_day", "observation_sequence"), payload,
        ).where("known_id is not null").select("evidence_claim_id", F.lit(name).alias("known_from"), "known_id")
        out = found if out is None else out.unionByName(found)
    return out


def p2_valid(spark: SparkSession, sf: str) -> DataFrame:
    """What each claim knew of its registrant's prices of thirty days before, on both axes: valid then, recorded by now."""
    claims = table(spark, sf, "evidence_claims").withColumn("wanted", F.date_sub(F.to_date("evidence_available_at"), 30))
    found = as_known(
        claims, table(spark, sf, "temporal_price_points"), "evidence_claim_id", "registrant_asset_id", "evidence_available_at",
        "asset_id", "causal_available_at", ("trading_day", "observation_sequence"), "price_observation_id", valid_at="wanted",
    )
    return found.where("known_id is not null")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "asset_entities")
    out = None
    for name, ref_id, key, at, parent_key in (
        ("relation_name_candidates", "relation_candidate_id", "resolved_target_entity_id", "evidence_available_at", "entity_id"),
        ("temporal_origins", "origin_id", "asset_id", "state_time", "asset_id"),
    ):
        lost = orphan_references(table(spark, sf, name), ref_id, key, at, parents, parent_key, "registered_at", "removed_at")
        lost = lost.select(F.lit(name).alias("ref_table"), "ref_id", "key", "at")
        out = lost if out is None else out.unionByName(lost)
    return out


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_table", "ref_id")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references and the distinct keys they name, per table and month."""
    return (
        _orphans(spark, sf)
        .groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("period"))
        .agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("key").alias("n_keys"))
    )


def _slack(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "global_reference_observations")
    return k_slack(rows, SLACK_KEYS, "observation_id", "observed_at", "observation_sequence")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _slack(spark, sf).where("outcome in ('corrected', 'dropped')").select("observation_id", "outcome")


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per source and trading day, corrected up to 48 hours of lateness."""
    slack = stored(_slack(spark, sf), "slack")  # read for the rows and for the steps of the latest time
    out = released(slack, SLACK_KEYS, "observation_id")
    return released_counts(slack, out, ("source_id", "trading_day"), "observation_id").withColumn("trading_day", F.date_format("trading_day", "yyyy-MM-dd"))


def p5_released(spark: SparkSession, sf: str) -> DataFrame:
    """When each observation leaves the buffer, and the step from the one that left before it."""
    return released(stored(_slack(spark, sf), "slack"), SLACK_KEYS, "observation_id").select("observation_id", "released_at", "since")


def p5_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Provisional and final counts of every source, symbol and day after each arrival."""
    out = timeline(released(stored(_slack(spark, sf), "slack"), SLACK_KEYS, "observation_id"), SLACK_KEYS)
    return out.withColumn("trading_day", F.date_format("trading_day", "yyyy-MM-dd"))


def p5_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the stream operator: what it released, flushed and dropped, in batches from a folder."""
    from tidemark.plans.platform import drained, stream_of

    rows = stream_of(spark, sf, "global_reference_observations").dropDuplicates(["observation_id"])
    out = drained(k_slack_buffer(rows, SLACK_KEYS, "observation_id", "observed_at", "observation_sequence", 48 * HOUR), "append")
    return out.where("kind in ('released', 'dropped', 'flushed')").select("observation_id", "kind", "released_at")


QUERIES = {
    "p1_found": p1_found, "p1_totals": p1_totals, "p2_found": p2_found, "p2_valid": p2_valid, "p3_found": p3_found,
    "p3_report": p3_report, "p5_found": p5_found, "p5_counts": p5_counts, "p5_released": p5_released, "p5_timeline": p5_timeline, "p5_stream": p5_stream,
}

_CLOSES = """
closes as (select asset_id, trading_day::date d, arg_max(v, observation_sequence) v from (
    select asset_id, trading_day, observation_sequence, struct_pack(c := raw_close) v from temporal_price_points) group by all),
usable as (select asset_id, d, v.c v from closes where v.c > 0 and not isnan(v.c)),
spans as (select asset_id, min(d) lo, max(d) hi from usable group by 1),
cal as (select asset_id, unnest(generate_series(lo, hi, interval 1 day))::date d from spans)
"""

_SLACK = """
rows_ as (select distinct source_id, symbol, trading_day, observation_id, observation_sequence s, epoch_us(observed_at) t from global_reference_observations),
high as (select *, max(t) over (partition by source_id, symbol, trading_day order by s range between unbounded preceding and 1 preceding) h,
    max(t) over (partition by source_id, symbol, trading_day) fin from rows_),
slack as (select *, case when t is null then 'untimed' when h is null or t >= h then 'in_order' when h - t <= 172800000000 then 'corrected' else 'dropped' end outcome from high)
"""

_RELEASED = f"""{_SLACK.strip()},
step as (select source_id, symbol, trading_day, s, greatest(max(h), max(t)) v from slack group by all),
kept as (select * from slack where outcome in ('in_order', 'corrected')),
rel0 as (select k.*, (select min(x.s) from step x where x.source_id is not distinct from k.source_id and x.symbol is not distinct from k.symbol and x.trading_day is not distinct from k.trading_day and x.v >= k.t + 172800000000)::bigint r0,
    t - lag(t) over (partition by source_id, symbol, trading_day order by t, s, observation_id) since from kept k), rel as (select *, case when r0 is not null then greatest(r0, s) end released_at from rel0)"""

_LOST = """
lost as (
    select distinct 'relation_name_candidates' ref_table, r.relation_candidate_id ref_id, r.resolved_target_entity_id k, r.evidence_available_at  ref_time
    from relation_name_candidates r where r.resolved_target_entity_id is not null and not exists (select 1 from asset_entities a
        where a.entity_id = r.resolved_target_entity_id and a.registered_at <= r.evidence_available_at and (a.removed_at is null or r.evidence_available_at < a.removed_at))
    union all
    select distinct 'temporal_origins', o.origin_id::varchar, o.asset_id, o.state_time
    from temporal_origins o where o.asset_id is not null and not exists (select 1 from asset_entities a
        where a.asset_id = o.asset_id and a.registered_at <= o.state_time and (a.removed_at is null or o.state_time < a.removed_at)))
"""


def _known_sql(name: str, event_key: str, key: str, at: str, payload: str) -> str:
    return f"""select evidence_claim_id, '{name}' known_from, known_id from (
        select c.evidence_claim_id, arg_max(p.{payload}, (p.trading_day, p.observation_sequence, p.{payload})) known_id
        from (select distinct evidence_claim_id, {event_key} k, evidence_available_at t from evidence_claims) c
        join {name} p on p.{key} = c.k and p.{at} <= c.t group by 1)"""


def _totals_sql() -> str:
    cols = []
    for w in WINDOWS:
        total = f"coalesce(sum(round(u.v * {UNIT})::bigint) filter (c.d - u.d < {w}), 0)"
        n = f"count(u.v) filter (c.d - u.d < {w})"
        cols += [
            f"{total}::double / {UNIT} total_{w}", f"{total}::double / {w} / {UNIT} avg_day_{w}",
            f"{total}::double / nullif({n}, 0) / {UNIT} avg_active_{w}", f"{n} active_days_{w}",
        ]
    return f"""with {_CLOSES.replace("from usable group by 1)", "from closes group by 1)")} select c.asset_id, strftime(c.d, '%Y-%m-%d') calendar_day, {', '.join(cols)}
        from cal c left join usable u on u.asset_id = c.asset_id and u.d between c.d - {max(WINDOWS) - 1} and c.d group by c.asset_id, c.d"""


ORACLE = {
    "p1_found": f"""with {_CLOSES} select c.asset_id, strftime(c.d, '%Y-%m-%d') calendar_day from cal c
        where not exists (select 1 from usable u where u.asset_id = c.asset_id and u.d between c.d - 6 and c.d)""",
    "p1_totals": _totals_sql(),
    "p2_found": _known_sql("temporal_price_points", "registrant_asset_id", "asset_id", "causal_available_at", "price_observation_id")
    + " union all "
    + _known_sql("global_reference_observations", "registrant_ticker", "symbol", "available_at", "observation_id"),
    "p2_valid": """select evidence_claim_id, arg_max(price_observation_id, (trading_day, observation_sequence, price_observation_id)) known_id from (select distinct evidence_claim_id, registrant_asset_id k, evidence_available_at t from evidence_claims) c
        join temporal_price_points p on p.asset_id = c.k and p.causal_available_at <= c.t and p.trading_day <= c.t::date - 30 group by 1""",
    "p3_found": f"with {_LOST} select ref_table, ref_id from lost",
    "p3_report": f"with {_LOST} select ref_table, strftime(ref_time, '%Y-%m') period, count(*) n_orphans, count(distinct k) n_keys from lost group by all",
    "p5_found": f"with {_SLACK} select observation_id, outcome from slack where outcome in ('corrected', 'dropped')",
    "p5_counts": f"""with {_RELEASED} select source_id, strftime(trading_day, '%Y-%m-%d') trading_day, count(*) n_arrived,
        count(*) filter (outcome = 'in_order') n_in_order, count(*) filter (outcome = 'corrected') n_corrected,
        count(*) filter (outcome = 'dropped') n_dropped, count(*) filter (outcome in ('in_order', 'corrected')) n_final,
        count(*) filter (outcome in ('in_order', 'corrected') and t > fin - 172800000000) n_provisional,
        arg_min(observation_id, (t, s, observation_id)) filter (outcome in ('in_order', 'corrected')) first_id,
        arg_max(observation_id, (t, s, observation_id)) filter (outcome in ('in_order', 'corrected')) last_id,
        (select max(since) from rel where rel.source_id is not distinct from slack.source_id and rel.trading_day is not distinct from slack.trading_day) longest_step
        from slack group by all""",
    "p5_released": f"with {_RELEASED} select observation_id, released_at, since from rel",
    "p5_timeline": f"""with {_RELEASED}, e as (select source_id, symbol, trading_day, s a, 1 p, 0 f from rel union all select source_id, symbol, trading_day, released_at, 0, 1 from rel where released_at is not null), g as (select source_id, symbol, trading_day, a, sum(p) p, sum(f) f from e group by all)
        select source_id, symbol, strftime(trading_day, '%Y-%m-%d') trading_day, a::bigint arrival, sum(p) over k::bigint n_provisional, sum(f) over k::bigint n_final from g window k as (partition by source_id, symbol, g.trading_day order by a)""",
    "p5_stream": f"""with {_RELEASED}, w as (select max(t) - 30 * 86400000000 m from slack) select observation_id, case when released_at is not null then 'released' else 'flushed' end kind, released_at from rel, w where released_at is not null or t + 172800000000 < m
        union all select observation_id, 'dropped', null from slack where outcome = 'dropped'""",
}
