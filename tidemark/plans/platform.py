"""Queries over aggregates, sets, pivots, sessions, registries, audits, samples and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import audit, lake, registry
from tidemark.operators import windows as w
from tidemark.operators.distribution import quantiles_of
from tidemark.plans import views
from tidemark.plans.views import ACTIONS_SQL, DAILY_SQL, EVENTS_SQL, MONTHLY_SQL, OBS_SQL
from tidemark.session import ensure_checkpoint_dir, scratch, table
from tidemark.sources import readers
from tidemark.streaming import streams


def _r(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def a01_hash_aggregate(spark, sf):
    li = table(spark, sf, "lineitem")
    return _r(li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.min("l_discount").alias("least_discount"), F.max("l_extendedprice").alias("most"), F.avg("l_tax").alias("mean_tax"),
        F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("first_lines"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("discounted_parts")))


def a05_arg_extremes(spark, sf):
    ev = views.events(spark, sf)
    order = F.struct("ts", "event_id")
    return ev.groupBy("user_id").agg(
        F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", order)).alias("last_purchase"))


def a06_vwap(spark, sf):
    obs = views.observations(spark, sf)
    return _r(obs.groupBy("asset_id", F.trunc("day", "month").alias("month")).agg(F.try_divide(F.sum(F.col("price") * F.col("volume")), F.nullif(F.sum("volume"), F.lit(0))).alias("vwap")))


def a07_quantiles(spark, sf):
    obs = views.observations(spark, sf)
    return _r(obs.groupBy("asset_id").agg(*[F.percentile("price", F.lit(q)).alias(f"p{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)], F.stddev_pop("price").alias("std_pop"), F.var_samp("price").alias("var_samp")))


def a12_approx_distinct(spark, sf):
    """The estimate beside the exact number: it must lie within five times its stated error."""
    one = table(spark, sf, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.01).alias("a"), F.countDistinct("l_partkey").alias("parts"))
    return one.select("parts", (F.abs(F.col("a") / F.col("parts") - 1) <= 0.05).alias("close"))


def a13_excess_rows(spark, sf):
    """Rows beyond the first of every record, by a hash of all columns."""
    out = None
    for name in ("temporal_price_points", "evidence_claims", "relation_name_candidates", "identity_conflict_evidence"):
        df = table(spark, sf, name)
        one = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("d")).select(F.lit(name).alias("name"), "n", (F.col("n") - F.col("d")).alias("excess"))
        out = one if out is None else out.unionByName(one)
    return out


def a16_collected_sets(spark, sf):
    ev = views.events(spark, sf)
    return ev.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


def a17_mode(spark, sf):
    from tidemark.operators.graph import mode_of

    return mode_of(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority").withColumnRenamed("o_custkey", "custkey")


def a18_product(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.round(F.exp(F.sum(F.ln(1 + F.col("l_tax")))), 6).alias("growth"))


def a23_group_broadcast(spark, sf):
    ev = views.events(spark, sf)
    g = Window.partitionBy("user_id")
    return _r(ev.select("event_id", F.avg("value").over(g).alias("mean"), F.count("value").over(g).alias("n"), F.unix_micros(F.min("ts").over(g)).alias("first_us")))


def a28_singletons(spark, sf):
    docs = table(spark, sf, "documents").where("asset_id is not null")
    per = docs.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("s"))
    return per.agg(F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("s") > 1).alias("multi_source"), F.count(F.lit(1)).alias("groups"))


def a29_size_classes(spark, sf):
    return audit.size_classes(table(spark, sf, "evidence_claims").distinct(), "accession_number")


def a33_coverage(spark, sf):
    pts = table(spark, sf, "temporal_price_points").distinct()
    return _r(audit.coverage(pts.withColumn("year", F.year("trading_day").cast("long")), ["year"], F.col("raw_close") > 0))


def a35_profile(spark, sf):
    return audit.profile(table(spark, sf, "temporal_origins"), ["asset_id", "ticker", "sector", "state_id"])


def a36_gaps(spark, sf):
    return _r(audit.gaps(views.events(spark, sf), "user_id", "ts"))


def p11_status_ladder(spark, sf):
    pts = table(spark, sf, "temporal_price_points").distinct()
    status = F.when(F.col("raw_close").isNull(), "missing").when(F.col("raw_close") <= 0, "zero").when(F.col("causal_available_at").isNull(), "unknown_clock").when(
        F.col("causal_available_at") > F.col("bar_end_utc") + F.expr("interval 2 days"), "late").otherwise("usable")
    return pts.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def p14_terciles(spark, sf):
    df = views.monthly(spark, sf)
    train = df.where("day < '1999-01-01'")
    a, b = quantiles_of(train, "volume", (1 / 3, 2 / 3))
    regime = F.when(F.col("volume") <= a, "low").when(F.col("volume") <= b, "mid").otherwise("high")
    return df.where("day >= '1999-01-01'").groupBy(regime.alias("regime")).agg(F.count(F.lit(1)).alias("n"))


def p15_finite(spark, sf):
    df = views.daily(spark, sf).withColumn("ret", w.lag_return("close", 20, "asset_id", "day"))
    kept = df.where(F.col("ret").isNotNull() & ~F.isnan("ret") & F.col("volume").isNotNull())
    return kept.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))


def p16_envelope(spark, sf):
    bars = views.daily(spark, sf)
    off = (F.col("high") < F.greatest("close", "low")) | (F.col("low") > F.least("close", "high"))
    return bars.groupBy("sector").agg(F.count_if(off).alias("n_off"), F.count(F.lit(1)).alias("n"))


def p17_nocase(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where((F.upper("lang") == "EN") & F.col("source").ilike("wire_%") & ~F.col("title").rlike("^[0-9]")).select("doc_id")


def p20_drop_duplicates_last(spark, sf):
    from tidemark.operators.clocks import latest_revision

    ev = views.events(spark, sf)
    return latest_revision(ev, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


def p23_eav_pivot(spark, sf):
    """Long features back to columns; absent ones are null."""
    obs = views.daily(spark, sf).select("asset_id", F.trunc("day", "year").alias("year"), F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in ("close", "high", "volume")])))
    return _r(obs.groupBy("asset_id", "year").pivot("name", ["close", "high", "volume"]).max("x"))


def p24_role_pivot(spark, sf):
    orders = table(spark, sf, "orders")
    wide = orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return wide.select("year", *[F.coalesce(F.col(f"{s}_n"), F.lit(0)).alias(f"{s.lower()}_n") for s in "FOP"], *[F.col(f"{s}_most").alias(f"{s.lower()}_most") for s in "FOP"])


def p25_unnest(spark, sf):
    g = table(spark, sf, "identity_conflict_groups").select("conflict_group_id", "jurisdictions_json").distinct()
    return g.select("conflict_group_id", F.explode(F.from_json("jurisdictions_json", "array<string>")).alias("jurisdiction")).groupBy("conflict_group_id").agg(F.count(F.lit(1)).alias("n"), F.min("jurisdiction").alias("first"))


def p28_exists_flag(spark, sf):
    g = table(spark, sf, "identity_conflict_groups").select("conflict_group_id").distinct()
    dba = table(spark, sf, "identity_conflict_evidence").where("dba_alias_raw is not null").select("conflict_group_id", F.lit(1).alias("_h")).distinct()
    return g.join(dba, "conflict_group_id", "left").select("conflict_group_id", F.coalesce("_h", F.lit(0)).alias("has_dba"))


def j03_validated_merge(spark, sf):
    sectors = lake.assert_unique(views.sectors(spark, sf), ["asset_id"])
    obs = views.observations(spark, sf)
    return obs.join(sectors, "asset_id").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def j06_common_support(spark, sf):
    """Assets all of whose months have at least two observations."""
    per = views.observations(spark, sf).groupBy("asset_id", F.trunc("day", "month").alias("m")).agg((F.count(F.lit(1)) >= 2).cast("int").alias("ok"))
    return per.groupBy("asset_id").agg(F.min("ok").alias("ok"), F.count(F.lit(1)).alias("n_months")).where("ok = 1").select("asset_id", "n_months")


def j07_orphans(spark, sf):
    ev = table(spark, sf, "identity_conflict_evidence").select("conflict_evidence_id", "conflict_bucket_id").distinct()
    b = table(spark, sf, "identity_conflict_buckets").select("conflict_bucket_id")
    return ev.join(b, "conflict_bucket_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def j15_offset_join(spark, sf):
    o = table(spark, sf, "temporal_origins").distinct()
    a, b = o.alias("a"), o.alias("b")
    return a.join(b, (F.col("a.asset_id") == F.col("b.asset_id")) & (F.col("b.origin_session_index") == F.col("a.origin_session_index") + 5)).select(F.col("a.origin_id").alias("origin_id"), F.col("b.origin_id").alias("target_id"))


def j17_path_steps(spark, sf):
    """Origins with the action days in their next ten days, by differences of running counts."""
    days, acts = views.daily(spark, sf).select("asset_id", "day"), views.actions(spark, sf)
    spine = days.join(acts.withColumn("a", F.lit(1)), ["asset_id", "day"], "left")
    cum = F.sum(F.coalesce("a", F.lit(0))).over(w.ordered("asset_id", "day").rowsBetween(Window.unboundedPreceding, 0))
    c = spine.withColumn("c", cum)
    return c.select("asset_id", F.col("day").cast("string").alias("day"), (F.lead("c", 10).over(w.ordered("asset_id", "day")) - F.col("c")).alias("n_actions")).where("n_actions > 0")


def j18_origin_horizon(spark, sf):
    o = table(spark, sf, "temporal_origins").distinct().where("asset_id is not null")
    return o.select("asset_id", F.explode(F.array(*[F.lit(t) for t in (1, 5, 21)])).alias("tau")).groupBy("asset_id", "tau").agg(F.count(F.lit(1)).alias("n"))


def j23_paired(spark, sf):
    a = views.events(spark, sf).where("event_type = 'view'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("views"))
    b = views.events(spark, sf).where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("buys"))
    return _r(a.join(b, ["user_id", "day"]))


def j24_parity(spark, sf):
    a = views.daily(spark, sf).where("volume > 10")
    b = views.daily(spark, sf).where("volume < 60").withColumn("high", F.when(F.col("volume") > 55, F.col("high") + 1).otherwise(F.col("high")))
    return lake.parity(a, b, ["asset_id", "day"], ["high", "volume"])


def j25_disjunction(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "asset_id", "document_kind")
    reg = table(spark, sf, "asset_entities").select(F.col("asset_id").alias("reg_asset")).distinct()
    return docs.join(reg, F.col("asset_id") == F.col("reg_asset"), "left").where("reg_asset is not null or (asset_id is null and document_kind = 'news')").select("doc_id")


def o02_top_k(spark, sf):
    c = table(spark, sf, "temporal_price_points").distinct()
    return c.orderBy(F.coalesce("raw_close", F.lit(0.0)).desc(), "price_observation_id").limit(50).select("price_observation_id")


def o03_top_frequencies(spark, sf):
    return table(spark, sf, "relation_name_candidates").groupBy("source_entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("source_entity_id").asc_nulls_first()).limit(20)


def o04_extremes(spark, sf):
    obs = views.observations(spark, sf).select("seq", "l_partkey", "price")
    low = obs.orderBy("price", "seq", "l_partkey").limit(10).withColumn("tail", F.lit("low"))
    return low.unionByName(obs.orderBy(F.col("price").desc(), "seq", "l_partkey").limit(10).withColumn("tail", F.lit("high")))


def o06_cap_per_asset(spark, sf):
    ev = views.events(spark, sf)
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    return ev.withColumn("rn", rn).where("rn <= 3").select("user_id", "event_id")


def u01_set_operations(spark, sf):
    ev = views.events(spark, sf)
    a = ev.where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day"))
    b = ev.where("event_type = 'click'").select("user_id", F.to_date("ts").alias("day"))
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)), ("symmetric", a.subtract(b).union(b.subtract(a))), ("union_all", a.unionByName(b)), ("except_all", a.exceptAll(b))]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def u05_overlap(spark, sf):
    ev = views.events(spark, sf).groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    probe = F.array(F.lit("purchase"), F.lit("error"))
    return ev.select("user_id", F.arrays_overlap("t", probe).cast("int").alias("any"), F.size(F.array_intersect("t", probe)).cast("long").alias("shared"))


def u06_snapshot_diff(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderdate < timestamp_ntz '2000-06-01'").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderdate >= timestamp_ntz '1995-06-01'").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return lake.snapshot_diff(old, new, ["o_orderkey"], "o_orderstatus").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def l17_session_bars(spark, sf):
    bars = lake.session_bars(views.events(spark, sf).withColumn("size", F.lit(2.0)), "user_id", "ts", "value", "size", "America/New_York", "event_id")
    return _r(bars.withColumn("first_at", F.unix_micros("first_at")).withColumn("last_at", F.unix_micros("last_at")))


def l18_reconciliation(spark, sf):
    a = views.observations(spark, sf).where("checked = 1").groupBy("asset_id", "day").agg(F.max("price").alias("close"))
    b = views.daily(spark, sf).select("asset_id", "day", F.col("high").alias("close"))
    out = lake.reconcile(a, b, ["asset_id", "day"], "close", 0.01)
    return out.withColumn("day", F.col("day").cast("string")).withColumn("difference", F.round("difference", 6))


def l19_opening(spark, sf):
    """The first value of a user's day against the last of the day before, and the move to the day's last."""
    ev = views.events(spark, sf).withColumn("session", F.to_date("ts"))
    per = ev.groupBy("user_id", "session").agg(F.min_by("value", F.struct("ts", "event_id")).alias("o"), F.max_by("value", F.struct("ts", "event_id")).alias("c"))
    prev = F.lag("c").over(w.ordered("user_id", "session"))
    return _r(per.select("user_id", "session", (100 * (F.try_divide(F.col("o"), prev) - 1)).alias("gap"), (100 * (F.try_divide(F.col("c"), F.col("o")) - 1)).alias("rest")))


def k06_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    old, new = o.where("o_orderdate < timestamp_ntz '1998-01-01'"), o.where("o_orderdate >= timestamp_ntz '1998-01-01'")
    return registry.upsert(old, new, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


def k07_append_new(spark, sf):
    c = table(spark, sf, "evidence_claims").select("evidence_claim_id", "claim_kind")
    return registry.new_rows(c.where("claim_kind <> 'subsidiary_claim'"), c, "evidence_claim_id").select("evidence_claim_id")


def k09_replace_scope(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    out = registry.replace_scope(o, o.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("R")), F.col("o_orderstatus") == "P")
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def k10_seal(spark, sf):
    o = table(spark, sf, "orders")
    sealed = o.where("o_orderpriority < '3'").select("o_orderkey", F.col("o_orderstatus").alias("payload"))
    batch = o.select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "Z").otherwise(F.col("o_orderstatus")).alias("payload"))
    return registry.seal(sealed, batch, "o_orderkey", "payload").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def k01_published(spark, sf):
    """A partitioned, sealed artifact, written (or found) and read again by partition."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    path = f"{ensure_checkpoint_dir(spark)}/orders-by-year-{lake.content_seal(df).replace('-', '_')}"
    lake.publish(df, path, ["year"], ["o_orderkey"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def q01_rules(spark, sf):
    bars = views.daily(spark, sf)
    return audit.check_rules(bars, {
        "positive close": F.col("close") > 0, "high is highest": F.col("high") >= F.col("close") - 1e-9, "low is lowest": F.col("low") <= F.col("close") + 1e-9, "volume below 90": F.col("volume") < 90, "close present": F.col("close").isNotNull()})


def q02_missing_sessions(spark, sf):
    pts = table(spark, sf, "temporal_price_points").select("asset_id", F.col("trading_day").alias("day"))
    return _r(audit.missing_sessions(pts, pts, "asset_id", "day").groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_missing"), F.min("day").alias("first_missing")))


def q03_duplicate_keys(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "temporal_price_points"), ["asset_id", "trading_day"]).withColumn("trading_day", F.col("trading_day").cast("string"))


def q11_clock_order(spark, sf):
    pts = table(spark, sf, "temporal_price_points").distinct()
    return audit.check_rules(pts, {"seen after the bar": F.col("observed_at") >= F.col("bar_end_utc"), "available after the bar": F.col("causal_available_at") >= F.col("bar_end_utc"), "sequence from one": F.col("observation_sequence") >= 1})


def q12_expected_groups(spark, sf):
    docs = table(spark, sf, "documents").groupBy("source").agg(F.collect_set("document_kind").alias("have"))
    expected = F.array(*[F.lit(x) for x in ("news", "filing", "board", "mail")])
    return docs.select("source", F.array_join(F.array_sort(F.array_except(expected, "have")), ",").alias("lacking"))


def s20_modulus_sample(spark, sf):
    return readers.modulus_sample(table(spark, sf, "temporal_origins").where("origin_id is not null").distinct(), "origin_id", 10).select("origin_id")


def s21_even_days(spark, sf):
    days = views.observations(spark, sf).select("day").distinct()
    return _r(readers.evenly_spaced(days, ["day"], 9))


def s19_hash_sample(spark, sf):
    return readers.hash_sample(table(spark, sf, "orders"), "o_orderkey", 100, 3).select("o_orderkey")


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, as its files would arrive in a folder one by one."""
    path = f"{sf}/{name}.parquet"
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = files.resolvePath(root).toString()
    folder = files.getFileStatus(root).isDirectory()
    # a stream reads folders: a single file is the only one of its name's pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(whole if folder else whole[: -len("parquet")] + "parque[t]")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives of all that is there now; ``append`` its rows, else its last whole result."""
    spark = stream.sparkSession
    base, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", base).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(base)
    # each batch's whole result replaces the one before, as a table and not in the driver's memory
    write = lambda df, _: df.write.mode("overwrite").parquet(base)
    q = stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", state).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def r06_tumbling(spark, sf):
    out = drained(streams.windowed_counts(_stream(spark, sf), "ts", ["event_type"], "1 day", "2 days"), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


def r04_sliding(spark, sf):
    out = drained(streams.windowed_counts(_stream(spark, sf), "ts", [], "6 hours", "2 days", "3 hours"), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "n")


def r01_once(spark, sf):
    return drained(streams.once(_stream(spark, sf), "ts", "event_id").select("event_id"), "append")


QUERIES = {
    "A01_hash_aggregate": a01_hash_aggregate, "A05_arg_extremes": a05_arg_extremes, "A06_vwap": a06_vwap, "A07_quantiles": a07_quantiles, "A12_approx_distinct": a12_approx_distinct, "A13_excess_rows": a13_excess_rows,
    "A16_collected_sets": a16_collected_sets, "A17_mode": a17_mode, "A18_product": a18_product, "A23_group_broadcast": a23_group_broadcast, "A28_singletons": a28_singletons, "A29_size_classes": a29_size_classes,
    "A33_coverage": a33_coverage, "A35_profile": a35_profile, "A36_gaps": a36_gaps, "P11_status_ladder": p11_status_ladder, "P14_terciles": p14_terciles, "P15_finite": p15_finite, "P16_envelope": p16_envelope,
    "P17_nocase": p17_nocase, "P20_drop_duplicates_last": p20_drop_duplicates_last, "P23_eav_pivot": p23_eav_pivot, "P24_role_pivot": p24_role_pivot, "P25_unnest": p25_unnest, "P28_exists_flag": p28_exists_flag,
    "J03_validated_merge": j03_validated_merge, "J06_common_support": j06_common_support, "J07_orphans": j07_orphans, "J15_offset_join": j15_offset_join, "J17_path_steps": j17_path_steps, "J18_origin_horizon": j18_origin_horizon,
    "J23_paired": j23_paired, "J24_parity": j24_parity, "J25_disjunction": j25_disjunction, "O02_top_k": o02_top_k, "O03_top_frequencies": o03_top_frequencies, "O04_extremes": o04_extremes, "O06_cap_per_asset": o06_cap_per_asset,
    "U01_set_operations": u01_set_operations, "U05_overlap": u05_overlap, "U06_snapshot_diff": u06_snapshot_diff, "L17_session_bars": l17_session_bars, "L18_reconciliation": l18_reconciliation, "L19_opening": l19_opening,
    "K01_published": k01_published, "K06_upsert": k06_upsert, "K07_append_new": k07_append_new, "K09_replace_scope": k09_replace_scope, "K10_seal": k10_seal, "Q01_rules": q01_rules, "Q02_missing_sessions": q02_missing_sessions,
    "Q03_duplicate_keys": q03_duplicate_keys, "Q11_clock_order": q11_clock_order, "Q12_expected_groups": q12_expected_groups, "S19_hash_sample": s19_hash_sample, "S20_modulus_sample": s20_modulus_sample, "S21_even_days": s21_even_days,
    "R01_once": r01_once, "R04_sliding": r04_sliding, "R06_tumbling": r06_tumbling,
}

_LOCAL = "timezone('America/New_York', timezone('UTC', ts))"
_MIN = f"(hour({_LOCAL}) * 60 + minute({_LOCAL}))"
_SESSION = f"case when isodow({_LOCAL}) >= 6 then 'WEEKEND' when {_MIN} >= 240 and {_MIN} < 570 then 'PREMARKET' when {_MIN} >= 570 and {_MIN} < 960 then 'RTH' when {_MIN} >= 960 and {_MIN} < 1200 then 'AFTERHOURS' else 'OUTSIDE' end"
_ALL_V, _ALL_C = ("(select user_id, ts::date as day from events where event_type = '%s')" % t for t in ("view", "click"))


def _rules_sql(source: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select '{n}' as rule, count(*) n_rows, count(*) filter (not coalesce({c}, true)) n_violations, case when count(*) filter (not coalesce({c}, true)) = 0 then 'pass' else 'fail' end status from {source}" for n, c in rules.items())


ORACLE = {
    "A01_hash_aggregate": "select l_returnflag, l_linestatus, count(*) n, sum(l_quantity) quantity, min(l_discount) least_discount, max(l_extendedprice) most, round(avg(l_tax), 6) mean_tax, sum(l_quantity) filter (l_linenumber = 1) first_lines, count(distinct l_suppkey) suppliers, count(distinct l_partkey) filter (l_discount > 0.05) discounted_parts from lineitem group by 1, 2",
    "A05_arg_extremes": "select user_id, arg_min(value, (ts, event_id)) first_value, arg_max(value, (ts, event_id)) last_value, arg_max(value, (ts, event_id)) filter (event_type = 'purchase') last_purchase from events group by 1",
    "A06_vwap": f"with {OBS_SQL} select asset_id, strftime(date_trunc('month', day), '%Y-%m-%d') as month, round(sum(price * volume) / nullif(sum(volume), 0), 6) vwap from obs group by 1, 2",
    "A07_quantiles": f"with {OBS_SQL} select asset_id, round(quantile_cont(price, 0.05), 6) p05, round(quantile_cont(price, 0.5), 6) p50, round(quantile_cont(price, 0.95), 6) p95, round(stddev_pop(price), 6) std_pop, round(var_samp(price), 6) var_samp from obs group by 1",
    "A12_approx_distinct": "select count(distinct l_partkey) parts, true as close from lineitem",
    "S19_hash_sample": "select o_orderkey from orders order by md5('3|' || o_orderkey), o_orderkey limit 100",
    "S21_even_days": "with d as (select day, row_number() over (order by day) - 1 i, count(*) over () n from (select distinct l_shipdate::date as day from lineitem)) select strftime(d.day, '%Y-%m-%d') as day from d where n <= 9 or i in (select floor(k * (d.n - 1) / 8)::bigint from (select unnest(range(0, 9)) k))",
    "A13_excess_rows": " union all ".join(f"select '{t}' as name, (select count(*) from {t}) n, (select count(*) from {t}) - (select count(*) from (select distinct * from {t})) excess" for t in ("temporal_price_points", "evidence_claims", "relation_name_candidates", "identity_conflict_evidence")),
    "A16_collected_sets": "select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as types from events group by 1",
    "A17_mode": "with c as (select o_custkey, o_orderpriority p, count(*) n from orders group by 1, 2) select o_custkey custkey, p as mode, n mode_count from c qualify row_number() over (partition by o_custkey order by n desc, lower(p), p) = 1",
    "A18_product": "select l_suppkey, year(l_shipdate) as year, round(exp(sum(ln(1 + l_tax))), 6) growth from lineitem group by 1, 2",
    "A23_group_broadcast": "select event_id, round(avg(value) over g, 6) mean, count(value) over g n, epoch_us(min(ts) over g) first_us from events window g as (partition by user_id)",
    "A28_singletons": "with p as (select asset_id, count(*) n, count(distinct source) s from documents where asset_id is not null group by 1) select count(*) filter (n = 1) singletons, count(*) filter (s > 1) multi_source, count(*) as \"groups\" from p",
    "A29_size_classes": "with p as (select accession_number, count(*) n from (select distinct * from evidence_claims) group by 1) select case when n = 1 then '1' when n = 2 then '2' when n <= 5 then '3-5' when n <= 10 then '6-10' else '>10' end as size, count(*) n_groups from p group by 1",
    "A33_coverage": "select year(trading_day) as year, count(*) n, count(*) filter (raw_close > 0) n_resolved, round(count(*) filter (raw_close > 0) / count(*), 6) share from (select distinct * from temporal_price_points) group by 1",
    "A35_profile": " union all ".join(f"select '{c}' as \"column\", count(*) n_rows, count(*) filter ({c} is null) n_null, count(distinct {c}) n_distinct, min({c})::varchar least, max({c})::varchar as most from temporal_origins" for c in ("asset_id", "ticker", "sector", "state_id")),
    "A36_gaps": "with t as (select distinct user_id, epoch_us(ts) t from events), s as (select *, (t - lag(t) over (partition by user_id order by t)) / 1e6 step from t) select user_id, count(*) n_times, round(median(step), 6) median_step, round(max(step), 6) longest_step from s group by 1",
    "P11_status_ladder": "select case when raw_close is null then 'missing' when raw_close <= 0 then 'zero' when causal_available_at is null then 'unknown_clock' when causal_available_at > bar_end_utc + interval 2 days then 'late' else 'usable' end status, count(*) n from (select distinct * from temporal_price_points) group by 1",
    "P14_terciles": f"with {MONTHLY_SQL}, q as (select quantile_cont(volume, 1/3) a, quantile_cont(volume, 2/3) b from monthly where day < date '1999-01-01') select case when volume <= a then 'low' when volume <= b then 'mid' else 'high' end regime, count(*) n from monthly, q where day >= date '1999-01-01' group by 1",
    "P15_finite": f"with {DAILY_SQL}, r as (select asset_id, lag(close, 20) over (partition by asset_id order by day) l, volume from daily) select asset_id, count(*) n from r where l is not null and volume is not null group by 1",
    "P16_envelope": f"with {DAILY_SQL} select sector, count(*) filter (high < greatest(close, low) or low > least(close, high)) n_off, count(*) n from daily group by 1",
    "P17_nocase": "select doc_id from documents where upper(lang) = 'EN' and source ilike 'wire_%' and not regexp_matches(title, '^[0-9]')",
    "P20_drop_duplicates_last": "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "P23_eav_pivot": f"with {DAILY_SQL} select asset_id, strftime(date_trunc('year', day), '%Y-%m-%d') as year, round(max(close), 6) as close, round(max(high), 6) high, round(max(volume), 6) volume from daily group by 1, 2",
    "P24_role_pivot": "select year(o_orderdate) as year, " + ", ".join(f"count(*) filter (o_orderstatus = '{s}') {s.lower()}_n, max(o_totalprice) filter (o_orderstatus = '{s}') {s.lower()}_most" for s in "FOP") + " from orders group by 1",
    "P25_unnest": "with g as (select distinct conflict_group_id, jurisdictions_json from identity_conflict_groups), u as (select conflict_group_id, unnest(from_json(jurisdictions_json, '[\"VARCHAR\"]')) j from g) select conflict_group_id, count(*) n, min(j) as first from u group by 1",
    "P28_exists_flag": "select distinct conflict_group_id, (exists (select 1 from identity_conflict_evidence e where e.conflict_group_id = g.conflict_group_id and dba_alias_raw is not null))::int has_dba from identity_conflict_groups g",
    "J03_validated_merge": f"with {OBS_SQL} select sector, count(*) n from obs join sectors using (asset_id) group by 1",
    "J06_common_support": f"with {OBS_SQL}, p as (select asset_id, date_trunc('month', day) m, count(*) n from obs group by 1, 2) select asset_id, count(*) n_months from p group by 1 having min(n) >= 2",
    "J07_orphans": "select count(distinct conflict_evidence_id) n from identity_conflict_evidence e where not exists (select 1 from identity_conflict_buckets b where b.conflict_bucket_id = e.conflict_bucket_id)",
    "J15_offset_join": "with o as (select distinct * from temporal_origins) select a.origin_id, b.origin_id target_id from o a join o b on a.asset_id = b.asset_id and b.origin_session_index = a.origin_session_index + 5",
    "J17_path_steps": f"with {DAILY_SQL}, {ACTIONS_SQL}, i as (select asset_id, day, row_number() over (partition by asset_id order by day) n from daily), s as (select i.* from i join actions using (asset_id, day)), m as (select asset_id, max(n) mx from i group by 1), c as (select i.asset_id, i.day, count(*) n_actions from i join m using (asset_id) join s on s.asset_id = i.asset_id and s.n > i.n and s.n <= i.n + 10 where i.n + 10 <= mx group by 1, 2) select asset_id, strftime(c.day, '%Y-%m-%d') as day, n_actions from c",
    "J18_origin_horizon": "select asset_id, tau, count(*) n from (select distinct * from temporal_origins) o, (select unnest([1, 5, 21]) tau) t where asset_id is not null group by 1, 2",
    "J23_paired": "with a as (select user_id, ts::date as day, count(*) filter (event_type = 'view') v, count(*) filter (event_type = 'purchase') b from events group by 1, 2) select user_id, strftime(a.day, '%Y-%m-%d') as day, v as views, b buys from a where v > 0 and b > 0",
    "J24_parity": f"with {DAILY_SQL} select count(*) filter (volume > 10 and not volume < 60) only_left, count(*) filter (volume < 60 and not volume > 10) only_right, count(*) filter (volume > 10 and volume < 60) in_both, count(*) filter (volume > 55 and volume < 60) differs_high, 0::bigint differs_volume from daily",
    "J25_disjunction": "select doc_id from documents d where exists (select 1 from asset_entities a where a.asset_id = d.asset_id) or (asset_id is null and document_kind = 'news')",
    "O02_top_k": "select price_observation_id from (select distinct * from temporal_price_points) order by coalesce(raw_close, 0) desc, price_observation_id limit 50",
    "O03_top_frequencies": "select source_entity_id, count(*) n from relation_name_candidates group by 1 order by n desc, source_entity_id nulls first limit 20",
    "O04_extremes": f"with {OBS_SQL} select * from (select seq, l_partkey, price, 'low' tail from obs order by price, seq, l_partkey limit 10) union all select * from (select seq, l_partkey, price, 'high' from obs order by price desc, seq, l_partkey limit 10)",
    "O06_cap_per_asset": "select user_id, event_id from events qualify row_number() over (partition by user_id order by value desc, event_id) <= 3",
    "U01_set_operations": f"select 'union' op, (select count(*) from (select * from {_ALL_V} union select * from {_ALL_C})) n union all select 'intersect', (select count(*) from (select * from {_ALL_V} intersect select * from {_ALL_C})) union all select 'except', (select count(*) from (select * from {_ALL_V} except select * from {_ALL_C})) union all select 'symmetric', (select count(*) from (select * from {_ALL_V} except select * from {_ALL_C})) + (select count(*) from (select * from {_ALL_C} except select * from {_ALL_V})) union all select 'union_all', (select count(*) from (select * from {_ALL_V} union all select * from {_ALL_C})) union all select 'except_all', (select count(*) from (select * from {_ALL_V} except all select * from {_ALL_C}))",
    "U05_overlap": "select user_id, (count(*) filter (event_type in ('purchase', 'error')) > 0)::int as \"any\", count(distinct event_type) filter (event_type in ('purchase', 'error')) shared from events group by 1",
    "U06_snapshot_diff": "with a as (select o_orderkey k, o_orderstatus s from orders where o_orderdate < timestamp '2000-06-01'), b as (select o_orderkey k, case when o_totalprice > 200000 then 'X' else o_orderstatus end s from orders where o_orderdate >= timestamp '1995-06-01') select case when a.k is null then 'added' when b.k is null then 'removed' when a.s = b.s then 'unchanged' else 'changed' end as change, count(*) n from a full join b on a.k = b.k group by 1",
    "L17_session_bars": f"with t as (select *, {_LOCAL}::date as day, {_SESSION} as sess from events) select user_id, strftime(t.day, '%Y-%m-%d') as day, sess as session, arg_min(value, (ts, event_id)) as open, max(value) high, min(value) low, arg_max(value, (ts, event_id)) as close, 2.0 * count(*) volume, round(avg(value), 6) vwap, count(*) n, epoch_us(min(ts)) first_at, epoch_us(max(ts)) last_at from t group by user_id, t.day, sess",
    "L18_reconciliation": f"with {DAILY_SQL}, a as (select asset_id, day, max(price) lv from obs where checked = 1 group by 1, 2), d as (select asset_id, daily.day, lv, high, 100 * (lv / nullif(high, 0) - 1) df from daily left join a using (asset_id, day)) select asset_id, strftime(d.day, '%Y-%m-%d') as day, lv left_value, high right_value, round(df, 6) difference, case when lv is null then 'right_only' when abs(df) <= 0.01 then 'match' else 'differs' end status from d",
    "L19_opening": "with p as (select user_id, ts::date as sess, arg_min(value, (ts, event_id)) o, arg_max(value, (ts, event_id)) c from events group by 1, 2) select user_id, strftime(sess, '%Y-%m-%d') as session, round(100 * (o / nullif(lag(c) over (partition by user_id order by sess), 0) - 1), 6) gap, round(100 * (c / nullif(o, 0) - 1), 6) rest from p",
    "K01_published": "select year(o_orderdate) as year, count(*) n from orders group by 1",
    "K06_upsert": "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "K07_append_new": "select distinct evidence_claim_id from evidence_claims where claim_kind = 'subsidiary_claim' or claim_kind is null",
    "K09_replace_scope": "select case when o_orderstatus = 'P' then 'R' else o_orderstatus end o_orderstatus, count(*) n from orders group by 1",
    "K10_seal": "select case when not o_orderpriority < '3' then 'new' when o_totalprice > 250000 then 'conflict' else 'already_sealed' end status, count(*) n from orders group by 1",
    "Q01_rules": f"with {DAILY_SQL} " + _rules_sql("daily", {"positive close": "close > 0", "high is highest": "high >= close - 1e-9", "low is lowest": "low <= close + 1e-9", "volume below 90": "volume < 90", "close present": "close is not null"}),
    "Q02_missing_sessions": "with d as (select distinct asset_id, trading_day as day from temporal_price_points), s as (select asset_id, min(day) lo, max(day) hi from d group by 1), c as (select distinct day from d), m as (select s.asset_id, c.day from s join c on c.day between lo and hi where not exists (select 1 from d where d.asset_id = s.asset_id and d.day = c.day)) select asset_id, count(*) n_missing, strftime(min(day), '%Y-%m-%d') first_missing from m group by 1",
    "Q03_duplicate_keys": "select asset_id, strftime(trading_day, '%Y-%m-%d') trading_day, count(*) n from temporal_price_points group by asset_id, temporal_price_points.trading_day having count(*) > 1",
    "Q11_clock_order": _rules_sql("(select distinct * from temporal_price_points)", {"seen after the bar": "observed_at >= bar_end_utc", "available after the bar": "causal_available_at >= bar_end_utc", "sequence from one": "observation_sequence >= 1"}),
    "Q12_expected_groups": "select source, array_to_string(list_sort(list_filter(['news', 'filing', 'board', 'mail'], lambda x: not list_contains(k, x))), ',') lacking from (select source, list(distinct document_kind) filter (document_kind is not null) k from documents group by 1)",
    "S20_modulus_sample": "select distinct origin_id from temporal_origins where origin_id % 10 = 0",
    "R01_once": "select distinct event_id from events",
    "R04_sliding": "with e as (select epoch_us(ts) t from events), s as (select t // 10800000000 * 10800000000 - o * 10800000000 start_us from e, (select unnest([0, 1]) o)) select start_us, count(*) n from s group by 1",
    "R06_tumbling": "select epoch_us(ts) // 86400000000 * 86400000000 start_us, event_type, count(*) n from events group by 1, 2",
}
