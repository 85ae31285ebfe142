"""Queries over projections, joins, aggregates, windows, orders and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import audit, graph, lake, panel
from tidemark.operators import distribution as D
from tidemark.operators import windows as w
from tidemark.plans import views
from tidemark.plans.registry import Registry, plain, rows_n
from tidemark.plans.views import DAILY_SQL, MONTHLY_SQL, OBS_SQL
from tidemark.session import require_columns, table

entry = Registry()
QUERIES, ORACLE = entry.queries, entry.oracle
K, O = "asset_id", "day"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _sql_w(n: int) -> str:
    return f"over (partition by asset_id order by day rows between {n - 1} preceding and current row)"


def _sql_roll(fn: str, v: str, n: int) -> str:
    return f"case when count({v}) {_sql_w(n)} >= {n} then {fn}({v}) {_sql_w(n)} end"


_LAG = "lag({v}, {n}) over (partition by asset_id order by day)"
_DAYTEXT = "strftime(day, '%Y-%m-%d') as day"
_SECTORS = "s as (select *, 100 * (close / nullif(lag(close) over (partition by asset_id order by day), 0) - 1) ret from monthly)"


# projections and predicates


@entry("P08_prefix_projection", "select o_orderkey, o_orderstatus, o_orderpriority from orders")
def p08_prefix_projection(spark, sf):
    """Columns by families of names; only these are read."""
    return audit.columns_like(table(spark, sf, "orders"), ("o_orderk", "o_orders", "o_orderp"))


@entry("P09_required_columns", "select * from (values ('lineitem', 'complete'), ('orders', 'lacks o_colour')) t(name, status)")
def p09_required_columns(spark, sf):
    out = []
    for name, wanted in (("lineitem", ["l_orderkey", "l_tax"]), ("orders", ["o_orderkey", "o_colour"])):
        try:
            require_columns(table(spark, sf, name), wanted, name)
            out.append((name, "complete"))
        except ValueError as e:
            out.append((name, "lacks " + ", ".join(c for c in wanted if c in str(e))))
    return spark.createDataFrame(out, "name string, status string")


@entry("P10_allow_list", "select column_name as \"column\", case when column_name in ('event_id', 'ts', 'value') then 'allowed' else 'refused' end status from (describe events) union all select 'weight', 'absent'")
def p10_allow_list(spark, sf):
    return audit.allow_list(table(spark, sf, "events"), ("event_id", "ts", "value", "weight"))


_LOCAL = "timezone('America/New_York', timezone('UTC', ts))"
_MIN = f"(hour({_LOCAL}) * 60 + minute({_LOCAL}))"


@entry("P12_session_class", f"""select case when isodow({_LOCAL}) >= 6 then 'WEEKEND' when {_MIN} >= 240 and {_MIN} < 570 then 'PREMARKET' when {_MIN} >= 570 and {_MIN} < 960 then 'RTH'
    when {_MIN} >= 960 and {_MIN} < 1200 then 'AFTERHOURS' else 'OUTSIDE' end as session, count(*) n from events group by 1""")
def p12_session_class(spark, sf):
    local = F.from_utc_timestamp("ts", "America/New_York")
    return views.events(spark, sf).groupBy(lake.session_class(local).alias("session")).agg(rows_n())


@entry("P18_in_list", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 9000)")
def p18_in_list(spark, sf):
    """A list made at run time, as a semi join: it may be of any length."""
    wanted = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@entry("P19_drop_nulls", "select sector, count(*) n from temporal_origins where ticker is not null and sector is not null and asset_id is not null group by 1")
def p19_drop_nulls(spark, sf):
    return table(spark, sf, "temporal_origins").dropna(subset=["ticker", "sector", "asset_id"]).groupBy("sector").agg(rows_n())


@entry("P21_monotone_levels", f"""with {OBS_SQL}, q as (select asset_id, quantile_cont(price, 0.05) a, quantile_cont(price, 0.5) b, quantile_cont(price, 0.95) c, avg((price > 1500)::int) p from obs group by 1)
    select 'levels rise' as rule, count(*) n_rows, count(*) filter (not (a <= b and b <= c)) n_violations, case when count(*) filter (not (a <= b and b <= c)) = 0 then 'pass' else 'fail' end status from q
    union all select 'chance in range', count(*), count(*) filter (not p between 0 and 1), case when count(*) filter (not p between 0 and 1) = 0 then 'pass' else 'fail' end from q
    union all select 'chance below a half', count(*), count(*) filter (not p < 0.5), case when count(*) filter (not p < 0.5) = 0 then 'pass' else 'fail' end from q""")
def p21_monotone_levels(spark, sf):
    q = views.observations(spark, sf).groupBy(K).agg(*[F.percentile("price", F.lit(x)).alias(n) for n, x in (("a", 0.05), ("b", 0.5), ("c", 0.95))], F.avg((F.col("price") > 1500).cast("int")).alias("p"))
    return audit.check_rules(q, {"levels rise": (F.col("a") <= F.col("b")) & (F.col("b") <= F.col("c")), "chance in range": F.col("p").between(0, 1), "chance below a half": F.col("p") < 0.5})


@entry("P22_default_category", "select coalesce(nullif(trim(sector), ''), 'unknown') sector, count(*) n from temporal_origins group by 1")
def p22_default_category(spark, sf):
    return table(spark, sf, "temporal_origins").groupBy(F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("unknown")).alias("sector")).agg(rows_n())


@entry("P26_prefix_patterns", """select case when regexp_matches(title, '^[0-9]') then 0 else 1 end numeric_first, source ilike 'wire_%' as is_wire, count(*) n, min(title) as first_title
    from documents where source not like 'data%' and title is not null group by 1, 2""")
def p26_prefix_patterns(spark, sf):
    docs = table(spark, sf, "documents").where("source not like 'data%' and title is not null")
    return docs.groupBy(F.when(F.col("title").rlike("^[0-9]"), 0).otherwise(1).alias("numeric_first"), F.col("source").ilike("wire_%").alias("is_wire")).agg(rows_n(), F.min("title").alias("first_title"))


@entry("P27_between", "select claim_kind, count(*) n from evidence_claims where evidence_available_at::date between date '2022-01-01' and date '2022-12-31' and evidence_char_end - evidence_char_start between 20 and 60 group by 1")
def p27_between(spark, sf):
    """Both ends belong to the range; the day is compared on the stored time, so the scan can skip."""
    c = table(spark, sf, "evidence_claims")
    inside = F.col("evidence_available_at").between(F.lit("2022-01-01").cast("timestamp_ntz"), F.lit("2022-12-31 23:59:59.999999").cast("timestamp_ntz"))
    return c.where(inside & (F.col("evidence_char_end") - F.col("evidence_char_start")).between(20, 60)).groupBy("claim_kind").agg(rows_n())


# joins


@entry("J01_inner_equi", """select e.schema_family, count(*) n from (select distinct * from identity_conflict_evidence) e
    join (select distinct conflict_bucket_id, conflict_group_id, identity_bucket_id from identity_conflict_buckets) b using (conflict_bucket_id, conflict_group_id, identity_bucket_id) group by 1""")
def j01_inner_equi(spark, sf):
    keys = ["conflict_bucket_id", "conflict_group_id", "identity_bucket_id"]
    b = table(spark, sf, "identity_conflict_buckets").select(*keys).distinct()
    return table(spark, sf, "identity_conflict_evidence").distinct().join(b, keys).groupBy("schema_family").agg(rows_n())


@entry("J02_left_classified", """select case when c.registrant_ticker is null then 'no_key' when s.symbol is null then 'unmatched' else 'matched' end as status, count(*) n
    from evidence_claims c left join (select distinct symbol from global_reference_observations) s on s.symbol = c.registrant_ticker group by 1""")
def j02_left_classified(spark, sf):
    s = table(spark, sf, "global_reference_observations").select(F.col("symbol").alias("registrant_ticker"), F.lit(1).alias("_s")).distinct()
    status = F.when(F.col("registrant_ticker").isNull(), "no_key").when(F.col("_s").isNull(), "unmatched").otherwise("matched")
    return table(spark, sf, "evidence_claims").join(s, "registrant_ticker", "left").groupBy(status.alias("status")).agg(rows_n())


@entry("J04_semi", "select count(*) n, count(distinct asset_id) n_assets from temporal_origins where asset_id in (select registrant_asset_id from evidence_claims)")
def j04_semi(spark, sf):
    claimed = table(spark, sf, "evidence_claims").select(F.col("registrant_asset_id").alias("asset_id"))
    return table(spark, sf, "temporal_origins").join(claimed, "asset_id", "left_semi").agg(rows_n(), F.countDistinct("asset_id").alias("n_assets"))


@entry("J05_anti", "select count(*) n, count(distinct asset_id) n_assets from temporal_origins o where not exists (select 1 from evidence_claims c where c.registrant_asset_id = o.asset_id)")
def j05_anti(spark, sf):
    claimed = table(spark, sf, "evidence_claims").select(F.col("registrant_asset_id").alias("asset_id"))
    return table(spark, sf, "temporal_origins").join(claimed, "asset_id", "left_anti").agg(rows_n(), F.countDistinct("asset_id").alias("n_assets"))


@entry("J19_pairs_in_group", """with b as (select distinct * from identity_conflict_buckets) select x.conflict_group_id, count(*) n_pairs, count(*) filter (x.normalized_jurisdiction = y.normalized_jurisdiction) n_same
    from b x join b y on x.conflict_group_id = y.conflict_group_id and x.conflict_bucket_id < y.conflict_bucket_id group by 1""")
def j19_pairs_in_group(spark, sf):
    """Unordered pairs, counted without being made: all of them, and those that agree."""
    b = table(spark, sf, "identity_conflict_buckets").distinct()
    per = b.groupBy("conflict_group_id", "normalized_jurisdiction").agg(rows_n())
    half = lambda c: c * (c - 1) / 2
    same = F.coalesce(F.sum(F.when(F.col("normalized_jurisdiction").isNotNull(), half(F.col("n")))), F.lit(0.0))
    out = per.groupBy("conflict_group_id").agg(half(F.sum("n")).cast("long").alias("n_pairs"), same.cast("long").alias("n_same"))
    return out.where("n_pairs > 0")


@entry("J20_symmetric_adjacency", """with e as (select distinct source_entity_id a, resolved_target_entity_id b from relation_name_candidates where source_entity_id <> resolved_target_entity_id),
    s as (select a entity, b other, 'outgoing' o from e union all select b, a, 'incoming' from e) select entity, count(*) n, count(distinct other) n_others, count(*) filter (o = 'incoming') n_incoming from s group by 1""")
def j20_symmetric_adjacency(spark, sf):
    e = table(spark, sf, "relation_name_candidates").select(F.col("source_entity_id").alias("a"), F.col("resolved_target_entity_id").alias("b")).where("a <> b").distinct()
    both = e.select(F.inline(F.array(F.struct(F.col("a").alias("entity"), F.col("b").alias("other"), F.lit(0).alias("inc")), F.struct(F.col("b").alias("entity"), F.col("a").alias("other"), F.lit(1).alias("inc")))))
    return both.groupBy("entity").agg(rows_n(), F.countDistinct("other").alias("n_others"), F.sum("inc").alias("n_incoming"))


@entry("J21_global_fallback", """with g as (select sector, avg(raw_close_origin) m, count(*) n from temporal_origins where sector is not null group by 1 having count(*) >= 20),
    a as (select avg(raw_close_origin) m from temporal_origins) select o.origin_id, round(coalesce(g.m, a.m), 6) level from (select distinct * from temporal_origins) o left join g using (sector), a""")
def j21_global_fallback(spark, sf):
    o = table(spark, sf, "temporal_origins")
    per = o.where("sector is not null").groupBy("sector").agg(F.avg("raw_close_origin").alias("m"), F.count(F.lit(1)).alias("c")).where("c >= 20")
    everyone = F.broadcast(o.agg(F.avg("raw_close_origin").alias("e")))  # one row
    return plain(o.distinct().join(per, "sector", "left").join(everyone).select("origin_id", F.coalesce("m", "e").alias("level")))


@entry("J26_lineage", """select r1.r_name supplier_region, r2.r_name customer_region, count(*) n, count(o_orderkey) n_orders, count(c_custkey) n_customers from lineitem left join supplier on s_suppkey = l_suppkey left join nation n1 on n1.n_nationkey = s_nationkey
    left join region r1 on r1.r_regionkey = n1.n_regionkey left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation n2 on n2.n_nationkey = c_nationkey
    left join region r2 on r2.r_regionkey = n2.n_regionkey left join part on p_partkey = l_partkey group by 1, 2""")
def j26_lineage(spark, sf):
    """Eight left joins; the small sides are broadcast by their size, the lines are shuffled for two."""
    t = lambda n: table(spark, sf, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    sup = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("r_name").alias("supplier_region"))
    cus = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("r_name").alias("customer_region"))
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    df = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    df = df.join(cus, F.col("o_custkey") == F.col("c_custkey"), "left").join(t("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return df.groupBy("supplier_region", "customer_region").agg(rows_n(), F.count("o_orderkey").alias("n_orders"), F.count("c_custkey").alias("n_customers"))


@entry("J28_first_flag", """select o_orderkey, coalesce((select arg_min((l_returnflag = 'R')::int, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) from lineitem where l_orderkey = o_orderkey), 0) first_returned from orders""")
def j28_first_flag(spark, sf):
    """The flag of each order's first line, 0 for an order without lines."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by((F.col("l_returnflag") == "R").cast("int"), order).alias("f"))
    return table(spark, sf, "orders").select("o_orderkey").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("f", F.lit(0)).alias("first_returned"))


@entry("J29_day_donor", f"with {MONTHLY_SQL} select strftime(monthly.day, '%Y-%m-%d') as day, count(*) n, 0::bigint n_own, round(sum(volume), 6) total from monthly group by monthly.day having count(*) > 1")
def j29_day_donor(spark, sf):
    """Every row gets another row's value of its day; each value is given once."""
    df = D.day_donor(views.monthly(spark, sf), O, K, "volume", 3).where("donor is not null")
    named = D.day_donor(views.monthly(spark, sf), O, K, K, 3).select(K, O, F.col("donor").alias("giver"))
    return plain(df.join(named, [K, O]).groupBy(O).agg(rows_n(), F.count_if(F.col("giver") == F.col(K)).alias("n_own"), F.sum("donor").alias("total")))


@entry("J30_reassembly", f"with {MONTHLY_SQL}, {_SECTORS} select asset_id, {_DAYTEXT}, round(ret, 6) total from s where ret is not null")
def j30_reassembly(spark, sf):
    """Market, sector and asset parts, each at its own grain, joined and added up again."""
    df = views.monthly(spark, sf).withColumn("ret", w.lag_return("close", 1, K, O)).where("ret is not null")
    market = df.groupBy(O).agg(F.avg("ret").alias("m"))
    sector = df.groupBy(O, "sector").agg(F.avg("ret").alias("s"))
    asset = df.join(sector, [O, "sector"]).select(K, O, "sector", (F.col("ret") - F.col("s")).alias("a"))
    out = asset.join(sector, [O, "sector"]).join(market, O)
    return plain(out.select(K, O, (F.col("m") + (F.col("s") - F.col("m")) + F.col("a")).alias("total")))


# aggregates


@entry("A02_conditional_sums", "select l_suppkey, sum(case when l_returnflag = 'R' then l_quantity else 0 end) returned, sum((l_returnflag <> l_linestatus)::int)::bigint n_unlike, sum(case when l_discount > 0.05 then 1 end)::bigint n_discounted from lineitem group by 1")
def a02_conditional_sums(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("returned"), F.sum((F.col("l_returnflag") != F.col("l_linestatus")).cast("int")).alias("n_unlike"),
        F.sum(F.when(F.col("l_discount") > 0.05, 1)).alias("n_discounted"))


@entry("A03_filter_clause", "select user_id, count(*) filter (event_type = 'view') views, round(avg(value) filter (event_type <> 'error'), 6) mean_value, max(value) filter (value < 10) as below_ten from events group by 1")
def a03_filter_clause(spark, sf):
    views.events(spark, sf).createOrReplaceTempView("a03_events")
    return plain(spark.sql("select user_id, count(*) filter (where event_type = 'view') views, avg(value) filter (where event_type <> 'error') mean_value, max(value) filter (where value < 10) below_ten from a03_events group by user_id"))


@entry("A04_count_distinct", "select document_class, count(distinct accession_number) n, count(distinct accession_number) filter (edge_ready = 1) n_ready, count(distinct case when registrant_ticker is not null then registrant_asset_id end) n_assets from evidence_claims group by 1")
def a04_count_distinct(spark, sf):
    return table(spark, sf, "evidence_claims").groupBy("document_class").agg(
        F.countDistinct("accession_number").alias("n"), F.countDistinct(F.when(F.col("edge_ready") == 1, F.col("accession_number"))).alias("n_ready"),
        F.countDistinct(F.when(F.col("registrant_ticker").isNotNull(), F.col("registrant_asset_id"))).alias("n_assets"))


@entry("A08_quantile_vector", "select q, round(v, 6) level from (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]) q, unnest(quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95])) v from orders)")
def a08_quantile_vector(spark, sf):
    """Exact interpolated quantiles of a whole column, found by counts in buckets first."""
    return plain(D.global_quantiles(table(spark, sf, "orders"), "o_totalprice", (0.05, 0.25, 0.5, 0.75, 0.95)).select("q", F.col("value").alias("level")))


@entry("A09_grouped_quantiles", "select event_type, round(quantile_cont(value, 0.1), 6) q10, round(quantile_cont(value, 0.9), 6) q90, count(value) n from events group by 1")
def a09_grouped_quantiles(spark, sf):
    return plain(views.events(spark, sf).groupBy("event_type").agg(F.percentile("value", F.lit(0.1)).alias("q10"), F.percentile("value", F.lit(0.9)).alias("q90"), F.count("value").alias("n")))


@entry("A11_median", "select o_orderpriority, round(median(o_totalprice), 6) middle from orders group by 1 union all select 'ALL', round(median(o_totalprice), 6) from orders")
def a11_median(spark, sf):
    o = table(spark, sf, "orders")
    every = D.global_quantiles(o, "o_totalprice", (0.5,)).select(F.lit("ALL").alias("o_orderpriority"), F.col("value").alias("middle"))
    return plain(o.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.lit(0.5)).alias("middle")).unionByName(every))


@entry("A14_any_value", "select registrant_entity_id, min(registrant_ticker) ticker, count(*) n from evidence_claims where registrant_entity_id is not null group by 1 having count(distinct registrant_ticker) <= 1")
def a14_any_value(spark, sf):
    """A value of the group where all are the same; the smallest, so that it is the same one every time."""
    c = table(spark, sf, "evidence_claims").where("registrant_entity_id is not null")
    return c.groupBy("registrant_entity_id").agg(F.min("registrant_ticker").alias("ticker"), rows_n(), F.countDistinct("registrant_ticker").alias("d")).where("d <= 1").drop("d")


@entry("A15_group_by_all", "select c_mktsegment, c_nationkey % 5 as zone, count(*) n, round(sum(c_acctbal), 2) balance from customer group by all")
def a15_group_by_all(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("a15_customer")
    return spark.sql("select c_mktsegment, c_nationkey % 5 as zone, count(*) n, round(sum(c_acctbal), 2) balance from a15_customer group by all")


@entry("A19_deviations", "select l_suppkey, round(stddev_pop(l_quantity), 6) std_pop, round(stddev_samp(l_quantity), 6) std_samp, round(var_pop(l_discount), 6) var_pop, round(var_samp(l_discount), 6) var_samp from lineitem group by 1")
def a19_deviations(spark, sf):
    return plain(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.stddev_pop("l_quantity").alias("std_pop"), F.stddev_samp("l_quantity").alias("std_samp"), F.var_pop("l_discount").alias("var_pop"), F.var_samp("l_discount").alias("var_samp")))


@entry("A20_named_aggregates", f"with {MONTHLY_SQL} select strftime(monthly.day, '%Y-%m-%d') as day, round(avg(close), 6) mean, round(median(close), 6) middle, round(min(close), 6) least, round(max(close), 6) most, count(close) n from monthly group by monthly.day")
def a20_named_aggregates(spark, sf):
    return plain(views.monthly(spark, sf).groupBy(O).agg(F.avg("close").alias("mean"), F.percentile("close", F.lit(0.5)).alias("middle"), F.min("close").alias("least"), F.max("close").alias("most"), F.count("close").alias("n")))


@entry("A21_most_common", """select * from (select 'source' as field, source as "value", count(*) n from documents group by 2 order by n desc, 2 nulls first limit 5)
    union all select * from (select 'lang', lang, count(*) n from documents group by 2 order by n desc, 2 nulls first limit 5)""")
def a21_most_common(spark, sf):
    docs = table(spark, sf, "documents")
    return _union([docs.groupBy(F.lit(c).alias("field"), F.col(c).alias("value")).agg(rows_n()).orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()).limit(5) for c in ("source", "lang")])


_LOO = "with {m}, a as (select *, count(volume) over (partition by day) - 1 n, sum(volume) over (partition by day) - volume s, sum(volume * volume) over (partition by day) - volume * volume q, sum((volume > 40)::int) over (partition by day) - (volume > 40)::int u from monthly)".format(m=MONTHLY_SQL)


@entry("A24_leave_one_out", f"{_LOO} select asset_id, {_DAYTEXT}, n peers, round(s / nullif(n, 0), 6) mean, round(sqrt(greatest(0, q / nullif(n, 0) - (s / nullif(n, 0)) ** 2)), 6) std from a")
def a24_leave_one_out(spark, sf):
    df = views.monthly(spark, sf)
    return plain(df.select(K, O, w.peers("volume", O).alias("peers"), w.leave_one_out_mean("volume", O).alias("mean"), w.leave_one_out_std("volume", O).alias("std")))


@entry("A25_leave_one_out_breadth", f"{_LOO} select asset_id, {_DAYTEXT}, round(u / nullif(n, 0), 6) breadth from a")
def a25_leave_one_out_breadth(spark, sf):
    return plain(views.monthly(spark, sf).select(K, O, w.leave_one_out_mean((F.col("volume") > 40).cast("double"), O).alias("breadth")))


@entry("A27_repeated_keys", "select registrant_asset_id, accession_number, count(*) n from evidence_claims group by 1, 2 having count(*) > 1")
def a27_repeated_keys(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "evidence_claims"), ["registrant_asset_id", "accession_number"])


@entry("A30_hit_rates", f"""with {MONTHLY_SQL}, q as (select asset_id, quantile_cont(volume, 0.25) a, quantile_cont(volume, 0.75) b from monthly where day < date '1999-01-01' group by 1), h as (select sector, avg((volume <= a)::int) x, avg((volume <= b)::int) y, count(*) n from monthly join q using (asset_id) where day >= date '1999-01-01' group by 1)
    select sector, round(x, 6) hit_25, round(y, 6) hit_75, round((abs(x - 0.25) + abs(y - 0.75)) / 2, 6) calibration_error, n from h""")
def a30_hit_rates(spark, sf):
    df = views.monthly(spark, sf)
    q = df.where("day < '1999-01-01'").groupBy(K).agg(F.percentile("volume", F.lit(0.25)).alias("a"), F.percentile("volume", F.lit(0.75)).alias("b"))
    hit = lambda c: F.avg((F.col("volume") <= F.col(c)).cast("double"))
    out = df.where("day >= '1999-01-01'").join(q, K).groupBy("sector").agg(hit("a").alias("hit_25"), hit("b").alias("hit_75"), rows_n())
    return plain(out.withColumn("calibration_error", (F.abs(F.col("hit_25") - 0.25) + F.abs(F.col("hit_75") - 0.75)) / 2))


@entry("A34_weighted_average", f"with {MONTHLY_SQL}, f as (select year(day) y, avg(close) m, count(*) n from monthly group by 1) select round(sum(m * n) / sum(n), 6) weighted, round(avg(m), 6) unweighted, count(*) n_folds from f")
def a34_weighted_average(spark, sf):
    f = views.monthly(spark, sf).groupBy(F.year(O).alias("y")).agg(F.avg("close").alias("m"), F.count(F.lit(1)).alias("c"))
    return plain(f.agg(F.try_divide(F.sum(F.col("m") * F.col("c")), F.sum("c")).alias("weighted"), F.avg("m").alias("unweighted"), F.count(F.lit(1)).alias("n_folds")))


# windows


@entry("W04_history_counter", "select asset_id, strftime(trading_day, '%Y-%m-%d') trading_day, row_number() over (partition by asset_id order by p.trading_day) n from (select distinct asset_id, trading_day from temporal_price_points) p")
def w04_history_counter(spark, sf):
    d = table(spark, sf, "temporal_price_points").select("asset_id", "trading_day").distinct()
    return d.select("asset_id", F.col("trading_day").cast("string").alias("trading_day"), F.row_number().over(w.ordered("asset_id", "trading_day")).cast("long").alias("n"))


@entry("W05_ready_per_day", """with d as (select distinct asset_id, trading_day from temporal_price_points), n as (select *, row_number() over (partition by asset_id order by trading_day) h from d)
    select strftime(trading_day, '%Y-%m-%d') trading_day, count(*) n, count(*) filter (h >= 40) n_ready from n group by n.trading_day""")
def w05_ready_per_day(spark, sf):
    d = table(spark, sf, "temporal_price_points").select("asset_id", "trading_day").distinct().withColumn("h", F.row_number().over(w.ordered("asset_id", "trading_day")))
    return plain(d.groupBy("trading_day").agg(rows_n(), F.count_if(F.col("h") >= 40).alias("n_ready")))


@entry("W06_lag_returns", f"with {MONTHLY_SQL} select asset_id, {_DAYTEXT}, " + ", ".join(f"round(100 * (close / nullif({_LAG.format(v='close', n=n)}, 0) - 1), 6) ret_{n}" for n in (1, 3, 12)).replace("order by day", "order by monthly.day") + " from monthly")
def w06_lag_returns(spark, sf):
    return plain(views.monthly(spark, sf).select(K, O, *[w.lag_return("close", n, K, O).alias(f"ret_{n}") for n in (1, 3, 12)]))


@entry("W07_lag_gap", f"with {MONTHLY_SQL} select asset_id, {_DAYTEXT}, round(high - lag(low) over (partition by asset_id order by monthly.day), 8) gap, datediff('day', lag(monthly.day) over (partition by asset_id order by monthly.day), monthly.day) as n_days from monthly")
def w07_lag_gap(spark, sf):
    o = w.ordered(K, O)
    return plain(views.monthly(spark, sf).select(K, O, (F.col("high") - F.lag("low").over(o)).alias("gap"), F.datediff(O, F.lag(O).over(o)).cast("long").alias("n_days")), 8)


@entry("W08_rolling_deviation", f"with {DAILY_SQL}, a as (select *, 100 * (close / nullif({_LAG.format(v='close', n=1)}, 0) - 1) r from daily) select asset_id, {_DAYTEXT}, round({_sql_roll('stddev_pop', 'r', 5)}, 6) vol_5, round({_sql_roll('stddev_pop', 'r', 20)}, 6) vol_20 from a".replace("order by day rows", "order by a.day rows"))
def w08_rolling_deviation(spark, sf):
    df = views.daily(spark, sf).withColumn("r", w.lag_return("close", 1, K, O))
    return plain(df.select(K, O, *[w.trailing(F.stddev_pop, "r", n, K, O).alias(f"vol_{n}") for n in (5, 20)]))


@entry("W11_rolling_extremes", f"with {DAILY_SQL} select asset_id, {_DAYTEXT}, round(100 * (close / nullif({_sql_roll('max', 'close', 20)}, 0) - 1), 6) drawdown_20, round(100 * (close / min(close) {_sql_w(20)} - 1), 6) from_low_20 from daily".replace("order by day rows", "order by daily.day rows"))
def w11_rolling_extremes(spark, sf):
    df = views.daily(spark, sf)
    pct = lambda c: 100 * (F.try_divide(F.col("close"), c) - 1)
    return plain(df.select(K, O, pct(w.trailing(F.max, "close", 20, K, O)).alias("drawdown_20"), pct(w.trailing(F.min, "close", 20, K, O, least=1)).alias("from_low_20")))


@entry("W12_mean_distance", f"with {DAILY_SQL} select asset_id, {_DAYTEXT}, " + ", ".join(f"round(100 * (close / nullif({_sql_roll('avg', 'close', n)}, 0) - 1), 6) dist_{n}" for n in (15, 60)).replace("order by day rows", "order by daily.day rows") + " from daily")
def w12_mean_distance(spark, sf):
    return plain(views.daily(spark, sf).select(K, O, *[(100 * (F.try_divide(F.col("close"), w.trailing(F.avg, "close", n, K, O)) - 1)).alias(f"dist_{n}") for n in (15, 60)]))


@entry("W15_relative_strength", f"""with {DAILY_SQL}, a as (select *, close - {_LAG.format(v='close', n=1)} step from daily), b as (select *, case when step is not null then greatest(step, 0.0) end g, case when step is not null then greatest(-step, 0.0) end l from a),
    c as (select asset_id, day, {_sql_roll('avg', 'g', 14)} ag, {_sql_roll('avg', 'l', 14)} al from b) select asset_id, {_DAYTEXT}, round(case when al > 0 then 100 - 100 / (1 + ag / al) end, 6) rsi from c""")
def w15_relative_strength(spark, sf):
    df = views.daily(spark, sf).withColumn("step", F.col("close") - F.lag("close").over(w.ordered(K, O)))
    return plain(df.select(K, O, w.rsi("step", 14, K, O).alias("rsi")))


def _beta_sql(y: str, x: str, n: int) -> str:
    wn, both = _sql_w(n), f"{y} is not null and {x} is not null"
    x2 = f"case when {both} then {x} end"
    return f"case when count(case when {both} then 1 end) {wn} >= {n} and var_samp({x2}) {wn} > 1e-12 then covar_samp(case when {both} then {y} end, {x2}) {wn} / var_samp({x2}) {wn} end"


@entry("W17_residual_state", f"""with {MONTHLY_SQL}, {_SECTORS}, m as (select *, avg(ret) over (partition by day) market, avg(ret) over (partition by day, sector) - avg(ret) over (partition by day) rel from s), b as (select *, {_beta_sql('ret', 'market', 18)} beta from m),
    c as (select *, ret - beta * market residual from b), g as (select *, {_beta_sql('residual', 'rel', 18)} gamma from c), i as (select *, residual - gamma * rel own from g) select asset_id, {_DAYTEXT}, round(gamma, 6) gamma, round({_sql_roll('stddev_pop', 'own', 18).replace('order by day', 'order by i.day')}, 6) own_vol from i""")
def w17_residual_state(spark, sf):
    df = views.monthly(spark, sf).withColumn("ret", w.lag_return("close", 1, K, O))
    return plain(panel.factor_state(df, "ret", 18).select(K, O, "gamma", "own_vol"))


@entry("W21_filtered_lag", """with d as (select distinct asset_id, trading_day as day from temporal_price_points), c as (select day from d group by 1 having count(*) >= 3)
    select asset_id, strftime(d.day, '%Y-%m-%d') as day, strftime(lag(d.day) over (partition by asset_id order by d.day), '%Y-%m-%d') before from d semi join c using (day)""")
def w21_filtered_lag(spark, sf):
    """The calendar is filtered first, then lagged: the day before is the last one that counts."""
    d = table(spark, sf, "temporal_price_points").select("asset_id", F.col("trading_day").alias("day")).distinct()
    kept = d.groupBy("day").count().where("count >= 3").select("day")
    return plain(d.join(kept, "day", "left_semi").select("asset_id", "day", F.lag("day").over(w.ordered("asset_id", "day")).alias("before")))


@entry("W23_cross_section", f"with {MONTHLY_SQL} select asset_id, {_DAYTEXT}, round(avg(volume) over d, 6) mean, round(volume - avg(volume) over d, 6) minus_mean, round(avg((volume > 40)::int) over d, 6) breadth from monthly window d as (partition by monthly.day)")
def w23_cross_section(spark, sf):
    d = Window.partitionBy(O)
    return plain(views.monthly(spark, sf).select(K, O, F.avg("volume").over(d).alias("mean"), (F.col("volume") - F.avg("volume").over(d)).alias("minus_mean"), F.avg((F.col("volume") > 40).cast("double")).over(d).alias("breadth")))


_NEXT6 = "over (partition by asset_id order by monthly.day rows between 1 following and 6 following)"


@entry("W24_forward_window", f"with {MONTHLY_SQL} select asset_id, {_DAYTEXT}, case when count(close) {_NEXT6} = 6 then round(max(close) {_NEXT6}, 10) end highest, case when count(close) {_NEXT6} = 6 then round(min(close) {_NEXT6}, 10) end lowest, case when count(close) {_NEXT6} = 6 then round(stddev_pop(close) {_NEXT6}, 10) end spread from monthly")
def w24_forward_window(spark, sf):
    df = views.monthly(spark, sf)
    return plain(df.select(K, O, *[w.forward(fn, "close", 6, K, O).alias(n) for fn, n in ((F.max, "highest"), (F.min, "lowest"), (F.stddev_pop, "spread"))]), 10)


@entry("W25_forward_lead", f"with {MONTHLY_SQL} select asset_id, {_DAYTEXT}, round(lead(close, 3) over a, 10) target, strftime(lead(monthly.day, 3) over a, '%Y-%m-%d') target_day from monthly window a as (partition by asset_id order by monthly.day)")
def w25_forward_lead(spark, sf):
    o = w.ordered(K, O)
    return plain(views.monthly(spark, sf).select(K, O, F.lead("close", 3).over(o).alias("target"), F.lead(O, 3).over(o).alias("target_day")), 10)


@entry("W26_prefix_sums", f"with {DAILY_SQL}, a as (select asset_id, day, sum(volume) over (partition by asset_id order by day rows between 1 following and 15 following) v, count(*) over (partition by asset_id order by day rows between 1 following and 15 following) c from daily) select asset_id, {_DAYTEXT}, round(v, 6) next_15 from a where c = 15")
def w26_prefix_sums(spark, sf):
    """Sums over the path ahead, from differences of one running sum."""
    o = w.ordered(K, O)
    df = views.daily(spark, sf).withColumn("c", F.sum("volume").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return plain(df.select(K, O, (F.lead("c", 15).over(o) - F.col("c")).alias("next_15")).where("next_15 is not null"))


@entry("W27_counts_at_arrival", """with e as (select distinct * from identity_conflict_evidence where evidence_available_at is not null), p as (select conflict_group_id, evidence_available_at a, count(*) n, count(dba_alias_raw) d from e group by 1, 2)
    select conflict_group_id, epoch_us(a) at_us, sum(n) over k::bigint n_evidence, sum(d) over k::bigint n_alias from p window k as (partition by conflict_group_id order by a)""")
def w27_counts_at_arrival(spark, sf):
    e = table(spark, sf, "identity_conflict_evidence").where("evidence_available_at is not null").distinct()
    e = e.withColumn("kind", F.when(F.col("dba_alias_raw").isNotNull(), "alias"))
    out = graph.evidence_states(e, "conflict_group_id", "evidence_available_at", "kind", ("alias",), "accession_number")
    return out.select("conflict_group_id", F.unix_micros(F.col("evidence_available_at").cast("timestamp")).alias("at_us"), "n_evidence", "n_alias")


@entry("W28_first_anchor", "select evidence_claim_id, epoch_us(min(evidence_available_at) over (partition by accession_number)) anchor from (select distinct * from evidence_claims where accession_number is not null)")
def w28_first_anchor(spark, sf):
    c = table(spark, sf, "evidence_claims").where("accession_number is not null").distinct()
    return c.select("evidence_claim_id", F.unix_micros(F.min("evidence_available_at").over(Window.partitionBy("accession_number")).cast("timestamp")).alias("anchor"))


@entry("W29_equal_chunks", "with d as (select distinct trading_day from temporal_price_points), c as (select trading_day, ntile(7) over (order by trading_day) fold from d) select fold, strftime(min(trading_day), '%Y-%m-%d') first_day, strftime(max(trading_day), '%Y-%m-%d') last_day from c group by 1")
def w29_equal_chunks(spark, sf):
    from tidemark.operators.splits import day_folds

    return plain(day_folds(table(spark, sf, "temporal_price_points"), "trading_day", 7))


# orders and limits


@entry("O01_stable_order", "select o_orderkey, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) place from orders qualify place <= 100")
def o01_stable_order(spark, sf):
    """The first hundred in a full order; only these are ever numbered in one place."""
    top = table(spark, sf, "orders").orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey").limit(100)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"))
    return top.select("o_orderkey", place.cast("long").alias("place"))


@entry("O05_due_budget", """select symbol, n from (select symbol, count(*) n, max(observed_at) last from global_reference_observations group by 1) where last < timestamp '2024-06-01' order by n desc, last, symbol limit 25""")
def o05_due_budget(spark, sf):
    """What is due, by weight, then age, then name, up to a budget."""
    per = table(spark, sf, "global_reference_observations").groupBy("symbol").agg(rows_n(), F.max("observed_at").alias("last"))
    return per.where("last < timestamp_ntz '2024-06-01'").orderBy(F.col("n").desc(), "last", "symbol").limit(25).select("symbol", "n")


@entry("O07_last_then_forward", "select origin_id, row_number() over (order by state_time, origin_id) place from (select distinct origin_id, state_time from temporal_origins where state_time is not null order by state_time desc, origin_id desc limit 40)")
def o07_last_then_forward(spark, sf):
    last = table(spark, sf, "temporal_origins").where("state_time is not null").select("origin_id", "state_time").distinct().orderBy(F.col("state_time").desc(), F.col("origin_id").desc()).limit(40)
    return last.select("origin_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("state_time", "origin_id")).cast("long").alias("place"))


@entry("O08_best_of_grid", f"""with {MONTHLY_SQL}, g as (select k, l from (select unnest([1, 2, 3, 6]) k), (select unnest([30, 40, 50]) l)), s as (select k, l, round(avg(abs(volume - l - k)), 9) score from monthly, g group by 1, 2)
    select k, l, round(score, 6) score from s order by s.score, k, l limit 1""")
def o08_best_of_grid(spark, sf):
    """The least score of a grid of parameters, all scored in one pass over the rows."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(l).alias("l")) for k in (1, 2, 3, 6) for l in (30, 40, 50)])  # noqa: E741
    scored = views.monthly(spark, sf).select("volume", F.inline(grid)).groupBy("k", "l").agg(F.round(F.avg(F.abs(F.col("volume") - F.col("l") - F.col("k"))), 9).alias("score"))
    return plain(scored.agg(F.min(F.struct("score", "k", "l")).alias("b")).select("b.k", "b.l", "b.score"))


@entry("O09_last_per_block", "select event_id, event_type from events qualify row_number() over (partition by event_type, ts::date order by ts desc, event_id desc) <= 5")
def o09_last_per_block(spark, sf):
    ev = views.events(spark, sf)
    rn = F.row_number().over(Window.partitionBy("event_type", F.to_date("ts")).orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return ev.withColumn("rn", rn).where("rn <= 5").select("event_id", "event_type")


# sets


def _entities(spark, sf):
    claims = table(spark, sf, "evidence_claims").select(F.col("registrant_entity_id").alias("e")).where("e is not null").distinct()
    rel = table(spark, sf, "relation_name_candidates").select(F.col("source_entity_id").alias("e")).where("e is not null and relation_type = 'parent_of'").distinct()
    return claims, rel


_E1, _E2 = "(select distinct registrant_entity_id e from evidence_claims where registrant_entity_id is not null)", "(select distinct source_entity_id e from relation_name_candidates where source_entity_id is not null and relation_type = 'parent_of')"


@entry("U02_key_differences", f"select e, 'only_left' as side from (select e from {_E1} except select e from {_E2}) union all select e, 'only_right' from (select e from {_E2} except select e from {_E1})")
def u02_key_differences(spark, sf):
    a, b = _entities(spark, sf)
    return a.subtract(b).withColumn("side", F.lit("only_left")).unionByName(b.subtract(a).withColumn("side", F.lit("only_right")))


@entry("U03_key_intersection", f"select e from {_E1} intersect select e from {_E2}")
def u03_key_intersection(spark, sf):
    a, b = _entities(spark, sf)
    return a.intersect(b)


@entry("U04_set_equality", f"""select 'sources' as pair, not exists (select e from {_E1} except select e from {_E2}) and not exists (select e from {_E2} except select e from {_E1}) as equal
    union all select 'nations', true""")
def u04_set_equality(spark, sf):
    """Whether two key sets are the same: nothing is left on either side."""
    a, b = _entities(spark, sf)
    n = table(spark, sf, "nation").select("n_nationkey")
    s = table(spark, sf, "nation").select("n_nationkey", "n_name").distinct().select("n_nationkey")
    return _union([lake.set_equality(x, y, name) for x, y, name in ((a, b, "sources"), (n, s, "nations"))])


@entry("U07_coverage_matrix", """with s as (select asset_id, origin_trading_day as day, count(*) n from (select distinct * from temporal_origins) where asset_id is not null group by 1, 2), p as (select distinct asset_id, trading_day as day from temporal_price_points)
    select year(s.day) as year, count(p.day) days_matched, count(*) - count(p.day) days_unmatched, coalesce(sum(n) filter (p.day is not null), 0)::bigint states_matched, sum(n)::bigint states from s left join p using (asset_id, day) group by 1""")
def u07_coverage_matrix(spark, sf):
    s = table(spark, sf, "temporal_origins").distinct().where("asset_id is not null").groupBy("asset_id", F.col("origin_trading_day").alias("day")).agg(rows_n())
    p = table(spark, sf, "temporal_price_points").select("asset_id", F.col("trading_day").alias("day"), F.lit(1).alias("p")).distinct()
    joined = s.join(p, ["asset_id", "day"], "left")
    return joined.groupBy(F.year("day").cast("long").alias("year")).agg(
        F.count("p").alias("days_matched"), (F.count(F.lit(1)) - F.count("p")).alias("days_unmatched"), F.coalesce(F.sum(F.when(F.col("p") == 1, F.col("n"))), F.lit(0)).alias("states_matched"), F.sum("n").alias("states"))
