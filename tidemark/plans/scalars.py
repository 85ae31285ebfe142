"""Queries over scalar functions: text, names, addresses, times, numbers, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import markup
from tidemark.functions import text as T
from tidemark.operators import documents
from tidemark.operators import distribution as D
from tidemark.operators.windows import ordered
from tidemark.plans import views
from tidemark.plans.registry import Registry, plain, rows_n
from tidemark.plans.views import MONTHLY_SQL
from tidemark.session import table

entry = Registry()
QUERIES, ORACLE = entry.queries, entry.oracle
K, O = "asset_id", "day"
_NORM = "trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = f"w as (select doc_id, asset_id, list_filter(string_split({_NORM.format(c="coalesce(text, '')")}, ' '), lambda x: x <> '') ws from documents)"
_SH = "sh as (select *, case when len(ws) = 0 then []::varchar[] else list_sort(list_distinct(list_transform(range(0, greatest(len(ws) - 5, 0) + 1), lambda i: substring(sha256(array_to_string(ws[i + 1:i + 5], ' ')), 1, 16)))) end s from w)"


@entry("F01_unicode_tokens")
def f01_unicode_tokens(spark, sf):
    """Words of any script; tested against Python, as SQL has no NFKC."""
    toks = T.unicode_tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.size(toks).alias("n_tokens"), F.sha2(F.array_join(toks, " "), 256).alias("sha"))


_PAGE = "'<html><head><title>' || n_name || '</title><style>p{color:red}</style></head><body><p>Region&nbsp;' || n_regionkey || '</p><script>var n = 1;</script><noscript>no</noscript><div>Key <b>' || n_nationkey || '</b> &lt;end&gt;</div></body></html>'"


@entry("F02_visible_text", "select n_nationkey, n_name || chr(10) || 'Region ' || n_regionkey || chr(10) || 'Key ' || n_nationkey || ' <end>' as seen from nation")
def f02_visible_text(spark, sf):
    page = F.concat(
        F.lit("<html><head><title>"), "n_name", F.lit("</title><style>p{color:red}</style></head><body><p>Region&nbsp;"), F.col("n_regionkey").cast("string"),
        F.lit("</p><script>var n = 1;</script><noscript>no</noscript><div>Key <b>"), F.col("n_nationkey").cast("string"), F.lit("</b> &lt;end&gt;</div></body></html>"))
    return table(spark, sf, "nation").select("n_nationkey", markup.visible_text(page).alias("seen"))


@entry("F05_canonical_url", "select o_orderkey, 'https://news.example.invalid/A/' || o_orderkey || '?id=' || o_custkey as url from orders")
def f05_canonical_url(spark, sf):
    """Tracking parameters and fragments go, scheme and host are lowered, paths and other parameters stay."""
    typed = F.concat(F.lit(" HTTPS://News.Example.invalid/A/"), F.col("o_orderkey").cast("string"), F.lit("?utm_source=x&id="), F.col("o_custkey").cast("string"), F.lit("&gclid=7&utm_medium=mail#top"))
    return table(spark, sf, "orders").select("o_orderkey", T.canonical_url(typed).alias("url"))


@entry("F06_domain", "select regexp_extract(lower(source_url), '^https?://(?:www\\.)?([^/:?#]+)', 1) as domain, count(*) n from evidence_claims where source_url is not null group by 1")
def f06_domain(spark, sf):
    return table(spark, sf, "evidence_claims").where("source_url is not null").groupBy(T.domain("source_url").alias("domain")).agg(rows_n())


@entry("F08_name_key", """select name_key, count(*) n from (select regexp_replace(trim(regexp_replace(translate(legal_name_raw, chr(160) || '‘’“”', ' ''''""'), '\\s+', ' ', 'g')), '^[\\s.,;:]+|[\\s.,;:]+$', '', 'g') k, lower(k) name_key from identity_conflict_evidence where legal_name_raw is not null and ascii(legal_name_raw) > 0 and not regexp_matches(legal_name_raw, '[^\\x00-\\x7F]')) group by 1""")
def f08_name_key(spark, sf):
    """Names as keys; held against SQL for those in ASCII, whose lower case is the same everywhere."""
    e = table(spark, sf, "identity_conflict_evidence").where("legal_name_raw is not null and legal_name_raw <> ''").where(~F.col("legal_name_raw").rlike(r"[^\x00-\x7F]"))
    return e.groupBy(T.name_key("legal_name_raw").alias("name_key")).agg(rows_n())


@entry("F09_legal_form", """with v as (select * from (values ('Alpha Mining LLC', 'llc', 'alpha mining'), ('Beta Foods, Inc.', 'inc', 'beta foods'), ('Gamma Proprietary Limited', 'pty', 'gamma'), ('Delta Limited Liability Company', 'llc', 'delta'), ('Incorporated', null, 'incorporated'), ('Omega', null, 'omega')) t(n, family, stem))
    select c_custkey % 6 as which, family, stem || ' ' || (c_custkey % 3) as stem, count(*) n from customer join (select row_number() over () - 1 i, * from v) on i = c_custkey % 6 group by 1, 2, 3""")
def f09_legal_form(spark, sf):
    names = ("Alpha Mining LLC", "Beta Foods, Inc.", "Gamma Proprietary Limited", "Delta Limited Liability Company", "Incorporated", "Omega")
    name = F.get(F.array(*[F.lit(x) for x in names]), (F.col("c_custkey") % 6).cast("int"))
    got = T.legal_form(name)
    df = table(spark, sf, "customer").select((F.col("c_custkey") % 6).alias("which"), got.alias("f"), (F.col("c_custkey") % 3).cast("string").alias("k"))
    return df.groupBy("which", F.col("f.family").alias("family"), F.concat_ws(" ", "f.stem", "k").alias("stem")).agg(rows_n())


@entry("F12_simhash", f"""with {_WORDS}, {_SH}, h as (select doc_id, unnest(s) x from sh), v as (select doc_id, ('0x' || x)::ubigint v from h),
    b as (select doc_id, i, sum(case when (v >> i::ubigint) & 1::ubigint = 1 then 1 else -1 end) c from v, (select unnest(range(0, 64)) i) group by 1, 2),
    m as (select doc_id, sum(case when c > 0 then 1::hugeint << i::int else 0::hugeint end) m from b group by 1)
    select doc_id, coalesce(printf('%x', (m % 65536)::bigint), '0') as k0, coalesce(printf('%x', (m // 281474976710656)::bigint), '0') as k3 from w left join m using (doc_id)""")
def f12_simhash(spark, sf):
    """The first and last band of each document's simhash; four bands of sixteen bits."""
    fp = documents.fingerprints(table(spark, sf, "documents"), "doc_id", "text")
    keys = T.band_keys(T.simhash64("shingles"))
    bare = lambda i: F.regexp_replace(F.regexp_replace(F.get(keys, F.lit(i)), r"^\d:0*", ""), "^$", "0")
    return fp.select(F.col("doc").alias("doc_id"), bare(0).alias("k0"), bare(3).alias("k3"))


@entry("F13_jaccard", f"""with {_WORDS}, {_SH}, p as (select doc_id, asset_id, s, lag(s) over (partition by asset_id order by doc_id) before from sh where asset_id is not null)
    select doc_id, round(len(list_intersect(s, before)) / nullif(len(s) + len(before) - len(list_intersect(s, before)), 0), 6) similarity from p where before is not null""")
def f13_jaccard(spark, sf):
    """How alike each document and the one before it of its asset are."""
    docs = table(spark, sf, "documents")
    fp = documents.fingerprints(docs, "doc_id", "text").join(docs.select(F.col("doc_id").alias("doc"), "asset_id"), "doc").where("asset_id is not null")
    before = fp.withColumn("before", F.lag("shingles").over(ordered("asset_id", "doc"))).where("before is not null")
    return plain(before.select(F.col("doc").alias("doc_id"), T.jaccard("shingles", "before").alias("similarity")))


@entry("F14_item_lists", "select o_orderkey, case when o_orderkey % 4 = 3 then [] else [(o_custkey % 9) || '.0' || (o_orderkey % 3), '9.01'] end::varchar[] as items from orders")
def f14_item_lists(spark, sf):
    """Item numbers out of lists, objects and texts, each once and in order."""
    a = F.concat((F.col("o_custkey") % 9).cast("string"), F.lit(".0"), (F.col("o_orderkey") % 3).cast("string"))
    kind = F.col("o_orderkey") % 4
    raw = F.when(kind == 0, F.concat(F.lit('["Item '), a, F.lit('", "9.01", "item '), a, F.lit('"]'))).when(kind == 1, F.concat(F.lit('{"'), a, F.lit('": "Results", "9.01": "Exhibits"}'))).when(
        kind == 2, F.concat(F.lit("Item "), a, F.lit("; ITEM 9.01 Exhibits; "), a)).otherwise(F.lit("none; n/a"))
    return table(spark, sf, "orders").select("o_orderkey", T.items_of(raw).alias("items"))


@entry("F15_taxonomy", "select case document_class when 'annual_report' then 'periodic' when 'proxy_statement' then 'governance' when 'current_report' then 'event' when 'material_contract' then 'contract' when 'subsidiary_exhibit' then 'structure' else 'other' end as kind, count(*) n from evidence_claims group by 1")
def f15_taxonomy(spark, sf):
    kinds = {"annual_report": "periodic", "proxy_statement": "governance", "current_report": "event", "material_contract": "contract", "subsidiary_exhibit": "structure"}
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return table(spark, sf, "evidence_claims").groupBy(F.coalesce(F.try_element_at(named, F.col("document_class")), F.lit("other")).alias("kind")).agg(rows_n())


@entry("F16_text_basics", "select n_nationkey, upper(substring(n_name, 1, 3)) || '-' || lower(n_name) || '-' || length(n_name) as a, replace(trim('  ' || n_name || ' '), '_', ' ') as b from nation")
def f16_text_basics(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").select(
        "n_nationkey", F.concat_ws("-", F.upper(F.substring(n, 1, 3)), F.lower(n), F.length(n).cast("string")).alias("a"), F.replace(F.trim(F.concat(F.lit("  "), n, F.lit(" "))), F.lit("_"), F.lit(" ")).alias("b"))


@entry("F17_chunks")
def f17_chunks(spark, sf):
    """Texts in overlapping pieces that end at paragraphs, sentences or words; tested by putting them together again (F18)."""
    return markup.chunked(table(spark, sf, "documents"), "doc_id", "text", 800, 120).select("doc_id", "chunk", "start", F.length("piece").cast("long").alias("n"))


@entry("F18_reassembled", "select doc_id, sha256(text) sha, true as consistent from documents where text <> ''")
def f18_reassembled(spark, sf):
    pieces = markup.chunked(table(spark, sf, "documents"), "doc_id", "text", 800, 120)
    return markup.reassembled(pieces, "doc_id").select("doc_id", F.sha2("text", 256).alias("sha"), "consistent")


@entry("F20_ownership", "select conflict_evidence_id, round(try_cast(regexp_extract(lower(trim(ownership_raw)), '([0-9]+(?:\\.[0-9]+)?)', 1) as double), 6) as percent from (select distinct conflict_evidence_id, ownership_raw from identity_conflict_evidence) where ownership_raw is not null and not regexp_matches(lower(ownership_raw), 'wholly|^all$')")
def f20_ownership(spark, sf):
    e = table(spark, sf, "identity_conflict_evidence").select("conflict_evidence_id", "ownership_raw").distinct()
    return plain(e.where("ownership_raw is not null").where(~F.lower("ownership_raw").rlike("wholly|^all$")).select("conflict_evidence_id", T.ownership_percent("ownership_raw").alias("percent")))


@entry("F21_times_compared", "select claim_kind, count(*) filter (evidence_available_at >= timestamp '2023-01-01 05:00:00') n_after, count(*) n from evidence_claims where evidence_available_at is not null group by 1")
def f21_times_compared(spark, sf):
    """Times with offsets as text, compared as times: 2023-01-01 in New York is 05:00 in UTC."""
    c = table(spark, sf, "evidence_claims").where("evidence_available_at is not null")
    text = F.concat(F.date_format(F.col("evidence_available_at") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    after = T.as_timestamp(text) >= T.as_timestamp(F.lit("2023-01-01T00:00:00-05:00"))
    return c.groupBy("claim_kind").agg(F.count_if(after).alias("n_after"), rows_n())


@entry("F22_time_parts", "select event_id, year(ts) y, isodow(ts) dow, hour(ts) h, minute(ts) m, strftime(ts::date, '%Y-%m-%d') as day, weekofyear(ts) as week from events")
def f22_time_parts(spark, sf):
    t = F.col("ts")
    return views.events(spark, sf).select(
        "event_id", F.year(t).cast("long").alias("y"), (F.weekday(t) + 1).cast("long").alias("dow"), F.hour(t).cast("long").alias("h"), F.minute(t).cast("long").alias("m"), F.to_date(t).cast("string").alias("day"), F.weekofyear(t).cast("long").alias("week"))


@entry("F23_zones", "select event_id, epoch_us(timezone('America/New_York', timezone('UTC', ts))) local_us, epoch_us(timezone('UTC', timezone('America/New_York', ts))) utc_us from events")
def f23_zones(spark, sf):
    return views.events(spark, sf).select(
        "event_id", F.unix_micros(F.from_utc_timestamp("ts", "America/New_York")).alias("local_us"), F.unix_micros(F.to_utc_timestamp("ts", "America/New_York")).alias("utc_us"))


@entry("F24_ages", "select asset_id, strftime(trading_day, '%Y-%m-%d') trading_day, price_observation_id, round((epoch_us(causal_available_at) - epoch_us(bar_end_utc)) / 1e6, 6) as seconds, greatest(0, datediff('day', trading_day, causal_available_at::date)) as n_days from (select distinct * from temporal_price_points)")
def f24_ages(spark, sf):
    p = table(spark, sf, "temporal_price_points").distinct()
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    days = F.datediff(F.to_date("causal_available_at"), "trading_day")
    return plain(p.select("asset_id", "trading_day", "price_observation_id", ((us("causal_available_at") - us("bar_end_utc")) / 1e6).alias("seconds"), F.greatest(F.lit(0), days).cast("long").alias("n_days")))


@entry("F25_blocks", "select epoch_us(ts) // 900000000 * 900000000 block_us, count(*) n from events group by 1")
def f25_blocks(spark, sf):
    us = F.unix_micros("ts")
    return views.events(spark, sf).groupBy((us - F.pmod(us, F.lit(900_000_000))).alias("block_us")).agg(rows_n())


@entry("F27_precision", """with d as (select doc_id, case when available_at is null then null when doc_id % 3 = 0 then strftime(available_at, '%Y-%m-%d') when doc_id % 3 = 1 then strftime(available_at, '%Y-%m-%dT%H:%M:%S') else strftime(available_at, '%Y-%m-%dT%H:%M:%S') || 'Z' end t from documents)
    select case when t is null then 'missing' when length(t) = 10 then 'date_only' when t like '%Z' then 'timestamp_utc' else 'timestamp_naive' end as "precision", count(*) n from d group by 1""")
def f27_precision(spark, sf):
    """How precise a time text is: only a date, a time without zone, one with it."""
    at = lambda p: F.date_format("available_at", p)
    third = F.col("doc_id") % 3
    t = F.when(third == 0, at("yyyy-MM-dd")).when(third == 1, at("yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    kind = F.when(t.isNull(), "missing").when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date_only").when(T.zone_aware(t), "timestamp_utc").otherwise("timestamp_naive")
    return table(spark, sf, "documents").groupBy(kind.alias("precision")).agg(rows_n())


@entry("F28_arithmetic", "select event_id, round(abs(value - 20), 6) a, sign(value - 20)::double b, round(sqrt(value), 6) c, greatest(value, 15.0) d, least(value, 15.0) e, round(ln(1 + value), 6) f, round(exp(value / 100) - 1, 6) g, round(power(value, 0.5) + log10(1 + value), 6) h, round(greatest(0, least(1, (value - 10) / 20)), 6) i from events where value >= 0")
def f28_arithmetic(spark, sf):
    v = F.col("value")
    return plain(views.events(spark, sf).where("value >= 0").select(
        "event_id", F.abs(v - 20).alias("a"), F.signum(v - 20).alias("b"), F.sqrt(v).alias("c"), F.greatest(v, F.lit(15.0)).alias("d"), F.least(v, F.lit(15.0)).alias("e"), F.log1p(v).alias("f"), F.expm1(v / 100).alias("g"),
        (F.pow(v, F.lit(0.5)) + F.log10(1 + v)).alias("h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - 10) / 20)).alias("i")))


@entry("F29_tau_coordinates", "select tau::bigint tau, round(tau / 252, 6) share, round(ln(1 + tau) / ln(253), 6) log_share from (select unnest(range(1, 253)) tau)")
def f29_tau_coordinates(spark, sf):
    return plain(spark.range(1, 253).select(F.col("id").alias("tau"), *D.tau_coordinates(F.col("id"))))


@entry("F30_half_life", "select tau::bigint tau, round(greatest(0, least(1, power(2, -(tau - 1) / 63.0))), 6) weight from (select unnest(range(0, 400)) tau)")
def f30_half_life(spark, sf):
    return plain(spark.range(0, 400).select(F.col("id").alias("tau"), D.half_life(F.col("id"), 63.0).alias("weight")))


@entry("F31_safe_division", "select asset_id, sum(volume) v, round(sum(price) / nullif(sum(case when checked = 1 then volume else 0 end), 0), 6) ratio from (select l_suppkey asset_id, l_quantity volume, l_extendedprice / l_quantity price, (l_linestatus = 'F')::int checked from lineitem) group by 1")
def f31_safe_division(spark, sf):
    obs = views.observations(spark, sf)
    return plain(obs.groupBy(K).agg(F.sum("volume").alias("v"), F.try_divide(F.sum("price"), F.sum(F.when(F.col("checked") == 1, F.col("volume")).otherwise(0.0))).alias("ratio")))


@entry("F33_row_order", f"with {MONTHLY_SQL} select asset_id, strftime(monthly.day, '%Y-%m-%d') as day, round(list_sort([low, close, high, volume])[1], 8) least, round(list_sort([low, close, high, volume])[4], 8) as most, (low > close or close > high or high > volume)::int crossed from monthly")
def f33_row_order(spark, sf):
    names = ("low", "close", "high", "volume")
    kept = D.rearranged(names)
    df = views.monthly(spark, sf).select(K, O, D.crosses(names).cast("int").alias("crossed"), *kept)
    return plain(df.select(K, O, F.col("low").alias("least"), F.col("volume").alias("most"), "crossed"), 8)


@entry("F34_json", "select event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' as canonical, json_extract_string(props, '$.k')::bigint k from events")
def f34_json(spark, sf):
    """JSON read by path and by schema, and written again with sorted keys and no spaces."""
    ev = views.events(spark, sf).withColumn("p", F.from_json("props", "k bigint"))
    return ev.select("event_id", F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("type"))).alias("canonical"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@entry("F35_try_cast", "select try_cast(ownership_raw as double) is not null as plain_number, count(*) n from identity_conflict_evidence where ownership_raw is not null group by 1")
def f35_try_cast(spark, sf):
    e = table(spark, sf, "identity_conflict_evidence").where("ownership_raw is not null")
    return e.groupBy(F.col("ownership_raw").try_cast("double").isNotNull().alias("plain_number")).agg(rows_n())


@entry("F36_clean_numbers", "select price_observation_id, case when asset_id % 5 in (0, 1) then null else raw_close end as clean from (select distinct * from temporal_price_points)")
def f36_clean_numbers(spark, sf):
    p = table(spark, sf, "temporal_price_points").distinct()
    dirty = F.when(F.col("asset_id") % 5 == 0, F.lit(float("nan"))).when(F.col("asset_id") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("raw_close"))
    return p.select("price_observation_id", T.clean_number(dirty).alias("clean"))


@entry("F37_period_scope", "select case c_custkey % 5 when 0 then 'unknown' when 1 then 'quarter' when 2 then 'year' when 3 then 'provider:next_month' else 'quarter' end as scope, count(*) n from customer group by 1")
def f37_period_scope(spark, sf):
    text = F.get(F.array(F.lit(" "), F.lit("Fiscal Quarter"), F.lit("FY2024"), F.lit("Next  month!"), F.lit("q3 2024")), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, sf, "customer").groupBy(T.period_scope(text).alias("scope")).agg(rows_n())


@entry("F39_day_keys", "select upper(trim(ticker)) || '|' || strftime(origin_trading_day, '%Y%m%d') as day_key, count(distinct origin_id) n from temporal_origins where ticker is not null and origin_trading_day is not null group by 1")
def f39_day_keys(spark, sf):
    o = table(spark, sf, "temporal_origins").where("ticker is not null and origin_trading_day is not null")
    return o.groupBy(F.concat_ws("|", F.upper(F.trim("ticker")), F.date_format("origin_trading_day", "yyyyMMdd")).alias("day_key")).agg(F.countDistinct("origin_id").alias("n"))


@entry("F40_level_names", "select name, round(v, 6) as level from (select unnest(['q05', 'q25', 'q50', 'q75', 'q95']) as name, unnest(quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95])) v from events)")
def f40_level_names(spark, sf):
    """Quantiles under their names: two digits after q."""
    q = D.global_quantiles(views.events(spark, sf), "value", D.QS)
    return plain(q.select(F.concat(F.lit("q"), F.lpad(F.round(F.col("q") * 100).cast("int").cast("string"), 2, "0")).alias("name"), F.col("value").alias("level")))
