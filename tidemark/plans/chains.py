"""Queries over filings, news, evidence and relations along their chains, audits of them, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import markup
from tidemark.functions import text as T
from tidemark.operators import audit, graph, panel
from tidemark.operators import windows as w
from tidemark.plans import views
from tidemark.plans.platform import _stream, drained
from tidemark.plans.registry import Registry, plain, rows_n
from tidemark.plans.views import ACTIONS_SQL, DAILY_SQL, MONTHLY_SQL
from tidemark.session import micros, table
from tidemark.streaming import streams

entry = Registry()
QUERIES, ORACLE = entry.queries, entry.oracle
K, O = "asset_id", "day"
_NORM = "trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', ' ', 'g'))"
_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(title), 'https?://\\S+', ' ', 'g'), '\\((?:reuters|ap|afp|bloomberg)\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_CLAIMS = "c as (select distinct * from evidence_claims)"


def _claims(spark, sf):
    return table(spark, sf, "evidence_claims").distinct()


@entry("T04_unique_lineage", f"""with {_CLAIMS}, p as (select coalesce(registrant_ticker, 'none') raw, accession_number f from c), g as (select raw, count(distinct f) n, min(f) f from p group by 1) select raw as ticker, case when n = 1 then f end as accession_number, case when n = 1 then 'unique' when n > 1 then 'ambiguous' else 'unknown' end status from g
    union all select content_raw_document_id, min(accession_number), 'unique' from c where content_raw_document_id is not null group by 1 having count(distinct accession_number) = 1""")
def t04_unique_lineage(spark, sf):
    """Filings that raw documents, and tickers, lead back to."""
    c = _claims(spark, sf).withColumn("ticker", F.coalesce("registrant_ticker", F.lit("none")))
    docs = graph.unique_lineage(c, "content_raw_document_id", "accession_number").where("status = 'unique'")
    return graph.unique_lineage(c, "ticker", "accession_number").unionByName(docs.withColumnRenamed("content_raw_document_id", "ticker"))


@entry("T05_temporal_anchor", f"with {_CLAIMS} select accession_number, epoch_us(greatest(min(evidence_available_at), max(case when document_class = 'annual_report' then evidence_available_at end))) anchor_us, bool_and(availability_is_point_in_time = 1) pit from c where accession_number is not null group by 1")
def t05_temporal_anchor(spark, sf):
    """An event is known from the later of its metadata and its first evidence, and point in time only if all of it is."""
    meta = F.max(F.when(F.col("document_class") == "annual_report", F.col("evidence_available_at")))
    return plain(_claims(spark, sf).where("accession_number is not null").groupBy("accession_number").agg(
        F.greatest(F.min("evidence_available_at"), meta).alias("anchor_us"), F.bool_and(F.col("availability_is_point_in_time") == 1).alias("pit")))


@entry("T06_event_versions", f"""with {_CLAIMS}, r as (select 'event_' || sha256(coalesce(registrant_entity_id::varchar, '') || chr(31) || coalesce(claim_kind, '')) e, evidence_available_at a, named_entity_normalized i from c where evidence_available_at is not null and named_entity_normalized is not null), f as (select e, i, min(a) a from r group by 1, 2),
    s as (select e, a, count(*) n, sum(('0x' || substring(md5(i), 1, 8))::bigint) h from f group by 1, 2) select e event_id, sha256(e || '|' || (sum(h) over k)::varchar) version_id, row_number() over k as "version", epoch_us(a) first_at, sum(n) over k::bigint n_items from s window k as (partition by e order by a)""")
def t06_event_versions(spark, sf):
    return plain(graph.event_versions(_claims(spark, sf), ["registrant_entity_id", "claim_kind"], "evidence_available_at", "named_entity_normalized"))


@entry("T09_projected_evidence", f"with {_CLAIMS} select registrant_entity_id, count(distinct raw_sha256) n_contents, count(*) n_evidence, (count(distinct (raw_sha256, accession_number)) > count(distinct raw_sha256))::int conflict from c where registrant_entity_id is not null and raw_sha256 is not null and accession_number is not null group by 1")
def t09_projected_evidence(spark, sf):
    """All states of an entity as one set of contents; a content under two filings is a conflict."""
    c = _claims(spark, sf).where("registrant_entity_id is not null and raw_sha256 is not null and accession_number is not null")
    return c.groupBy("registrant_entity_id").agg(
        F.countDistinct("raw_sha256").alias("n_contents"), F.count(F.lit(1)).alias("n_evidence"), (F.countDistinct("raw_sha256", "accession_number") > F.countDistinct("raw_sha256")).cast("int").alias("conflict"))


def _rules_sql(source: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select '{n}' as rule, count(*) n_rows, count(*) filter (not coalesce({c}, true)) n_violations, case when count(*) filter (not coalesce({c}, true)) = 0 then 'pass' else 'fail' end status from {source}" for n, c in rules.items())


@entry("T10_clock_verification", f"with {_CLAIMS} " + _rules_sql("c", {"has a clock": "evidence_available_at is not null", "says how sure": "availability_is_point_in_time in (0, 1)", "accession is whole": "regexp_matches(accession_number, '^[0-9]{10}-[0-9]{3}-[0-9]{7}$')", "after 2020": "evidence_available_at >= timestamp '2021-01-01'"}))
def t10_clock_verification(spark, sf):
    """What metadata says about clocks, by rules."""
    at = F.col("evidence_available_at")
    return audit.check_rules(_claims(spark, sf), {
        "has a clock": at.isNotNull(), "says how sure": F.col("availability_is_point_in_time").isin(0, 1), "accession is whole": F.col("accession_number").rlike("^[0-9]{10}-[0-9]{3}-[0-9]{7}$"),
        "after 2020": at >= F.lit("2021-01-01").cast("timestamp_ntz")})


@entry("T11_entity_bridge", f"""with {_CLAIMS}, f as (select accession_number, resolved_named_entity_id e, min((evidence_available_at, evidence_claim_id)) m from c where resolved_named_entity_id is not null and evidence_available_at is not null group by 1, 2), a as (select entity_id, min(asset_id) a from asset_entities group by 1)
    select accession_number, e as entity, m[2] as evidence_claim_id, a as asset_id from f left join a on a.entity_id = f.e""".replace("m[2]", "struct_extract_at(m, 2)"))
def t11_entity_bridge(spark, sf):
    """The first evidence of every filing for every entity, with the entity's asset if it has one."""
    c = _claims(spark, sf).where("resolved_named_entity_id is not null and evidence_available_at is not null")
    first = c.groupBy("accession_number", F.col("resolved_named_entity_id").alias("entity")).agg(F.min(F.struct("evidence_available_at", "evidence_claim_id"))["evidence_claim_id"].alias("evidence_claim_id"))
    assets = table(spark, sf, "asset_entities").groupBy(F.col("entity_id").alias("entity")).agg(F.min("asset_id").alias("asset_id"))
    return first.join(assets, "entity", "left").select("accession_number", "entity", "evidence_claim_id", "asset_id")


@entry("T13_observed_relations", """with r as (select distinct relation_candidate_id id, source_entity_id s, resolved_target_entity_id t, relation_type, evidence_available_at a from relation_name_candidates where resolved_target_entity_id is not null and source_entity_id is not null)
    select id as relation_candidate_id, row_number() over (partition by s, t, relation_type order by (a >= timestamp '2023-01-01')::int, a, id) as sequence from r qualify a >= timestamp '2023-01-01'""")
def t13_observed_relations(spark, sf):
    """Later observations of relations, numbered on from those observed before; those that are there are not brought again."""
    from tidemark.operators.clocks import ingested

    r = table(spark, sf, "relation_name_candidates").where("resolved_target_entity_id is not null and source_entity_id is not null").distinct()
    keys = ["source_entity_id", "resolved_target_entity_id", "relation_type"]
    old = r.where("evidence_available_at < timestamp_ntz '2023-01-01'")
    out = ingested(old, r.where("evidence_available_at is not null"), keys, ["target_name_raw"], ["evidence_available_at"], "relation_candidate_id")
    return out.select("relation_candidate_id", "sequence")


_LINES = """l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) i from documents where document_kind = 'exhibit' and text is not null), p as (select *, regexp_split_to_array(trim(line), '\\s*(?:\\t|\\|)\\s*') c from l),
    x as (select doc_id, i, c[1] as "name", c[2] place, nullif(regexp_extract(coalesce(c[3], ''), '([0-9]+(?:\\.[0-9]+)?)', 1), '')::double pct from p where len(c) between 2 and 3 and c[1] <> '' and c[2] <> '')"""


def _exhibit_lines(spark, sf):
    docs = table(spark, sf, "documents").where("document_kind = 'exhibit' and text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    c = F.split(F.trim("line"), r"\s*(?:\t|\|)\s*")
    out = lines.select("doc_id", F.col("i").cast("long").alias("i"), c.alias("c")).where(F.size("c").between(2, 3)).where("c[0] <> '' and c[1] <> ''")
    return out.select("doc_id", "i", F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(1)).alias("place"), F.nullif(F.regexp_extract(F.coalesce(F.get("c", F.lit(2)), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double").alias("pct"))


@entry("T16_exhibit_lines", f"with {_LINES} select * from x")
def t16_exhibit_lines(spark, sf):
    """Subsidiaries, their places and shares out of the lines of exhibits."""
    return _exhibit_lines(spark, sf)


@entry("T17_typed_tables", f"""with {_LINES}, n as (select *, row_number() over (partition by doc_id order by i) r from x where name not like '%<%' and place not like '%<%') select doc_id, case when r <= 3 then 'explicit' when doc_id % 2 = 0 then 'inherited' else 'implicit' end schema_kind, name as legal_name, place as jurisdiction, case when r <= 3 or doc_id % 2 = 0 then pct::varchar end as ownership from n""")
def t17_typed_tables(spark, sf):
    """Tables of pages with their columns found by headers, inherited from the table before, or by place."""
    x = _exhibit_lines(spark, sf).where("name not like '%<%' and place not like '%<%'")
    x = x.withColumn("r", F.row_number().over(w.ordered("doc_id", "i")))
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;"))
    pct, name, place = esc(F.col("pct").cast("string")), esc(F.col("name")), esc(F.col("place"))
    td = lambda *cs: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cs), F.lit("</td></tr>"))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", td(pct, name, place).alias("t")))))
    later = F.array_sort(F.collect_list(F.when(F.col("r") > 3, F.struct("r", F.when(F.col("doc_id") % 2 == 0, td(pct, name, place)).otherwise(td(name, place)).alias("t")))))
    head = F.lit("<table><tr><th>Ownership %</th><th>Name of subsidiary</th><th>Jurisdiction</th></tr>")
    page = F.concat(F.lit("<p>Subsidiaries</p>"), head, F.array_join(first["t"], ""), F.lit("</table><table>"), F.array_join(later["t"], ""), F.lit("</table>"))
    rows = markup.table_rows(x.groupBy("doc_id").agg(page.alias("html")), "doc_id", "html")
    out = markup.typed_rows(rows, "doc_id", {"legal_name": ("name", "company"), "jurisdiction": ("jurisdiction", "state"), "ownership": ("ownership", "percent")})
    return out.select("doc_id", "schema_kind", "legal_name", "jurisdiction", "ownership")


@entry("T21_place_relations", """with n as (select lower(jurisdiction_code) k, jurisdiction_code c, jurisdiction_kind kind from jurisdiction_reference union select lower(jurisdiction_name), jurisdiction_code, jurisdiction_kind from jurisdiction_reference union select lower(local_name), jurisdiction_code, jurisdiction_kind from jurisdiction_reference where local_name is not null),
    b as (select distinct conflict_group_id, conflict_bucket_id, lower(trim(normalized_jurisdiction)) k from identity_conflict_buckets), j as (select b.*, c, kind from b left join n using (k))
    select conflict_group_id, count(distinct conflict_bucket_id) n, case when count(*) filter (c is null) > 0 then 'open' when count(distinct c) = 1 then 'same' when count(distinct kind) > 1 then 'kinds_differ' else 'different' end relation from j group by 1""")
def t21_place_relations(spark, sf):
    """Whether the places of a group are one entry, several of one kind, of several kinds, or not all known."""
    ref = table(spark, sf, "jurisdiction_reference")
    names = ref.select(F.explode(F.array("jurisdiction_code", "jurisdiction_name", "local_name")).alias("k"), F.col("jurisdiction_code").alias("c"), F.col("jurisdiction_kind").alias("kind")).where("k is not null").withColumn("k", F.lower("k")).distinct()
    b = table(spark, sf, "identity_conflict_buckets").select("conflict_group_id", "conflict_bucket_id", F.lower(F.trim("normalized_jurisdiction")).alias("k")).distinct()
    out = b.join(names, "k", "left").groupBy("conflict_group_id").agg(
        F.countDistinct("conflict_bucket_id").alias("n"),
        F.when(F.count_if(F.col("c").isNull()) > 0, "open").when(F.countDistinct("c") == 1, "same").when(F.countDistinct("kind") > 1, "kinds_differ").otherwise("different").alias("relation"))
    return out


@entry("T22_selected_classes", """with c as (select distinct accession_number, document_class, case document_class when 'subsidiary_exhibit' then 1 when 'material_contract' then 2 when 'annual_report' then 3 when 'proxy_statement' then 4 else 9 end p, count(*) n from relation_name_candidates where accession_number is not null group by 1, 2)
    select accession_number, document_class, n from c qualify row_number() over (partition by accession_number order by p, document_class) = 1""")
def t22_selected_classes(spark, sf):
    """Of every filing the class of document that says most about relations, and how much it says."""
    c = table(spark, sf, "relation_name_candidates").where("accession_number is not null").groupBy("accession_number", "document_class").agg(rows_n())
    place = F.when(F.col("document_class") == "subsidiary_exhibit", 1).when(F.col("document_class") == "material_contract", 2).when(F.col("document_class") == "annual_report", 3).when(F.col("document_class") == "proxy_statement", 4).otherwise(9)
    return c.groupBy("accession_number").agg(F.min(F.struct(place.alias("p"), "document_class", "n")).alias("b")).select("accession_number", "b.document_class", "b.n")


@entry("T23_news_ids", f"""with d as (select doc_id, source, asset_id, available_at, {_TITLE} k, {_NORM.format(c="coalesce(text, '')")} t from documents where document_kind = 'news')
    select doc_id, 'ver_' || sha256(t) as version_id, case when k <> '' then 'story_' || sha256(k) end as story_id, case when k <> '' and available_at is not null and asset_id is not null then 'episode_' || sha256(k || chr(31) || strftime(available_at, '%Y-%m-%d') || chr(31) || asset_id) end as episode_id from d""")
def t23_news_ids(spark, sf):
    """Ids of news that follow from their content: version, story by title, episode by title, day and asset."""
    d = table(spark, sf, "documents").where("document_kind = 'news'").withColumn("k", T.title_key("title"))
    story = F.when(F.col("k") != "", T.content_id("story_", "k"))
    whole = (F.col("k") != "") & F.col("available_at").isNotNull() & F.col("asset_id").isNotNull()
    return d.select("doc_id", T.content_id("ver_", T.normalized(F.coalesce("text", F.lit("")))).alias("version_id"), story.alias("story_id"), F.when(whole, T.content_id("episode_", "k", F.to_date("available_at"), "asset_id")).alias("episode_id"))


@entry("T24_versions_and_links", f"""with d as (select doc_id, source, asset_id, available_at, sha256({_NORM.format(c='text')}) v from documents where text is not null and {_NORM.format(c='text')} <> ''), v as (select v, count(*) n, count(distinct source) s, count(distinct asset_id) a, min(available_at) f from d group by 1)
    select v as version_sha, n as n_documents, s as n_sources, a as n_assets, epoch_us(f) first_us from v""")
def t24_versions_and_links(spark, sf):
    """Versions of texts, how often and where they were collected, and the assets they are linked to."""
    d = table(spark, sf, "documents").withColumn("plain", T.normalized("text")).where("plain <> ''")
    return plain(d.groupBy(F.sha2("plain", 256).alias("version_sha")).agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.countDistinct("asset_id").alias("n_assets"), F.min("available_at").alias("first_us")))


@entry("T27_annotations", f"with {_CLAIMS}, e as (select claim_kind, unnest(from_json(quality_flags_json, '[\"VARCHAR\"]')) flag, evidence_claim_id from c where quality_flags_json is not null) select claim_kind, flag, count(*) n, count(distinct evidence_claim_id) n_claims from e group by 1, 2")
def t27_annotations(spark, sf):
    """Lists of annotations as rows."""
    c = _claims(spark, sf).select("claim_kind", "evidence_claim_id", F.explode(F.from_json("quality_flags_json", "array<string>")).alias("flag"))
    return c.groupBy("claim_kind", "flag").agg(rows_n(), F.countDistinct("evidence_claim_id").alias("n_claims"))


@entry("T28_revision_diff", """with p as (select distinct asset_id, trading_day d, observation_sequence s, raw_close v from temporal_price_points where asset_id is not null and trading_day is not null), n as (select *, lag(v) over k b, lag(s) over k bs from p window k as (partition by asset_id, d order by s))
    select year(d) as year, case when bs is null then 'new' when v is null and b is null then 'still_missing' when v is null then 'withdrawn' when b is null then 'filled' when v = b then 'unchanged' else 'changed' end as change, count(*) n, round(avg(v - b), 6) mean_change from n group by 1, 2""")
def t28_revision_diff(spark, sf):
    """What every revision changed against the one before."""
    p = table(spark, sf, "temporal_price_points").where("asset_id is not null and trading_day is not null").select("asset_id", F.col("trading_day").alias("d"), F.col("observation_sequence").alias("s"), F.col("raw_close").alias("v")).distinct()
    o = w.ordered(["asset_id", "d"], "s")
    p = p.withColumn("b", F.lag("v").over(o)).withColumn("bs", F.lag("s").over(o))
    v, b = F.col("v"), F.col("b")
    change = F.when(F.col("bs").isNull(), "new").when(v.isNull() & b.isNull(), "still_missing").when(v.isNull(), "withdrawn").when(b.isNull(), "filled").when(v == b, "unchanged").otherwise("changed")
    return plain(p.groupBy(F.year("d").cast("long").alias("year"), change.alias("change")).agg(rows_n(), F.avg(v - b).alias("mean_change")))


# audits


@entry("Q04_identity_audit", f"with {MONTHLY_SQL} select count(*) filter (ret is not null) n, true as exact from (select 100 * (close / nullif(lag(close) over (partition by asset_id order by day), 0) - 1) ret from monthly)")
def q04_identity_audit(spark, sf):
    """Parts must add up to their whole: the greatest error over all rows."""
    df = panel.decompose(views.monthly(spark, sf).withColumn("ret", w.lag_return("close", 1, K, O)).where("ret is not null"), "ret")
    off = F.abs(F.col("market_part") + F.col("sector_part") + F.col("asset_part") - F.col("ret"))
    return df.agg(rows_n(), (F.max(off) <= 1e-9).alias("exact"))


@entry("Q05_foundation_coverage", r"""select source, document_kind, count(*) n, count(*) filter (text is null or not regexp_matches(text, '[^ \t\n\r\f]')) n_blank, count(asset_id) n_linked, round(count(asset_id) / count(*), 6) linked_share from documents group by 1, 2""")
def q05_foundation_coverage(spark, sf):
    d = table(spark, sf, "documents")
    return plain(d.groupBy("source", "document_kind").agg(rows_n(), F.count_if(F.col("text").isNull() | ~F.col("text").rlike(r"[^ \t\n\r\f]")).alias("n_blank"), F.count("asset_id").alias("n_linked"), (F.count("asset_id") / F.count(F.lit(1))).alias("linked_share")))


@entry("Q06_dataset_span", f"with {_CLAIMS}, y as (select registrant_entity_id e, count(*) n from c group by 1) select (select count(*) from c) n_rows, (select count(distinct registrant_entity_id) from c) n_entities, round((select max(n) from y) / (select count(*) from c), 6) largest_share, (select datediff('day', min(evidence_available_at)::date, max(evidence_available_at)::date) from c) span_days")
def q06_dataset_span(spark, sf):
    """Rows, entities, the share of the largest and the span of days."""
    c = _claims(spark, sf)
    per = c.groupBy("registrant_entity_id").agg(F.count(F.lit(1)).alias("c"), F.min("evidence_available_at").alias("a"), F.max("evidence_available_at").alias("z"))
    return plain(per.agg(F.sum("c").alias("n_rows"), F.count("registrant_entity_id").alias("n_entities"), (F.max("c") / F.sum("c")).alias("largest_share"), F.datediff(F.to_date(F.max("z")), F.to_date(F.min("a"))).cast("long").alias("span_days")))


@entry("Q07_lineage", """select 'bucket_of_group' as link, count(*) n, count(*) filter (conflict_group_id not in (select conflict_group_id from identity_conflict_groups where conflict_group_id is not null)) n_lost from (select distinct * from identity_conflict_buckets)
    union all select 'evidence_of_bucket', count(*), count(*) filter (conflict_bucket_id not in (select conflict_bucket_id from identity_conflict_buckets where conflict_bucket_id is not null)) from (select distinct * from identity_conflict_evidence)
    union all select 'origin_of_point', count(*), count(*) filter ((asset_id, origin_trading_day) not in (select (asset_id, trading_day) from temporal_price_points where asset_id is not null and trading_day is not null)) from (select distinct * from temporal_origins where asset_id is not null and origin_trading_day is not null)""")
def q07_lineage(spark, sf):
    """Rows of each table that lead to no row of the table they come from."""
    t = lambda n: table(spark, sf, n).distinct()
    pts = t("temporal_price_points").select("asset_id", F.col("trading_day").alias("origin_trading_day"))
    out = None
    for name, child, parent, keys in (
        ("bucket_of_group", t("identity_conflict_buckets"), t("identity_conflict_groups"), ["conflict_group_id"]), ("evidence_of_bucket", t("identity_conflict_evidence"), t("identity_conflict_buckets"), ["conflict_bucket_id"]),
        ("origin_of_point", t("temporal_origins").where("asset_id is not null and origin_trading_day is not null"), pts, ["asset_id", "origin_trading_day"]),
    ):
        marked = child.join(parent.select(*keys).distinct().withColumn("_p", F.lit(1)), keys, "left")
        one = marked.agg(rows_n(), F.count_if(F.col("_p").isNull()).alias("n_lost")).select(F.lit(name).alias("link"), "n", "n_lost")
        out = one if out is None else out.unionByName(one)
    return out


@entry("Q08_plain_step_identity", f"with {DAILY_SQL}, cash as (select asset_id, day, max(price) / 40 cash from obs where l_returnflag = 'R' and l_discount >= 0.09 group by 1, 2), a as (select daily.*, cash, lag(close) over (partition by asset_id order by daily.day) prev from daily left join cash using (asset_id, day)) select count(*) n, 0::bigint n_off from a where cash is null and prev is not null")
def q08_plain_step_identity(spark, sf):
    """Without cash the economic step is the provider's step, to the last place."""
    obs = views.observations(spark, sf)
    cash = obs.where("l_returnflag = 'R' and l_discount >= 0.09").groupBy(K, O).agg((F.max("price") / 40).alias("c"))
    df = views.daily(spark, sf).join(cash, [K, O], "left").withColumn("cash", F.coalesce("c", F.lit(0.0))).withColumn("prev", F.lag("close").over(w.ordered(K, O)))
    return panel.step_classes(df).where("c is null and prev is not null").agg(rows_n(), F.count_if(F.col("economic") != F.col("provider")).alias("n_off"))


@entry("Q10_tail_lineage", f"""with {DAILY_SQL}, a as (select asset_id, day, 100 * (lead(close, 5) over k / close - 1) r, lead(close, 5) over k is not null ok from daily window k as (partition by asset_id order by day)) select asset_id, strftime(a.day, '%Y-%m-%d') as day, round(r, 6) outcome, true as same from a where ok order by r desc, asset_id, a.day limit 20""")
def q10_tail_lineage(spark, sf):
    """The largest outcomes, each computed again from the steps of its path."""
    o = w.ordered(K, O)
    df = views.daily(spark, sf).withColumn("l", F.ln(F.col("close") / F.lag("close").over(o)))
    df = df.select(K, O, (100 * (F.lead("close", 5).over(o) / F.col("close") - 1)).alias("outcome"), (100 * F.expm1(w.forward(F.sum, "l", 5, K, O))).alias("again")).where("outcome is not null")
    top = df.orderBy(F.col("outcome").desc(), K, O).limit(20)
    return plain(top.select(K, O, "outcome", (F.abs(F.col("outcome") - F.col("again")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("outcome"))).alias("same")))


@entry("Q13_corpus_profile", f"""select source, count(*) n, count(*) filter (text is null) n_null, count(*) filter (text = '') n_empty, count(distinct lang) n_langs, count(distinct sha256({_NORM.format(c='text')})) n_texts, max(n_chars) longest from documents group by 1""")
def q13_corpus_profile(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(rows_n(), F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.col("text") == "").alias("n_empty"), F.countDistinct("lang").alias("n_langs"), F.countDistinct(F.sha2(T.normalized("text"), 256)).alias("n_texts"), F.max("n_chars").alias("longest"))


@entry("Q14_nested_contract", "with e as (select value, json_extract_string(props, '$.k')::bigint k, event_type t from events) " + _rules_sql("e", {"value in range": "value between 0 and 90", "key known": "k is not null and k >= 0", "type named": "t in ('view', 'click', 'purchase', 'error', 'signup')"}))
def q14_nested_contract(spark, sf):
    """Rules over a nested state."""
    state = F.struct(F.struct(F.col("value"), F.get_json_object("props", "$.k").cast("long").alias("k")).alias("body"), F.col("event_type").alias("type"))
    df = views.events(spark, sf).select(state.alias("s"))
    return audit.check_rules(df, {
        "value in range": F.col("s.body.value").between(0, 90), "key known": F.col("s.body.k").isNotNull() & (F.col("s.body.k") >= 0), "type named": F.col("s.type").isin("view", "click", "purchase", "error", "signup")})


# arrivals and streams


@entry("R02_late_revisions", """with r as (select distinct observation_id, source_id, symbol, trading_day, observation_sequence s, observed_at o from global_reference_observations), m as (select *, max(o) over (partition by source_id, symbol, trading_day order by s rows between unbounded preceding and 1 preceding) h, count(*) over (partition by source_id, symbol, trading_day) c from r)
    select source_id, count(*) n_kept, count(*) filter (o < h) n_late, count(*) filter (s > 1) n_revisions from m group by 1""")
def r02_late_revisions(spark, sf):
    """Late rows are revisions beside the others: all are kept, and counted."""
    r = table(spark, sf, "global_reference_observations").select("observation_id", "source_id", "symbol", "trading_day", F.col("observation_sequence").alias("s"), F.col("observed_at").alias("o")).distinct()
    high = F.max("o").over(w.ordered(["source_id", "symbol", "trading_day"], "s").rowsBetween(Window.unboundedPreceding, -1))
    return r.withColumn("h", high).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("o") < F.col("h")).alias("n_late"), F.count_if(F.col("s") > 1).alias("n_revisions"))


@entry("R03_deadlines", "select source_id, count(*) filter (observed_at <= trading_day + interval 40 hours) n_in_time, count(*) filter (observed_at > trading_day + interval 40 hours) n_after, count(*) filter (observed_at is null or trading_day is null) n_unknown from (select distinct * from global_reference_observations) group by 1")
def r03_deadlines(spark, sf):
    """Rows that came within sixteen hours of the end of their day, and after."""
    r = table(spark, sf, "global_reference_observations").distinct()
    limit = micros(F.col("trading_day").cast("timestamp")) + 40 * 3_600_000_000
    return r.groupBy("source_id").agg(F.count_if(micros("observed_at") <= limit).alias("n_in_time"), F.count_if(micros("observed_at") > limit).alias("n_after"), F.count_if(F.col("observed_at").isNull() | F.col("trading_day").isNull()).alias("n_unknown"))


@entry("R05_due", "select user_id, epoch_us(max(ts)) last_us, (timestamp '2024-01-31' - max(ts) >= interval 12 hours)::int as due from events group by 1")
def r05_due(spark, sf):
    """What was last seen longer ago than its interval is due."""
    last = views.events(spark, sf).groupBy("user_id").agg(F.unix_micros(F.max("ts")).alias("last_us"))
    return last.withColumn("due", (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.col("last_us") >= 12 * 3_600_000_000).cast("int"))


@entry("R07_retractions", "select user_id, arg_max(event_type, (ts, event_id)) as last_type, count(*) n from events group by 1 having arg_max(event_type, (ts, event_id)) <> 'error'")
def r07_retractions(spark, sf):
    """Only what the last event does not take back."""
    per = views.events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), rows_n())
    return per.where("last_type <> 'error'")


@entry("R08_sessions", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end s from events), g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) i from e), x as (select user_id, i, epoch_us(min(ts)) start_us, epoch_us(max(ts)) + 7200000000 end_us, count(*) n from g group by 1, 2), w as (select max(epoch_us(ts)) - 0 w from events)
    select user_id, start_us, end_us, n from x""")
def r08_sessions(spark, sf):
    """Sessions of a stream that end after two hours of silence, all of them, as they stand at the end of the input."""
    out = drained(streams.sessions(_stream(spark, sf), "ts", "user_id", "2 hours", "2 days"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@entry("R09_stream_join", "select b.event_id, count(*) n from events b join events v on v.user_id = b.user_id and v.event_type = 'view' and b.event_type = 'purchase' and v.ts between b.ts - interval 6 hours and b.ts group by 1")
def r09_stream_join(spark, sf):
    """Two streams joined within six hours: what was seen before each purchase; state older than that is let go."""
    ev = lambda: _stream(spark, sf).select("event_id", "user_id", "event_type", "ts")
    out = drained(streams.joined_within(ev().where("event_type = 'purchase'"), ev().where("event_type = 'view'"), "user_id", "ts", "6 hours", "2 days").select("event_id"), "append")
    return out.groupBy("event_id").agg(rows_n())
