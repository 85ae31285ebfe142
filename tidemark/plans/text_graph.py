"""Queries over documents, names, events and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import documents, graph
from tidemark.session import stored, table

AT = "2023-06-30 12:00:00"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def f03_normalized(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.normalized("text"), 256).alias("sha"), F.length(T.normalized("text")).cast("long").alias("n"))


def f04_urls(spark, sf):
    rel = table(spark, sf, "relation_name_candidates").select("source_url").distinct()
    return rel.select("source_url", T.plain_url("source_url").alias("plain"), T.canonical_url("source_url").alias("canonical"), T.domain("source_url").alias("domain"))


def f07_titles(spark, sf):
    return _docs(spark, sf).select("doc_id", T.title_key("title").alias("title_key"), T.name_key("source").alias("source_key"))


def f10_content_ids(spark, sf):
    refs = table(spark, sf, "global_reference_observations").distinct()
    return refs.select("observation_id", T.content_id("obs_", "source_id", "symbol", "observation_sequence").alias("content_id"))


def f11_shingles(spark, sf):
    fp = documents.fingerprints(_docs(spark, sf), "doc_id", "text")
    return fp.select(F.col("doc").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.size("shingles").cast("long").alias("n_shingles"), F.get("shingles", F.lit(0)).alias("least"))


def f19_cues(spark, sf):
    return _docs(spark, sf).groupBy("source").agg(*[F.sum(T.count_cues("text", c)).alias("n_" + c.replace(" ", "_")) for c in ("the", "credit", "revenue", "agreed to")])


def f26_times(spark, sf):
    rows = table(spark, sf, "evidence_claims").select("evidence_claim_id", "evidence_available_at").distinct()
    iso = F.date_format("evidence_available_at", "yyyy-MM-dd'T'HH:mm:ss")
    epoch = F.unix_seconds(F.col("evidence_available_at").cast("timestamp")).cast("string")
    odd = F.when(F.pmod(F.xxhash64("evidence_claim_id"), F.lit(2)) == 0, iso).otherwise(epoch)
    return rows.select("evidence_claim_id", F.unix_seconds(T.as_timestamp(odd)).alias("at_seconds"))


def f38_buckets(spark, sf):
    return table(spark, sf, "asset_entities").select("entity_id").distinct().select("entity_id", T.hash_bucket("entity_id", 97).alias("bucket"))


def t01_exact_copies(spark, sf):
    fp = documents.fingerprints(_docs(spark, sf), "doc_id", "text").where("n_words >= 8")
    return fp.groupBy("norm_sha").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first_doc")).where("n > 1").select("first_doc", "n")


def t02_clusters(spark, sf):
    out = documents.causal_clusters(_docs(spark, sf), "doc_id", "text", "asset_id", "available_at")
    return out.select(F.col("doc").alias("doc_id"), F.col("cluster").alias("cluster_id"), "reason")


def j27_near_copies(spark, sf):
    """Every document with the near copies counted that its source sent up to two years earlier."""
    docs = _docs(spark, sf)
    fp = documents.fingerprints(docs, "doc_id", "text").join(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("asset"), F.unix_micros(F.col("available_at").cast("timestamp")).alias("at")), "doc")
    near = documents.earlier_near_copies(stored(fp, "prints"), days=730)
    return near.groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_earlier"), F.round(F.max("score"), 6).alias("best"))


def t03_extents(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "asset_id", F.sha2(T.normalized("text"), 256).alias("sha"), F.col("available_at").cast("timestamp").alias("at"), "source")
    # a text without words is no copy of another
    return docs.where(F.col("sha").isNotNull() & (F.col("sha") != F.sha2(F.lit(""), 256))).groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.unix_micros(F.min("at")).alias("first_us"), F.unix_micros(F.max("at")).alias("last_us")).where("n > 1")


def t25_stories(spark, sf):
    docs = _docs(spark, sf).where("asset_id is not null and available_at is not null").select("doc_id", T.title_key("title").alias("k"), F.to_date("available_at").alias("day"), "asset_id").where("k <> ''")
    out = documents.stories(docs, "doc_id", "k", "day", "asset_id")
    return out.withColumn("day", F.col("day").cast("string"))


def t26_syndicated(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text", "source", F.trunc("available_at", "month").cast("string").alias("day"))
    return documents.syndicated(docs, "doc_id", "text", "source", "day", 40)


def _edges(spark, sf):
    rel = table(spark, sf, "relation_name_candidates")
    return rel.where(f"resolved_target_entity_id is not null and source_entity_id is not null and evidence_available_at <= timestamp_ntz '{AT}'").select(
        F.col("source_entity_id").alias("source"), F.col("resolved_target_entity_id").alias("target"), "relation_type").distinct()


def t12_relations_asof(spark, sf):
    """Edges read as assertions: the last mention known decides, one in ten of them takes the edge back."""
    rel = table(spark, sf, "relation_name_candidates").where("resolved_target_entity_id is not null").distinct()
    rel = rel.withColumn("relation_id", F.concat_ws("|", "source_entity_id", "resolved_target_entity_id", "relation_type"))
    observations = rel.select("relation_id", "evidence_available_at", F.col("evidence_char_start").alias("observation_sequence"), F.when(F.col("mention_count") >= 4, "retracted").otherwise("asserted").alias("action"))
    assertions = rel.groupBy("relation_id").agg(F.min("evidence_available_at").alias("valid_from")).withColumn("valid_to", F.col("valid_from") + F.expr("interval 1500 days"))
    return graph.relations_asof(assertions, observations, F.lit(AT).cast("timestamp_ntz")).select("relation_id")


def t14_one_hop(spark, sf):
    seeds = table(spark, sf, "evidence_claims").select("evidence_claim_id", F.col("registrant_entity_id").alias("entity")).where("entity is not null").distinct()
    out = graph.one_hop(seeds.select(F.col("entity").alias("seed"), "entity").distinct(), _edges(spark, sf), "seed", "entity")
    return out


def t15_aliases(spark, sf):
    rel = table(spark, sf, "relation_name_candidates").distinct()
    aliases = rel.where("resolution_status = 'resolved_exact' and matched_alias is not null and resolved_target_entity_id is not null").select("matched_alias", "resolved_target_entity_id").distinct()
    out = graph.resolve_alias(rel.select("relation_candidate_id", "target_name_normalized"), aliases, "target_name_normalized", "matched_alias", "resolved_target_entity_id")
    return out.select("relation_candidate_id", "status", "entity")


def t07_evidence_states(spark, sf):
    rows = table(spark, sf, "evidence_claims").distinct().where("registrant_entity_id is not null")
    out = graph.evidence_states(rows.withColumn("kind", F.when(F.col("edge_ready") == 1, "ready").otherwise("open")), "registrant_entity_id", "evidence_available_at", "kind", ("ready", "open"), "accession_number")
    return out.withColumn("at_us", F.unix_micros(F.col("evidence_available_at").cast("timestamp"))).drop("evidence_available_at")


def t08_latest_states(spark, sf):
    """Of each entity the last state known at a time, and how old it is then."""
    out = t07_evidence_states(spark, sf)
    cut = F.unix_micros(F.lit(AT).cast("timestamp"))
    best = F.max(F.struct("at_us", "n_evidence", "n_sources"))
    return out.where(F.col("at_us") <= cut).groupBy("registrant_entity_id").agg(best.alias("b")).select("registrant_entity_id", "b.n_evidence", "b.n_sources", (cut - F.col("b.at_us")).alias("age_us"))


def t18_identity_buckets(spark, sf):
    ev = table(spark, sf, "identity_conflict_evidence").distinct()
    name = graph.mode_of(ev, ["conflict_bucket_id"], "legal_name_raw").withColumnRenamed("mode", "name")
    counts = ev.groupBy("conflict_bucket_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("accession_number").alias("n_accessions"), F.count("dba_alias_raw").alias("n_dba"))
    return counts.join(name, "conflict_bucket_id", "left")


def t19_bucket_pairs(spark, sf):
    b = table(spark, sf, "identity_conflict_buckets").distinct()
    return graph.pairs_in_groups(b, "conflict_group_id", "conflict_bucket_id", "first_evidence_available_at", "last_evidence_available_at")


def t20_conflicts(spark, sf):
    b = table(spark, sf, "identity_conflict_buckets").distinct()
    return b.groupBy("conflict_group_id").agg(F.countDistinct("normalized_jurisdiction").alias("n_jurisdictions"), F.sum("evidence_occurrence_count").alias("n_evidence")).where("n_jurisdictions > 1")


QUERIES = {
    "F03_normalized": f03_normalized, "F04_urls": f04_urls, "F07_titles": f07_titles, "F10_content_ids": f10_content_ids, "F11_shingles": f11_shingles, "F19_cues": f19_cues,
    "F26_times": f26_times, "F38_buckets": f38_buckets, "T01_exact_copies": t01_exact_copies, "T02_clusters": t02_clusters, "J27_near_copies": j27_near_copies, "T03_extents": t03_extents,
    "T25_stories": t25_stories, "T26_syndicated": t26_syndicated, "T12_relations_asof": t12_relations_asof, "T14_one_hop": t14_one_hop, "T15_aliases": t15_aliases, "T07_evidence_states": t07_evidence_states,
    "T08_latest_states": t08_latest_states, "T18_identity_buckets": t18_identity_buckets, "T19_bucket_pairs": t19_bucket_pairs, "T20_conflicts": t20_conflicts,
}

_N = "trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', ' ', 'g'))"
_NT = _N.format(c="text")
_WORDS = f"w as (select doc_id, source, asset_id, available_at, {_N.format(c="coalesce(text, '')")} t, list_filter(string_split({_N.format(c="coalesce(text, '')")}, ' '), lambda x: x <> '') ws from documents)"
_SH = """sh as (select *, case when len(ws) = 0 then []::varchar[] else list_sort(list_distinct(list_transform(range(0, greatest(len(ws) - 5, 0) + 1), lambda i: substring(sha256(array_to_string(ws[i + 1:i + 5], ' ')), 1, 16)))) end s from w)"""
_EDGES = f"edges as (select distinct source_entity_id a, resolved_target_entity_id b, relation_type from relation_name_candidates where source_entity_id is not null and resolved_target_entity_id is not null and evidence_available_at <= timestamp '{AT}')"
_STATES = """rows_ as (select distinct * from evidence_claims where registrant_entity_id is not null and evidence_available_at is not null),
    m as (select *, (row_number() over (partition by registrant_entity_id, accession_number order by evidence_available_at) = 1 and accession_number is not null)::int fresh from rows_),
    p as (select registrant_entity_id, evidence_available_at, count(*) n, sum(fresh) new, count(*) filter (edge_ready = 1) r, count(*) filter (edge_ready <> 1 or edge_ready is null) o from m group by 1, 2),
    states as (select registrant_entity_id, sum(n) over k::bigint n_evidence, sum(new) over k::bigint n_sources, sum(r) over k::bigint n_ready, sum(o) over k::bigint n_open,
        epoch_us(evidence_available_at) - epoch_us(min(evidence_available_at) over k) age_us, row_number() over k state_number, epoch_us(evidence_available_at) at_us from p window k as (partition by registrant_entity_id order by evidence_available_at))"""

ORACLE = {
    "F03_normalized": f"select doc_id, sha256({_NT}) sha, length({_NT}) n from documents",
    "F04_urls": "select distinct source_url, lower(regexp_replace(trim(source_url), '#.*$', '')) plain, lower(regexp_extract(split_part(trim(source_url), '#', 1), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)', 1)) || regexp_replace(split_part(trim(source_url), '#', 1), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') canonical, regexp_extract(lower(source_url), '^https?://(?:www\\.)?([^/:?#]+)', 1) as domain from relation_name_candidates",
    "F07_titles": f"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), 'https?://\\S+', ' ', 'g'), '\\((?:reuters|ap|afp|bloomberg)\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) title_key, lower(source) source_key from documents",
    "F10_content_ids": "select distinct observation_id, 'obs_' || sha256(coalesce(source_id, '') || chr(31) || coalesce(symbol, '') || chr(31) || coalesce(observation_sequence::varchar, '')) content_id from global_reference_observations",
    "F11_shingles": f"with {_WORDS}, {_SH} select doc_id, len(ws) n_words, len(s) n_shingles, s[1] least from sh",
    "F19_cues": "select source, " + ", ".join(f"sum((length(lower(text)) - length(replace(lower(text), '{c}', ''))) // {len(c)})::bigint n_{c.replace(' ', '_')}" for c in ("the", "credit", "revenue", "agreed to")) + " from documents group by 1",
    "F26_times": "select distinct evidence_claim_id, epoch_us(evidence_available_at) // 1000000 at_seconds from evidence_claims",
    "F38_buckets": "select distinct entity_id, (('0x' || substring(sha256(entity_id::varchar), 1, 15))::hugeint % 97)::bigint bucket from asset_entities",
    "T01_exact_copies": f"with {_WORDS} select min(doc_id) first_doc, count(*) n from w where len(ws) >= 8 group by t having count(*) > 1",
    "T02_clusters": f"""with recursive {_WORDS}, {_SH}, b as (select doc_id, asset_id, t, s, ws, epoch_us(available_at) a from sh),
        e as (select doc_id, lag(doc_id) over k parent, a - lag(a) over k age from b where len(ws) >= 8 and asset_id is not null window k as (partition by asset_id, t order by a, doc_id)), ex as (select doc_id, parent from e where age <= 604800000000),
        n as (select x.doc_id, y.doc_id o, y.a, len(list_intersect(x.s, y.s)) i, len(x.s) + len(y.s) u from b x join b y on x.asset_id = y.asset_id and (y.a, y.doc_id) < (x.a, x.doc_id) and x.a - y.a <= 259200000000 and len(x.ws) >= 8 and len(y.ws) >= 8 and least(len(x.s), len(y.s)) >= 0.8 * greatest(len(x.s), len(y.s))),
        ne as (select doc_id, arg_max(o, (i / (u - i), -a, o)) parent from n where i / (u - i) >= 0.8 group by 1), p as (select doc_id, parent, 'exact' reason from ex union all select doc_id, parent, 'near' from ne where doc_id not in (select doc_id from ex)),
        r as (select doc_id, doc_id root from documents where doc_id not in (select doc_id from p) union all select p.doc_id, r.root from p join r on p.parent = r.doc_id)
        select r.doc_id, root cluster_id, coalesce(reason, 'anchor') reason from r left join p on p.doc_id = r.doc_id""",
    "J27_near_copies": f"""with {_WORDS}, {_SH}, p as (select x.doc_id, len(list_intersect(x.s, y.s)) i, len(x.s) a, len(y.s) b from sh x join sh y on x.source = y.source and (y.available_at, y.doc_id) < (x.available_at, x.doc_id) and x.available_at - y.available_at <= interval 730 days
        and len(x.s) > 0 and len(y.s) > 0 and least(len(x.s), len(y.s)) >= 0.8 * greatest(len(x.s), len(y.s)))
        select doc_id, count(*) n_earlier, round(max(i / (a + b - i)), 6) best from p where i / (a + b - i) >= 0.8 group by 1""",
    "T03_extents": f"with d as (select sha256({_NT}) sha, source, available_at from documents where text is not null and {_NT} <> '') select sha, count(*) n, count(distinct source) n_sources, epoch_us(min(available_at)) first_us, epoch_us(max(available_at)) last_us from d group by 1 having count(*) > 1",
    "T12_relations_asof": f"""with r as (select distinct *, concat_ws('|', source_entity_id, resolved_target_entity_id, relation_type) rid, case when mention_count >= 4 then 'retracted' else 'asserted' end act from relation_name_candidates where resolved_target_entity_id is not null),
        v as (select rid, min(evidence_available_at) f from r group by 1), l as (select rid, arg_max(act, (evidence_available_at, evidence_char_start, act)) act from r where evidence_available_at <= timestamp '{AT}' group by 1)
        select v.rid relation_id from v join l using (rid) where act <> 'retracted' and f <= timestamp '{AT}' and timestamp '{AT}' < f + interval 1500 days""",
    "T14_one_hop": f"""with {_EDGES}, s as (select distinct registrant_entity_id e from evidence_claims where registrant_entity_id is not null), b as (select a, b, relation_type, 'outgoing' o from edges where a <> b union select b, a, relation_type, 'incoming' from edges where a <> b)
        select e seed, e entity, 0::bigint hops, null::varchar relation_type, 'self' orientation from s union all select distinct e, b.b, 1, relation_type, o from s join b on b.a = s.e""",
    "T15_aliases": """with a as (select matched_alias k, count(distinct resolved_target_entity_id) n, min(resolved_target_entity_id) e from relation_name_candidates where resolution_status = 'resolved_exact' and matched_alias is not null and resolved_target_entity_id is not null group by 1),
        r as (select distinct relation_candidate_id, target_name_normalized from relation_name_candidates)
        select relation_candidate_id, case when n is null then 'unresolved' when n > 1 then 'ambiguous' else 'resolved' end status, case when n = 1 then e end entity from r left join a on target_name_normalized = k""",
    "T07_evidence_states": f"with {_STATES} select * from states",
    "T08_latest_states": f"with {_STATES} select registrant_entity_id, arg_max(n_evidence, at_us) n_evidence, arg_max(n_sources, at_us) n_sources, epoch_us(timestamp '{AT}') - max(at_us) age_us from states where at_us <= epoch_us(timestamp '{AT}') group by 1",
    "T18_identity_buckets": """with e as (select distinct * from identity_conflict_evidence), n as (select conflict_bucket_id, legal_name_raw v, count(*) c from e where legal_name_raw is not null group by 1, 2),
        m as (select conflict_bucket_id, v as name, c mode_count from n qualify row_number() over (partition by conflict_bucket_id order by c desc, lower(v), v) = 1)
        select conflict_bucket_id, count(*) n, count(distinct accession_number) n_accessions, count(dba_alias_raw) n_dba, any_value(m.name) as name, any_value(mode_count) mode_count from e left join m using (conflict_bucket_id) group by 1""",
    "T19_bucket_pairs": """with b as (select distinct * from identity_conflict_buckets) select x.conflict_group_id, x.conflict_bucket_id left_item, y.conflict_bucket_id right_item,
        case when x.first_evidence_available_at is null or x.last_evidence_available_at is null or y.first_evidence_available_at is null or y.last_evidence_available_at is null then 'unknown'
        when x.first_evidence_available_at <= y.last_evidence_available_at and y.first_evidence_available_at <= x.last_evidence_available_at then 'overlapping' else 'sequential' end pattern
        from b x join b y on x.conflict_group_id = y.conflict_group_id and x.conflict_bucket_id < y.conflict_bucket_id""",
    "T20_conflicts": "with b as (select distinct * from identity_conflict_buckets) select conflict_group_id, count(distinct normalized_jurisdiction) n_jurisdictions, sum(evidence_occurrence_count)::bigint n_evidence from b group by 1 having count(distinct normalized_jurisdiction) > 1",
    "T25_stories": """with d as (select doc_id, asset_id, available_at::date as day, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), 'https?://\\S+', ' ', 'g'), '\\((?:reuters|ap|afp|bloomberg)\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) k from documents where asset_id is not null and available_at is not null)
        select k story, strftime(d.day, '%Y-%m-%d') as day, asset_id asset, count(distinct doc_id) n_docs, min(doc_id) first_doc from d where k <> '' group by k, d.day, asset_id""",
    "T26_syndicated": f"""with d as (select doc_id, source, strftime(date_trunc('month', available_at), '%Y-%m-%d') as day, {_NT} t from documents), g as (select d.day, substring(t, 1, 40) k, count(distinct source) n_sources, count(distinct doc_id) n_docs, min(doc_id) first_doc from d where length(t) >= 40 group by 1, 2)
        select g.day, n_sources, n_docs, first_doc from g where n_sources > 1""",
}
