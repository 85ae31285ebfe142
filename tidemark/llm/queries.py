"""Queries p4 and p6 to p10, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.abuse import THRESHOLD, score_documents, source_rates
from tidemark.llm.bpe import encode_corpus, token_counts
from tidemark.llm.canonical import map_to_reference
from tidemark.llm.names import link_names, linked_pairs
from tidemark.llm.packing import fill_report, pack
from tidemark.llm.survivor import STAND_INS, best_values, consensus_values
from tidemark.session import micros, stored, table

CAPACITY = 2048  # tokens a container


def _open_groups(spark: SparkSession, sf: str) -> DataFrame:
    status = F.trim(F.regexp_replace(F.lower("decision_status"), r"[^a-z]+", " "))
    groups = table(spark, sf, "identity_conflict_groups")
    return groups.where(F.coalesce(status, F.lit("")) != "confirmed distinct").select("conflict_group_id").distinct()


def _surviving(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The surviving name and jurisdiction of every group by rank, as the groups' rules want; votes could not change it."""
    buckets = table(spark, sf, "identity_conflict_buckets").join(_open_groups(spark, sf), "conflict_group_id", "left_semi")
    count, last = F.col("evidence_occurrence_count"), micros("last_evidence_available_at")
    key = ("conflict_group_id", "conflict_bucket_id")
    names = best_values(buckets, *key, "display_legal_name", (count, last))
    places = best_values(buckets, *key, "display_jurisdiction", (last, count))
    return names, places


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    names, places = _surviving(spark, sf)
    names = names.select("conflict_group_id", F.col("conflict_bucket_id").alias("name_bucket_id"))
    places = places.select("conflict_group_id", F.col("conflict_bucket_id").alias("jurisdiction_bucket_id"))
    return names.join(places, "conflict_group_id", "full")


def p4_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving record of every open group: name and jurisdiction with the buckets they come from."""
    names, places = _surviving(spark, sf)
    names = names.withColumnRenamed("conflict_bucket_id", "name_bucket_id")
    places = places.withColumnRenamed("conflict_bucket_id", "jurisdiction_bucket_id")
    return names.join(places, "conflict_group_id", "full")


def p4_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """The name closest to what most evidence says: votes are summed evidence counts."""
    buckets = table(spark, sf, "identity_conflict_buckets").join(_open_groups(spark, sf), "conflict_group_id", "left_semi")
    count, last = F.col("evidence_occurrence_count"), micros("last_evidence_available_at")
    return consensus_values(buckets, "conflict_group_id", "conflict_bucket_id", "display_legal_name", (count, last), weight=count)


def p4_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How often the consensus, and the best ranked name, say what the group is called in identity_conflict_groups, letters and digits alone compared."""
    names, _ = _surviving(spark, sf)
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    called = table(spark, sf, "identity_conflict_groups").select("conflict_group_id", key("normalized_legal_name").alias("called")).distinct()
    voted = p4_consensus(spark, sf).select("conflict_group_id", key("display_legal_name").alias("voted"), F.col("conflict_bucket_id").alias("voted_id"))
    ranked = names.select("conflict_group_id", key("display_legal_name").alias("ranked"), F.col("conflict_bucket_id").alias("ranked_id"))
    both = called.join(voted, "conflict_group_id").join(ranked, "conflict_group_id")
    return both.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("voted_id") == F.col("ranked_id")).alias("n_same_bucket"),
        F.count_if(F.col("voted") == F.col("called")).alias("n_voted_right"), F.count_if(F.col("ranked") == F.col("called")).alias("n_ranked_right"),
    )


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    mentions = table(spark, sf, "relation_name_candidates").select(F.col("relation_candidate_id").alias("id"), F.col("target_name_raw").alias("raw"))
    evidence = table(spark, sf, "identity_conflict_evidence")
    grouped = evidence.select(F.col("conflict_group_id").alias("id"), F.explode(F.array("legal_name_raw", "dba_alias_raw")).alias("raw"))
    return link_names(mentions, grouped)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return linked_pairs(_linked(spark, sf))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate with the class of what it names, and how many other candidates are linked with it."""
    linked = _linked(spark, sf).where("not is_group")
    sizes = linked.groupBy("entity").agg(F.min("id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    return linked.join(sizes, "entity").select(F.col("id").alias("relation_candidate_id"), "class_id", "n_links")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    evidence, buckets = table(spark, sf, "identity_conflict_evidence"), table(spark, sf, "identity_conflict_buckets")
    typed = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("jurisdiction_raw", "location_raw")]))
    values = evidence.select(F.col("conflict_evidence_id").alias("record_id"), typed.alias("t")).select("record_id", "t.*").unionByName(
        buckets.select(F.col("conflict_bucket_id").alias("record_id"), F.lit("normalized_jurisdiction").alias("field_name"), F.col("normalized_jurisdiction").alias("value"))
    )
    return values.where(r"value is not null and value rlike '[^\\s\\u00a0\\u200b]' and value <> '__missing__'").distinct()


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    values = _places(spark, sf)
    reference = table(spark, sf, "jurisdiction_reference")
    return map_to_reference(values, reference, "jurisdiction_code", ("jurisdiction_name", "local_name"), "record_id", "field_name", "value")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("record_id", "field_name", F.col("code").alias("jurisdiction_code"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Cases, matches and misses per field, and how far the matches lie from what was typed."""
    missed: Column = F.col("code") == "UNMATCHED"
    return _mapped(spark, sf).groupBy("field_name").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(missed).alias("n_unmatched"),
        F.count_if(F.col("distance") == 0).alias("n_exact"), F.countDistinct(F.when(missed, F.col("value"))).alias("n_unmatched_values"),
    )


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p8_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens per source and language."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "source", "lang").join(token_counts(docs), "doc_id").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest")
    )


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, whole or in pieces, with its container of CAPACITY tokens."""
    sizes = stored(token_counts(table(spark, sf, "documents")), "sizes")  # read three times below, counted once
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p9_containers(spark, sf), CAPACITY)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(table(spark, sf, "documents")).where(F.col("peak") >= THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(table(spark, sf, "documents"))


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return source_rates(score_documents(table(spark, sf, "documents"), "doc_id", "text", "source"))


QUERIES = {
    "p4_found": p4_found, "p4_survivors": p4_survivors, "p4_consensus": p4_consensus, "p4_agreement": p4_agreement, "p6_found": p6_found, "p6_classes": p6_classes,
    "p7_found": p7_found, "p7_report": p7_report, "p8_ids": p8_ids, "p8_totals": p8_totals,
    "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
}

_NO_VALUE = ", ".join("'" + s + "'" for s in sorted(STAND_INS))


def _survivors_sql(columns: str) -> str:
    def best(field: str, order: str) -> str:
        return f"""select conflict_group_id, conflict_bucket_id, {field} from open_buckets
            where regexp_matches({field}, '[\\p{{L}}\\p{{N}}]') and lower(trim(regexp_replace({field}, '[\\s\\x{{200b}}]+', ' ', 'g'))) not in ({_NO_VALUE})
            qualify row_number() over (partition by conflict_group_id order by {order}) = 1"""

    return f"""with open_groups as (select distinct conflict_group_id from identity_conflict_groups
            where coalesce(trim(regexp_replace(lower(decision_status), '[^a-z]+', ' ', 'g')), '') <> 'confirmed distinct'),
        open_buckets as (select * from identity_conflict_buckets semi join open_groups using (conflict_group_id)),
        n as ({best('display_legal_name', 'evidence_occurrence_count desc nulls last, last_evidence_available_at desc nulls last, conflict_bucket_id')}),
        j as ({best('display_jurisdiction', 'last_evidence_available_at desc nulls last, evidence_occurrence_count desc nulls last, conflict_bucket_id')})
        select coalesce(n.conflict_group_id, j.conflict_group_id) conflict_group_id, n.conflict_bucket_id name_bucket_id,
            j.conflict_bucket_id jurisdiction_bucket_id{columns} from n full join j on n.conflict_group_id = j.conflict_group_id"""


ORACLE = {"p4_found": _survivors_sql(""), "p4_survivors": _survivors_sql(", display_legal_name, display_jurisdiction")}
