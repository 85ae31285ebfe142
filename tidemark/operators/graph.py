"""Entities and relations in time: edges as of a date, one hop, aliases, evidence counts, identity buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relations_asof(assertions: DataFrame, observations: DataFrame, at: Column) -> DataFrame:
    """Assertions whose latest observation known at ``at`` does not retract them and whose validity holds ``at``."""
    known = observations.where(F.col("evidence_available_at") <= at)
    last = known.groupBy("relation_id").agg(F.max(F.struct("evidence_available_at", "observation_sequence", "action"))["action"].alias("action"))
    alive = last.where("action <> 'retracted'").select("relation_id")
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    return assertions.where(valid).join(alive, "relation_id", "left_semi")


def one_hop(seeds: DataFrame, edges: DataFrame, seed: str, entity: str) -> DataFrame:
    """``seed, entity, hops, relation_type, orientation``: the seed's own entity and its neighbours, edges read both ways.

    ``edges`` has ``source, target, relation_type``.  Each neighbour comes once a
    relation type and orientation, never as its own neighbour.
    """
    both = edges.select(F.col("source").alias("_a"), F.col("target").alias("_b"), "relation_type", F.lit("outgoing").alias("orientation")).unionByName(
        edges.select(F.col("target").alias("_a"), F.col("source").alias("_b"), "relation_type", F.lit("incoming").alias("orientation"))
    ).where("_a <> _b").distinct()
    own = seeds.select(F.col(seed), F.col(entity), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("string").alias("relation_type"), F.lit("self").alias("orientation")).distinct()
    near = seeds.select(seed, F.col(entity).alias("_a")).distinct().join(both, "_a").select(seed, F.col("_b").alias(entity), F.lit(1).cast("long").alias("hops"), "relation_type", "orientation")
    return own.unionByName(near.distinct())


def resolve_alias(mentions: DataFrame, aliases: DataFrame, mention: str, alias: str, entity: str) -> DataFrame:
    """Mentions with the one entity that bears the alias; ``ambiguous`` where several do, ``unresolved`` where none."""
    per = aliases.where(F.col(alias).isNotNull()).groupBy(F.col(alias).alias("_k")).agg(F.countDistinct(entity).alias("_n"), F.min(entity).alias("_e"))
    status = F.when(F.col("_n").isNull(), "unresolved").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    joined = mentions.join(per, F.col(mention) == F.col("_k"), "left")
    return joined.withColumn("status", status).withColumn("entity", F.when(F.col("_n") == 1, F.col("_e"))).drop("_k", "_n", "_e")


def evidence_states(rows: DataFrame, subject: str, at: str, kind: str, kinds: Sequence[str], source: str) -> DataFrame:
    """After every arrival for a subject: evidence so far by kind, sources so far, age of the first and the last.

    Arrivals at the same time make one state that holds them all.  A source counts
    when it first appears, so running sums are enough and no set grows along.
    """
    first = F.row_number().over(Window.partitionBy(subject, source).orderBy(at))
    marked = rows.where(F.col(at).isNotNull()).withColumn("_new", ((first == 1) & F.col(source).isNotNull()).cast("long"))
    per = marked.groupBy(subject, at).agg(F.count(F.lit(1)).alias("n"), F.sum("_new").alias("new"), *[F.count_if(F.col(kind) == k).alias(f"k_{k}") for k in kinds])
    upto = Window.partitionBy(subject).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.min(at).over(upto)
    return per.select(
        subject, at, F.sum("n").over(upto).alias("n_evidence"), F.sum("new").over(upto).alias("n_sources"), *[F.sum(f"k_{k}").over(upto).alias(f"n_{k}") for k in kinds],
        (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(begun.cast("timestamp"))).alias("age_us"), F.row_number().over(Window.partitionBy(subject).orderBy(at)).cast("long").alias("state_number"),
    )


def mode_of(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equals the one first in lower case, then as written."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("a"), F.lower(value).alias("b"), F.col(value).alias("v"), "n"))
    return per.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.v").alias("mode"), F.col("_b.n").alias("mode_count"))


def pairs_in_groups(df: DataFrame, group: str, item: str, lo: str, hi: str) -> DataFrame:
    """Unordered pairs of a group's items, and whether their spans overlap; for groups that are small by definition."""
    a, b = df.alias("a"), df.alias("b")
    met = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
    known = F.col(f"a.{lo}").isNotNull() & F.col(f"b.{lo}").isNotNull() & F.col(f"a.{hi}").isNotNull() & F.col(f"b.{hi}").isNotNull()
    overlap = (F.col(f"a.{lo}") <= F.col(f"b.{hi}")) & (F.col(f"b.{lo}") <= F.col(f"a.{hi}"))
    pattern = F.when(~known, "unknown").when(overlap, "overlapping").otherwise("sequential")
    return met.select(F.col(f"a.{group}").alias(group), F.col(f"a.{item}").alias("left_item"), F.col(f"b.{item}").alias("right_item"), pattern.alias("pattern"))


def unique_lineage(rows: DataFrame, raw: str, filing: str) -> DataFrame:
    """``raw, filing, status`` of every raw document: the one filing it belongs to, or ``ambiguous`` or ``unknown`` and none."""
    per = rows.where(F.col(raw).isNotNull()).groupBy(raw).agg(F.min(filing).alias("_f"), F.countDistinct(filing).alias("_n"))
    status = F.when(F.col("_n") == 1, "unique").when(F.col("_n") > 1, "ambiguous").otherwise("unknown")
    return per.select(raw, F.when(F.col("_n") == 1, F.col("_f")).alias(filing), status.alias("status"))


def event_versions(evidence: DataFrame, subject: Sequence[str], at: str, item: str) -> DataFrame:
    """``event_id, version_id, version, first_at, n_items`` of every state an event's evidence went through.

    The event is its subject, a version the set of items known at an arrival;
    arrivals that add nothing make no version.  Items are counted when they first
    appear, and the version is a hash that does not depend on their order.
    """
    event = F.concat(F.lit("event_"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in subject]), 256))
    rows = evidence.where(F.col(at).isNotNull() & F.col(item).isNotNull()).select(event.alias("event_id"), F.col(at).alias("at"), F.col(item).alias("item"))
    first = rows.groupBy("event_id", "item").agg(F.min("at").alias("at"))
    step = first.groupBy("event_id", "at").agg(F.count(F.lit(1)).alias("new"), F.sum(F.conv(F.substring(F.md5("item"), 1, 8), 16, 10).cast("long")).alias("h"))
    order = Window.partitionBy("event_id").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    total = step.select("event_id", F.col("at").alias("first_at"), F.row_number().over(order).cast("long").alias("version"), F.sum("new").over(upto).alias("n_items"), F.sum("h").over(upto).alias("_h"))
    return total.select("event_id", F.sha2(F.concat_ws("|", "event_id", F.col("_h").cast("string")), 256).alias("version_id"), "version", "first_at", "n_items")
