"""Append-only tables: new rows by content id, keep-latest upserts, sealed batches, scoped replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clocks import latest_revision


def new_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose content id is not there yet, each once; equal ids are equal content by definition."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Existing and incoming rows, of each key the first in ``order``; incoming ones win ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_revision(both, keys, [*order, F.col("_new").desc()]).drop("_new")


def replace_scope(existing: DataFrame, regenerated: DataFrame, scope: Column) -> DataFrame:
    """Existing rows outside the scope, with the regenerated ones in it (rows where the scope is null stay)."""
    return existing.where(~F.coalesce(scope, F.lit(False))).unionByName(regenerated)


def seal(sealed: DataFrame, batch: DataFrame, key: str, payload: str) -> DataFrame:
    """Each key of a batch as ``new``, ``already_sealed`` (equal payload) or ``conflict``."""
    old = sealed.select(F.col(key).alias("_k"), F.col(payload).alias("_p"))
    joined = batch.select(key, payload).join(old, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col("_k").isNull(), "new").when(F.col("_p").eqNullSafe(F.col(payload)), "already_sealed").otherwise("conflict")
    return joined.select(key, payload, status.alias("status"))


def append_sealed(sealed: DataFrame, batch: DataFrame, key: str, payload: str) -> DataFrame:
    """The sealed table with the batch's new keys; raises, and appends nothing, if a key is there with another payload."""
    checked = seal(sealed, batch, key, payload)
    if not checked.where("status = 'conflict'").isEmpty():
        raise ValueError(f"a {key} is sealed with another {payload}")
    return sealed.select(key, payload).unionByName(checked.where("status = 'new'").select(key, payload).distinct())


def replace_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Existing rows with those of incoming keys replaced, whatever they held; of several incoming ones of a key the first in ``order``."""
    fresh = latest_revision(incoming, keys, order)
    return existing.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh.select(*existing.columns))


def link_outcomes(links: DataFrame, predictions: DataFrame, outcomes: DataFrame, key: str, role: str, payload: str) -> DataFrame:
    """``key, role, payload, status`` of each prediction with an outcome: ``new``, ``already_linked``, or ``conflict`` with what is linked.

    One outcome serves every role of its key.
    """
    due = predictions.select(key, role).distinct().join(outcomes.select(key, payload), key)
    old = links.select(F.col(key).alias("_k"), F.col(role).alias("_r"), F.col(payload).alias("_p"))
    joined = due.join(old, (F.col(key) == F.col("_k")) & (F.col(role) == F.col("_r")), "left")
    status = F.when(F.col("_k").isNull(), "new").when(F.col("_p").eqNullSafe(F.col(payload)), "already_linked").otherwise("conflict")
    return joined.select(key, role, payload, status.alias("status"))


def mapped_import(legacy: DataFrame, mapping: DataFrame, legacy_key: str, existing: DataFrame, ident: str) -> DataFrame:
    """Legacy rows under their new keys: rows whose legacy key is not mapped, or mapped to several, are left out, ids that are there are not brought again."""
    one = mapping.where(F.col(legacy_key).isNotNull()).groupBy(legacy_key).agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("_n")).where("_n = 1").drop("_n")
    return new_rows(existing, legacy.join(one, legacy_key), ident)


def backfill_gate(required: DataFrame, having: DataFrame, key: str, name: str) -> DataFrame:
    """``gate, n_required, n_lacking, status``: whether every required key has a row; a backfill is published only on ``complete``."""
    need = required.select(key).where(F.col(key).isNotNull()).distinct()
    lacking = need.join(having.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_lacking"))
    out = need.agg(F.count(F.lit(1)).alias("n_required")).join(F.broadcast(lacking))  # one row each
    return out.select(F.lit(name).alias("gate"), "n_required", "n_lacking", F.when(F.col("n_lacking") == 0, "complete").otherwise("incomplete").alias("status"))
