"""Documents: fingerprints, near copies, causal clusters, stories and syndication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalized, shingles, words
from tidemark.session import micros, stored

DAY = 86_400_000_000


def fingerprints(docs: DataFrame, doc_id: str, text: str, k: int = 5) -> DataFrame:
    """``doc, norm_sha, n_words, shingles``; whole texts, null texts as empty ones."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc"), F.sha2(normalized(body), 256).alias("norm_sha"), words(body).alias("_w")).select(
        "doc", "norm_sha", F.size("_w").alias("n_words"), shingles("_w", k).alias("shingles")
    )


def earlier_near_copies(prints: DataFrame, least: float = 0.8, days: int = 3) -> DataFrame:
    """``doc, other, score``: pairs of one ``asset`` in which ``other`` came at most ``days`` earlier and shares ``least`` of the shingles.

    ``prints`` has ``doc, asset, at`` (micros) and ``shingles``.  Exact: of two sets
    of that similarity, the first ``n - ceil(least * n) + 1`` elements in any fixed
    order have one in common, so only these are joined, together with the asset and
    the place in time; the similarity is then computed from the whole sets.  The
    order is from the rarest shingle on, so what all texts of an asset share is
    hardly ever looked up.
    """
    n = F.size("shingles")
    span = days * DAY
    whole = prints.where((n > 0) & F.col("asset").isNotNull() & F.col("at").isNotNull())
    said = whole.select("doc", "asset", F.explode("shingles").alias("key"))
    common = said.groupBy("asset", "key").agg(F.count(F.lit(1)).alias("df"))
    # a shingle of one document of its asset meets nothing and needs no lookup, but keeps its place in the order
    ordered = F.array_sort(F.collect_list(F.struct("df", "key")))
    heads = said.join(common, ["asset", "key"]).groupBy("doc", "asset").agg(ordered.alias("o"))
    head = F.slice("o", 1, F.greatest(F.lit(1), F.size("o") - F.ceil(F.size("o") * least).cast("int") + 1))
    heads = heads.select("doc", F.size("o").alias("n"), F.filter(head, lambda x: x["df"] > 1).alias("h")).select("doc", "n", F.explode("h.key").alias("key"))
    keyed = whole.select("doc", "asset", "at").join(heads, "doc")
    keyed = keyed.withColumn("slot", F.floor(F.col("at") / span))
    late = keyed.select("doc", "asset", "at", "n", "key", F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"))
    cond = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("asset", "key", "slot")]
    before = (F.struct("y.at", "y.doc") < F.struct("x.at", "x.doc")) & (F.col("x.at") - F.col("y.at") <= span)
    sized = (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least)
    met = late.alias("x").join(keyed.alias("y"), cond[0] & cond[1] & cond[2] & before & sized).select(F.col("x.doc").alias("doc"), F.col("y.doc").alias("other")).distinct()
    sets = prints.select("doc", "shingles")
    both = met.join(sets, "doc").withColumnRenamed("shingles", "a").join(sets.withColumnRenamed("doc", "other"), "other")
    shared = F.size(F.array_intersect("a", "shingles"))
    score = shared / (F.size("a") + F.size("shingles") - shared)
    return both.select("doc", "other", score.alias("score")).where(F.col("score") >= least)


def causal_parents(prints: DataFrame, least: float = 0.8, copy_days: int = 7, near_days: int = 3, least_words: int = 8) -> DataFrame:
    """``doc, parent, reason, score``: for each document the earlier one it repeats, if any.

    Where ``prints`` has ``accession``, the first document of the same accession
    comes before all others, whenever it came.  Then the latest exact copy of the asset within ``copy_days`` (for texts of
    ``least_words``), else the nearest copy within ``near_days``, the earliest of
    equals.  Only what came earlier is looked at, so later documents change nothing.
    """
    order = Window.partitionBy("asset", "norm_sha").orderBy("at", "doc")
    copies = prints.where((F.col("n_words") >= least_words) & F.col("asset").isNotNull()).select(
        "doc", F.lag("doc").over(order).alias("parent"), (F.col("at") - F.lag("at").over(order)).alias("age")
    ).where((F.col("parent").isNotNull()) & (F.col("age") <= copy_days * DAY)).select("doc", "parent", F.lit("exact").alias("reason"), F.lit(1.0).alias("score"))
    near = earlier_near_copies(prints.where(F.col("n_words") >= least_words), least, near_days)
    at = prints.select(F.col("doc").alias("other"), "at")
    best = F.max(F.struct("score", (-F.col("at")).alias("a"), F.col("other").alias("o")))
    near = near.join(at, "other").groupBy("doc").agg(best.alias("b")).select("doc", F.col("b.o").alias("parent"), F.lit("near").alias("reason"), F.col("b.score").alias("score"))
    out = copies.unionByName(near.join(copies.select("doc"), "doc", "left_anti"))
    if "accession" not in prints.columns:
        return out
    filed = prints.where(F.col("accession").isNotNull())
    first = filed.groupBy("accession").agg(F.min(F.struct("at", "doc"))["doc"].alias("parent"))
    same = filed.join(first, "accession").where("doc <> parent").select("doc", "parent", F.lit("accession").alias("reason"), F.lit(1.0).alias("score"))
    return same.unionByName(out.join(same.select("doc"), "doc", "left_anti"))


def roots(docs: DataFrame, parents: DataFrame) -> DataFrame:
    """``doc, root``: the end of each document's chain of parents, by doubling steps; chains lead backwards, so they end."""
    now = stored(docs.select("doc").join(parents.select("doc", "parent"), "doc", "left").select("doc", F.coalesce("parent", "doc").alias("root")), "roots")
    while True:
        step = now.alias("x").join(now.select(F.col("doc").alias("root"), F.col("root").alias("next")).alias("y"), "root")
        then = stored(step.select("doc", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = then.select("doc", "root")
        if then.where("moved").isEmpty():
            return now


def causal_clusters(docs: DataFrame, doc_id: str, text: str, asset: str, at: str, accession: str | None = None) -> DataFrame:
    """``doc, cluster, reason``: documents by the first one they go back to; ``reason`` is ``anchor``, ``accession``, ``exact`` or ``near``."""
    more = [F.col(accession).alias("accession")] if accession else []
    meta = docs.select(F.col(doc_id).alias("doc"), F.col(asset).alias("asset"), micros(at).alias("at"), *more)
    prints = stored(fingerprints(docs, doc_id, text).join(meta, "doc"), "prints")
    parents = stored(causal_parents(prints), "parents")
    return roots(prints, parents).join(parents.select("doc", "reason"), "doc", "left").select("doc", F.col("root").alias("cluster"), F.coalesce("reason", F.lit("anchor")).alias("reason"))


def stories(docs: DataFrame, doc_id: str, title_key: str, day: str, asset: str) -> DataFrame:
    """Documents of one title as stories, and stories with a day and an asset as episodes of at least two documents or sources."""
    return docs.groupBy(F.col(title_key).alias("story"), F.col(day).alias("day"), F.col(asset).alias("asset")).agg(
        F.countDistinct(doc_id).alias("n_docs"), F.min(doc_id).alias("first_doc")
    )


def syndicated(docs: DataFrame, doc_id: str, text: str, source: str, day: str, prefix: int = 120) -> DataFrame:
    """Days on which several sources carry texts of equal beginning, with the number of both.

    The beginning is what the report is about; documents are compared by it only.
    """
    key = F.xxhash64(F.substring(normalized(F.col(text)), 1, prefix))
    return docs.where(F.length(normalized(F.col(text))) >= prefix).groupBy(day, key.alias("_k")).agg(
        F.countDistinct(source).alias("n_sources"), F.countDistinct(doc_id).alias("n_docs"), F.min(doc_id).alias("first_doc")
    ).where("n_sources > 1").drop("_k")
