"""Filling containers of a fixed capacity: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class TournamentTree:
    """Free room of bins 0, 1, 2, ...; each inner node holds the most room below it."""

    def __init__(self, capacity: int, bins: int):
        self.width = 1
        while self.width < max(1, bins):
            self.width *= 2
        self.room = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, whose room then shrinks."""
        room, at = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.width
        room[at] -= size
        at //= 2
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            room[at] = left if left > right else right
            at //= 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, in the order of ``sizes``; every size must fit into a bin."""
    tree, out = TournamentTree(capacity, len(sizes)), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = tree.place(sizes[i])
    return out


def pack(items: DataFrame, item_id: str, size: str, capacity: int, group_items: int = 8192, seed: int = 0) -> DataFrame:
    """``item_id, piece, piece_start, piece_size, container``: every item in containers of ``capacity``.

    Items longer than the capacity are cut into full pieces and a rest; full
    pieces get containers of their own (negative numbers) and need no packing.
    Other items stay whole.  Items of size zero take no room and are put like the
    others; null sizes count as zero; repeated ids are items of their own.

    The rest are spread by a seeded hash over groups of about ``group_items`` items
    and packed group by group, so a group is bounded whatever the input holds and
    wastes at most one half-empty container.  The number of groups follows from
    the number of items, counted in the same query.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = items.select(F.col(item_id).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    full = F.floor(F.col("size") / capacity)
    # each row's rest, and one piece for each whole capacity
    last = F.when((F.col("size") % capacity == 0) & (F.col("size") > 0), full - 1).otherwise(full)
    pieces = rows.select("item", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), last))).select(
        "item", F.col("pos").alias("piece"), (F.col("col") * capacity).alias("piece_start"),
        F.least(F.lit(capacity), F.col("size") - F.col("col") * capacity).cast("long").alias("piece_size"),
    )
    count = rows.agg(F.count(F.lit(1))).scalar()
    groups = F.greatest(F.lit(1), F.ceil(count / group_items))
    salt = F.xxhash64(F.lit(seed), "item", "piece")
    kind = dict(pieces.dtypes)["item"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # equal sizes are put in the order of ids, so the result does not depend on the order of rows
        pdf = pdf.sort_values(["item", "piece"], kind="stable")
        bins = first_fit_decreasing(pdf["piece_size"].tolist(), capacity)
        pdf["container"] = pdf["grp"].to_numpy() * (1 << 20) + bins
        return pdf[["item", "piece", "piece_start", "piece_size", "container"]]

    small = pieces.where(F.col("piece_size") < capacity).withColumn("grp", F.pmod(salt, groups))
    packed = small.groupBy("grp").applyInPandas(run, f"item {kind}, piece int, piece_start long, piece_size long, container long")
    # full pieces are numbered by group and place in it, so their numbers follow from item and piece alone
    alone = pieces.where(F.col("piece_size") >= capacity).withColumn("grp", F.pmod(salt, groups))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("item", "piece"))
    alone = alone.withColumn("container", -1 - (F.col("grp") * F.lit(1 << 32) + place)).drop("grp")
    return packed.unionByName(alone).withColumnRenamed("item", item_id)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers used, tokens held, the share filled, and the least number of containers possible."""
    per = packed.groupBy("container").agg(F.sum("piece_size").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill_share"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
    )
