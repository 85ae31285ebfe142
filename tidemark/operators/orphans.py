"""References to keys that are not registered at their time, by bitmaps of keys per range and period."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored

BITS = 15  # a bitmap covers 2**15 keys, the size of Spark's bitmap aggregates


def period_of(col: Column | str) -> Column:
    """Number of the calendar month since 1970-01."""
    col = F.col(col) if isinstance(col, str) else col
    return ((F.year(col) - 1970) * 12 + F.month(col) - 1).cast("int")


def period_start(period: Column) -> Column:
    return F.add_months(F.lit("1970-01-01").cast("date"), period)


ARRAY, RUNS, BITMAP = 0, 1, 2  # kinds of containers, named by the first byte


def packed(positions: np.ndarray) -> bytes:
    """A set of sorted positions below 2**16 as the smallest of three containers: the positions, runs of them, or a bitmap."""
    breaks = np.flatnonzero(np.diff(positions.astype(np.int64)) != 1)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(positions) - 1]))
    if not len(positions):
        return bytes([ARRAY])
    size = {ARRAY: 2 * len(positions), RUNS: 4 * len(starts), BITMAP: 1 << (BITS - 3)}
    kind = min(size, key=size.get)
    if kind == ARRAY:
        return bytes([ARRAY]) + positions.astype("<u2").tobytes()
    if kind == RUNS:
        return bytes([RUNS]) + np.stack([positions[starts], positions[ends]], 1).astype("<u2").tobytes()
    bits = np.zeros(1 << BITS, np.uint8)
    bits[positions] = 1
    return bytes([BITMAP]) + np.packbits(bits, bitorder="little").tobytes()


def unpacked(container: bytes) -> np.ndarray:
    """The sorted positions of a container."""
    kind, body = container[0], container[1:]
    if kind == ARRAY:
        return np.frombuffer(body, "<u2").astype(np.int32)
    if kind == RUNS:
        runs = np.frombuffer(body, "<u2").astype(np.int32).reshape(-1, 2)
        sizes = runs[:, 1] - runs[:, 0] + 1
        return np.repeat(runs[:, 0] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum(), dtype=np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")).astype(np.int32)


def packed_and_not(reference: bytes, parent: bytes | None) -> np.ndarray:
    """Positions in the reference container and not in the parent's (absent: none is)."""
    ref = unpacked(reference)
    return ref if parent is None else ref[~np.isin(ref, unpacked(parent), assume_unique=True, kind="table")]


@F.pandas_udf(T.BinaryType())
def _compressed(bitmaps: pd.Series) -> pd.Series:
    """Containers of bitmaps, one a range of keys."""
    return bitmaps.map(lambda b: packed(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little"))))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _and_not(reference: pd.Series, parent: pd.Series) -> pd.Series:
    """:func:`packed_and_not` of each pair of containers, of which a range and period have one."""
    return pd.Series([packed_and_not(r, p) for r, p in zip(reference, parent, strict=True)])


def key_bitmaps(df: DataFrame, key: str, *by: str) -> DataFrame:
    """``range, *by, bits``: one compressed bitmap of the integer keys of each range of 2**15 and each ``by``.

    The aggregate is combined before the shuffle, so a key that holds a third of
    all rows is one bit a task; what comes out is stored as positions, runs or
    bits, whichever is smallest.
    """
    plain = (
        df.select(F.shiftright(F.col(key), BITS).alias("range"), F.col(key).bitwiseAND(F.lit((1 << BITS) - 1)).alias("pos"), *by)
        .groupBy("range", *by)
        .agg(F.bitmap_construct_agg("pos").alias("bits"))
    )
    return plain.select("range", *by, _compressed("bits").alias("bits"))


def encode_keys(refs: DataFrame, parents: DataFrame, key: str, parent_key: str, buckets: int | None = None) -> DataFrame:
    """``key, code``: a dictionary of dense integers for keys of any type (as text), built without a global sort.

    The code is the key's hash bucket followed by its place inside the bucket, so
    every bucket fills ranges of 2**15 codes from their beginning.  Buckets only
    hold distinct keys, so none is hot; without ``buckets`` there is one for about
    2**14 keys, which takes one count.
    """
    keys = refs.select(F.col(key).cast("string").alias("key")).unionByName(
        parents.select(F.col(parent_key).cast("string").alias("key"))
    ).where("key is not null").distinct()
    if buckets is None:
        keys = stored(keys, "keys")
        buckets = max(1, -(-keys.count() // (1 << 14)))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
    return keys.withColumn("bucket", bucket).select("key", (F.shiftleft(F.col("bucket"), 40) + place - 1).alias("code"))


def orphan_references(
    refs: DataFrame,
    ref_id: str,
    key: str,
    at: str,
    parents: DataFrame,
    parent_key: str,
    valid_from: str,
    valid_to: str,
) -> DataFrame:
    """``ref_id, key, at, period``: references whose key is not registered at their time.

    A key is registered at ``t`` if a parent row has ``valid_from <= t`` and
    ``valid_to`` null or later than ``t``.  Null keys refer to nothing and are no
    orphans; a reference with a null time is one only if its key has no parent
    row at all.  Copies of a reference give one row.  Keys are of any type and
    compared as text.

    Keys of both sides are encoded as dense integers by a dictionary.  Per month
    and range of codes, the compressed bitmap of referenced keys AND NOT that of
    keys registered for the whole month leaves a few codes; decoded, these are the
    keys that need a look at the exact times, and only their references are read
    against the spans.
    """
    r = (
        refs.select(F.col(ref_id).cast("string").alias("ref_id"), F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"))
        .where("key is not null")
        .withColumn("period", F.coalesce(period_of("at"), F.lit(-(2**31)).cast("int")))
    )
    spans = parents.select(
        F.col(parent_key).cast("string").alias("key"), F.col(valid_from).cast("timestamp").alias("lo"), F.col(valid_to).cast("timestamp").alias("hi")
    ).where("key is not null and lo is not null").distinct()
    timed = r.where("at is not null")
    p0, p1 = timed.agg(F.min("period")).scalar(), timed.agg(F.max("period")).scalar()
    # the first month that begins inside the span, and the last that ends inside it
    first = period_of("lo") + F.when(F.trunc("lo", "month").cast("timestamp") < F.col("lo"), 1).otherwise(0)
    last = period_of("hi") - 1
    asked = stored(r.select("key", "period").distinct(), "asked")  # a hot key is one row a month from here on
    codes = stored(encode_keys(asked, spans, "key", "key"), "codes")
    whole = (
        spans.join(codes, "key")
        .select("code", F.greatest(first, p0).alias("a"), F.least(F.coalesce(last, p1), p1).alias("b"))
        .where("a <= b")
        .select("code", F.explode(F.sequence("a", "b")).alias("period"))
    )
    left = key_bitmaps(asked.join(codes, "key"), "code", "period")
    right = key_bitmaps(whole, "code", "period").withColumnRenamed("bits", "parent_bits")
    survivors = (
        left.join(right, ["range", "period"], "left")
        .select("period", "range", F.explode(_and_not("bits", "parent_bits")).alias("pos"))
        .select((F.shiftleft(F.col("range"), BITS) + F.col("pos")).alias("code"), "period")
        .join(codes, "code").select("key", "period")
    )
    suspects = r.join(survivors, ["key", "period"], "left_semi")
    covered = (F.col("s.key") == F.col("o.key")) & (
        F.col("o.at").isNull() | ((F.col("s.lo") <= F.col("o.at")) & (F.col("s.hi").isNull() | (F.col("o.at") < F.col("s.hi"))))
    )
    lost = suspects.alias("o").join(spans.alias("s"), covered, "left_anti")
    return lost.select("ref_id", "key", "at", "period").distinct()
