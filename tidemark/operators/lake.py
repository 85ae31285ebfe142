"""Bars by session, reconciliation of sources, and sealed, partitioned writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stored


#: The names of the session classes and the minutes at which they begin.
def session_class(local: Column) -> Column:
    """WEEKEND, PREMARKET, RTH, AFTERHOURS or OUTSIDE of a local time."""
    minute = F.hour(local) * 60 + F.minute(local)
    return (
        F.when(F.weekday(local) >= 5, "WEEKEND").when((minute >= 240) & (minute < 570), "PREMARKET").when((minute >= 570) & (minute < 960), "RTH")
        .when((minute >= 960) & (minute < 1200), "AFTERHOURS").otherwise("OUTSIDE")
    )


def session_bars(ticks: DataFrame, key: str, at: str, price: str, size: str, zone: str, tie: str) -> DataFrame:
    """Open, high, low, close, volume and volume-weighted price of each key, local day and session class; times of the first and last tick."""
    local = F.from_utc_timestamp(F.col(at), zone)
    t = ticks.select(key, at, price, size, tie, F.to_date(local).alias("day"), session_class(local).alias("session"))
    order = F.struct(at, tie)
    return t.groupBy(key, "day", "session").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(size).alias("volume"),
        F.try_divide(F.sum(F.col(price) * F.col(size)), F.sum(size)).alias("vwap"), F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
    )


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Both sources' values of every key with their difference in percent and what it means."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    both = a.join(b, list(keys), "full")
    diff = 100 * (F.try_divide(F.col("left_value"), F.col("right_value")) - 1)
    status = (
        F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only").when(F.abs(diff) <= tolerance, "match").otherwise("differs")
    )
    return both.select(*keys, "left_value", "right_value", diff.alias("difference"), status.alias("status"))


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """One row: keys missing on either side, and differing values of each field (null equals null)."""
    a = left.select(*keys, *[F.col(f).alias(f"l_{f}") for f in fields], F.lit(1).alias("_l"))
    b = right.select(*keys, *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(1).alias("_r"))
    both = a.join(b, list(keys), "full")
    here = F.col("_l").isNotNull() & F.col("_r").isNotNull()

    def off(f: str) -> Column:
        same = F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))
        if tolerance:
            same = same | F.coalesce(F.abs(F.col(f"l_{f}") - F.col(f"r_{f}")) <= tolerance, F.lit(False))
        return F.count_if(here & ~same).alias(f"differs_{f}")

    return both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(here).alias("in_both"), *[off(f) for f in fields])


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys added, removed, changed or unchanged between two snapshots; ``ambiguous`` where a key comes several times in one."""
    a = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("_no"), F.max(value).alias("old_value"))
    b = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nn"), F.max(value).alias("new_value"))
    both = a.join(b, list(keys), "full")
    change = (
        F.when((F.col("_no") > 1) | (F.col("_nn") > 1), "ambiguous").when(F.col("_no").isNull(), "added").when(F.col("_nn").isNull(), "removed")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    )
    return both.select(*keys, "old_value", "new_value", change.alias("change"))


def set_equality(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """``pair, equal``: whether two sets of rows are the same; what is on one side only is looked for, not counted."""
    off = left.subtract(right).unionByName(right.subtract(left)).limit(1)
    return off.agg((F.count(F.lit(1)) == 0).alias("equal")).select(F.lit(name).alias("pair"), "equal")


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = (), keys: Sequence[str] = ()) -> str:
    """Write a partitioned Parquet artifact once: a finished one of equal content is kept, another raises.

    Rows go to a staging folder beside ``path`` and are renamed when complete, so a
    reader never meets half of them; the seal holds the number of rows and a hash
    that does not depend on their order.  Returns ``written`` or ``reused``.
    """
    spark = df.sparkSession
    df = stored(df, "publish")  # looked at for keys and seal before it is written
    if keys:
        assert_unique(df, keys)
    seal = content_seal(df)
    files, target = _fs(spark, path)
    if files.exists(_path(spark, f"{path}/_SEAL")):
        stream = files.open(_path(spark, f"{path}/_SEAL"))  # Spark's readers skip files with an underscore
        said = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if said == seal:
            return "reused"
        raise ValueError(f"{path} is sealed with other content")
    staging = f"{path}.staging"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    stream = files.create(_path(spark, f"{staging}/_SEAL"), True)
    stream.write(bytearray(seal.encode()))
    stream.close()
    if not files.rename(_path(spark, staging), target):
        raise OSError(f"could not rename {staging}")
    return "written"


def publish_batches(df: DataFrame, path: str, batch: str) -> DataFrame:
    """Publish each batch of a table as its own sealed artifact; ``batch, result`` says which were written and which were there.

    A run that was cut short goes on where it stopped: batches sealed before are
    compared and kept.  Batches are named in the data, and are as many as a
    person would list.
    """
    names = sorted(r[0] for r in df.select(F.col(batch).cast("string")).where(F.col(batch).isNotNull()).distinct().collect())
    done = [(n, publish(df.where(F.col(batch).cast("string") == n), f"{path}/{batch}={n}")) for n in names]
    return df.sparkSession.createDataFrame(done, "batch string, result string")


def id_shards(df: DataFrame, ident: str, size: str, most: int, digits: int = 1) -> DataFrame:
    """``bucket, n, size, n_files`` for rows bucketed by the first hex digits of their id's hash, and the files a bucket needs so that none is beyond ``most``."""
    bucket = F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, digits)
    per = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    return per.withColumn("n_files", F.greatest(F.lit(1), F.ceil(F.col("size") / most)).cast("long"))


def size_gate(spark: SparkSession, path: str, most_bytes: int) -> str:
    """``within`` or ``beyond``: whether what lies under a path may be read by a stage; ``absent`` where nothing lies there."""
    files, target = _fs(spark, path)
    if not files.exists(target):
        return "absent"
    return "within" if files.getContentSummary(target).getLength() <= most_bytes else "beyond"


def content_seal(df: DataFrame) -> str:
    """Rows and an order-free hash of a table's content."""
    h = F.xxhash64(*sorted(df.columns)) if df.columns else F.lit(0)
    n, low, high = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0))).first()
    return f"{n}-{low}-{high}"


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key comes twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{list(keys)} is not unique: {twice[0]}")
    return df


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
