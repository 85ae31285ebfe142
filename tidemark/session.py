"""Session helpers: reading tables, micros, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "tidemark", cores: str = "8", **conf: str) -> SparkSession:
    """A single-JVM session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where it is unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    sc.setCheckpointDir(named)
    return named


def micros(col: Column | str) -> Column:
    """Epoch microseconds of a timestamp with or without zone (naive ones mean UTC)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col.cast(T.TimestampType()))


def require_columns(df: DataFrame, names: list[str], what: str = "input") -> DataFrame:
    """Raise before any work starts when a required column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, deleted by :func:`release`."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it again.

    Like a checkpoint, but columnar and compressed: later steps read the columns
    they need, and a lost executor costs nothing of what is written.  The files stay
    until :func:`release`, as results are read from them lazily.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what was written to :func:`scratch` paths in this session, when no result that reads it is wanted any more; returns how many folders went."""
    mine = [x for x in _WRITTEN if x[0] is spark]
    for x in mine:
        path = spark._jvm.org.apache.hadoop.fs.Path(x[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(x)
    return len(mine)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        with contextlib.suppress(Exception):  # the session may have ended
            release(spark)
