"""Sources: CSV, JSON lines, columnar JSON, raw bytes, partitioned lakes, session calendars, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Several Parquet files or folders by column name, with the file each row comes from."""
    return spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("source_file", F.col("_metadata.file_path"))


def bound_query(spark: SparkSession, sql: str, params: dict[str, object], **tables: DataFrame) -> DataFrame:
    """A query with bound parameters (``:name``) over tables named in braces; values never become part of the text."""
    return spark.sql(sql, args=params, **tables)


def hashed_chunks(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """The rows in ``n`` parts by the hash of a key, for work that must go step by step; each part is a filter on the scan."""
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return [df.where(part == i) for i in range(n)]


def attach(spark: SparkSession, name: str, folder: str) -> list[str]:
    """Every Parquet table of a folder as a read-only view ``name_table``; several folders make several databases."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    made = []
    for f in files:
        path = f.getPath()
        if path.getName().endswith(".parquet"):
            view = f"{name}_{path.getName()[: -len('.parquet')]}"
            spark.read.parquet(path.toString()).select("*").createOrReplaceTempView(view)  # a projection can't be inserted into
            made.append(view)
    return sorted(made)


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def csv_window(spark: SparkSession, path: str, day: str, start: str, end: str, numbers: Sequence[str], aliases: dict[str, Sequence[str]] | None = None, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Rows of a CSV with a header whose day lies in ``[start, end)``, numbers parsed only there.

    ``aliases`` maps a column to other headers it may bear.  A row with an
    unreadable day, or inside the window with an unreadable number, is kept with
    nulls and ``problem`` says which column; rows outside the window are not looked at.
    """
    raw = spark.read.option("header", "true").csv(path)
    for name, others in (aliases or {}).items():
        there = [c for c in (name, *others) if c in raw.columns]
        raw = raw.withColumn(name, F.coalesce(*[F.col(c) for c in there]) if there else F.lit(None).cast("string")).drop(*[c for c in there if c != name])
    raw = raw.withColumn("_d", F.try_to_timestamp(F.trim(F.col(day)), F.lit(pattern)).cast("date"))
    inside = raw.where(F.col("_d").isNull() | ((F.col("_d") >= F.lit(start).cast("date")) & (F.col("_d") < F.lit(end).cast("date"))))
    problem = F.when(F.col("_d").isNull(), F.lit(day))
    for n in numbers:
        problem = problem.when(F.col(n).isNotNull() & F.trim(F.col(n)).try_cast("double").isNull(), F.lit(n))
    return inside.select(F.col("_d").alias(day), *[F.trim(F.col(n)).try_cast("double").alias(n) for n in numbers], *[c for c in raw.columns if c not in (day, "_d", *numbers)], problem.alias("problem"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a JSONL file; lines that hold none come with their text in ``corrupt`` and nulls elsewhere, empty lines not at all."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    bad = ~F.trim("value").startswith("{")
    return lines.select(parsed.alias("p"), "value", bad.alias("bad")).select(
        *[F.when(~F.col("bad"), F.col(f"p.{f.name}")).alias(f.name) for f in schema.fields], F.when(F.col("bad"), F.col("value")).otherwise(F.col("p.corrupt")).alias("corrupt")
    )


def columnar_json(spark: SparkSession, path: str, fields: dict[str, str], root: str | None = None) -> DataFrame:
    """Rows of parallel arrays in a JSON document; short arrays are filled up with nulls."""
    inner = T.StructType([T.StructField(n, T.ArrayType(T._parse_datatype_string(k))) for n, k in fields.items()])
    schema = T.StructType([T.StructField(root, inner)]) if root else inner
    df = spark.read.option("multiLine", "true").schema(schema).json(path)
    at = f"{root}." if root else ""
    return df.select(F.inline(F.arrays_zip(*[F.coalesce(F.col(at + n), F.array()).alias(n) for n in fields])))


def nested_lists(df: DataFrame, payload: str, paths: Sequence[str], schema: str) -> DataFrame:
    """Elements of every list found under one of the JSON paths of a payload, as structs of ``schema``."""
    lists = [F.coalesce(F.from_json(F.get_json_object(payload, p), f"array<struct<{schema}>>"), F.array()) for p in paths]
    return df.select(*[c for c in df.columns if c != payload], F.inline(F.concat(*lists)))


def raw_documents(spark: SparkSession, path: str, most_bytes: int = 50_000_000) -> DataFrame:
    """Raw files with length, hash, and their text where it is text; gzip of any number of members is opened.

    Files beyond ``most_bytes``, packed or opened, and gzip that is broken or cut short are reported unread.
    """
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("text string, read boolean")
    def decode(contents):  # noqa: ANN001
        import zlib

        import pandas as pd

        out = []
        for c in contents:
            try:
                data = bytes(c)
                if data[:2] == b"\x1f\x8b":
                    rest, members, size = data, [], 0
                    while rest:
                        opened = zlib.decompressobj(31)
                        members.append(opened.decompress(rest, most_bytes + 1 - size))
                        size += len(members[-1])
                        if size > most_bytes or not opened.eof:
                            raise ValueError
                        rest = opened.unused_data.lstrip(b"\x00")  # members may be padded with zeros
                    data = b"".join(members)
                out.append((None if b"\x00" in data else data.decode("utf-8", "replace"), True))
            except (ValueError, zlib.error):
                out.append((None, False))
        return pd.DataFrame(out, columns=["text", "read"])

    small = F.col("length") <= most_bytes
    opened = files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(small, decode("content")).alias("_d"))
    return opened.select("path", "length", "sha256", F.col("_d.text").alias("text"), F.coalesce("_d.read", F.lit(False)).alias("read"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of their key: the same ones every time."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(n)


def modulus_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.where(F.pmod(F.col(key), F.lit(n)) == 0)


def evenly_spaced(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """``n`` rows at even places of the order, first and last included; all rows where there are fewer.

    Meant for days and the like, of which there are few: places are counted in one pass.
    """
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    # row i is chosen if some k of n rounds to it
    k = F.round(F.col("_i") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.floor(k * (F.col("_n") - 1) / F.lit(max(1, n - 1))) == F.col("_i")
    return placed.where((F.col("_n") <= n) | hit).drop("_i", "_n")


def weekday_sessions(spark: SparkSession, start: str, end: str, closed: Sequence[str] = (), open_utc: str = "14:30:00", close_utc: str = "21:00:00") -> DataFrame:
    """A session calendar: weekdays of ``[start, end]`` that are not closed, with opening and closing time."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as day").where(F.weekday("day") < 5)
    days = days.where(~F.col("day").cast("string").isin(list(closed)))
    at = lambda t: F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit(t)))
    return days.select("day", at(open_utc).alias("opens"), at(close_utc).alias("closes"))


def html_index(pages: DataFrame, page_id: str, html: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the tables of filing-index pages: ``page_id, row, *columns, href``; header rows and rows of another width are left out.

    ``href`` is the first link of the row.
    """
    from tidemark.functions.markup import table_rows

    cells = table_rows(pages.select(page_id, html), page_id, html).where((F.size("cells") == len(columns)) & ~F.col("header"))
    row = F.row_number().over(Window.partitionBy(page_id).orderBy("table_index", "row_index"))
    return cells.select(page_id, row.cast("long").alias("row"), *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)], "href")
