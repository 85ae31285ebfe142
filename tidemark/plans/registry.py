"""Registration of queries beside the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Query = Callable[..., DataFrame]


class Registry:
    """``QUERIES`` and ``ORACLE`` of a module, filled by a decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return add


def rows_n() -> Column:
    """The number of rows, as ``n``."""
    return F.count(F.lit(1)).alias("n")


def plain(df: DataFrame, places: int = 6) -> DataFrame:
    """Days as text, timestamps as epoch microseconds, and doubles rounded; prices have up to seven places, so eight leave no ties."""
    kinds = dict(df.dtypes)
    made = {"date": lambda c: F.col(c).cast("string"), "double": lambda c: F.round(c, places), "timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(F.col(c).cast("timestamp"))}
    return df.select(*[made.get(kinds[c], F.col)(c).alias(c) for c in df.columns])
