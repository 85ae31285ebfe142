"""Q09_horizon_review: the middle by counting, on tables that repeat, lack or divide by nothing, and quantiles of groups against Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck
from tidemark.operators import distribution

NAME = "Q09_horizon_review"


def _tables(spark, folder, seed):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.05 else dt.datetime(1995, 1, 1) + dt.timedelta(days=rng.randrange(0, 40))
    pick = lambda *odd: rng.choice(odd) if rng.random() < 0.1 else None
    lines = []
    for i in range(900):
        q, p = pick(0.0, 1.0), pick(0.0, 2.5)
        lines.append((i, i % 7, rng.choice([0, 1, 2, 3, 4, 99, None]), 1, float(rng.randrange(1, 50)) if q is None else q, round(rng.uniform(900, 9000), 2) if p is None else p, 0.09, "R", "F", day()))
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, kinds).write.parquet(f"{folder}/lineitem.parquet")
    # 2 stands twice, 4 has no nation, 99 isn't there
    spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 1), (3, 2), (4, 77)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(1, 0), (2, 3)], "n_nationkey int, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


@pytest.mark.parametrize("seed", range(3))
def test_odd_tables(spark, tmp_path, seed):
    sf = _tables(spark, tmp_path, seed)
    said, _, ok = compare(spark, duck(sf), NAME, entry.queries()[NAME], entry.oracle_sql()[NAME], sf)
    assert ok and said == "ok 2", said


def test_no_lines(spark, tmp_path):
    sf = _tables(spark, tmp_path, 9)
    spark.read.parquet(f"{sf}/lineitem.parquet").limit(0).write.parquet(f"{sf}/none/lineitem.parquet")
    for name in ("supplier", "nation"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{sf}/none/{name}.parquet")
    assert entry.queries()[NAME](spark, f"{sf}/none").count() == 0


def test_no_task_holds_a_horizon(spark, sf, monkeypatch):
    """An exact percentile keeps every different value of a horizon in one task; at 32 million bars that never ends."""

    def refused(*_):
        raise AssertionError("all of a horizon's values in one task")

    for name in ("percentile", "median", "collect_list"):
        monkeypatch.setattr(F, name, refused)
    assert entry.queries()[NAME](spark, sf).count() == 2


def test_quantiles_by(spark):
    rng = random.Random(4)
    inf, nan, levels = math.inf, math.nan, (0.0, 0.1, 0.5, 0.77, 1.0)
    values = {
        "a": [rng.choice([0.0, -0.0, 1e-300, 5.0, rng.gauss(0, 1e6), rng.random()]) for _ in range(301)] + [1e308, -1e308], "b": [7.0] * 40, "c": [-inf, -inf, 1.0, 2.0, 3.0, 4.0, inf, inf],
        "d": [], "e": [1.0, 2.0, nan, nan], None: [3.0, 4.0], "f": [nan], "g": [-inf, inf], "h": [0.0, 5e-324, 5e-324],
    }
    rows = [(g, v) for g, vs in values.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in distribution.quantiles_by(df, "g", "v", levels, parts=4).collect()}
    assert {g: (r.n, r.n_values) for g, r in got.items()} == {g: (len(vs) + 1, len(vs)) for g, vs in values.items()}
    for g in ("a", "b", None):
        assert got[g].levels == pytest.approx(np.quantile(values[g], levels).tolist(), rel=1e-9)
    assert got["c"].levels[::2] == [-inf, 2.5, inf] and got["d"].levels == [None] * 5
    assert got["h"].levels[0] == 0.0 and got["h"].levels[2] == 5e-324
    assert got["e"].levels[0] == 1.0 and math.isnan(got["e"].levels[4]) and all(math.isnan(x) for x in got["f"].levels)
    assert distribution.quantiles_by(df.limit(0), "g", "v", levels).count() == 0
