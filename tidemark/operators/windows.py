"""Trailing, forward and cross-sectional windows with the guards that panels need."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def divided(a: Column | str, b: Column | str) -> Column:
    """The quotient of doubles as SQL without errors has it: infinite by zero, NaN where both are zero, null only for a null."""
    a, b = col(a), col(b)
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def ordered(key: str | Sequence[str], order: str | Sequence[str]) -> Window:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


def trailing(fn: Callable[[Column], Column], value: Column | str, n: int, key, order, least: int | None = None) -> Column:
    """``fn`` over the last ``n`` rows; null until ``least`` (all ``n`` by default) of them have a value."""
    w = ordered(key, order).rowsBetween(-(n - 1), 0)
    v = col(value)
    return F.when(F.count(v).over(w) >= (n if least is None else least), fn(v).over(w))


def forward(fn: Callable[[Column], Column], value: Column | str, n: int, key, order) -> Column:
    """``fn`` over the next ``n`` rows without the current one; null unless all have a value."""
    w = ordered(key, order).rowsBetween(1, n)
    v = col(value)
    return F.when(F.count(v).over(w) == n, fn(v).over(w))


def lag_return(value: Column | str, n: int, key, order) -> Column:
    """Change in percent against ``n`` rows ago."""
    v = col(value)
    return 100 * (F.try_divide(v, F.lag(v, n).over(ordered(key, order))) - 1)


def compound(ret: Column | str, n: int, key, order) -> Column:
    """Compounded return of ``n`` simple returns, all present."""
    return F.exp(trailing(F.sum, F.ln(1 + col(ret)), n, key, order)) - 1


def zscore(value: Column | str, n: int, key, order, least_std: float = 1e-12) -> Column:
    """Distance from the trailing mean in population deviations; null where these vanish."""
    mean, std = trailing(F.avg, value, n, key, order), trailing(F.stddev_pop, value, n, key, order)
    return F.when(std > least_std, (col(value) - mean) / std)


def percent_rank_ties(value: Column | str, by: str | Sequence[str]) -> Column:
    """Average-tie rank over count within ``by``, as a share; null values get null."""
    keys = [by] if isinstance(by, str) else list(by)
    v = col(value)
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy(v.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, v))
    return F.when(v.isNotNull(), (rank + (ties - 1) / 2.0) / F.count(v).over(w))


def leave_one_out_mean(value: Column | str, by: str | Sequence[str]) -> Column:
    """Mean of the others of the group; null for an only member."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by))
    v = col(value)
    return F.try_divide(F.sum(v).over(w) - v, F.count(v).over(w) - 1)


def leave_one_out_std(value: Column | str, by: str | Sequence[str]) -> Column:
    """Population deviation of the others, from their first two moments, never below zero."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by))
    v = col(value)
    n = F.count(v).over(w) - 1
    mean = F.try_divide(F.sum(v).over(w) - v, n)
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(v * v).over(w) - v * v, n) - mean * mean))


def peers(value: Column | str, by: str | Sequence[str]) -> Column:
    return F.count(col(value)).over(Window.partitionBy(*([by] if isinstance(by, str) else by))) - 1


def true_range(high: Column | str, low: Column | str, close: Column | str, key, order) -> Column:
    prev = F.lag(col(close)).over(ordered(key, order))
    return F.greatest(col(high) - col(low), F.abs(col(high) - prev), F.abs(col(low) - prev))


def rsi(step: Column | str, n: int, key, order) -> Column:
    """Relative strength of ``n`` changes by simple means; null where there was no loss."""
    gain = trailing(F.avg, F.greatest(col(step), F.lit(0.0)) + col(step) * 0, n, key, order)
    loss = trailing(F.avg, F.greatest(-col(step), F.lit(0.0)) + col(step) * 0, n, key, order)
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss))


def slope(value: Column | str, position: Column | str, n: int, key, order) -> Column:
    """Least-squares slope of the last ``n`` values against their position."""
    w = ordered(key, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(value)).over(w) >= n, F.regr_slope(col(value), col(position)).over(w))


def beta(y: Column | str, x: Column | str, n: int, key, order, least_var: float = 1e-12) -> Column:
    """Trailing covariance over variance, sample moments, with a floor for the variance."""
    w = ordered(key, order).rowsBetween(-(n - 1), 0)
    both = col(y).isNotNull() & col(x).isNotNull()
    var = F.var_samp(F.when(both, col(x))).over(w)
    cov = F.covar_samp(F.when(both, col(y)), F.when(both, col(x))).over(w)
    return F.when((F.count(F.when(both, 1)).over(w) >= n) & (var > least_var), cov / var)
