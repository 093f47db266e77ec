"""Rolling and expanding column functions over an ordered window.

A window of n rows gives a value only if it holds n (or min_rows) non-null values; NaN counts as missing and is to be
turned into null at the source. Every function takes the ordered window spec of the series, so features of one series
share one exchange and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: A standard deviation below this is that of a constant.
FLAT = 1e-12


def over(series: str | list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*([series] if isinstance(series, str) else series)).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def expanding(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def ln(x: Column) -> Column:
    """Logarithm of what is positive, else null."""
    return F.when(x > 0, F.log(x))


def ratio(x: Column, y: Column) -> Column:
    """x / y; null where y is 0."""
    return x / F.nullif(y, F.lit(0.0))


def rolling(agg, x: Column, w: WindowSpec, n: int, min_rows: int | None = None) -> Column:
    f = last_rows(w, n)
    return F.when(F.count(x).over(f) >= (n if min_rows is None else min_rows), agg(x).over(f))


def rolling_std(x: Column, w: WindowSpec, n: int) -> Column:
    s = rolling(F.stddev_samp, x, w, n)
    return F.when(s > FLAT, s)


def zscore(x: Column, w: WindowSpec, n: int) -> Column:
    return (x - rolling(F.avg, x, w, n)) / rolling_std(x, w, n)


def pair(agg, x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    """A two-column aggregate over rows where both are present."""
    both = x.isNotNull() & y.isNotNull()
    f = last_rows(w, n)
    return F.when(F.count(F.when(both, 1)).over(f) >= n, agg(F.when(both, x), F.when(both, y)).over(f))


def running_sum(x: Column, w: WindowSpec) -> Column:
    """Sum so far; null on rows without a value."""
    return F.when(x.isNotNull(), F.sum(x).over(expanding(w)))


def fill_forward(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(expanding(w))


def forward_sum(x: Column, w: WindowSpec, h: int) -> Column:
    """Sum of this row and the h - 1 that follow."""
    f = w.rowsBetween(0, h - 1)
    return F.when(F.count(x).over(f) >= h, F.sum(x).over(f))


def ou_half_life(x: Column, lagged: Column, w: WindowSpec, n: int) -> Column:
    """Half-life of reversion from the slope of the change on the level before, within n rows (n - 1 pairs)."""
    f = last_rows(w, n - 1)
    d = x - lagged
    var = F.var_pop(F.when(d.isNotNull(), lagged)).over(f)
    b = F.covar_samp(lagged, d).over(f) / F.when(var > FLAT * FLAT, var)
    full = F.count(x).over(last_rows(w, n)) >= n
    return F.when(full & (b < 0) & (b > -1), -math.log(2) / F.log(1 + b))


def rebalanced(x: Column, w: WindowSpec, every: int) -> Column:
    """x as of each every-th row, held in between; a null on such a row keeps the older value."""
    return fill_forward(F.when((F.row_number().over(w) - 1) % every == 0, x), w)
