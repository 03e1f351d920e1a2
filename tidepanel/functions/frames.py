"""Per-symbol window expressions on the trading-day ordinal `t`.

A panel keeps only the rows that exist. Every shift and rolling window is a RANGE frame over `t`, so "n days ago"
means n rows of the shared calendar, not n rows of the symbol, and no dense date x symbol grid is needed: a lookup
that lands on a missing day is NULL, and a rolling value is NULL unless all n days are there.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY = ("symbol",)


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_symbol(key=KEY):
    return Window.partitionBy(*key).orderBy("t")


def shift(x, n: int, key=KEY) -> Column:
    """Value of x exactly n calendar rows earlier (negative n: later)."""
    return F.max(col(x)).over(by_symbol(key).rangeBetween(-n, -n))


def span(n: int, key=KEY, lag: int = 0):
    return by_symbol(key).rangeBetween(-(n - 1) - lag, -lag)


def rolling(agg, x, n: int, key=KEY, lag: int = 0) -> Column:
    """agg over the n days ending `lag` days ago; NULL unless all n values are known."""
    w = span(n, key, lag)
    return F.when(F.count(col(x)).over(w) == n, agg(col(x)).over(w))


def ratio(a, b) -> Column:
    """a / b with a NULL for a zero or missing denominator."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def change(x, n: int = 1, key=KEY) -> Column:
    """Return over the last n calendar rows, never bridging a gap."""
    if int(n) < 1:
        raise ValueError("the lookback must be a whole number of days, at least 1")
    return ratio(x, shift(x, n, key)) - 1


def ahead(x, h: int = 1, key=KEY) -> Column:
    """Return over the next h calendar rows."""
    return ratio(shift(x, -h, key), x) - 1


def clean(x) -> Column:
    """NaN and infinity become NULL."""
    c = col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
