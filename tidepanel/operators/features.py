"""Past-looking columns of the panel. Every name maps to a native expression, so one select emits the whole list."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import avg_rank, size
from ..functions.frames import by_symbol, change, col, ratio, rolling, shift

HIGH_WINDOW, VOLUME_WINDOW = 252, 63
#: The published lags.
LAGS = tuple(range(1, 21)) + tuple(range(40, 241, 20))
TRADING_DAYS = 252
_NAME = re.compile(r"^(ret|vol)_(\d+)$")


def past_return(x, n: int) -> Column:
    return change(x, n)


def rolling_vol(ret, n: int) -> Column:
    if int(n) < 2:
        raise ValueError(f"no spread can be taken over {n!r} day(s)")
    return rolling(F.stddev_samp, ret, n)


def volume_zscore(v, n: int = VOLUME_WINDOW) -> Column:
    return ratio(col(v) - rolling(F.avg, v, n), rolling(F.stddev_samp, v, n))


def high_distance(x, n: int = HIGH_WINDOW) -> Column:
    return ratio(x, rolling(F.max, x, n)) - 1


def feature(name: str, high_window: int = HIGH_WINDOW, volume_window: int = VOLUME_WINDOW) -> Column:
    """Column of one feature over a panel with adj_close, ret and volume: ret_N, vol_N, volume_z or hi52."""
    m = _NAME.match(name)
    if m:
        n = int(m.group(2))
        return past_return("adj_close", n) if m.group(1) == "ret" else rolling_vol("ret", n)
    if name == "volume_z":
        return volume_zscore("volume", volume_window)
    if name == "hi52":
        return high_distance("adj_close", high_window)
    raise ValueError(f"no feature is called {name!r}; there are ret_<days>, vol_<days>, volume_z and hi52")


def feature_names(momentum: int = 21, extra: str = "vol_63") -> list[str]:
    """The default list with its momentum and extra slots filled; a duplicate appears once."""
    slots = ["ret_1", "ret_5", f"ret_{int(momentum)}", "ret_63", "vol_21", str(extra), "volume_z", "hi52"]
    return list(dict.fromkeys(slots))


def rows_needed(names: Sequence[str], high_window: int = HIGH_WINDOW, volume_window: int = VOLUME_WINDOW) -> int:
    """Trading days of history before the last row of these features is complete."""
    need = [2]
    for n in names:
        m = _NAME.match(n)
        if m:
            need.append(int(m.group(2)) + 1)
        elif n == "volume_z":
            need.append(volume_window)
        elif n == "hi52":
            need.append(high_window)
    return max(need)


def lookback_date(cal: DataFrame, start, rows: int) -> dt.date:
    """First date to scan so that features are complete on `start`. Reads one row of the calendar, so the scan filter
    below the windows can be a literal that reaches the files."""
    hit = (cal.where(F.col("date") <= F.lit(start)).orderBy(F.desc("date")).limit(max(int(rows), 1))
           .agg(F.min("date").alias("d")).first())
    return hit["d"]


def build_features(panel: DataFrame, names: Sequence[str], keep: Sequence[str] = ("date", "symbol", "t"),
                   high_window: int = HIGH_WINDOW, volume_window: int = VOLUME_WINDOW) -> DataFrame:
    names = list(dict.fromkeys(names))
    if any(n.startswith("vol_") for n in names):
        panel = panel.withColumn("ret", change("adj_close", 1))
    return panel.select(*keep, *[feature(n, high_window, volume_window).alias(n) for n in names])


def rank_normalise(feats: DataFrame, names: Sequence[str], by: Sequence[str] = ("date",)) -> DataFrame:
    """(rank - 0.5) / count - 0.5 within each date; NULLs stay NULL and are not counted. One shuffle for all columns."""
    others = [c for c in feats.columns if c not in names]
    f = feats.repartition(*by)
    return f.select(*others, *[((avg_rank(n, by) - 0.5) / size(n, by) - 0.5).alias(n) for n in names])


def lagged_returns(panel: DataFrame, lags: Sequence[int] = LAGS, keep=("date", "symbol", "t")) -> DataFrame:
    """R{m} per lag; only rows where every lag is known."""
    names = [f"R{m}" for m in lags]
    return panel.select(*keep, *[change("adj_close", m).alias(f"R{m}") for m in lags]).dropna(subset=names)


def market_volatility(panel: DataFrame, window: int = 20, per_year: int = TRADING_DAYS) -> DataFrame:
    """Annualised volatility of the equal-weight average return, known at the close of each date."""
    r = panel.select("date", "t", change("adj_close", 1).alias("ret"))
    m = r.groupBy("date", "t").agg(F.avg("ret").alias("mkt"))
    w = Window.orderBy("t").rowsBetween(-(window - 1), 0)      # one row per date
    return m.select("date", "t", "mkt", F.when(F.count("mkt").over(w) == window, F.stddev_samp("mkt").over(w)
                                               * F.sqrt(F.lit(float(per_year)))).alias("market_vol"))


def trading_time_returns(panel: DataFrame, window: int = 10) -> Column:
    """Return scaled by the average volume of the previous `window` days over today's."""
    return F.col("ret") * ratio(rolling(F.avg, "volume", window, lag=1), "volume")


def trend_signals(x="adj_close", year: int = 252, month: int = 21, week: int = 5) -> dict[str, Column]:
    """Momentum, short-term and weekly reversal, signed so that high means expected to rise."""
    return {"MOM": ratio(shift(x, month), shift(x, year)) - 1, "STR": -change(x, month), "WSTR": -change(x, week)}


def rebased(x="adj_close") -> Column:
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return ratio(x, F.first(col(x), ignorenulls=True).over(w)) * 100
