"""Forward-looking columns and dataset assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import wide_rank
from ..functions.frames import ahead, change
from .features import LAGS


def forward_return(x="adj_close", h: int = 1) -> Column:
    return ahead(x, h)


def median_label(fwd="fwd", by: Sequence[str] = ("date",)) -> Column:
    """1.0 where the forward return beats the date's exact median, 0.0 where not, NULL where unknown."""
    r = F.col(fwd)
    return F.when(r.isNotNull(), (r > F.median(r).over(Window.partitionBy(*by))).cast("double"))


def median_label_wide(df: DataFrame, fwd: str, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The same label for groups too large for one task: a value beats the median exactly when it exceeds the mean of
    the two middle order statistics, found from distributed places."""
    r = wide_rank(df.where(F.col(fwd).isNotNull()), list(by), fwd, list(tie))
    lo, hi = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1
    mid = r.where((F.col("place") == lo) | (F.col("place") == hi)).groupBy(*by).agg(F.avg(fwd).alias("_median"))
    return df.join(mid, list(by), "left").withColumn(
        "y", F.when(F.col(fwd).isNotNull(), (F.col(fwd) > F.col("_median")).cast("double"))).drop("_median")


def up_label(fwd="fwd") -> Column:
    return (F.col(fwd) > 0).cast("int")


def make_dataset(features: DataFrame, target: DataFrame, names: Sequence[str], on=("date", "symbol")) -> DataFrame:
    """Features joined to `target`, incomplete rows dropped."""
    return features.join(target, list(on), "left").dropna(how="any", subset=[*names, "target"])


def make_panel(panel: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Lagged returns with fwd and y on the same rows: one window stage per symbol, then one per date."""
    names = [f"R{m}" for m in lags]
    p = panel.select("date", "symbol", "t", *[change("adj_close", m).alias(f"R{m}") for m in lags],
                     ahead("adj_close", 1).alias("fwd"))
    return p.withColumn("y", median_label()).dropna(subset=names)


def label_uniqueness(labels: DataFrame, h: int) -> DataFrame:
    """Average uniqueness of overlapping h-day labels per symbol: mean of 1 / (labels covering the day) over the span."""
    spans = labels.select("symbol", "t", F.explode(F.sequence(F.col("t") + 1, F.col("t") + h)).alias("day"))
    load = spans.groupBy("symbol", "day").agg(F.count("*").alias("concurrent"))
    return (spans.join(load, ["symbol", "day"]).groupBy("symbol", "t")
            .agg(F.avg(1.0 / F.col("concurrent")).alias("uniqueness")))
