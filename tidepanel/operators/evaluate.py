"""Forecast evaluation: pooled scores, rank correlations, decile tables, accuracy.

Pooled measures rank whole tables, so they use distributed ranks; per-date measures use one window per date, or
distributed ranks where `wide` is set because the universe grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import avg_rank, ceil_group, place, qcut_group, rank_corr, safe_corr, size, wide_rank
from ..functions.frames import ratio

TIE = ("date", "symbol")


def pooled_ranks(df: DataFrame, by: Sequence[str], columns: dict[str, str], tie: Sequence[str] = TIE) -> DataFrame:
    """Average ranks of several columns over each whole group: {name}_rank for column -> name, among the rows that have
    all of them. Each column's ranking reads a written table, not the ranking before it again."""
    df = df.dropna(subset=list(columns))
    for c, name in columns.items():
        df = wide_rank(df, list(by), c, list(tie), prefix=f"{name}_")
    return df


def baselines(ds: DataFrame, train: Column, target: str = "target") -> DataFrame:
    """Zero and training-mean forecasts next to the target."""
    mean = ds.where(train).select(F.avg(target)).scalar()
    return ds.select("date", "symbol", target, F.lit(0.0).alias("zero"), mean.alias("train_mean"))


def score_table(df: DataFrame, by: str, pred: str, y: str) -> DataFrame:
    """mse, r2 against zero, pooled rank correlation and hit rate per group."""
    r = pooled_ranks(df.select(by, *TIE, pred, y), [by], {pred: "p", y: "y"})
    p, t = F.col(pred), F.col(y)
    moved = t != 0
    mse, base = F.avg((t - p) * (t - p)), F.avg(t * t)
    hits = F.avg(F.when(moved, (F.signum(p) == F.signum(t)).cast("double")))
    any_call = F.max(F.when(moved, (p != 0).cast("int")))
    return r.groupBy(by).agg(
        mse.alias("mse"), (1 - mse / F.nullif(base, F.lit(0.0))).alias("r2_vs_zero"),
        F.when(F.count("*") >= 3, rank_corr("p_rank", "y_rank")).alias("ic"),
        F.when(any_call == 1, hits).alias("hit_rate"), F.count("*").alias("rows"))


def auc_accuracy(df: DataFrame, by: str, score: str, y: str, threshold: float) -> DataFrame:
    """Area under the ROC curve by rank sums, and accuracy of `score > threshold`."""
    r = pooled_ranks(df.select(by, *TIE, score, y), [by], {score: "s"})
    pos = F.col(y) == 1
    n1, n0 = F.count(F.when(pos, 1)).cast("double"), F.count(F.when(~pos, 1)).cast("double")
    auc = (F.sum(F.when(pos, F.col("s_rank"))) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))
    acc = F.avg(((F.col(score) > threshold).cast("int") == F.col(y)).cast("double"))
    return r.groupBy(by).agg(auc.alias("auc"), acc.alias("accuracy"), F.count("*").alias("rows"))


def decile_table(df: DataFrame, by: str, pred: str, y: str, n: int = 10) -> DataFrame:
    """Equal-count groups of the pooled forecasts: mean forecast, mean target, its standard error, rows."""
    r = wide_rank(df.select(by, *TIE, pred, y), [by], pred, list(TIE))
    return (r.withColumn("decile", qcut_group("place", "size", n)).groupBy(by, "decile")
            .agg(F.avg(pred).alias("mean_forecast"), F.avg(y).alias("mean_target"),
                 (F.stddev_samp(y) / F.sqrt(F.count("*"))).alias("target_se"), F.count("*").alias("rows")))


def decile_spread(table: DataFrame, by: str, n: int = 10) -> DataFrame:
    top = F.max(F.when(F.col("decile") == n, F.col("mean_target")))
    low = F.max(F.when(F.col("decile") == 1, F.col("mean_target")))
    return table.groupBy(by).agg((top - low).alias("spread"))


def date_ranks(df: DataFrame, by: Sequence[str], columns: Sequence[str], wide: bool = False,
               tie: str = "symbol") -> DataFrame:
    """Adds {column}_rank within each group."""
    if wide:
        return pooled_ranks(df, by, {c: c for c in columns}, [tie])
    return df.repartition(*by).select("*", *[avg_rank(c, by).alias(f"{c}_rank") for c in columns])


def ic_by_group(df: DataFrame, by: Sequence[str], score: str, y: str, at_least: int = 1, rank: bool = True,
                wide: bool = False) -> DataFrame:
    """Cross-sectional correlation per group (Spearman, or Pearson with rank=False); small groups dropped."""
    df = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    a, b = score, y
    if rank:
        df, a, b = date_ranks(df, by, [score, y], wide), f"{score}_rank", f"{y}_rank"
    corr = rank_corr(a, b) if rank else safe_corr(a, b)
    g = df.groupBy(*by).agg(corr.alias("ic"), F.count("*").alias("n"))
    return g.where(F.col("n") >= at_least)


def ic_summary(ics: DataFrame, by: str) -> DataFrame:
    """Mean, spread, t statistic and share of positive values of the per-date correlations."""
    sd, m, n = F.stddev_samp("ic"), F.avg("ic"), F.count("ic")
    return ics.groupBy(by).agg(m.alias("mean_ic"), sd.alias("std_ic"), (m / F.nullif(sd, F.lit(0.0)) * F.sqrt(n)).alias("t_stat"),
                               F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("positive"),
                               n.alias("days"))


def unpivot_features(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keep), list(names), "feature", "value")


def decile_returns(df: DataFrame, by: Sequence[str], score: str, y: str, n: int = 10, relative: bool = True,
                   wide: bool = False, out: Sequence[str] = ()) -> DataFrame:
    """Mean next return per decile formed within each date; `relative` subtracts the date's mean first."""
    by = list(by)
    df = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    if wide:
        r = wide_rank(df, by, score, ["symbol"])
        mean = df.groupBy(*by).agg(F.avg(y).alias("_mean"))
        r = r.join(mean, by)
    else:
        r = df.repartition(*by).select("*", place([F.col(score), F.col("symbol")], by).alias("place"),
                                       size("*", by).alias("size"), F.avg(y).over(Window.partitionBy(*by)).alias("_mean"))
    v = F.col(y) - F.col("_mean") if relative else F.col(y)
    return (r.where(F.col("size") >= n).groupBy(*out, ceil_group("place", "size", n).alias("decile"))
            .agg(F.avg(v).alias("mean_return"), F.count("*").alias("rows")))


def period_accuracy(df: DataFrame, by: Sequence[str], score: str, y: str, threshold: float | None = 0.5) -> DataFrame:
    """Share of names whose direction was called right per date; threshold None calls against the date's median."""
    df = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    cut = F.median(score).over(Window.partitionBy(*by)) if threshold is None else F.lit(float(threshold))
    hit = ((F.col(score) > cut) == (F.col(y) > 0)).cast("double")
    return df.select(*by, hit.alias("hit")).groupBy(*by).agg(F.avg("hit").alias("accuracy"), F.count("*").alias("n"))


def agreement(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Average over dates of the rank correlation of every two models, all pairs in one aggregate."""
    r = date_ranks(df.dropna(subset=list(models)), ["date"], models)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    g = r.groupBy("date").agg(*[rank_corr(f"{a}_rank", f"{b}_rank").alias(f"{a}|{b}") for a, b in pairs])
    long = g.unpivot(["date"], [f"{a}|{b}" for a, b in pairs], "pair", "ic")
    part = lambda i: F.split("pair", r"\|")[i]
    return (long.groupBy(part(0).alias("model_a"), part(1).alias("model_b"))
            .agg(F.avg("ic").alias("agreement"), F.count("ic").alias("days")))


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest gap, unmatched rows and rank correlation of two versions of one series."""
    j = (a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), list(keys), "full_outer"))
    r = pooled_ranks(j.where(F.col("va").isNotNull() & F.col("vb").isNotNull()), [], {"va": "a", "vb": "b"}, list(keys))
    gaps = j.agg(F.max(F.abs(F.col("va") - F.col("vb"))).alias("max_gap"),
                 F.count(F.when(F.col("va").isNull() | F.col("vb").isNull(), 1)).alias("unmatched"))
    return gaps.join(r.agg(rank_corr("a_rank", "b_rank").alias("rank_corr"), F.count("*").alias("matched")))
