"""Performance and multiple-testing statistics per variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio
from ..functions.normal import expected_best, normal_cdf


def with_equity(daily: DataFrame, value: str, by: Sequence[str] = ("variant",), order: str = "date",
                start_at_one: bool = False) -> DataFrame:
    """Adds equity, peak and drawdown. A variant's daily series has one row per trading day, so its window is bounded
    by the calendar. start_at_one counts the starting capital as the first peak."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("equity", F.product(1 + F.col(value)).over(w))
    peak = F.max("equity").over(w)
    d = d.withColumn("peak", F.greatest(peak, F.lit(1.0)) if start_at_one else peak)
    return d.withColumn("drawdown", ratio("equity", "peak") - 1)


def perf_stats(daily: DataFrame, value: str = "net", by: Sequence[str] = ("variant",), per_year: int = 252,
               order: str = "date") -> DataFrame:
    """Mean, annual return and volatility, Sharpe, worst drawdown, hit rate and days of a daily series."""
    d = with_equity(daily.where(F.col(value).isNotNull()), value, by, order)
    r = F.col(value)
    n, sd, m = F.count("*"), F.stddev_samp(r), F.avg(r)
    last = F.max_by("equity", order)
    year = F.lit(float(per_year))
    return d.groupBy(*by).agg(
        m.alias("mean_daily"), F.when(last > 0, F.pow(last, year / n) - 1).alias("annual_return"),
        (sd * F.sqrt(year)).alias("annual_vol"), (m / F.nullif(sd, F.lit(0.0)) * F.sqrt(year)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        (F.count(F.when(r > 0, 1)) / F.greatest(F.count(F.when(r != 0, 1)), F.lit(1))).alias("hit_rate"), n.alias("days"))


def drift_stats(daily: DataFrame, per_year: int = 252) -> DataFrame:
    """Headline numbers of a drifting backtest; a blown-up book reports -100% and no path statistics."""
    w = Window.partitionBy("variant").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("_dd", ratio("equity", F.greatest(F.max("equity").over(w), F.lit(1.0))) - 1)
    blown = F.max("blown_up") == 1
    n, sd, m = F.count("*"), F.stddev_samp("net"), F.avg("net")
    total = F.max_by("equity", "t") - 1
    year = F.lit(float(per_year))
    ok = lambda c: F.when(~blown, c)
    return d.groupBy("variant").agg(
        F.when(blown, -1.0).otherwise(total).alias("total_return"),
        F.when(blown, -1.0).otherwise(F.pow(1 + total, year / n) - 1).alias("annual_return"),
        ok(sd * F.sqrt(year)).alias("annual_vol"), ok(m / F.nullif(sd, F.lit(0.0)) * F.sqrt(year)).alias("sharpe"),
        ok(F.least(F.min("_dd"), F.lit(0.0))).alias("max_drawdown"),
        F.coalesce(F.avg(F.when(F.col("rebalanced") == 1, F.col("turnover"))), F.lit(0.0)).alias("avg_turnover"),
        F.sum("rebalanced").alias("n_rebalances"), F.max("blown_up").alias("blown_up"))


def period_stats(periods: DataFrame, h: int, per_year: int = 252) -> DataFrame:
    """Statistics of one return per holding period, before and after costs."""
    k = F.lit(per_year / h)
    out = []
    for c, tag in (("spread", "gross"), ("net", "net")):
        m, sd = F.avg(c), F.stddev_samp(c)
        out += [(m * k).alias(f"annual_{tag}"), (m / F.nullif(sd, F.lit(0.0)) * F.sqrt(k)).alias(f"sharpe_{tag}")]
    return periods.groupBy("variant").agg(*out, F.avg("turnover").alias("turnover"), F.count("*").alias("rebalances"))


def by_range(daily: DataFrame, cuts: DataFrame, value: str = "net", per_year: int = 252, more_than: int = 20) -> DataFrame:
    """perf_stats per named date range with more than `more_than` days. Ranges are a short hand-written list."""
    d = daily.join(F.broadcast(cuts), F.col("date").between(F.col("start"), F.col("end"))).drop("start", "end")
    return perf_stats(d, value, ("variant", "name"), per_year).where(F.col("days") > more_than)


def yearly(daily: DataFrame, value: str = "net") -> DataFrame:
    return (daily.groupBy("variant", F.year("date").alias("year")).agg((F.product(1 + F.col(value)) - 1).alias("ret")))


def volatility_buckets(daily: DataFrame, market: DataFrame, buckets: int = 5) -> DataFrame:
    """Mean gross and net return by quantile of yesterday's market volatility, edges interpolated over the days."""
    vol = market.select(F.col("t") + 1, "market_vol").toDF("t", "vol")
    d = daily.join(F.broadcast(vol), "t").where(F.col("vol").isNotNull())
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = F.percentile("vol", probs).over(Window.partitionBy("variant"))
    d = d.withColumn("_e", edges).withColumn("bucket", 1 + F.size(F.filter("_e", lambda e: e < F.col("vol"))))
    return d.groupBy("variant", "bucket").agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.count("*").alias("days"))


def side_by_side(stats: DataFrame, variants: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per statistic, one column per variant."""
    long = stats.select("variant", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["variant"], list(names), "stat", "value")
    return long.groupBy("stat").pivot("variant", list(variants)).agg(F.first("value"))


def redate_next(daily: DataFrame, cal: DataFrame) -> DataFrame:
    """Move a series stored on the decision date to the date its return is earned."""
    nxt = cal.select("date", F.lead("date").over(Window.orderBy("date")).alias("_d"))
    return (daily.join(F.broadcast(nxt), "date").where(F.col("_d").isNotNull()).drop("date").withColumnRenamed("_d", "date"))


def sharpe_ratio(r: str) -> Column:
    return F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0))


def moments(daily: DataFrame, value: str = "net", by: Sequence[str] = ("variant",)) -> DataFrame:
    """n, per-period Sharpe, population skewness and (non-excess) kurtosis in one pass."""
    return daily.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), sharpe_ratio(value).alias("sr"), F.skewness(value).alias("skew"),
        (F.kurtosis(value) + 3).alias("kurt"))


def probabilistic(benchmark: Column) -> Column:
    """P(true per-period Sharpe > benchmark) from sr, skew, kurt and n."""
    sr = F.col("sr")
    var = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    return normal_cdf((sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(var))


def deflated(trials: DataFrame, per_year: int = 252) -> DataFrame:
    """The best of the trials against the best expected from luck alone. `trials` holds one row of moments per variant."""
    s = F.struct("sr", "variant", "n", "skew", "kurt")
    a = trials.where(F.col("sr").isNotNull()).agg(F.max(s).alias("b"), F.count("*").alias("trials"), F.var_samp("sr").alias("v"))
    a = a.select("b.*", "trials", F.coalesce("v", F.lit(0.0)).alias("v")).withColumn("hurdle", expected_best("trials", F.col("v")))
    year = F.sqrt(F.lit(float(per_year)))
    return a.select("variant", "sr", (F.col("sr") * year).alias("sharpe_annual"), "trials", "hurdle",
                    (F.col("hurdle") * year).alias("hurdle_annual"), probabilistic(F.lit(0.0)).alias("psr_zero"),
                    probabilistic(F.col("hurdle")).alias("dsr"))
