"""Ranks, quantile groups and top-k picks within a date (or any group).

`narrow` ranks use one window per group: right where a group is a universe of instruments. `wide_rank` is for groups
of any size (a pooled table, a universe that grows with the data): it deals rows by value ranges, takes places inside a
range, and adds the counts of the lower ranges. It is exact, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .frames import col

DATE = ("date",)


def avg_rank(x, by=DATE) -> Column:
    """Average-tie rank of x among the non-NULL values of its group: the mean of the first and last place of its tie.

    Both counts share one window. Repartition by the group first when ranking several columns, so one shuffle serves all.
    """
    x = col(x)
    w = Window.partitionBy(*[F.col(b) for b in by], x.isNull()).orderBy(x)
    upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2.0)


def place(order: list[Column], by=DATE) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def size(x="*", by=DATE) -> Column:
    return F.count(F.lit(1) if x == "*" else col(x)).over(Window.partitionBy(*by))


def ceil_group(rank, n_rows, groups: int) -> Column:
    """ceil(rank / size * groups) in whole numbers."""
    return F.floor((col(rank) * groups + col(n_rows) - 1) / col(n_rows)).cast("bigint")


def qcut_group(rank, n_rows, groups: int) -> Column:
    """Equal-count group by interpolated quantile edges of the ranks 1..size, in whole numbers."""
    n = F.nullif(col(n_rows) - 1, F.lit(0))
    raw = F.floor(((col(rank) - 1) * groups + col(n_rows) - 2) / n)
    return F.greatest(F.lit(1), F.coalesce(raw, F.lit(1))).cast("bigint")


def _small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a written table of at most `most` rows, counted; else the plain table."""
    return F.broadcast(df) if df.count() <= most else df


def wide_rank(df: DataFrame, by: list[str], x: str, tie: list[str], prefix: str = "") -> DataFrame:
    """Adds {prefix}place (1..n by x then `tie`), {prefix}rank (average ties) and {prefix}size to the rows with a known x.

    The input is written once and dealt by ranges of (group, x, tie), so a group, or a value, of any size is cut where
    the ranges fall; the number of ranges is the session's number of shuffle partitions. A row's place is its place in its
    range plus the rows of the group in earlier ranges. Ties are counted inside a range; only values at the ends of
    ranges can reach over several, and those are few and counted apart. No exchange is on the group alone, but for the
    table of ranges.
    """
    by, keys = list(by), [*by, x, *tie]
    df = materialise(df.where(F.col(x).isNotNull()), "rank-input")
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    ranged = materialise(ranged, "rank-ranges")
    parts = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.min(x).alias("_min"), F.max(x).alias("_max"))
    group = Window.partitionBy(*by)
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialise(parts.withColumn("_shift", F.coalesce(before, F.lit(0)) - F.col("_first") + 1).withColumn(f"{prefix}size", F.sum("_n").over(group)),
                        "rank-parts")
    rows = ranged.join(_small(parts.drop("_n", "_first", "_min", "_max")), [*by, "_part"])
    rows = rows.withColumn(f"{prefix}place", F.col("_at") + F.col("_shift")).drop("_at", "_shift")
    ends = parts.select(*by, F.explode(F.array_distinct(F.array("_min", "_max"))).alias(x))
    over = ends.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    over = rows.join(_small(materialise(over, "rank-ends")), [*by, x]).groupBy(*by, x).agg(
        F.min(f"{prefix}place").alias("_over_low"), F.count(F.lit(1)).alias("_over_n"))
    inside = Window.partitionBy("_part", *by, x)
    rows = rows.withColumn("_low", F.min(f"{prefix}place").over(inside)).withColumn("_same", F.count(F.lit(1)).over(inside))
    rows = rows.join(_small(materialise(over, "rank-over")), [*by, x], "left")
    rank = F.coalesce("_over_low", "_low") + (F.coalesce("_over_n", "_same") - 1) / 2.0
    return rows.withColumn(f"{prefix}rank", rank).select(*df.columns, f"{prefix}place", f"{prefix}rank", f"{prefix}size")


def safe_corr(a, b, over=None) -> Column:
    """Pearson correlation of the rows that have both values, of a group or of the window `over`; NULL where either side
    is constant. Built from the covariance: `corr` divides by zero there, an error that a condition around it cannot stop."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    of = lambda agg: agg if over is None else agg.over(over)
    c = F.try_divide(of(F.covar_pop(x, y)), of(F.stddev_pop(x)) * of(F.stddev_pop(y)))
    flat = (of(F.min(x)) == of(F.max(x))) | (of(F.min(y)) == of(F.max(y)))
    return F.when(~flat & ~F.isnan(c), c)


def rank_corr(a, b) -> Column:
    """Correlation of two average-rank columns over the same rows of a group; NULL where either side is one tie.

    Average ranks of n values are halves that add up to n (n + 1) / 2, so with doubled ranks every sum is a whole number
    and a correlation of nothing is exactly 0, whatever the order of the rows."""
    whole = lambda x: F.rint(2 * col(x)).cast("decimal(19,0)")
    n = F.count(F.lit(1)).cast("decimal(12,0)")
    mean = (n * (n + 1) * (n + 1)).cast("decimal(38,0)")
    dot = lambda x, y: (F.sum((whole(x) * whole(y)).cast("decimal(38,0)")) - mean).cast("double")
    xx, yy = dot(a, a), dot(b, b)
    return F.when((xx > 0) & (yy > 0), dot(a, b) / (F.sqrt(xx) * F.sqrt(yy)))


def wide_percentiles(df: DataFrame, by: list[str], x: str, probs: list[float], tie: list[str], names: list[str]) -> DataFrame:
    """Exact interpolated percentiles per group, read off the places of `wide_rank`."""
    r = wide_rank(df, by, x, tie)
    out = []
    for p, name in zip(probs, names):
        at = (F.col("size") - 1) * F.lit(float(p))
        lo = F.max(F.when(F.col("place") == F.floor(at) + 1, F.col(x)))
        hi = F.max(F.when(F.col("place") == F.ceil(at) + 1, F.col(x)))
        frac = F.max(at - F.floor(at))
        out.append((lo + (hi - lo) * frac).alias(name))
    return r.groupBy(*by).agg(*out)
