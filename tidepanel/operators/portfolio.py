"""Scores to weights. Every rule states its tie order; weights of zero are implied unless a rule needs the row."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import place, qcut_group, size
from ..functions.frames import clean, col


def _counts(n_long: int, n_short: int) -> None:
    for n in (n_long, n_short):
        if isinstance(n, bool) or int(n) != n or n < 0:
            raise ValueError(f"a leg holds a whole, non-negative number of names; {n!r} is none")
    if n_long + n_short < 1:
        raise ValueError("a book without names on either leg")


def forecast_problems(df: DataFrame, by: Sequence[str], need: int, score: str = "score") -> DataFrame:
    """One row per group that cannot be turned into a book: a symbol twice, or too few finite forecasts."""
    per = df.groupBy(*by, "symbol").agg(F.count("*").alias("n"), F.count(clean(score)).alias("ok"))
    g = per.groupBy(*by).agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicates"), F.sum("ok").alias("forecasts"))
    return g.where((F.col("duplicates") > 0) | (F.col("forecasts") < need))


def weights_from_forecasts(df: DataFrame, by: Sequence[str], n_long: int, n_short: int, score: str = "score") -> DataFrame:
    """+1/n_long for the first n_long by (score descending, symbol), -1/n_short for the last n_short, else 0."""
    _counts(n_long, n_short)
    s = F.col("_s")
    w = Window.partitionBy(*by, s.isNull())
    r = F.row_number().over(w.orderBy(s.desc(), F.col("symbol")))
    n = F.count("*").over(w)
    weight = (F.when(s.isNotNull() & (F.col("_r") <= n_long), 1.0 / max(n_long, 1))
              .when(s.isNotNull() & (F.col("_r") > F.col("_n") - n_short), -1.0 / max(n_short, 1)).otherwise(0.0))
    return (df.withColumn("_s", clean(score)).withColumn("_r", r).withColumn("_n", n)
            .withColumn("_ok", F.max(F.when(s.isNotNull(), F.col("_n"))).over(Window.partitionBy(*by)) >= n_long + n_short)
            .where("_ok").withColumn("weight", weight).drop("_s", "_r", "_n", "_ok"))


def two_way_places(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """hi: place from the best, lo: place from the worst, both with the symbol breaking ties upward; n: names."""
    s, y = F.col(score), F.col("symbol")
    return df.where(s.isNotNull()).repartition(*by).select(
        "*", place([s.desc(), y], by).alias("hi"), place([s, y], by).alias("lo"), size("*", by).alias("n"))


def daily_weights(df: DataFrame, by: Sequence[str], k, score: str = "score") -> DataFrame:
    """+1/k for the k highest, -1/k for the k lowest of each group with at least 2k names; a short overrides a long.

    `k` may be a column, so one ranking serves a grid of variants."""
    k = F.lit(k) if isinstance(k, int) else col(k)
    ok = F.col("n") >= 2 * k
    w = F.when(ok & (F.col("lo") <= k), -1.0 / k).when(ok & (F.col("hi") <= k), 1.0 / k).otherwise(0.0)
    return two_way_places(df, by, score).withColumn("weight", w)


def wide_picks(df: DataFrame, by: Sequence[str], k: int, score: str = "score") -> DataFrame:
    """The same book over a universe of any size: only 2k names per group survive.

    Filtering row_number <= k lets Spark keep k rows per group in every map task before the shuffle."""
    by = list(by)
    s, y = F.col(score), F.col("symbol")
    df = df.where(s.isNotNull())
    enough = df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= 2 * k).select(*by)
    pick = lambda order, w: (df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
                             .where(F.col("_r") <= k).drop("_r").withColumn("weight", F.lit(w)))
    book = pick([s.desc(), y], 1.0 / k).unionByName(pick([s, y], -1.0 / k))
    return book.join(enough, by, "left_semi")


def live_weights(df: DataFrame, by: Sequence[str], k: int, gross: float = 1.0, score: str = "score") -> DataFrame:
    """+-gross/2k: the first k and the last k of one ascending (score, symbol) order."""
    return sized_weights(df, by, F.lit(k), F.lit(k), gross, score)


def sized_weights(df: DataFrame, by: Sequence[str], n_long: Column, n_short: Column, gross: float = 1.0,
                  score: str = "score") -> DataFrame:
    s, y = F.col(score), F.col("symbol")
    r = df.where(s.isNotNull()).repartition(*by).select("*", place([s, y], by).alias("_r"), size("*", by).alias("_n"))
    w = (F.when(F.col("_r") <= n_short, -gross / 2 / n_short).when(F.col("_r") > F.col("_n") - n_long, gross / 2 / n_long)
         .otherwise(0.0))
    return r.where(F.col("_n") >= n_long + n_short).withColumn("weight", w).drop("_r", "_n")


def decile_sizes(df: DataFrame, by: Sequence[str], n: int = 10, score: str = "score") -> DataFrame:
    """Names in the top and bottom group of each date."""
    s = F.col(score)
    r = df.where(s.isNotNull()).repartition(*by).select(
        *by, qcut_group(place([s, F.col("symbol")], by), size("*", by), n).alias("decile"))
    return r.groupBy(*by).agg(F.count(F.when(F.col("decile") == n, 1)).alias("n_long"),
                              F.count(F.when(F.col("decile") == 1, 1)).alias("n_short"), F.count("*").alias("scored"))


def weights_with_borrow(df: DataFrame, by: Sequence[str], k: int, gross: float = 1.0, score: str = "score") -> DataFrame:
    """Live weights whose shorts can be borrowed; `shortable` is a column (NULL: could not check, kept).

    The k shorts are the lowest names not known to be blocked. Blocked names ranked below the last of them are skipped:
    they leave the ranking and stay in the book at weight 0. The longs are the top k of what remains.
    status: ok, or too_few where fewer than 2k names remain.
    """
    by = list(by)
    s, y = F.col(score), F.col("symbol")
    g = Window.partitionBy(*by)
    up = g.orderBy(s, y)
    free = F.coalesce(F.col("shortable"), F.lit(True))
    r = df.where(s.isNotNull()).repartition(*by).select("*", F.row_number().over(up).alias("_r"), free.alias("_free"))
    r = r.withColumn("_nfree", F.sum(F.col("_free").cast("int")).over(g.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("_free") & (F.col("_nfree") == k), F.col("_r"))).over(g)
    r = r.withColumn("_last", F.coalesce(last, F.lit(1 << 30)))
    r = r.withColumn("skipped", ~F.col("_free") & (F.col("_r") < F.col("_last")))
    kept = F.count(F.when(~F.col("skipped"), 1))
    r = r.withColumn("_kept", kept.over(g)).withColumn(
        "_top", kept.over(g.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)))
    w = (F.when(F.col("skipped"), 0.0)
         .when(F.col("_free") & (F.col("_r") <= F.col("_last")), -gross / (2.0 * k))
         .when(F.col("_top") <= k, gross / (2.0 * k)).otherwise(0.0))
    return (r.withColumn("status", F.when(F.col("_kept") >= 2 * k, "ok").otherwise("too_few"))
            .withColumn("weight", F.when(F.col("status") == "ok", w)).drop("_r", "_free", "_nfree", "_last", "_kept", "_top"))


def band_candidates(df: DataFrame, by: Sequence[str], k, exit_k, score: str = "score") -> DataFrame:
    """The only rows a banded book can touch: a held name survives within exit_k of an end, and refilling a leg of k
    names never looks past place 2k. At most 4 * max(exit_k, 2k) rows per date, whatever the universe.

    hi is the place by (score descending, symbol); lo reads the same order from the other end."""
    by = list(by)
    s = F.col(score)
    reach = F.greatest(F.lit(exit_k) if isinstance(exit_k, int) else col(exit_k),
                       2 * (F.lit(k) if isinstance(k, int) else col(k)))
    r = df.where(s.isNotNull()).repartition(*by).select("*", place([s.desc(), F.col("symbol")], by).alias("hi"),
                                                        size("*", by).alias("n"))
    r = r.withColumn("lo", F.col("n") - F.col("hi") + 1)
    return r.where((F.col("hi") <= reach) | (F.col("lo") <= reach))


class _Band:
    """The state of one banded book: which names it holds on each side. A day's candidates come in ranking order."""

    def __init__(self, k: int, exit_k: int):
        self.k, self.exit_k, self.side = k, exit_k, {}

    def step(self, names: list, from_top: list, from_bottom: list, n: int) -> dict:
        """The side of every name held after the day: +1 or -1."""
        if n < 2 * self.k:
            self.side = {}
            return {}
        place = {+1: dict(zip(names, from_top)), -1: dict(zip(names, from_bottom))}
        near = lambda s, x: place[s].get(x, float("inf"))        # not ranked today: it leaves
        held = {x: s for x, s in self.side.items() if near(s, x) <= self.exit_k}
        for s in (+1, -1):                       # longs choose first; a name is on one side only
            room = self.k - sum(v == s for v in held.values())
            free = sorted((x for x in names if x not in held), key=lambda x: near(s, x))
            held |= dict.fromkeys(free[:max(room, 0)], s)
        self.side = held
        return held


def banded_weights(candidates: DataFrame) -> DataFrame:
    """Books that keep a name until it leaves the best (worst) exit_k. Each date depends on the last one's whole book, so
    a variant is walked in date order over its `band_candidates` only; variants run in parallel. Days are packed into
    one row each, sorted by Spark, and pass through the task in batches: it holds a batch and the book, not the history.

    Columns in: variant, k, exit_k, t, symbol, hi, lo, n."""
    name = F.struct("hi", "lo", "symbol")
    days = (candidates.groupBy("variant", "k", "exit_k", "t").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(name)).alias("c"))
            .repartition("variant").sortWithinPartitions("variant", "t"))

    def walk(batches):
        books: dict = {}
        for pdf in batches:
            out = []
            for v, k, e, t, n, c in pdf[["variant", "k", "exit_k", "t", "n", "c"]].itertuples(index=False):
                if v not in books:
                    books = {v: _Band(int(k), int(e))}            # variants follow one another in a sorted partition
                side = books[v].step([x["symbol"] for x in c], [x["hi"] for x in c], [x["lo"] for x in c], int(n))
                out += [(v, int(t), x, s / float(k)) for x, s in side.items()]
            yield pd.DataFrame(out, columns=["variant", "t", "symbol", "weight"]).astype({"t": "int32"})

    return days.mapInPandas(walk, "variant string, t int, symbol string, weight double")
