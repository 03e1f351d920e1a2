"""Books to daily series. Many variants share one job: `variant` is part of every key.

Turnover compares each book with the one before it by adding +w on its own date and -w on the next book date, so no
full outer join and no dense weight grid is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import place, qcut_group, size
from ..functions.frames import ratio
from ..session import cut_lineage


def _moves(book: DataFrame, dates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(variant, t, symbol, dw): change of every weight at each book date. `dates` lists the book dates of a variant."""
    nxt = dates.select(*keys, "t", F.lead("t").over(Window.partitionBy(*keys).orderBy("t")).alias("_next"))
    legs = book.where(F.col("weight") != 0).join(nxt, [*keys, "t"])
    both = legs.select(*keys, "symbol", F.explode(F.array(
        F.struct(F.col("t").alias("at"), F.col("weight").alias("w")),
        F.struct(F.col("_next").alias("at"), (-F.col("weight")).alias("w")))).alias("m"))
    return (both.where(F.col("m.at").isNotNull()).groupBy(*keys, F.col("m.at").alias("t"), "symbol")
            .agg(F.sum("m.w").alias("dw")))


def turnover(book: DataFrame, dates: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Sum of absolute weight changes per date, names that vanish included; the first date is the whole book."""
    return _moves(book, dates, keys).groupBy(*keys, "t").agg(F.sum(F.abs("dw")).alias("turnover"))


def long_short(book: DataFrame, dates: DataFrame, cost_bps=5.0, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Daily gross, legs, turnover and net of a book whose rows carry their own next-period return `fwd`.

    `dates` (keys, t, date) lists every book date: a date without positions is still a row. `cost_bps` may be a column
    of `dates`."""
    r = F.col("weight") * F.coalesce("fwd", F.lit(0.0))
    pnl = book.groupBy(*keys, "t").agg(
        F.sum(r).alias("gross"), F.sum(F.when(F.col("weight") > 0, r)).alias("long_leg"),
        F.sum(F.when(F.col("weight") < 0, r)).alias("short_leg"))
    cost = F.lit(float(cost_bps)) if not isinstance(cost_bps, Column) else cost_bps
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    d = (dates.join(pnl, [*keys, "t"], "left").join(turnover(book, dates, keys), [*keys, "t"], "left"))
    d = d.select(*dates.columns, zero("gross"), zero("long_leg"), zero("short_leg"), zero("turnover"))
    return d.withColumn("net", F.col("gross") - F.col("turnover") * cost / 1e4)


def book_dates(scored: DataFrame, keys: Sequence[str] = ("variant",), extra: Sequence[str] = ()) -> DataFrame:
    """Dates with scores whose next return is known for at least one name."""
    return (scored.groupBy(*keys, *extra, "t", "date").agg(F.count("fwd").alias("_known"))
            .where(F.col("_known") > 0).drop("_known"))


def schedule(scored: DataFrame, every: int, need: int, start_t: int | None = None) -> DataFrame:
    """Rebalance dates: every n-th date from the first scored one, where at least `need` names have a score."""
    if int(every) < 1:
        raise ValueError(f"a schedule needs a step of one day or more, not {every!r}")
    d = scored.groupBy("date", "t").agg(F.count("score").alias("scored"))
    first = d.select(F.min("t")).scalar() if start_t is None else F.lit(start_t)
    return d.where((F.pmod(F.col("t") - first, F.lit(every)) == 0) & (F.col("scored") >= need))


def drifting(targets: DataFrame, returns: DataFrame, days: DataFrame, cost_bps: float) -> DataFrame:
    """Backtest of books that float between rebalances, without a day loop.

    A book set at r is worth V = 1 + sum w (G - 1) later, G being a name's growth since r; its drifted weights are
    w G / V. targets (variant, t, symbol, weight) hold the rebalance books, returns (symbol, t, ret), days (variant, t,
    date) every day of the run. The first day with nothing left, or a cost of everything, ends the run: net -100%, then
    NULL.
    """
    targets = cut_lineage(targets.where(F.col("weight") != 0))      # a few names per rebalance, read five times
    reb = targets.select("variant", "t").distinct()
    end = days.groupBy("variant").agg(F.max("t").alias("_end"))
    seg = (reb.join(end, "variant")
           .select("variant", F.col("t").alias("r"),
                   F.coalesce(F.lead("t").over(Window.partitionBy("variant").orderBy("t")), F.col("_end")).alias("to")))
    held = (targets.withColumnRenamed("t", "r").join(seg, ["variant", "r"])
            .select("variant", "r", "to", "symbol", "weight", F.explode(F.sequence("r", "to")).alias("t"))
            .join(returns.select("symbol", "t", "ret"), ["symbol", "t"], "left"))
    step = F.when(F.col("t") == F.col("r"), 1.0).otherwise(1.0 + F.coalesce("ret", F.lit(0.0)))
    path = Window.partitionBy("variant", "r", "symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    held = cut_lineage(held.withColumn("growth", F.product(step).over(path)))
    value = held.groupBy("variant", "r", "t").agg((1 + F.sum(F.col("weight") * (F.col("growth") - 1))).alias("value"))
    along = Window.partitionBy("variant", "r").orderBy("t")
    day = (value.withColumn("gross", ratio("value", F.lag("value").over(along)) - 1)
           .where(F.col("t") > F.col("r")).select("variant", "t", "gross"))
    drifted = (held.where((F.col("t") == F.col("to")) & (F.col("to") > F.col("r"))).join(value, ["variant", "r", "t"])
               .select("variant", "t", "symbol", (-ratio(F.col("weight") * F.col("growth"), "value")).alias("w")))
    fresh = targets.select("variant", "t", "symbol", F.col("weight").alias("w"))
    drifted = drifted.join(reb, ["variant", "t"], "left_semi")
    turn = (fresh.unionByName(drifted).groupBy("variant", "t", "symbol").agg(F.sum("w").alias("dw"))
            .groupBy("variant", "t").agg(F.sum(F.abs("dw")).alias("turnover")))
    d = (days.join(day, ["variant", "t"], "left").join(turn, ["variant", "t"], "left")
         .withColumn("rebalanced", F.col("turnover").isNotNull())
         .withColumn("gross", F.coalesce("gross", F.lit(0.0))).withColumn("turnover", F.coalesce("turnover", F.lit(0.0))))
    rate = F.lit(float(cost_bps) / 1e4)
    dead = 1 + F.col("gross") <= 0
    v = Window.partitionBy("variant")
    d = d.withColumn("cost", F.when(dead, 0.0).otherwise(rate * F.col("turnover")))
    d = d.withColumn("_blown", F.min(F.when(dead | (F.col("cost") >= 1), F.col("t"))).over(v))
    alive = F.col("_blown").isNull() | (F.col("t") < F.col("_blown"))
    at = F.col("t") == F.col("_blown")
    d = (d.withColumn("net", F.when(alive, (1 + F.col("gross")) * (1 - F.col("cost")) - 1).when(at, -1.0))
         .withColumn("gross", F.when(alive | at, F.col("gross")).otherwise(0.0))
         .withColumn("turnover", F.when(alive, F.col("turnover")).otherwise(0.0))
         .withColumn("cost", F.when(alive | at, F.col("cost")).otherwise(0.0))
         .withColumn("rebalanced", (alive & F.col("rebalanced")).cast("int"))
         .withColumn("blown_up", F.col("_blown").isNotNull().cast("int")))
    grow = F.product(1 + F.coalesce("net", F.lit(0.0)))
    return d.withColumn("equity", grow.over(v.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).drop("_blown")


def run_backtest(scores: DataFrame, returns: DataFrame, n_long: int, n_short: int, every: int, cost_bps: float) -> DataFrame:
    """Drifting backtest of a forecast panel (variant, t, date, symbol, score): a book on every `every`-th day from the
    panel's first, held where too few names have a forecast."""
    from .portfolio import weights_from_forecasts
    days = scores.select("variant", "t", "date").distinct()
    order = days.withColumn("_i", F.row_number().over(Window.partitionBy("variant").orderBy("t")) - 1)
    due = order.where(F.pmod(F.col("_i"), F.lit(every)) == 0).select("variant", "t")
    books = weights_from_forecasts(scores.join(due, ["variant", "t"], "left_semi"), ["variant", "t"], n_long, n_short)
    return drifting(books.select("variant", "t", "symbol", "weight"), returns, days, cost_bps)


def equal_weight_targets(symbols: DataFrame, rebalances: DataFrame, n: Column) -> DataFrame:
    """1/N of every symbol at each rebalance date (variant, t). The dates, bounded by the calendar, travel to the
    symbols, never the other way round."""
    dates = rebalances.select(F.collect_list(F.struct("variant", "t"))).scalar()
    return (symbols.select("symbol", F.explode(dates).alias("d"))
            .select("d.variant", "d.t", "symbol", (1.0 / n).alias("weight")))


def decile_periods(scores: DataFrame, panel: DataFrame, cal: DataFrame, h: int, start_t: int = 0, n_deciles: int = 10):
    """(picks, path) of the buy-and-hold decile rule: every h-th day from `start_t` whose holding period is over, with
    at least two names per decile. path has every held name's growth since the pick, prices carried forward over gaps.
    """
    last = cal.select(F.max("t")).scalar()
    on = F.col("t") - start_t
    priced = panel.where(F.col("adj_close").isNotNull()).select("symbol", "t", "adj_close")
    s = (scores.where((on >= 0) & (F.pmod(on, F.lit(h)) == 0) & F.col("score").isNotNull() & (F.col("t") + h <= last))
         .join(priced, ["symbol", "t"]))
    by = ["variant", "t"]
    picks = s.repartition(*by).select("variant", F.col("t").alias("p"), "symbol", F.col("adj_close").alias("p0"),
                                      size("*", by).alias("n"),
                                      place([F.col("score"), F.col("symbol")], by).alias("_r"))
    picks = (picks.where(F.col("n") >= 2 * n_deciles).withColumn("decile", qcut_group("_r", "n", n_deciles)).drop("_r"))
    held = (picks.withColumn("t", F.explode(F.sequence(F.col("p") + 1, F.col("p") + h)))
            .join(priced, ["symbol", "t"], "left"))
    path = Window.partitionBy("variant", "p", "symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.coalesce(F.last("adj_close", ignorenulls=True).over(path), F.col("p0"))
    return picks, held.withColumn("growth", carried / F.col("p0"))


def decile_backtest(scores: DataFrame, panel: DataFrame, cal: DataFrame, h: int, start_t: int = 0, n_deciles: int = 10,
                    cost_bps: float = 5.0) -> dict[str, DataFrame]:
    """periods, deciles and daily series of the top-minus-bottom decile book held h days."""
    picks, held = (cut_lineage(d) for d in decile_periods(scores, panel, cal, h, start_t, n_deciles))
    top, low = F.col("decile") == n_deciles, F.col("decile") == 1
    side = held.where(top | low)
    value = side.groupBy("variant", "p", "t").agg(F.avg(F.when(top, F.col("growth"))).alias("l"),
                                                  F.avg(F.when(low, F.col("growth"))).alias("s"))
    last = F.col("t") == F.col("p") + h
    ends = value.where(last).select("variant", "p", "l", "s")
    counts = picks.groupBy("variant", "p").agg(F.max("n").alias("n"), F.count(F.when(top, 1)).alias("nl"),
                                               F.count(F.when(low, 1)).alias("ns"))
    each = F.when(top, 1.0 / F.col("nl")).otherwise(-1.0 / F.col("ns"))
    new = (picks.where(top | low).join(counts.drop("n"), ["variant", "p"])
           .select("variant", F.col("p").alias("at"), "symbol", each.alias("w")))
    old = (side.where(last).join(counts.drop("n"), ["variant", "p"])
           .select("variant", F.col("t").alias("at"), "symbol", (-each * F.col("growth")).alias("w")))
    turn = (new.unionByName(old).groupBy("variant", "at", "symbol").agg(F.sum("w").alias("dw"))
            .groupBy("variant", F.col("at").alias("p")).agg(F.sum(F.abs("dw")).alias("turnover")))
    day = lambda name, t: F.broadcast(cal.select(F.col("t").alias(t), F.col("date").alias(name)))
    periods = (ends.join(counts.select("variant", "p", "n"), ["variant", "p"]).join(turn, ["variant", "p"])
               .withColumn("_f", F.col("p") + 1).withColumn("_l", F.col("p") + h)
               .join(day("date", "p"), "p").join(day("first_day", "_f"), "_f").join(day("last_day", "_l"), "_l")
               .withColumn("cost", F.col("turnover") * cost_bps / 1e4)
               .select("variant", "date", "p", (F.col("l") - 1).alias("long"), (F.col("s") - 1).alias("short"),
                       (F.col("l") - F.col("s")).alias("spread"), "n", "turnover", "cost",
                       (F.col("l") - F.col("s") - F.col("cost")).alias("net"), "first_day", "last_day"))
    w = Window.partitionBy("variant", "p").orderBy("t")
    x = F.col("l") - F.col("s")
    daily = (value.withColumn("gross", x - F.coalesce(F.lag(x).over(w), F.lit(0.0)))
             .join(periods.select("variant", "p", "cost"), ["variant", "p"])
             .withColumn("net", F.col("gross") - F.when(F.col("t") == F.col("p") + 1, F.col("cost")).otherwise(0.0))
             .join(F.broadcast(cal), "t").select("variant", "date", "t", "gross", "net"))
    deciles = (held.where(last).groupBy("variant", "p", "decile").agg(F.avg(F.col("growth") - 1).alias("ret"))
               .join(day("date", "p"), "p").select("variant", "date", "decile", "ret"))
    return {"periods": periods, "daily": daily, "deciles": deciles}


def window_daily(daily: DataFrame, start, end) -> DataFrame:
    return daily.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def window_trades(trades: DataFrame, start, end) -> DataFrame:
    """Trades that open and close inside the range."""
    return trades.where((F.col("entry") >= F.lit(start).cast("date")) & (F.col("exit") <= F.lit(end).cast("date")))


def window_periods(result: dict[str, DataFrame], start, end) -> dict[str, DataFrame]:
    """Rebalances inside the range with exactly the days they held."""
    p = result["periods"].where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    span = p.groupBy("variant").agg(F.min("first_day").alias("_a"), F.max("last_day").alias("_z"))
    daily = (result["daily"].join(F.broadcast(span), "variant")
             .where(F.col("date").between(F.col("_a"), F.col("_z"))).drop("_a", "_z"))
    deciles = result["deciles"].join(p.select("variant", "date"), ["variant", "date"], "left_semi")
    return {"periods": p, "daily": daily, "deciles": deciles}


def volatility_filter(daily: DataFrame, market: DataFrame, threshold: float) -> DataFrame:
    """Flat unless yesterday's market volatility is above the threshold."""
    vol = market.select(F.col("t") + 1, "market_vol").toDF("t", "prior_vol")
    return daily.join(F.broadcast(vol), "t", "left").withColumn(
        "net", F.when(F.col("prior_vol") > threshold, F.col("net")).otherwise(0.0))


def cost_per_year(turnover_col, rebalance_days, cost_bps: float = 5.0, per_year: int = 252) -> Column:
    return F.col(turnover_col) * cost_bps / 1e4 * per_year / F.col(rebalance_days)
