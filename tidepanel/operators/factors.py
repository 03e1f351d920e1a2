"""Factor residuals, mean-reversion fits, trade states and the stateful hedged book.

The one-factor fit comes from running sums (`running_fit`); only residual paths asked for as such are gathered as arrays.
Trade states are a scan that is parallel inside a symbol. The eigenportfolio fit (see `eigen`) never forms a stock-by-stock matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio, span
from ..functions.statescan import scan_states
from ..session import cut_lineage
from .running_fit import running_fit

TRADING_DAYS = 252


@dataclass(frozen=True)
class FactorConfig:
    """Knobs of the residual mean-reversion strategy."""
    window: int = 60
    corr_window: int = 252
    var_explained: float = 0.55
    n_factors: int | None = None
    min_kappa: float = 252 / 30
    s_open: float = 1.25
    s_close_short: float = 0.75
    s_close_long: float = 0.50
    centre_means: bool = True
    position: float = 0.05
    cost_bps: float = 5.0
    min_names: int = 10
    per_year: int = TRADING_DAYS


# --------------------------------------------------------------------- factor assignment and fits

def hedge_funds(stock: DataFrame, funds: DataFrame, sectors: DataFrame, window: int, fallback: str = "MKT") -> DataFrame:
    """Stock returns with the hedge each symbol uses that day: its sector fund where that fund's whole window is known,
    the fallback otherwise. Adds hedge, f (the day's sector-fund return) and m (the fallback's).

    Funds are a handful of series, but they join by (fund, t) without a hint: Spark broadcasts them when small enough."""
    w = Window.partitionBy("symbol").orderBy("t").rangeBetween(-(window - 1), 0)
    f = funds.select("symbol", "t", "ret", (F.count("ret").over(w) == window).alias("usable"))
    sector = f.select(F.col("symbol").alias("fund"), "t", F.col("ret").alias("f"), "usable")
    market = f.where(F.col("symbol") == fallback).select("t", F.col("ret").alias("m"))
    j = (stock.join(sectors.select("symbol", "fund"), "symbol", "left").join(sector, ["fund", "t"], "left")
         .join(market, "t", "left"))
    return j.withColumn("hedge", F.when(F.coalesce("usable", F.lit(False)), F.col("fund")).otherwise(F.lit(fallback)))


def one_factor(j: DataFrame, window: int) -> DataFrame:
    """Window regression of each stock on its hedge: beta, alpha, r2 and the window's (ret, factor) pairs.

    Needs columns symbol, t, ret, f, m, hedge, fund. The pairs of the fallback and of the sector fund are both at hand,
    so a day's window uses one factor throughout. NULL unless all `window` pairs are known."""
    w = span(window)
    pick = lambda c: F.when(F.col("hedge") == F.col("fund"), F.col(c + "_f")).otherwise(F.col(c + "_m"))
    out = j
    for tag, x in (("f", "f"), ("m", "m")):
        both = F.col("ret").isNotNull() & F.col(x).isNotNull()
        y_, x_ = F.when(both, F.col("ret")), F.when(both, F.col(x))
        out = (out.withColumn(f"n_{tag}", F.count(y_).over(w)).withColumn(f"beta_{tag}", F.regr_slope(y_, x_).over(w))
               .withColumn(f"alpha_{tag}", F.regr_intercept(y_, x_).over(w)).withColumn(f"r2_{tag}", F.regr_r2(y_, x_).over(w)))
    pair = F.struct(F.col("ret").alias("r"), F.col("f").alias("f"), F.col("m").alias("m"))
    out = out.withColumn("pairs", F.collect_list(pair).over(w))
    full = pick("n") == window
    keep = [F.when(full, pick(c)).alias(c) for c in ("beta", "alpha", "r2")]
    return out.select(*j.columns, *keep, F.when(full, F.transform("pairs", lambda p: F.struct(
        p["r"].alias("y"), F.when(F.col("hedge") == F.col("fund"), p["f"]).otherwise(p["m"]).alias("x")))).alias("pairs"))


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))


def ou_from_paths(df: DataFrame, cfg: FactorConfig, path: str = "path") -> DataFrame:
    """kappa, m, sigma_eq and x_last from residual paths; NULL unless 0 < b < 1 and the noise has variance."""
    n = float(cfg.window - 1)
    p = F.col(path)
    df = (df.withColumn("_x", F.slice(p, 1, cfg.window - 1)).withColumn("_y", F.slice(p, 2, cfg.window - 1))
          .withColumn("_xm", _sum(F.col("_x"), lambda v: v) / n).withColumn("_ym", _sum(F.col("_y"), lambda v: v) / n))
    df = df.withColumn("_xy", F.arrays_zip("_x", "_y"))
    sxy = _sum(F.col("_xy"), lambda v: (v["_x"] - F.col("_xm")) * (v["_y"] - F.col("_ym")))
    sxx = _sum(F.col("_x"), lambda v: (v - F.col("_xm")) * (v - F.col("_xm")))
    df = df.withColumn("_b", ratio(sxy, sxx)).withColumn("_a", F.col("_ym") - F.col("_b") * F.col("_xm"))
    zm = _sum(F.col("_xy"), lambda v: v["_y"] - F.col("_a") - F.col("_b") * v["_x"]) / n
    df = df.withColumn("_zm", zm)
    dev = lambda v: v["_y"] - F.col("_a") - F.col("_b") * v["_x"] - F.col("_zm")
    df = df.withColumn("_var", _sum(F.col("_xy"), lambda v: dev(v) * dev(v)) / (n - 1))
    b = F.col("_b")
    ok = (b > 0) & (b < 1) & (F.col("_var") > 0)
    return (df.withColumn("kappa", F.when(ok, -F.ln(b) * cfg.per_year))
            .withColumn("m", F.when(ok, F.col("_a") / (1 - b)))
            .withColumn("sigma_eq", F.when(ok, F.sqrt(F.col("_var") / (1 - b * b))))
            .withColumn("x_last", F.element_at(p, -1)).withColumn("b", b)
            .drop("_x", "_y", "_xm", "_ym", "_xy", "_b", "_a", "_zm", "_var", path))


def residual_path(fit: DataFrame, cfg: FactorConfig) -> DataFrame:
    """Cumulative residuals of each window under that window's own alpha and beta."""
    res = F.transform("pairs", lambda p: p["y"] - (F.col("alpha") + F.col("beta") * p["x"]))
    walk = F.aggregate("_res", F.array().cast("array<double>"), lambda acc, v: F.concat(
        acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))
    return fit.withColumn("_res", res).withColumn("path", walk).drop("_res", "pairs")


def s_scores(ou: DataFrame, cfg: FactorConfig, by=("t",)) -> DataFrame:
    """eligible (kappa above the floor) and s, centred on the mean level m of the eligible names of the date; dates with
    fewer than min_names fits are dropped.

    The date mean and count are one partial aggregate joined back, so no date is gathered in one task. The narrow fit
    rows are written once, since both sides of that join read them."""
    ou = cut_lineage(ou.withColumn("eligible", F.coalesce(F.col("kappa") > cfg.min_kappa, F.lit(False))))
    mean = ou.groupBy(*by).agg(F.avg(F.when(F.col("eligible"), F.col("m"))).alias("_mm"), F.count("*").alias("_names"))
    ou = ou.join(mean.where(F.col("_names") >= cfg.min_names), list(by))
    centre = F.coalesce("_mm", F.lit(0.0)) if cfg.centre_means else F.lit(0.0)
    return ou.withColumn("s", (F.col("x_last") - (F.col("m") - centre)) / F.col("sigma_eq")).drop("_mm", "_names")


def enough_names(fit: DataFrame, cfg: FactorConfig) -> DataFrame:
    """Only complete windows, and only dates with at least `min_names` of them."""
    full = fit.where(F.col("beta").isNotNull())
    dates = full.groupBy("t").agg(F.count("*").alias("_n")).where(F.col("_n") >= cfg.min_names).select("t")
    return full.join(dates, "t", "left_semi")


def fund_fit(stock: DataFrame, funds: DataFrame, sectors: DataFrame, cfg: FactorConfig) -> DataFrame:
    """All days' estimates at once: stock and funds carry (date, symbol, t, ret)."""
    fit = running_fit(hedge_funds(stock, funds, sectors, cfg.window), cfg.window, cfg.per_year)
    return s_scores(fit, cfg)


# --------------------------------------------------------------------- trade states

def _next(state: Column, s: Column, ok: Column, cfg: FactorConfig) -> Column:
    return (F.when(s.isNull(), 0)
            .when(state == 0, F.when(~ok, 0).when(s < -cfg.s_open, 1).when(s > cfg.s_open, -1).otherwise(0))
            .when((state == 1) & (s > -cfg.s_close_long), 0)
            .when((state == -1) & (s < cfg.s_close_short), 0).otherwise(state))


def trade_states(scored: DataFrame, days: DataFrame, cfg: FactorConfig, key=("symbol",)) -> DataFrame:
    """(key, t, i, state): the open/close rule along each symbol's days. `days` (t) lists the days the strategy looks at; a
    day without a score closes the trade. The days' running number `i` shows gaps; see `statescan` for how it is spread."""
    d = days.select("t").distinct().withColumn("i", F.row_number().over(Window.orderBy("t")))
    h = scored.join(F.broadcast(d), "t").select(*key, F.col("t").cast("int").alias("t"), "i", "s", F.col("eligible").alias("ok"))
    rule = lambda before: _next(before, F.col("s"), F.col("ok"), cfg)
    return scan_states(h, key, ("i",), rule, "i").select(*key, "t", "i", "state")


# --------------------------------------------------------------------- books

def fund_book(states: DataFrame, fit: DataFrame, cfg: FactorConfig, frozen: bool = False) -> DataFrame:
    """(t, symbol, weight): stock legs plus, per fund, the negative of their summed beta. frozen keeps the beta and hedge
    of the day the trade opened."""
    open_ = states.where(F.col("state") != 0).join(fit.select("symbol", "t", "beta", "hedge"), ["symbol", "t"])
    if frozen:
        open_ = islands(states).where(F.col("state") != 0).join(fit.select("symbol", "t", "beta", "hedge"), ["symbol", "t"])
        w = Window.partitionBy("symbol", "island").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        open_ = open_.withColumn("beta", F.first("beta").over(w)).withColumn("hedge", F.first("hedge").over(w))
    pos = F.col("state") * F.lit(cfg.position)
    legs = open_.select("t", F.explode(F.array(
        F.struct(F.col("symbol").alias("symbol"), pos.alias("w")),
        F.struct(F.col("hedge").alias("symbol"), (-pos * F.col("beta")).alias("w")))).alias("leg"))
    return legs.groupBy("t", F.col("leg.symbol").alias("symbol")).agg(F.sum("leg.w").alias("weight"))


def islands(states: DataFrame, key=("symbol",)) -> DataFrame:
    """Adds `island`, a running number of each stretch of one state, and closes a trade on the first day without a row."""
    w = Window.partitionBy(*key).orderBy("t")
    prev, gap = F.lag("state").over(w), F.col("i") - F.lag("i").over(w)
    new = (prev.isNull() | (prev != F.col("state")) | (gap > 1)).cast("int")
    return states.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def hedged_returns(fit: DataFrame, stock: DataFrame, funds: DataFrame) -> DataFrame:
    """(symbol, t, hedged): next day's stock return minus beta times its hedge's, both missing values as no move."""
    nxt = lambda df, name: df.select("symbol", (F.col("t") - 1).alias("t"), F.col("ret").alias(name))
    j = (fit.select("symbol", "t", "beta", "hedge").join(nxt(stock, "rs"), ["symbol", "t"], "left")
         .join(nxt(funds, "rf").withColumnRenamed("symbol", "hedge"), ["hedge", "t"], "left"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.withColumn("hedged", z("rs") - F.col("beta") * z("rf"))


def stateful_backtest(book: DataFrame, states: DataFrame, days: DataFrame, returns: DataFrame, cal: DataFrame,
                      cfg: FactorConfig) -> DataFrame:
    """Daily series of a stateful book. Weights set at day t earn day t+1, where the result is stored; turnover is
    charged there too. `days` (t) are the estimation days, `returns` the next-day returns of stocks and funds."""
    last = cal.select(F.max("t")).scalar()
    d = days.where(F.col("t") < last).select("t")
    nxt = returns.select("symbol", (F.col("t") - 1).alias("t"), "ret")
    gross = (book.join(nxt, ["symbol", "t"], "left").groupBy("t")
             .agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross")))
    order = d.withColumn("nt", F.lead("t").over(Window.orderBy("t")))
    legs = book.join(F.broadcast(order), "t").select("symbol", F.explode(F.array(
        F.struct(F.col("t").alias("t"), F.col("weight").alias("w")),
        F.struct(F.col("nt").alias("t"), (-F.col("weight")).alias("w")))).alias("m"))
    turn = (legs.where(F.col("m.t").isNotNull()).groupBy(F.col("m.t").alias("t"), "symbol").agg(F.sum("m.w").alias("dw"))
            .groupBy("t").agg(F.sum(F.abs("dw")).alias("turnover")))
    n = states.groupBy("t").agg(F.count(F.when(F.col("state") > 0, 1)).alias("n_long"),
                                F.count(F.when(F.col("state") < 0, 1)).alias("n_short"))
    z = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    out = d.join(gross, "t", "left").join(turn, "t", "left").join(n, "t", "left")
    out = out.select((F.col("t") + 1).alias("t"), z("gross", 0.0), z("turnover", 0.0), z("n_long", 0), z("n_short", 0))
    return (out.withColumn("net", F.col("gross") - F.col("turnover") * cfg.cost_bps / 1e4)
            .join(F.broadcast(cal), "t"))


def trade_log(states: DataFrame, days: DataFrame, fit: DataFrame, pnl: DataFrame, cal: DataFrame) -> DataFrame:
    """One row per closed trade: side, entry, exit, days, summed hedged P&L and the estimates at entry.

    pnl (symbol, t, hedged) is what one long unit earns after day t. A trade closes on the first strategy day whose
    state differs; trades still open at the end are left out."""
    d = days.withColumn("i", F.row_number().over(Window.orderBy("t")))
    isl = islands(states).where(F.col("state") != 0)
    g = (isl.join(pnl.select("symbol", "t", "hedged"), ["symbol", "t"], "left").groupBy("symbol", "island")
         .agg(F.first("state").alias("side"), F.min("t").alias("t0"), F.max("i").alias("i1"),
              F.sum(F.col("state") * F.coalesce("hedged", F.lit(0.0))).alias("pnl")))
    ends = d.select((F.col("i") - 1).alias("i1"), F.col("t").alias("t1"))
    at = lambda name, t: F.broadcast(cal.select(F.col("t").alias(t), F.col("date").alias(name)))
    entry = fit.select("symbol", F.col("t").alias("t0"), F.col("s").alias("s_entry"), "kappa", "sigma_eq", "r2", "alpha")
    return (g.join(F.broadcast(ends), "i1").join(at("entry", "t0"), "t0").join(at("exit", "t1"), "t1")
            .join(entry, ["symbol", "t0"]).withColumn("days", F.col("t1") - F.col("t0"))
            .select("symbol", "side", "entry", "exit", "days", "pnl", "s_entry", "kappa", "sigma_eq", "r2", "alpha", "t0"))


def reversion_time(fit: DataFrame, cfg: FactorConfig) -> Column:
    return cfg.per_year / F.col("kappa")
