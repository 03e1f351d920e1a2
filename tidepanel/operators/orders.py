"""Plan jobs: target books and positions to order tables, for every account at once.

`account_id` is part of each key, so a plan for millions of accounts is the same joins with more rows. The jobs end at
the order table; nothing here talks to a broker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import clean
from .factors import FactorConfig, _next

#: Labels of orders that make a position smaller; the others are open and add to, long and short.
REDUCING = ("close long", "reduce long", "close short", "reduce short")


def trunc(x: Column) -> Column:
    """Whole part, toward zero."""
    return x.cast("bigint").cast("double")


def cents(x: Column) -> Column:
    """Dollars to the nearest cent, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def _legs(df: DataFrame, price: Column, extra: Sequence[str]) -> DataFrame:
    """One row per leg of a move from `cur` to `target`: a move through zero closes first, then opens."""
    cur, tgt = F.col("cur"), F.col("target")
    leg = lambda i, a, b: F.struct(F.lit(i).alias("leg"), a.alias("before"), b.alias("after"))
    z = F.lit(0.0)
    legs = F.when(cur * tgt < 0, F.array(leg(0, cur, z), leg(1, z, tgt))).otherwise(F.array(leg(0, cur, tgt)))
    b, a = F.col("l.before"), F.col("l.after")
    # an action is what happens to the size of the position, on the side that it has before or after
    up, grows = a > b, F.abs(a) > F.abs(b)
    side = F.when(a + b > 0, "long").otherwise("short")
    verb = F.when(grows & (b == 0), "open").when(grows, "add to").when(a == 0, "close").otherwise("reduce")
    action = F.concat_ws(" ", verb, side)
    qty = F.round(F.abs(a - b), 6)
    out = df.select("account_id", "symbol", *extra, "cur", "target", price.alias("px"), F.explode(legs).alias("l"))
    return (out.select("account_id", "symbol", *extra, F.col("l.leg").alias("leg"), F.when(up, "buy").otherwise("sell").alias("side"),
                       qty.alias("qty"), cents(qty * F.col("px")).alias("notional"), F.col("cur").alias("current_qty"),
                       F.col("target").alias("target_qty"), action.alias("action")).where("qty > 0"))


def _number(orders: DataFrame, phase: Column) -> DataFrame:
    """`seq` within each account: reductions first, then the rest, by symbol and leg."""
    w = Window.partitionBy("account_id").orderBy("phase", "symbol", "leg")
    return orders.withColumn("phase", phase).withColumn("seq", F.row_number().over(w)).drop("phase", "leg")


def propose_orders(weights: DataFrame, accounts: DataFrame, positions: DataFrame, prices: DataFrame,
                   min_notional: float = 1.0) -> DataFrame:
    """Orders from current positions to weight x equity / price, in whole shares rounded toward zero.

    weights (account_id, symbol, weight), accounts (account_id, equity), positions (account_id, symbol, qty),
    prices (symbol, price). Symbols without a weight row are not touched; a move below min_notional is skipped."""
    px = F.when(clean("price") > 0, F.col("price"))
    j = (weights.join(accounts.select("account_id", "equity"), "account_id").join(prices, "symbol", "left")
         .join(positions.select("account_id", "symbol", F.col("qty").alias("cur")), ["account_id", "symbol"], "left"))
    j = (j.withColumn("px", px).withColumn("cur", F.coalesce("cur", F.lit(0.0)))
         .withColumn("target", F.when(px.isNotNull(), trunc(F.coalesce(clean("weight"), F.lit(0.0)) * F.col("equity") / px)).otherwise(0.0)))
    move = (F.col("target") != F.col("cur")) & (F.col("px").isNull() | (F.abs(F.col("target") - F.col("cur")) * F.col("px") >= min_notional))
    legs = _legs(j.where(move), F.col("px"), ())
    return _number(legs, F.when(F.col("action").isin(*REDUCING), 0).otherwise(1))


def unpriced(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Targets that cannot be sized: a weight without a price. A plan with such rows must not run."""
    known = prices.where(clean("price") > 0).select("symbol")
    return weights.where(F.coalesce(F.col("weight"), F.lit(0.0)) != 0).join(known, "symbol", "left_anti")


def orders_for_targets(targets: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Orders to target SHARE counts; funds that add exposure go before stocks that do. targets: account_id, symbol,
    target, is_fund."""
    j = (targets.join(prices, "symbol", "left")
         .join(positions.select("account_id", "symbol", F.col("qty").alias("cur")), ["account_id", "symbol"], "left")
         .withColumn("cur", F.coalesce("cur", F.lit(0.0))).withColumn("target", trunc(F.col("target"))))
    legs = _legs(j.where(F.abs(F.col("target") - F.col("cur")) >= 1), F.col("price"), ("is_fund",))
    phase = F.when(F.col("action").isin(*REDUCING), 0).when(F.col("is_fund"), 1).otherwise(2)
    return _number(legs, phase).drop("is_fund")


def left_alone(positions: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Positions a plan must not touch: outside the strategy, or inside it without a forecast today."""
    j = positions.join(forecasts.select("symbol", F.lit(1).alias("_in"), clean("score").alias("_s")), "symbol", "left")
    why = F.when(F.col("_in").isNull(), "outside").when(F.col("_s").isNull(), "no forecast")
    return j.withColumn("reason", why).where(F.col("reason").isNotNull()).select("account_id", "symbol", "qty", "reason")


def targets_and_positions(weights: DataFrame, accounts: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Every current position and every target side by side."""
    w = weights.where("weight != 0")
    j = (positions.join(w, ["account_id", "symbol"], "full_outer").join(accounts.select("account_id", "equity"), "account_id")
         .join(prices, "symbol", "left"))
    q, px, eq = F.coalesce("qty", F.lit(0.0)), F.col("price"), F.col("equity")
    tgt = trunc(F.col("weight") * eq / px)
    return j.select("account_id", "symbol", q.alias("current_shares"), (q * px).alias("market_value"), (q * px / eq).alias("current_weight"),
                    F.col("weight").alias("target_weight"), tgt.alias("target_shares"), (tgt - q).alias("change"))


# --------------------------------------------------------------------- stateful plan

def stateful_plan(fit: DataFrame, accounts: DataFrame, positions: DataFrame, prices: DataFrame, shortable: DataFrame,
                  sectors: DataFrame, cfg: FactorConfig) -> DataFrame:
    """One row per (account, stock) that is held or that opens today, with the state before and after and the target
    shares. All other pairs are flat before and after and have no row.

    fit holds today's estimates per (strategy, symbol): s, eligible, beta, hedge, kappa, sigma_eq; accounts (account_id,
    strategy, equity). A pair can change only where the account holds the stock or where the strategy's signal opens it
    from flat, so accounts meet the few openers of their own strategy and not the universe. Held stocks without a price
    are blind: left alone, and the fund that hedges them is frozen for that account, so no new trade may hedge there. A
    new short needs a borrow (NULL: could not check, kept); one that a share's price makes too small is not opened.
    """
    px = F.when(clean("price") > 0, F.col("price"))
    stocks = sectors.select("symbol", "fund").join(prices, "symbol", "left").join(shortable, "symbol", "left").withColumn("px", px)
    today_ = fit.select("strategy", "symbol", "s", "eligible", "beta", "hedge", "kappa", "sigma_eq")
    holders = accounts.select("account_id", "strategy", "equity")
    held = (positions.where(clean("qty") != 0).select("account_id", "symbol", "qty").join(holders, "account_id").join(stocks, "symbol")
            .join(today_, ["strategy", "symbol"], "left"))
    starts = _next(F.lit(0), F.col("s"), F.coalesce("eligible", F.lit(False)), cfg) != 0
    openers = stocks.where("px IS NOT NULL").join(today_, "symbol").where(starts)
    opening = (holders.join(openers, "strategy").join(held.select("account_id", "symbol"), ["account_id", "symbol"], "left_anti")
               .withColumn("qty", F.lit(0.0)))
    rows = held.unionByName(opening)
    rows = (rows.withColumn("blind", (F.col("qty") != 0) & F.col("px").isNull())
            .withColumn("before", F.when(F.col("blind"), 0).otherwise(F.signum("qty")).cast("int")))
    frozen = rows.where("blind").select("account_id", F.col("fund").alias("hedge")).distinct().withColumn("frozen", F.lit(True))
    rows = rows.join(frozen, ["account_id", "hedge"], "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    raw = F.when(F.col("px").isNull(), 0).otherwise(_next(F.col("before"), F.col("s"), F.coalesce("eligible", F.lit(False)), cfg))
    rows = rows.withColumn("_raw", raw.cast("int"))
    new = (F.col("before") == 0) & (F.col("_raw") != 0)
    size = trunc(F.col("_raw") * cfg.position * F.col("equity") / F.col("px"))
    skip = (F.when(new & (F.col("_raw") < 0) & (F.col("shortable") == F.lit(False)), "no borrow")
            .when(new & F.col("frozen"), "hedge frozen").when(new & (size == 0), "too dear"))
    rows = rows.withColumn("skipped", skip).withColumn("after", F.when(F.col("skipped").isNotNull(), 0).otherwise(F.col("_raw")))
    target = (F.when(F.col("px").isNull(), None).when(F.col("after") == 0, 0.0)
              .when(F.col("after") == F.col("before"), F.col("qty")).otherwise(size))
    side = F.when(F.col("after") > 0, "long").otherwise("short")
    was = F.when(F.col("before") > 0, "long").otherwise("short")
    today = (F.when(F.col("skipped").isNotNull(), "not opened").when((F.col("before") == 0) & (F.col("after") != 0), F.concat(F.lit("open "), side))
             .when((F.col("before") != 0) & (F.col("after") == F.col("before")), F.concat(F.lit("keep "), was))
             .when((F.col("before") != 0) & (F.col("after") == 0), F.concat(F.lit("close "), was)).otherwise(""))
    return rows.withColumn("target", target).withColumn("today", today).drop("_raw")


def frozen_funds(plan: DataFrame) -> DataFrame:
    """(account_id, fund, holders): funds left as they are because a held stock they hedge has no price."""
    return plan.where("blind").groupBy("account_id", "fund").agg(F.count("*").alias("holders"))


def hedge_targets(plan: DataFrame, fund_prices: DataFrame, frozen: DataFrame) -> DataFrame:
    """Target shares per (account, fund): minus side x beta x dollars, summed, rounded toward zero; frozen funds are left
    out."""
    d = -F.col("after") * F.col("beta") * F.abs(F.col("target")) * F.col("px")
    g = (plan.where("after != 0").groupBy("account_id", F.col("hedge").alias("fund"))
         .agg(F.sum(d).alias("dollars"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("covers")))
    return (g.join(frozen.select("account_id", "fund"), ["account_id", "fund"], "left_anti")
            .join(fund_prices.select(F.col("symbol").alias("fund"), F.col("price").alias("fund_price")), "fund", "left")
            .withColumn("target", trunc(F.col("dollars") / F.col("fund_price"))))


# --------------------------------------------------------------------- order history and ids

def client_order_id(prefix: str, date, symbol, action) -> Column:
    return F.concat_ws("-", F.lit(prefix), F.date_format(date, "yyyyMMdd"), symbol, F.replace(action, F.lit(" "), F.lit("-")))


def last_rebalance(history: DataFrame, prefix: str, by: Sequence[str] = ("account_id",)) -> DataFrame:
    """Newest decision date among filled orders whose id carries one; ids that do not parse are skipped."""
    day = F.regexp_extract("client_order_id", rf"^{prefix}-(\d{{8}})-", 1)
    date = F.to_date(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyyMMdd")))
    ok = F.coalesce(F.expr("try_cast(filled AS double)"), F.lit(0.0)) > 0
    return history.groupBy(*by).agg(F.max(F.when(ok, date)).alias("last_rebalance"))


def rebalance_due(last: DataFrame, cal: DataFrame, decision: Column, every: int) -> DataFrame:
    """Trading days since the last rebalance, and whether `every` of them have passed."""
    days = F.broadcast(cal.where(F.col("date") <= decision).select(F.collect_list("date").alias("days")))
    # counted once for each date on which somebody last rebalanced, of which there are no more than calendar days
    dates = last.select("last_rebalance").where("last_rebalance IS NOT NULL").distinct()
    since = F.size(F.filter("days", lambda d: d > F.col("last_rebalance"))).cast("bigint")
    dates = dates.join(days).select("last_rebalance", since.alias("days_since"))
    return last.join(F.broadcast(dates), "last_rebalance", "left").select(
        *last.columns, "days_since", (F.col("days_since").isNull() | (F.col("days_since") >= every)).cast("int").alias("due"))


def fingerprint(orders: DataFrame, date: Column) -> DataFrame:
    """Twelve hex digits per account that change when any order does."""
    line = F.concat_ws(",", "symbol", "side", F.col("qty").cast("bigint").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    text = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("|"), F.array_join(F.transform(rows, lambda r: r["line"]), ";"))
    return orders.groupBy("account_id").agg(F.substring(F.sha2(text, 256), 1, 12).alias("fingerprint"))


def exposure_check(orders: DataFrame, accounts: DataFrame) -> DataFrame:
    """Dollars of exposure-adding orders against the smaller of two buying-power figures, and the exits-only count."""
    adds = ~F.col("action").isin(*REDUCING)
    g = orders.groupBy("account_id").agg(F.sum(F.when(adds, F.coalesce("notional", F.lit(0.0))).otherwise(0.0)).alias("opening"),
                                         F.count(F.when(~adds, 1)).alias("exits"))
    limit = F.least("buying_power", F.coalesce("overnight_power", F.col("buying_power")))
    return (g.join(accounts, "account_id").select("account_id", "opening", "exits", limit.alias("power_limit"),
                                                  (F.col("opening") > limit).cast("int").alias("over_limit")))
