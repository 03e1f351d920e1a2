"""Plan jobs over all customers as accounts."""

from pyspark.sql import functions as F

from ..functions.frames import change, shift
from ..operators import orders as K
from ..operators import portfolio as P
from .block_fg_books import shortable
from .block_h_factors import CFG, fit_of
from .registry import query
from .sqltext import cte, sql

MODELS = ("rev5", "str", "wstr")
PREFIX = "panel"
cte("accounts", """SELECT c_custkey AS account_id, CASE c_custkey % 3 WHEN 0 THEN 'rev5' WHEN 1 THEN 'str' ELSE 'wstr' END AS model,
 (abs(c_acctbal) + 500) * 100 AS equity, (abs(c_acctbal) + 500) * 150 AS buying_power, CASE WHEN c_custkey % 4 <> 0 THEN (abs(c_acctbal) + 500) * 120 END AS overnight_power FROM customer""")
cte("kprice", "SELECT symbol, arg_max(adj_close, date) AS price FROM bars GROUP BY symbol", "bars")
cte("kbook", """SELECT model, t, symbol, CASE WHEN n < 10 THEN 0.0 WHEN lo <= 5 THEN -1.0 / 5 WHEN hi <= 5 THEN 1.0 / 5 ELSE 0.0 END::DOUBLE AS weight
 FROM placed WHERE t >= (SELECT max(t) - 1 FROM cal)""", "placed", "cal")
cte("kweights", "SELECT account_id, symbol, weight FROM accounts JOIN kbook USING (model) WHERE t = (SELECT max(t) FROM cal)", "accounts", "kbook", "cal")
cte("kpos", """SELECT account_id, symbol, trunc(weight * equity / price) AS qty FROM accounts JOIN kbook b USING (model) JOIN kprice USING (symbol)
 WHERE t = (SELECT max(t) - 1 FROM cal) AND weight <> 0 AND left(md5(CAST(account_id AS VARCHAR) || '|' || symbol), 1) < 'c' AND trunc(weight * equity / price) <> 0""", "accounts", "kbook", "kprice", "cal")
#: What happens to the size of a position, and on which side: a leg never crosses zero, so a + b has the side's sign.
GROWTH = "CASE WHEN abs(a) < abs(b) THEN if(a = 0, 'close', 'reduce') ELSE if(b = 0, 'open', 'add to') END"
ACTION = f"concat_ws(' ', {GROWTH}, if(a + b > 0, 'long', 'short'))"


def legs_sql(rel: str, phase: str, extra: str = "") -> str:
    """Legs of moves cur -> target with px, numbered per account."""
    return f"""SELECT account_id, symbol, side, qty, notional, current_qty, target_qty, action, CAST(row_number() OVER (PARTITION BY account_id ORDER BY {phase}, symbol, leg) AS INTEGER) AS seq
FROM (SELECT *, CASE WHEN a > b THEN 'buy' ELSE 'sell' END AS side, abs(a - b) AS qty, floor(abs(a - b) * px * 100 + 0.5) / 100 AS notional, cur AS current_qty, target AS target_qty, {ACTION} AS action
 FROM (SELECT *, 0 AS leg, cur AS b, target AS a FROM {rel} WHERE cur * target >= 0 UNION ALL SELECT *, 0, cur, 0 FROM {rel} WHERE cur * target < 0 UNION ALL SELECT *, 1, 0, target FROM {rel} WHERE cur * target < 0)) WHERE qty > 0"""


PH2 = "CASE WHEN action LIKE 'close%' OR action LIKE 'reduce%' THEN 0 ELSE 1 END"
cte("kmoves", """SELECT w.account_id, w.symbol, coalesce(p.qty, 0)::DOUBLE AS cur, trunc(weight * equity / price)::DOUBLE AS target, price AS px FROM kweights w JOIN accounts USING (account_id)
 JOIN kprice USING (symbol) LEFT JOIN kpos p ON p.account_id = w.account_id AND p.symbol = w.symbol
 WHERE trunc(weight * equity / price) <> coalesce(p.qty, 0) AND abs(trunc(weight * equity / price) - coalesce(p.qty, 0)) * price >= 1""", "kweights", "accounts", "kprice", "kpos")
cte("korders", legs_sql("kmoves", PH2), "kmoves")
OC = ["account_id", "seq", "symbol", "side", "qty", "notional", "current_qty", "target_qty", "action"]


def accounts(t):
    bal = F.abs("c_acctbal") + 500
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t.table("customer").select(F.col("c_custkey").alias("account_id"), model.alias("model"), (bal * 100).alias("equity"),
                                      (bal * 150).alias("buying_power"), F.when(F.col("c_custkey") % 4 != 0, bal * 120).alias("overnight_power"))


def prices(t):
    return t.panel().groupBy("symbol").agg(F.max_by("adj_close", "t").alias("price"))


def setup(t):
    """accounts, weights and positions: each account follows one model; it holds most of last week's book."""
    t.keep_panel()
    cal_last = t.calendar().select(F.max("t")).scalar()
    book = (P.daily_weights(t.scores(MODELS), ["model", "t"], 5).where(F.col("t") >= cal_last - 1)
            .select("model", "t", "symbol", "weight"))
    a, px = accounts(t), prices(t)
    w = a.join(book.where(F.col("t") == cal_last), "model").select("account_id", "symbol", "weight")
    pos = a.join(book.where((F.col("t") == cal_last - 1) & (F.col("weight") != 0)).join(px, "symbol"), "model")
    keep = F.substring(F.md5(F.concat_ws("|", F.col("account_id").cast("string"), "symbol")), 1, 1) < "c"
    pos = pos.where(keep).select("account_id", "symbol", K.trunc(F.col("weight") * F.col("equity") / F.col("price")).alias("qty")).where("qty != 0")
    return a, w, pos, px


def plan_orders(t):
    a, w, pos, px = setup(t)
    return K.propose_orders(w, a, pos, px), a


@query("k1_order_proposal", sql(f"SELECT {', '.join(OC)} FROM korders", "korders"))
def k1(t):
    """Orders of every account: reductions first, moves through zero in two legs."""
    return plan_orders(t)[0].select(*OC)


@query("k6_left_alone", sql("""SELECT p.account_id, p.symbol, p.qty, CASE WHEN s.symbol IS NULL THEN 'outside' ELSE 'no forecast' END AS reason FROM kpos p
LEFT JOIN (SELECT symbol, mom FROM score_cols WHERE t = (SELECT max(t) FROM cal) AND x IS NOT NULL AND symbol NOT IN ('Brand#5', 'Brand#6', 'Brand#7', 'Brand#8')) s USING (symbol) WHERE s.symbol IS NULL OR s.mom IS NULL""", "kpos", "score_cols", "cal"))
def k6(t):
    """Positions a plan by the momentum score over 21 brands would leave alone."""
    _, _, pos, _ = setup(t)
    last = t.calendar().select(F.max("t")).scalar()
    out = ("Brand#5", "Brand#6", "Brand#7", "Brand#8")
    s = t.score_columns().where((F.col("t") == last) & ~F.col("symbol").isin(*out)).select("symbol", F.col("mom").alias("score"))
    return K.left_alone(pos, s)


@query("k7_targets_and_positions", sql("""SELECT account_id, symbol, coalesce(qty, 0)::DOUBLE AS current_shares, round(coalesce(qty, 0) * price, 6) AS market_value, round(coalesce(qty, 0) * price / equity, 6) AS current_weight,
 weight AS target_weight, trunc(weight * equity / price)::DOUBLE AS target_shares, (trunc(weight * equity / price) - coalesce(qty, 0))::DOUBLE AS change
FROM (SELECT * FROM kpos FULL OUTER JOIN (SELECT * FROM kweights WHERE weight <> 0) w USING (account_id, symbol)) JOIN accounts USING (account_id) JOIN kprice USING (symbol)""", "kpos", "kweights", "accounts", "kprice"))
def k7(t):
    a, w, pos, px = setup(t)
    return (K.targets_and_positions(w, a, pos, px).withColumn("market_value", F.round("market_value", 6))
            .withColumn("current_weight", F.round("current_weight", 6)))


cte("khist", """SELECT account_id, CASE WHEN account_id % 11 = 0 THEN 'other-id' WHEN account_id % 7 = 0 THEN 'panel-20011399-' || symbol || '-' || replace(action, ' ', '-')
 ELSE 'panel-' || strftime(DATE '2001-10-29' - CAST(account_id % 40 AS INTEGER), '%Y%m%d') || '-' || symbol || '-' || replace(action, ' ', '-') END AS client_order_id,
 CASE WHEN seq % 5 = 0 THEN 'x' WHEN seq % 5 = 1 THEN '0' ELSE CAST(qty AS VARCHAR) END AS filled FROM korders""", "korders")
cte("klast", """SELECT account_id, max(CASE WHEN coalesce(try_cast(filled AS DOUBLE), 0) > 0 THEN CAST(try_strptime(nullif(regexp_extract(client_order_id, '^panel-(\\d{8})-', 1), ''), '%Y%m%d') AS DATE) END) AS last_rebalance
 FROM khist GROUP BY account_id""", "khist")


def history(t):
    o, _ = plan_orders(t)
    day = F.date_sub(F.lit("2001-10-29").cast("date"), (F.col("account_id") % 40).cast("int"))
    bad = F.concat_ws("-", F.lit(PREFIX), F.lit("20011399"), "symbol", F.replace("action", F.lit(" "), F.lit("-")))
    coid = (F.when(F.col("account_id") % 11 == 0, "other-id").when(F.col("account_id") % 7 == 0, bad)
            .otherwise(K.client_order_id(PREFIX, day, F.col("symbol"), F.col("action"))))
    filled = F.when(F.col("seq") % 5 == 0, "x").when(F.col("seq") % 5 == 1, "0").otherwise(F.col("qty").cast("string"))
    return o.select("account_id", coid.alias("client_order_id"), filled.alias("filled"))


@query("k9_last_rebalance", sql("SELECT * FROM klast", "klast"))
def k9(t):
    """Newest decision date read from the ids of filled orders; malformed ids are skipped."""
    return K.last_rebalance(history(t), PREFIX)


@query("k10_rebalance_due", sql("""SELECT account_id, last_rebalance, CASE WHEN last_rebalance IS NOT NULL THEN (SELECT count(*) FROM cal WHERE date > last_rebalance AND date <= DATE '2001-10-29') END AS days_since,
 CAST(last_rebalance IS NULL OR (SELECT count(*) FROM cal WHERE date > last_rebalance AND date <= DATE '2001-10-29') >= 4 AS INTEGER) AS due FROM klast""", "klast", "cal"))
def k10(t):
    last = K.last_rebalance(history(t), PREFIX)
    return K.rebalance_due(last, t.calendar(), F.lit("2001-10-29").cast("date"), 4)


@query("k11_order_ids", sql("SELECT account_id, seq, 'panel-20011029-' || symbol || '-' || replace(action, ' ', '-') AS client_order_id FROM korders", "korders"))
def k11(t):
    o, _ = plan_orders(t)
    return o.select("account_id", "seq", K.client_order_id(PREFIX, F.lit("2001-10-29").cast("date"), F.col("symbol"), F.col("action")).alias("client_order_id"))


@query("k11_fingerprint", sql("""SELECT account_id, left(sha256('2001-10-29|' || string_agg(symbol || ',' || side || ',' || CAST(CAST(qty AS BIGINT) AS VARCHAR), ';' ORDER BY seq)), 12) AS fingerprint
FROM korders GROUP BY account_id""", "korders"))
def k11f(t):
    return K.fingerprint(plan_orders(t)[0], F.lit("2001-10-29").cast("date"))


@query("k12_exposure_check", sql("""SELECT account_id, round(sum(CASE WHEN action LIKE 'open%' OR action LIKE 'add%' THEN notional ELSE 0 END), 2) AS opening, count(*) FILTER (WHERE action LIKE 'close%' OR action LIKE 'reduce%') AS exits,
 any_value(least(buying_power, coalesce(overnight_power, buying_power))) AS power_limit,
 CAST(round(sum(CASE WHEN action LIKE 'open%' OR action LIKE 'add%' THEN notional ELSE 0 END), 2) > any_value(least(buying_power, coalesce(overnight_power, buying_power))) AS INTEGER) AS over_limit
FROM korders JOIN accounts USING (account_id) GROUP BY account_id""", "korders", "accounts"))
def k12(t):
    o, a = plan_orders(t)
    return K.exposure_check(o, a).withColumn("opening", F.round("opening", 2))


# ------------------------------------------------------------------ stateful plan with fund hedges

cte("sfit", "SELECT * FROM fit WHERE t = (SELECT max(t) FROM cal)", "fit", "cal")
cte("sprice", "SELECT symbol, CASE WHEN symbol IN ('Brand#11', 'Brand#12') THEN NULL ELSE price END AS price FROM kprice", "kprice")
cte("bought", """SELECT DISTINCT o_custkey AS account_id, p_brand AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 2""")
cte("spos", """SELECT account_id, symbol, trunc((CASE WHEN h < '4' THEN 1 ELSE -1 END) * 0.05::DOUBLE * equity / price) AS qty FROM (SELECT account_id, equity, symbol, p.price,
 left(md5(CAST(account_id AS VARCHAR) || '/' || symbol), 1) AS h FROM bought JOIN accounts USING (account_id) JOIN kprice p USING (symbol)) WHERE h < '8' AND trunc(0.05::DOUBLE * equity / price) <> 0""", "bought", "accounts", "kprice")
cte("fprice", "SELECT symbol, arg_max(x, t) AS price FROM fgrid WHERE x IS NOT NULL GROUP BY symbol", "fgrid")
cte("srows", """SELECT a.account_id, a.equity, s.symbol, s.fund, p.price AS px, b.shortable, f.s, f.eligible, f.beta, f.hedge, f.kappa, coalesce(q.qty, 0)::DOUBLE AS qty,
 coalesce(q.qty, 0) <> 0 AND p.price IS NULL AS blind FROM accounts a CROSS JOIN sectors s JOIN sprice p ON p.symbol = s.symbol JOIN shortable b ON b.symbol = s.symbol LEFT JOIN sfit f ON f.symbol = s.symbol
 LEFT JOIN spos q ON q.account_id = a.account_id AND q.symbol = s.symbol""", "accounts", "sectors", "sprice", "shortable", "sfit", "spos")
cte("splan", """SELECT *, CASE WHEN skipped IS NOT NULL THEN 0 ELSE raw END AS after, CASE WHEN px IS NULL THEN NULL WHEN skipped IS NOT NULL OR raw = 0 THEN 0 WHEN raw = before THEN qty ELSE size END::DOUBLE AS target
 FROM (SELECT *, CASE WHEN before = 0 AND raw < 0 AND shortable = FALSE THEN 'no borrow' WHEN before = 0 AND raw <> 0 AND (account_id, hedge) IN (SELECT (account_id, fund) FROM srows WHERE blind) THEN 'hedge frozen'
  WHEN before = 0 AND raw <> 0 AND size = 0 THEN 'too dear' END AS skipped
 FROM (SELECT *, trunc(raw * 0.05::DOUBLE * equity / px) AS size FROM (SELECT *, CASE WHEN px IS NULL OR s IS NULL THEN 0 WHEN before = 0 THEN CASE WHEN NOT eligible THEN 0 WHEN s < -1.25 THEN 1 WHEN s > 1.25 THEN -1 ELSE 0 END
  WHEN before = 1 AND s > -0.5 THEN 0 WHEN before = -1 AND s < 0.75 THEN 0 ELSE before END AS raw FROM (SELECT *, CASE WHEN blind THEN 0 ELSE CAST(sign(qty) AS INTEGER) END AS before FROM srows))) WHERE qty <> 0 OR raw <> 0)""", "srows")
cte("shedge", """SELECT account_id, hedge AS fund, sum(-after * beta * abs(target) * px) AS dollars, string_agg(symbol, ',' ORDER BY symbol) AS covers FROM splan
 WHERE after <> 0 AND (account_id, hedge) NOT IN (SELECT (account_id, fund) FROM srows WHERE blind) GROUP BY ALL""", "splan")


def state_plan(t):
    _, _, fit = fit_of(t)
    last = t.calendar().select(F.max("t")).scalar()
    a, px = accounts(t), prices(t)
    lines = t.table("lineitem").where("l_linenumber <= 2").join(t.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    bought = (lines.join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
              .select(F.col("o_custkey").alias("account_id"), F.col("p_brand").alias("symbol")).distinct())
    h = F.substring(F.md5(F.concat_ws("/", F.col("account_id").cast("string"), "symbol")), 1, 1)
    side = F.when(h < "4", 1).otherwise(-1)
    pos = (bought.where(h < "8").join(a, "account_id").join(px, "symbol")
           .select("account_id", "symbol", K.trunc(side * F.lit(0.05) * F.col("equity") / F.col("price")).alias("qty")).where("qty != 0"))
    known = px.withColumn("price", F.when(~F.col("symbol").isin("Brand#11", "Brand#12"), F.col("price")))
    today = fit.where(F.col("t") == last).withColumn("strategy", F.lit("factor"))
    plan = K.stateful_plan(today, a.withColumn("strategy", F.lit("factor")), pos, known, shortable(t), t.sectors(), CFG)
    fp = t.fund_bars().groupBy("symbol").agg(F.max_by("adj_close", "date").alias("price"))
    return plan, pos, known, fp


@query("k3_state_targets", sql("SELECT account_id, symbol, before, after, target, skipped FROM splan", "splan"))
def k3(t):
    """Closed to zero, kept as held, opened at position x equity / price."""
    return state_plan(t)[0].select("account_id", "symbol", "before", "after", "target", "skipped")


@query("k4_hedge_targets", sql("SELECT account_id, h.fund, round(dollars, 2) AS dollars, trunc(dollars / p.price)::DOUBLE AS target FROM shedge h JOIN fprice p ON p.symbol = h.fund", "shedge", "fprice"))
def k4(t):
    plan, _, _, fp = state_plan(t)
    return K.hedge_targets(plan, fp, K.frozen_funds(plan)).select("account_id", "fund", F.round("dollars", 2).alias("dollars"), "target")


@query("k5_frozen_funds", sql("SELECT account_id, fund, count(*) AS holders FROM srows WHERE blind GROUP BY ALL", "srows"))
def k5(t):
    return K.frozen_funds(state_plan(t)[0])


@query("k8_signal_table", sql("""SELECT account_id, symbol, round(s, 6) AS s, round(kappa, 6) AS kappa, round(beta, 6) AS beta, fund, coalesce(hedge, '') AS hedge, before, after,
 CASE WHEN skipped IS NOT NULL THEN 'not opened' WHEN before = 0 AND after <> 0 THEN 'open ' || CASE WHEN after > 0 THEN 'long' ELSE 'short' END
 WHEN before <> 0 AND after = before THEN 'keep ' || CASE WHEN before > 0 THEN 'long' ELSE 'short' END WHEN before <> 0 AND after = 0 THEN 'close ' || CASE WHEN before > 0 THEN 'long' ELSE 'short' END ELSE '' END AS today FROM splan""", "splan"))
def k8(t):
    p = state_plan(t)[0]
    return p.select("account_id", "symbol", F.round("s", 6).alias("s"), F.round("kappa", 6).alias("kappa"), F.round("beta", 6).alias("beta"), "fund",
                    F.coalesce("hedge", F.lit("")).alias("hedge"), "before", "after", "today")


@query("k8_book_table", sql("""SELECT account_id, symbol, 'stock' AS leg, target AS target_shares, round(target * px / equity, 6) AS target_weight, hedge AS hedges FROM splan WHERE after <> 0
UNION ALL SELECT h.account_id, h.fund, 'hedge', trunc(dollars / p.price)::DOUBLE, round(trunc(dollars / p.price) * p.price / a.equity, 6), covers FROM shedge h JOIN fprice p ON p.symbol = h.fund JOIN accounts a ON a.account_id = h.account_id""", "splan", "shedge", "fprice", "accounts"))
def k8b(t):
    """Stock legs and hedge legs with the symbols each fund covers."""
    p, _, _, fp = state_plan(t)
    s = p.where("after != 0").select("account_id", "symbol", F.lit("stock").alias("leg"), F.col("target").alias("target_shares"),
                                     F.round(F.col("target") * F.col("px") / F.col("equity"), 6).alias("target_weight"), F.col("hedge").alias("hedges"))
    h = K.hedge_targets(p, fp, K.frozen_funds(p)).join(accounts(t).select("account_id", "equity"), "account_id")
    return s.unionByName(h.select("account_id", F.col("fund").alias("symbol"), F.lit("hedge").alias("leg"), F.col("target").alias("target_shares"),
                                  F.round(F.col("target") * F.col("fund_price") / F.col("equity"), 6).alias("target_weight"), F.col("covers").alias("hedges")))


cte("smoves", """SELECT p.account_id, p.symbol, p.qty AS cur, trunc(target)::DOUBLE AS target, px, FALSE AS is_fund FROM splan p WHERE target IS NOT NULL AND abs(trunc(target) - qty) >= 1
 UNION ALL SELECT h.account_id, h.fund, 0::DOUBLE, trunc(dollars / p.price)::DOUBLE, p.price, TRUE FROM shedge h JOIN fprice p ON p.symbol = h.fund WHERE abs(trunc(dollars / p.price)) >= 1""", "splan", "shedge", "fprice")
PH3 = "CASE WHEN action LIKE 'close%' OR action LIKE 'reduce%' THEN 0 WHEN is_fund THEN 1 ELSE 2 END"


@query("k2_orders_for_targets", sql(legs_sql("smoves", PH3), "smoves"))
def k2(t):
    """Share-count targets: reductions, then fund hedges, then new stock trades."""
    p, pos, known, fp = state_plan(t)
    targets = (p.where("target IS NOT NULL").select("account_id", "symbol", "target", F.lit(False).alias("is_fund"))
               .unionByName(K.hedge_targets(p, fp, K.frozen_funds(p)).select("account_id", F.col("fund").alias("symbol"), "target", F.lit(True).alias("is_fund"))))
    return K.orders_for_targets(targets, pos, known.unionByName(fp)).select(*OC)
