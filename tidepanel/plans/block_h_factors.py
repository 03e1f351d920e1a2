"""Factor residual book on the weekly panel: 20-week fits, sector-fund or eigenportfolio hedges."""

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.crosssection import safe_corr
from ..functions.frames import change, rolling, span
from ..operators import eigen as EI
from ..operators import factors as H
from ..operators import stats as J
from ..operators.backtest import window_trades
from ..operators.features import market_volatility
from ..operators.running_fit import running_fit
from .block_e_evaluate import R, rnd
from .block_j_stats import perf, perf_sql, PERF
from ..session import materialise
from .registry import query
from .sqltext import cte, sql

N = 20
CFG = H.FactorConfig(window=N, corr_window=40, min_kappa=5.2, position=0.05, per_year=52)
LATE = 100      # the fund F4 starts trading at this week, so its brands hedge with the market before


def inputs(t):
    t.keep_panel()
    p = t.panel()
    stock = p.select("date", "symbol", "t", change("adj_close", 1).alias("ret"))
    legs = (p.join(t.sectors(), "symbol").withColumn("c", F.round(F.col("adj_close") * F.col("volume") * 100).cast("bigint"))
            .select("date", "t", F.explode(F.array("fund", F.lit("MKT"))).alias("symbol"), "c", "volume"))
    f = (legs.groupBy("date", "t", "symbol").agg((F.sum("c").cast("double") / 100.0 / F.sum("volume")).alias("x"))
         .where((F.col("symbol") != "F4") | (F.col("t") >= LATE)))
    funds = f.select("date", "symbol", "t", change("x", 1).alias("ret"))
    return stock, funds


cte("fgrid", f"""SELECT c.date, c.t, s.symbol, b.adj_close AS x FROM cal c CROSS JOIN (SELECT DISTINCT symbol FROM fund_bars) s LEFT JOIN fund_bars b
 ON b.date = c.date AND b.symbol = s.symbol AND (s.symbol <> 'F4' OR c.t >= {LATE})""", "fund_bars", "cal")
cte("fr", f"""SELECT *, count(ret) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW) = {N} AS usable
 FROM (SELECT symbol, t, x / lag(x) OVER (PARTITION BY symbol ORDER BY t) - 1 AS ret FROM fgrid)""", "fgrid")
cte("hedge", """SELECT r.symbol, r.date, r.t, CASE WHEN coalesce(f.usable, FALSE) THEN s.fund ELSE 'MKT' END AS hedge FROM rets r JOIN sectors s USING (symbol)
 LEFT JOIN fr f ON f.symbol = s.fund AND f.t = r.t WHERE r.x IS NOT NULL""", "rets", "sectors", "fr")
cte("win", f"""SELECT h.symbol, h.t, b.t AS u, b.ret AS y, f.ret AS x FROM hedge h JOIN rets b ON b.symbol = h.symbol AND b.t BETWEEN h.t - {N - 1} AND h.t
 JOIN fr f ON f.symbol = h.hedge AND f.t = b.t WHERE b.ret IS NOT NULL AND f.ret IS NOT NULL""", "hedge", "rets", "fr")
cte("reg0", f"SELECT symbol, t, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, regr_r2(y, x) AS r2 FROM win GROUP BY symbol, t HAVING count(*) = {N}", "win")
cte("reg", f"SELECT * FROM reg0 WHERE t IN (SELECT t FROM reg0 GROUP BY t HAVING count(*) >= {CFG.min_names})", "reg0")
cte("paths", "SELECT w.symbol, w.t, u, sum(y - (alpha + beta * x)) OVER (PARTITION BY w.symbol, w.t ORDER BY u) AS p FROM win w JOIN reg USING (symbol, t)", "win", "reg")
cte("pairs", "SELECT * FROM (SELECT symbol, t, u, p AS yn, lag(p) OVER (PARTITION BY symbol, t ORDER BY u) AS xp FROM paths) WHERE xp IS NOT NULL", "paths")
cte("ar", "SELECT symbol, t, regr_slope(yn, xp) AS b, regr_intercept(yn, xp) AS a FROM pairs GROUP BY symbol, t", "pairs")
cte("ar2", "SELECT p.symbol, p.t, any_value(b) AS b, any_value(a) AS a, var_samp(yn - a - b * xp) AS v, max_by(yn, u) AS x_last FROM pairs p JOIN ar USING (symbol, t) GROUP BY ALL", "pairs", "ar")
cte("ou", """SELECT r.*, h.hedge, h.date, b, x_last, CASE WHEN ok THEN -ln(b) * 52 END AS kappa, CASE WHEN ok THEN a / (1 - b) END AS m, CASE WHEN ok THEN sqrt(v / (1 - b * b)) END AS sigma_eq
 FROM (SELECT *, b > 0 AND b < 1 AND v > 0 AS ok FROM ar2) JOIN reg r USING (symbol, t) JOIN hedge h USING (symbol, t)""", "ar2", "reg", "hedge")
cte("fit", f"""SELECT *, (x_last - (m - coalesce(avg(m) FILTER (WHERE eligible) OVER (PARTITION BY t), 0))) / sigma_eq AS s
 FROM (SELECT *, coalesce(kappa > {CFG.min_kappa}, FALSE) AS eligible FROM ou)""", "ou")


def fit_of(t):
    stock, funds = inputs(t)
    fit = H.fund_fit(stock, funds, t.sectors(), CFG)
    return stock, funds, H.cut_lineage(fit)


@query("h1_hedge_assignment", sql("SELECT date, symbol, hedge FROM hedge", "hedge"))
def h1(t):
    stock, funds = inputs(t)
    return H.hedge_funds(stock, funds, t.sectors(), N).select("date", "symbol", "hedge")


@query("h2_rolling_regression", sql(f"SELECT symbol, t, {R('beta', 'alpha', 'r2')} FROM reg0", "reg0"))
def h2(t):
    stock, funds = inputs(t)
    f = H.one_factor(H.hedge_funds(stock, funds, t.sectors(), N), N).where("beta IS NOT NULL")
    return f.select("symbol", "t", *rnd("beta", "alpha", "r2"))


@query("h3_residual_path", sql("SELECT symbol, t, round(max_by(p, u), 6) AS x_last, round(max(p), 6) AS hi, round(min(p), 6) AS lo, count(*) AS n FROM paths GROUP BY symbol, t", "paths"))
def h3(t):
    """Each window's residuals under its own beta, cumulated; the last value, extremes and length."""
    stock, funds = inputs(t)
    f = H.enough_names(H.one_factor(H.hedge_funds(stock, funds, t.sectors(), N), N), CFG)
    p = H.residual_path(f, CFG)
    return p.select("symbol", "t", F.round(F.element_at("path", -1), 6).alias("x_last"), F.round(F.array_max("path"), 6).alias("hi"),
                    F.round(F.array_min("path"), 6).alias("lo"), F.size("path").cast("bigint").alias("n"))


@query("h3_path_moments", sql("SELECT symbol, t, round(avg(p), 6) AS path_mean, round(avg(p * p), 6) AS path_square FROM paths GROUP BY symbol, t", "paths"))
def h3m(t):
    """Mean and mean square of each window's residual path, from running sums: no path is written down."""
    stock, funds = inputs(t)
    fit = running_fit(H.hedge_funds(stock, funds, t.sectors(), N), N, CFG.per_year)
    return H.enough_names(fit, CFG).select("symbol", "t", *rnd("path_mean", "path_square"))


@query("h4_ou_parameters", sql(f"SELECT symbol, t, {R('b', 'kappa', 'm', 'sigma_eq')} FROM ou", "ou"))
def h4(t):
    return fit_of(t)[2].select("symbol", "t", *rnd("b", "kappa", "m", "sigma_eq"))


@query("h5_s_scores", sql("SELECT symbol, t, round(s, 6) AS s, CAST(eligible AS INTEGER) AS eligible FROM fit", "fit"))
def h5(t):
    return fit_of(t)[2].select("symbol", "t", *rnd("s"), F.col("eligible").cast("int").alias("eligible"))


@query("h6_eligible_universe", sql("SELECT t, count(*) AS names, count(*) FILTER (WHERE eligible) AS may_open FROM fit GROUP BY t", "fit"))
def h6(t):
    return fit_of(t)[2].groupBy("t").agg(F.count("*").alias("names"), F.count(F.when(F.col("eligible"), 1)).alias("may_open"))


@query("h7_fund_correlation", sql("""SELECT symbol, t, round(CASE WHEN n = 40 THEN c END, 6) AS rho FROM (SELECT r.symbol, r.t, corr(r.ret, f.ret) OVER w AS c, count(CASE WHEN f.ret IS NOT NULL THEN r.ret END) OVER w AS n, r.x
 FROM rets r JOIN fr f ON f.symbol = 'MKT' AND f.t = r.t WINDOW w AS (PARTITION BY r.symbol ORDER BY r.t ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)) WHERE x IS NOT NULL""", "rets", "fr"))
def h7(t):
    """Rolling correlation of every brand with the market fund: one row per brand and week, never all pairs."""
    stock, funds = inputs(t)
    j = stock.join(F.broadcast(funds.where("symbol = 'MKT'").select("t", F.col("ret").alias("mkt"))), "t")
    w = span(40)
    n = F.count(F.when(F.col("mkt").isNotNull(), F.col("ret"))).over(w)
    return j.select("symbol", "t", F.round(F.when(n == 40, safe_corr("ret", "mkt", w)), 6).alias("rho"))


# ------------------------------------------------------------------ states, books, backtest

cte("hdays", "SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM fit WHERE t < (SELECT max(t) FROM cal))", "fit", "cal")
cte("hsig", "SELECT s.symbol, d.i, d.t, f.s, coalesce(f.eligible, FALSE) AS ok, f.symbol IS NOT NULL AS fitted FROM hdays d CROSS JOIN (SELECT DISTINCT symbol FROM fit) s LEFT JOIN fit f ON f.symbol = s.symbol AND f.t = d.t", "hdays", "fit")
STATES = """RECURSIVE st AS (SELECT symbol, 0::BIGINT AS i, 0 AS state FROM (SELECT DISTINCT symbol FROM hsig) UNION ALL
 SELECT h.symbol, h.i, CASE WHEN h.s IS NULL THEN 0 WHEN st.state = 0 THEN CASE WHEN NOT h.ok THEN 0 WHEN h.s < -1.25 THEN 1 WHEN h.s > 1.25 THEN -1 ELSE 0 END
 WHEN st.state = 1 AND h.s > -0.5 THEN 0 WHEN st.state = -1 AND h.s < 0.75 THEN 0 ELSE st.state END FROM st JOIN hsig h ON h.symbol = st.symbol AND h.i = st.i + 1)"""


def rsql(body: str, *needs: str) -> str:
    """sql() with the recursive state walk added after the CTEs in `needs`."""
    base = sql("SELECT 1", *needs, "hsig")
    head = base[len("WITH "):base.rindex("\nSELECT 1")]
    walk = STATES[len("RECURSIVE "):]
    extra = body.lstrip()
    more = ""
    if extra[:5].upper() == "WITH ":
        k = extra.rindex("\nSELECT")
        more, extra = ",\n" + extra[5:k], extra[k + 1:]
    return f"WITH RECURSIVE {head},\n{walk},\nstates AS (SELECT st.symbol, st.i, d.t, st.state FROM st JOIN hdays d ON d.i = st.i){more}\n{extra}"


def state_inputs(t):
    stock, funds, fit = fit_of(t)
    last = t.calendar().select(F.max("t")).scalar()
    fit = fit.where(F.col("t") < last)
    days = fit.select("t").distinct()
    return stock, funds, fit, days, H.cut_lineage(H.trade_states(fit, days, CFG))


@query("f7_trade_states", rsql("SELECT s.symbol, s.t, CAST(state AS INTEGER) AS state FROM states s JOIN hsig h ON h.symbol = s.symbol AND h.t = s.t WHERE h.fitted"))
def f7(t):
    """Open at 1.25, close at 0.75 or 0.50, flat without a score."""
    return state_inputs(t)[4].select("symbol", "t", "state")


BOOK = """WITH legs AS (SELECT s.t, s.symbol, 0.05::DOUBLE * state AS w FROM states s WHERE state <> 0
 UNION ALL SELECT s.t, f.hedge, -0.05::DOUBLE * state * f.beta FROM states s JOIN fit f ON f.symbol = s.symbol AND f.t = s.t WHERE state <> 0),
book AS (SELECT t, symbol, sum(w) AS weight FROM legs GROUP BY t, symbol)"""


@query("f8_fund_hedged_book", rsql(BOOK + "\nSELECT t, symbol, round(weight, 6) AS weight FROM book", "fit"))
def f8(t):
    _, _, fit, _, states = state_inputs(t)
    return H.fund_book(states, fit, CFG).select("t", "symbol", *rnd("weight"))


@query("f10_frozen_hedge_book", rsql("""WITH n AS (SELECT *, CASE WHEN state <> lag(state, 1, 0) OVER (PARTITION BY symbol ORDER BY i) THEN 1 ELSE 0 END AS nw FROM states),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY i) AS island FROM n),
e AS (SELECT s.symbol, s.t, state, first_value(f.beta) OVER v AS beta, first_value(f.hedge) OVER v AS hedge FROM isl s JOIN fit f ON f.symbol = s.symbol AND f.t = s.t WHERE state <> 0
 WINDOW v AS (PARTITION BY s.symbol, island ORDER BY s.i)),
legs AS (SELECT t, symbol, 0.05::DOUBLE * state AS w FROM e UNION ALL SELECT t, hedge, -0.05::DOUBLE * state * beta FROM e)
SELECT t, symbol, round(sum(w), 6) AS weight FROM legs GROUP BY t, symbol""", "fit"))
def f10(t):
    """The hedge of the opening day, kept to the end of the trade."""
    _, _, fit, _, states = state_inputs(t)
    return H.fund_book(states, fit, CFG, frozen=True).select("t", "symbol", *rnd("weight"))


def run_fund(t):
    stock, funds, fit, days, states = state_inputs(t)
    cal = t.calendar()
    both = stock.select("symbol", "t", "ret").unionByName(funds.select("symbol", "t", "ret"))
    daily = H.stateful_backtest(H.fund_book(states, fit, CFG), states, days, both, cal, CFG)
    return daily, stock, funds, fit, days, states, cal


G7 = BOOK + """,
allr AS (SELECT symbol, t, ret FROM rets UNION ALL SELECT symbol, t, ret FROM fr),
g AS (SELECT b.t, sum(weight * coalesce(r.ret, 0)) AS gross FROM book b LEFT JOIN allr r ON r.symbol = b.symbol AND r.t = b.t + 1 GROUP BY b.t),
nx AS (SELECT t, lead(t) OVER (ORDER BY t) AS nt FROM hdays),
mv AS (SELECT t, symbol, sum(w) AS dw FROM (SELECT t, symbol, weight AS w FROM book UNION ALL SELECT nt, symbol, -weight FROM book JOIN nx USING (t) WHERE nt IS NOT NULL) GROUP BY t, symbol),
tv AS (SELECT t, sum(abs(dw)) AS turnover FROM mv GROUP BY t),
nn AS (SELECT t, count(*) FILTER (WHERE state > 0) AS n_long, count(*) FILTER (WHERE state < 0) AS n_short FROM states GROUP BY t),
sb AS (SELECT 'fund' AS variant, c.date, d.t + 1 AS t, coalesce(gross, 0) AS gross, coalesce(turnover, 0) AS turnover, n_long, n_short, coalesce(gross, 0) - coalesce(turnover, 0) * 5 / 1e4 AS net
 FROM hdays d LEFT JOIN g ON g.t = d.t LEFT JOIN tv ON tv.t = d.t LEFT JOIN nn ON nn.t = d.t JOIN cal c ON c.t = d.t + 1)"""


@query("g7_stateful_backtest", rsql(G7 + f"\nSELECT date, {R('gross', 'turnover', 'net')}, n_long, n_short FROM sb", "fit", "cal", "rets", "fr"))
def g7(t):
    d = run_fund(t)[0]
    return d.select("date", *rnd("gross", "turnover", "net"), F.col("n_long").cast("bigint").alias("n_long"), F.col("n_short").cast("bigint").alias("n_short"))


TRADES = """WITH n AS (SELECT *, CASE WHEN state <> lag(state, 1, 0) OVER (PARTITION BY symbol ORDER BY i) THEN 1 ELSE 0 END AS nw FROM states),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY i) AS island FROM n),
hr AS (SELECT f.symbol, f.t, coalesce(a.ret, 0) - f.beta * coalesce(b.ret, 0) AS hedged FROM fit f LEFT JOIN rets a ON a.symbol = f.symbol AND a.t = f.t + 1 LEFT JOIN fr b ON b.symbol = f.hedge AND b.t = f.t + 1),
k AS (SELECT s.symbol, island, any_value(state) AS side, min(s.t) AS t0, max(i) AS i1, sum(state * coalesce(hedged, 0)) AS pnl FROM isl s LEFT JOIN hr ON hr.symbol = s.symbol AND hr.t = s.t WHERE state <> 0 GROUP BY s.symbol, island),
tlog AS (SELECT 'fund' AS variant, k.symbol, CAST(side AS INTEGER) AS side, a.date AS entry, b.date AS exit, CAST(d.t - t0 AS INTEGER) AS days, pnl, f.s AS s_entry, f.kappa, f.sigma_eq, f.r2, f.alpha, t0
 FROM k JOIN hdays d ON d.i = k.i1 + 1 JOIN cal a ON a.t = t0 JOIN cal b ON b.t = d.t JOIN fit f ON f.symbol = k.symbol AND f.t = t0)"""
TNEED = ("fit", "cal", "rets", "fr")
TCOLS = ("pnl", "s_entry", "kappa", "sigma_eq", "r2", "alpha")


def trades_of(t):
    stock, funds, fit, days, states = state_inputs(t)
    return H.trade_log(states, days, fit, H.hedged_returns(fit, stock, funds), t.calendar()), stock


@query("g8_trade_log", rsql(TRADES + f"\nSELECT symbol, side, entry, exit, days, {R(*TCOLS)} FROM tlog", *TNEED))
def g8(t):
    return trades_of(t)[0].select("symbol", "side", "entry", "exit", "days", *rnd(*TCOLS))


@query("g9_hedged_returns", sql("""SELECT f.symbol, f.t, round(coalesce(a.ret, 0) - f.beta * coalesce(b.ret, 0), 6) AS hedged FROM fit f LEFT JOIN rets a ON a.symbol = f.symbol AND a.t = f.t + 1
 LEFT JOIN fr b ON b.symbol = f.hedge AND b.t = f.t + 1""", "fit", "rets", "fr"))
def g9(t):
    stock, funds, fit = fit_of(t)
    return H.hedged_returns(fit, stock, funds).select("symbol", "t", *rnd("hedged"))


@query("g10_window_trades", rsql(TRADES + "\nSELECT symbol, entry, exit, round(pnl, 6) AS pnl FROM tlog WHERE entry >= DATE '1997-01-01' AND exit <= DATE '1999-12-31'", *TNEED))
def g10t(t):
    return window_trades(trades_of(t)[0], "1997-01-01", "1999-12-31").select("symbol", "entry", "exit", *rnd("pnl"))


@query("c8_meta_label", rsql(TRADES + """
SELECT t.symbol, t.entry, CAST(pnl > 0 AS INTEGER) AS win, round(abs(s_entry), 6) AS abs_s, round(52 / kappa, 6) AS tau, round(m.market_vol, 6) AS market_vol FROM tlog t LEFT JOIN mktvol m ON m.date = t.entry""", *TNEED, "mktvol"))
def c8(t):
    """Closed trades labelled by outcome, with what was known at entry."""
    tr, _ = trades_of(t)
    return meta_rows(t, tr).select("symbol", "entry", "win", *rnd("abs_s", "tau", "market_vol"))


def meta_rows(t, tr):
    m = market_volatility(t.panel(), 20, 52).select(F.col("date").alias("entry"), "market_vol")
    return (tr.join(F.broadcast(m), "entry", "left").withColumn("win", (F.col("pnl") > 0).cast("int"))
            .withColumn("abs_s", F.abs("s_entry")).withColumn("tau", 52 / F.col("kappa")))


@query("j4_trade_book_stats", rsql(G7 + ",\n" + TRADES[5:] + ",\np AS (" + perf_sql("sb") + ")\nSELECT variant, " + R(*PERF) + """, days, (SELECT round(avg(turnover), 6) FROM sb) AS daily_turnover,
 (SELECT round(avg(n_long + n_short), 6) FROM sb) AS open_trades, (SELECT count(*) FROM tlog) AS trades, (SELECT round(avg(t.days), 6) FROM tlog t) AS holding_days FROM p""", *TNEED))
def j4(t):
    daily, stock, funds, fit, days, states, cal = run_fund(t)
    tr = H.trade_log(states, days, fit, H.hedged_returns(fit, stock, funds), cal)
    d = daily.withColumn("variant", F.lit("fund"))
    s = perf(d).join(d.groupBy("variant").agg(F.avg("turnover").alias("daily_turnover"), F.avg(F.col("n_long") + F.col("n_short")).alias("open_trades")), "variant")
    x = tr.agg(F.count("*").alias("trades"), F.round(F.avg("days"), 6).alias("holding_days"))
    return s.select("variant", *rnd(*PERF), "days", *rnd("daily_turnover", "open_trades")).join(F.broadcast(x))


@query("h13_reversion_time", sql("""SELECT round(quantile_cont(tau, 0.25), 6) AS q1, round(quantile_cont(tau, 0.5), 6) AS q2, round(quantile_cont(tau, 0.75), 6) AS q3,
 round(avg(CAST(tau < 6 AS INTEGER)), 6) AS fast, count(*) AS n FROM (SELECT 52 / kappa AS tau FROM fit WHERE kappa IS NOT NULL AND t % 5 = 0)""", "fit"))
def h13(t):
    """Quartiles of the reversion time on every fifth week, read off distributed ranks."""
    from ..functions.crosssection import wide_percentiles
    f = fit_of(t)[2].where("kappa IS NOT NULL AND t % 5 = 0").select("symbol", "t", (52 / F.col("kappa")).alias("tau"))
    q = wide_percentiles(f, [], "tau", [0.25, 0.5, 0.75], ["t", "symbol"], ["q1", "q2", "q3"])
    rest = f.agg(F.round(F.avg((F.col("tau") < 6).cast("double")), 6).alias("fast"), F.count("*").alias("n"))
    return q.select(*rnd("q1", "q2", "q3")).join(F.broadcast(rest))


@query("h14_symbol_path", rsql("""WITH p AS (SELECT s.t, f.s, state, CASE WHEN state <> 0 AND state <> lag(state, 1, 0) OVER (ORDER BY s.i) THEN 1 ELSE 0 END AS opened FROM states s JOIN fit f ON f.symbol = s.symbol AND f.t = s.t WHERE s.symbol = 'Brand#7')
SELECT CAST(count(*) AS BIGINT) AS days, CAST(sum(opened) AS BIGINT) AS opened, round(avg(CAST(state <> 0 AS INTEGER)), 6) AS in_trade, round(min(s), 6) AS lowest_s, round(max(s), 6) AS highest_s FROM p""", "fit"))
def h14(t):
    """One brand's score and state path: trades opened and share of weeks in one."""
    _, _, fit, _, states = state_inputs(t)
    w = Window.orderBy("t")
    p = (states.where("symbol = 'Brand#7'").join(fit.select("symbol", "t", "s"), ["symbol", "t"])
         .withColumn("opened", ((F.col("state") != 0) & (F.col("state") != F.lag("state", 1, 0).over(w))).cast("int")))
    return p.agg(F.count("*").alias("days"), F.sum("opened").alias("opened"), F.round(F.avg((F.col("state") != 0).cast("double")), 6).alias("in_trade"),
                 F.round(F.min("s"), 6).alias("lowest_s"), F.round(F.max("s"), 6).alias("highest_s"))


@query("h15_drift_adjusted_s", sql("SELECT symbol, t, round(s - alpha * 52 / (kappa * sigma_eq), 6) AS s_mod FROM fit WHERE s IS NOT NULL", "fit"))
def h15(t):
    f = fit_of(t)[2].where("s IS NOT NULL")
    return f.select("symbol", "t", F.round(F.col("s") - F.col("alpha") * 52 / (F.col("kappa") * F.col("sigma_eq")), 6).alias("s_mod"))


# ------------------------------------------------------------------ eigenportfolios

def eigen_of(t, cfg=CFG):
    """Every as-of week."""
    stock, _ = inputs(t)
    w = materialise(EI.day_blocks(stock, cfg), "blocks")
    days = H.cut_lineage(EI.eigen_days(w, cfg))
    return stock, w, days, EI.eigen_fit(w, days, cfg)


THREE = replace(CFG, n_factors=3)
cte("wholewin", f"""SELECT t, count(*) AS n FROM (SELECT t, count(ret) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {CFG.corr_window - 1} PRECEDING AND CURRENT ROW) AS known
 FROM rets) WHERE known = {CFG.corr_window} GROUP BY t HAVING count(*) >= {CFG.min_names}""", "rets")
_KL = "unnest([1, 2, 3]) AS k"


@query("h11_trace", sql("SELECT t, n AS n_stocks, CAST(n AS DOUBLE) AS trace FROM wholewin", "wholewin"))
def h11t(t):
    """A correlation matrix has one on its diagonal for every name: the eigenvalues of each week add up to the names."""
    days = eigen_of(t)[2]
    return days.select("t", "n_stocks", F.round(F.aggregate("eigenvalues", F.lit(0.0), lambda a, v: a + v), 6).alias("trace"))


@query("h8_loading_products", sql(f"""SELECT t, CAST(k AS INTEGER) AS k, CAST(l AS INTEGER) AS l, CAST(k = l AS DOUBLE) AS product
 FROM (SELECT t, k, unnest([1, 2, 3]) AS l FROM (SELECT t, {_KL} FROM wholewin))""", "wholewin"))
def h8p(t):
    """Loadings times volatility are unit vectors at right angles, every week, for three factors."""
    v = eigen_of(t, THREE)[3].select("t", F.transform("q", lambda x: x * F.col("sigma")).alias("v"))
    return _products(v, "v", "v")


def _products(df, left, right):
    """(t, k, l, product): sums over names of the k-th entry of one array times the l-th of another."""
    one = df.select("t", right, F.posexplode(left).alias("k", "x"))
    two = one.select("t", "k", "x", F.posexplode(right).alias("l", "y")).groupBy("t", "k", "l").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    return two.select("t", (F.col("k") + 1).alias("k"), (F.col("l") + 1).alias("l"), (F.round("p", 6) + F.lit(0.0)).alias("product"))


@query("h9_factor_exposures", sql(f"""SELECT t, CAST(k AS INTEGER) AS k, CAST(l AS INTEGER) AS l, CAST(k = l AS DOUBLE) AS product
 FROM (SELECT t, k, unnest([1, 2, 3]) AS l FROM (SELECT t, {_KL} FROM wholewin))""", "wholewin"))
def h9e(t):
    """A factor portfolio has exposure one to its own factor and none to the others."""
    return _products(eigen_of(t, THREE)[3], "q", "beta")


@query("f9_zero_exposure", sql(f"SELECT t, CAST(k AS INTEGER) AS factor, 0.0::DOUBLE AS exposure FROM (SELECT t, {_KL} FROM wholewin WHERE t < (SELECT max(t) FROM cal))", "wholewin", "cal"))
def f9z(t):
    """The hedged book's exposure to each of three factors, every week: nothing is left."""
    _, fit, _, states = eigen_states(t, THREE)
    book = EI.factor_book(states, fit, THREE)
    e = fit.select("t", "symbol", F.posexplode("beta").alias("k", "b")).join(book, ["t", "symbol"], "left")
    return e.groupBy("t", (F.col("k") + 1).alias("factor")).agg(F.abs(F.round(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("b")), 6)).alias("exposure"))


@query("h8_eigenportfolios")
def h8(t):
    """Eigenportfolio loadings per as-of week (checked against a dense decomposition in the tests)."""
    _, _, days, fit = eigen_of(t)
    return EI.eigenportfolios(fit, days).select("t", "factor", "symbol", *rnd("q", "eigenvalue"))


@query("h9_factor_regression")
def h9(t):
    """Multi-factor residual fits."""
    fit = eigen_of(t)[3]
    return fit.select("symbol", "t", "n_factors", *rnd("alpha", "r2", "kappa", "m", "sigma_eq", "x_last"))


@query("h10_factor_count_vs_volatility")
def h10(t):
    """Factors needed for 55% of the variance against market volatility."""
    _, _, days, _ = eigen_of(t)
    j = days.select("t", "n_factors").join(F.broadcast(market_volatility(t.panel(), 20, 52)), "t").where("market_vol IS NOT NULL")
    return j.agg(F.round(safe_corr(F.col("n_factors").cast("double"), "market_vol"), 6).alias("correlation"), F.count("*").alias("weeks"),
                 F.round(F.avg("n_factors"), 6).alias("mean_factors"))


@query("h11_spectrum")
def h11(t):
    """Eigenvalues against the noise edge."""
    _, _, days, _ = eigen_of(t)
    e = days.select("t", EI.noise_edge(F.col("n_stocks"), CFG.corr_window).alias("edge"), "n_stocks", F.posexplode("eigenvalues").alias("k", "eigenvalue"))
    return e.select("t", (F.col("k") + 1).alias("rank"), *rnd("eigenvalue", "edge"), F.round(F.col("eigenvalue") / F.col("n_stocks"), 6).alias("share"),
                    (F.col("eigenvalue") > F.col("edge")).cast("int").alias("above_noise"))


@query("h12_loadings_by_sector")
def h12(t):
    """First eigenvector (loadings times volatility) averaged by sector."""
    fit = eigen_of(t)[3]
    v = fit.select("t", "symbol", (F.element_at("q", 1) * F.col("sigma")).alias("v")).join(t.sectors(), "symbol")
    return v.groupBy("t", "fund").agg(F.round(F.avg("v"), 6).alias("mean_loading"), F.count("*").alias("names"))


def eigen_states(t, cfg=CFG):
    stock, _, _, fit = eigen_of(t, cfg)
    fit = H.cut_lineage(H.s_scores(fit, cfg))
    last = t.calendar().select(F.max("t")).scalar()
    fit = fit.where(F.col("t") < last)
    days = fit.select("t").distinct()
    return stock, fit, days, H.cut_lineage(H.trade_states(fit, days, cfg))


@query("f9_factor_hedged_book")
def f9(t):
    """Positions minus their factor exposure; factor exposure is zero by construction (tested)."""
    _, fit, _, states = eigen_states(t)
    return EI.factor_book(states, fit, CFG).select("t", "symbol", *rnd("weight"))


@query("g7_stateful_backtest_eigen")
def g7e(t):
    """The stateful book with eigenportfolio hedges."""
    stock, fit, days, states = eigen_states(t)
    d = H.stateful_backtest(EI.factor_book(states, fit, CFG), states, days, stock.select("symbol", "t", "ret"), t.calendar(), CFG)
    return d.select("date", *rnd("gross", "turnover", "net"), "n_long", "n_short")
