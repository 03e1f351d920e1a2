"""Books and backtests."""

from pyspark.sql import functions as F

from ..functions.frames import ahead, change
from ..operators import backtest as G
from ..operators import portfolio as P
from ..operators import stats as J
from ..operators.features import market_volatility
from ..session import cut_lineage
from .block_e_evaluate import R, known, qcut_sql, rnd
from .registry import query
from .sqltext import cte, sql

HI = "row_number() OVER (PARTITION BY model, date ORDER BY score DESC, symbol)"
LO = "row_number() OVER (PARTITION BY model, date ORDER BY score, symbol)"
N = "count(*) OVER (PARTITION BY model, date)"
cte("placed", f"SELECT *, {HI} AS hi, {LO} AS lo, {N} AS n FROM scores", "scores")


@query("f1_forecast_weights", sql("""SELECT model, date, symbol, CASE WHEN hi <= 4 THEN 0.25 WHEN hi > n - 4 THEN -0.25 ELSE 0.0 END::DOUBLE AS weight
FROM placed WHERE n >= 8""", "placed"))
def f1(t):
    return (P.weights_from_forecasts(t.scores(), ["model", "date"], 4, 4).select("model", "date", "symbol", "weight"))


@query("f1_forecast_problems", sql("""WITH s AS (SELECT date, symbol, rev5 FROM score_cols WHERE x IS NOT NULL), twice AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE symbol = 'Brand#7' AND day(date) <= 7),
p AS (SELECT date, symbol, count(*) AS n, count(rev5) AS ok FROM twice GROUP BY ALL)
SELECT date, count(*) FILTER (n > 1) AS duplicates, CAST(sum(ok) AS BIGINT) AS forecasts FROM p GROUP BY date HAVING count(*) FILTER (n > 1) > 0 OR sum(ok) < 24""", "score_cols"))
def f1p(t):
    """Dates whose forecasts cannot fill the book, or name a symbol twice: one symbol's are sent again in first weeks."""
    s = t.score_columns().select("date", "symbol", F.col("rev5").alias("score"))
    s = s.unionByName(s.where((F.col("symbol") == "Brand#7") & (F.dayofmonth("date") <= 7)))
    return P.forecast_problems(s, ["date"], 24)


@query("f2_daily_weights", sql("""SELECT model, date, symbol, CASE WHEN n < 10 THEN 0.0 WHEN lo <= 5 THEN -1.0 / 5 WHEN hi <= 5 THEN 1.0 / 5 ELSE 0.0 END::DOUBLE AS weight
FROM placed""", "placed"))
def f2(t):
    return P.daily_weights(t.scores(), ["model", "date"], 5).select("model", "date", "symbol", "weight")


@query("f2_wide_picks", sql("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS hi,
 row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS lo, count(*) OVER (PARTITION BY date) AS n FROM sscores)
SELECT date, symbol, 0.1::DOUBLE AS weight FROM r WHERE hi <= 10 AND n >= 20 UNION ALL SELECT date, symbol, -0.1 FROM r WHERE lo <= 10 AND n >= 20""", "sscores"))
def f2w(t):
    """Top and bottom ten of a universe that grows with the data."""
    return P.wide_picks(t.supplier_scores(), ["date"], 10).select("date", "symbol", "weight")


def banded(t, k=5, exit_k=10):
    s = known(t).withColumnRenamed("model", "variant").withColumn("k", F.lit(k)).withColumn("exit_k", F.lit(exit_k))
    return P.banded_weights(P.band_candidates(s, ["variant", "t"], k, exit_k))


@query("f3_banded_weights")
def f3(t):
    """Path-dependent books (checked against a brute-force walk in the tests)."""
    return banded(t)


@query("f3_banded_same_k", sql("""WITH k AS (SELECT * FROM scores WHERE fwd IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY score DESC, symbol) AS hi,
 count(*) OVER (PARTITION BY model, date) AS n FROM k)
SELECT model AS variant, t, symbol, CASE WHEN hi <= 5 THEN 0.2 ELSE -0.2 END::DOUBLE AS weight FROM p WHERE n >= 10 AND (hi <= 5 OR hi > n - 5)""", "scores"))
def f3s(t):
    """With exit_k = k the banded book is the daily book."""
    return banded(t, 5, 5)


@query("f4_live_weights", sql("""SELECT date, symbol, CASE WHEN lo <= 6 THEN -1.0 / 12 WHEN lo > n - 6 THEN 1.0 / 12 ELSE 0.0 END::DOUBLE AS weight FROM placed
WHERE model = 'rev5' AND n >= 12""", "placed"))
def f4(t):
    return P.live_weights(t.scores(("rev5",)), ["date"], 6).select("date", "symbol", "weight")


@query("f5_decile_sizes", sql(f"""SELECT model, date, count(*) FILTER (WHERE d = 10) AS n_long, count(*) FILTER (WHERE d = 1) AS n_short, count(*) AS scored
FROM (SELECT model, date, {qcut_sql('lo', 'n', 10)} AS d FROM placed) GROUP BY model, date""", "placed"))
def f5(t):
    return P.decile_sizes(t.scores(), ["model", "date"])


cte("shortable", """SELECT symbol, CASE WHEN symbol = 'Brand#3' THEN NULL ELSE CAST('0x' || left(md5(symbol), 4) AS BIGINT) % 7 <> 0 END AS shortable
FROM (SELECT DISTINCT p_brand AS symbol FROM part)""")


def shortable(t):
    bad = F.conv(F.substring(F.md5("symbol"), 1, 4), 16, 10).cast("bigint") % 7 != 0
    return t.sectors().select("symbol", F.when(F.col("symbol") != "Brand#3", bad).alias("shortable"))


@query("f6_borrow_weights", sql("""WITH s AS (SELECT date, symbol, score, coalesce(shortable, TRUE) AS free, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS r FROM scores JOIN shortable USING (symbol) WHERE model = 'rev5'),
f AS (SELECT date, r, row_number() OVER (PARTITION BY date ORDER BY r) AS i FROM s WHERE free),
last AS (SELECT date, max(r) FILTER (WHERE i = 6) AS z FROM f GROUP BY date),
k AS (SELECT s.*, z, NOT free AND r < coalesce(z, 1000000) AS skipped FROM s JOIN last USING (date)),
m AS (SELECT *, count(*) FILTER (WHERE NOT skipped) OVER (PARTITION BY date) AS kept, count(*) FILTER (WHERE NOT skipped) OVER (PARTITION BY date ORDER BY r DESC) AS top FROM k)
SELECT date, symbol, CAST(skipped AS INTEGER) AS skipped, CASE WHEN kept >= 12 THEN 'ok' ELSE 'too_few' END AS status,
 CASE WHEN kept < 12 THEN NULL WHEN skipped THEN 0.0 WHEN free AND r <= z THEN -1.0 / 12 WHEN top <= 6 THEN 1.0 / 12 ELSE 0.0 END::DOUBLE AS weight FROM m""", "scores", "shortable"))
def f6(t):
    s = t.scores(("rev5",)).join(shortable(t), "symbol")
    return (P.weights_with_borrow(s, ["date"], 6)
            .select("date", "symbol", F.col("skipped").cast("int").alias("skipped"), "status", "weight"))


@query("f11_schedule", sql("""SELECT date, t, count(*) AS scored FROM scores WHERE model = 'rev5' AND (t - (SELECT min(t) FROM scores WHERE model = 'rev5')) % 4 = 0
GROUP BY date, t HAVING count(*) >= 24""", "scores"))
def f11(t):
    return G.schedule(t.scores(("rev5",)), 4, 24)


# ------------------------------------------------------------------ daily long/short books

cte("ls_dates", "SELECT model AS variant, date, t FROM scores GROUP BY ALL HAVING count(fwd) > 0", "scores")
cte("ls_book", """SELECT variant, s.date, s.t, symbol, fwd, CASE WHEN n < 10 THEN 0.0 WHEN lo <= 5 THEN -1.0 / 5 WHEN hi <= 5 THEN 1.0 / 5 ELSE 0.0 END::DOUBLE AS w
FROM (SELECT *, model AS variant FROM placed) s JOIN ls_dates USING (variant, t)""", "placed", "ls_dates")


def turnover_sql(book: str, dates: str) -> str:
    return f"""SELECT variant, t, sum(abs(dw)) AS turnover FROM (SELECT variant, t, symbol, sum(w) AS dw FROM (
 SELECT variant, t, symbol, w FROM {book} UNION ALL
 SELECT b.variant, d.nt, symbol, -w FROM {book} b JOIN (SELECT variant, t, lead(t) OVER (PARTITION BY variant ORDER BY t) AS nt FROM {dates}) d
  ON b.variant = d.variant AND b.t = d.t WHERE d.nt IS NOT NULL) GROUP BY variant, t, symbol) GROUP BY variant, t"""


cte("ls_turn", turnover_sql("ls_book", "ls_dates"), "ls_book", "ls_dates")
cte("ls", """SELECT variant, date, b.t, sum(w * coalesce(fwd, 0)) AS gross, sum(CASE WHEN w > 0 THEN w * coalesce(fwd, 0) ELSE 0 END) AS long_leg,
 sum(CASE WHEN w < 0 THEN w * coalesce(fwd, 0) ELSE 0 END) AS short_leg, any_value(turnover) AS turnover,
 sum(w * coalesce(fwd, 0)) - any_value(turnover) * 5 / 1e4 AS net FROM ls_book b JOIN ls_turn USING (variant, t) GROUP BY variant, date, b.t""", "ls_book", "ls_turn")


def books(t, k=5):
    t.keep_panel()
    s = t.scores().withColumnRenamed("model", "variant")
    return cut_lineage(P.daily_weights(s, ["variant", "t"], k).where("weight != 0")), G.book_dates(s)


def ls_daily(t):
    """Model-free long/short books, 5 bps: the daily series other queries start from."""
    book, dates = books(t)
    return G.long_short(book, dates, 5.0)


@query("g1_long_short", sql(f"SELECT variant, date, {R('gross', 'long_leg', 'short_leg', 'turnover', 'net')} FROM ls", "ls"))
def g1(t):
    return ls_daily(t).select("variant", "date", *rnd("gross", "long_leg", "short_leg", "turnover", "net"))


@query("g1_long_short_banded")
def g1b(t):
    """Banded books through the same backtest."""
    t.keep_panel()
    s = known(t).withColumnRenamed("model", "variant")
    w = banded(t).join(s.select("variant", "t", "symbol", "fwd"), ["variant", "t", "symbol"])
    return G.long_short(w, G.book_dates(s)).select("variant", "date", *rnd("gross", "turnover", "net"))


@query("g2_turnover", sql("SELECT variant, t, round(turnover, 6) AS turnover FROM ls_turn", "ls_turn"))
def g2(t):
    book, dates = books(t)
    d = dates.join(G.turnover(book, dates), ["variant", "t"], "left")
    return d.select("variant", "t", F.round(F.coalesce("turnover", F.lit(0.0)), 6).alias("turnover"))


# ------------------------------------------------------------------ drifting backtest

cte("dr_days", "SELECT model AS variant, t, date FROM scores GROUP BY ALL", "scores")
cte("dr_targets", """SELECT model AS variant, t, symbol, CASE WHEN hi <= 4 THEN 0.25 WHEN hi > n - 4 THEN -0.25 ELSE 0.0 END::DOUBLE AS w
FROM placed p WHERE n >= 8 AND (t - (SELECT min(t) FROM dr_days d WHERE d.variant = p.model)) % 4 = 0""", "placed", "dr_days")
cte("bm_targets", """SELECT variant, t, symbol, 1.0::DOUBLE / 25 AS w FROM (SELECT 'benchmark' AS variant, t FROM dr_days WHERE variant = 'rev5' AND (t - 5) % 4 = 0)
 CROSS JOIN (SELECT DISTINCT symbol FROM bars)""", "dr_days", "bars")
cte("bm_days", "SELECT 'benchmark' AS variant, t, date FROM dr_days WHERE variant = 'rev5'", "dr_days")


def drift_ctes(tag: str, targets: str, days: str, bps: float) -> None:
    cte(f"{tag}_seg", f"""SELECT variant, t AS r, coalesce(lead(t) OVER (PARTITION BY variant ORDER BY t), z) AS e FROM (SELECT DISTINCT variant, t FROM {targets})
 JOIN (SELECT variant, max(t) AS z FROM {days} GROUP BY variant) USING (variant)""", targets, days)
    cte(f"{tag}_held", f"""SELECT k.variant, r, e, k.symbol, w, g.t, product(CASE WHEN g.t = r THEN 1 ELSE 1 + coalesce(g.ret, 0) END) OVER
 (PARTITION BY k.variant, r, k.symbol ORDER BY g.t) AS gr FROM {targets} k JOIN {tag}_seg s ON k.variant = s.variant AND k.t = s.r
 JOIN rets g ON g.symbol = k.symbol AND g.t BETWEEN r AND e WHERE w <> 0""", targets, f"{tag}_seg", "rets")
    cte(f"{tag}_val", f"SELECT variant, r, t, e, 1 + sum(w * (gr - 1)) AS v FROM {tag}_held GROUP BY ALL", f"{tag}_held")
    cte(f"{tag}_g", f"SELECT * FROM (SELECT variant, r, t, v / lag(v) OVER (PARTITION BY variant, r ORDER BY t) - 1 AS g FROM {tag}_val) WHERE t > r", f"{tag}_val")
    cte(f"{tag}_to", f"""SELECT variant, t, sum(abs(d)) AS turnover FROM (SELECT variant, t, symbol, sum(w) AS d FROM (SELECT variant, t, symbol, w FROM {targets}
 UNION ALL SELECT h.variant, h.t, h.symbol, -h.w * h.gr / v.v FROM {tag}_held h JOIN {tag}_val v ON h.variant = v.variant AND h.r = v.r AND h.t = v.t
 WHERE h.t = h.e AND h.e > h.r AND (h.variant, h.t) IN (SELECT (variant, t) FROM {targets})) GROUP BY ALL) GROUP BY ALL""", f"{tag}_held", f"{tag}_val")
    cte(f"{tag}_raw", f"""SELECT d.variant, d.t, d.date, coalesce(g, 0) AS gross, coalesce(turnover, 0) AS turnover, turnover IS NOT NULL AS reb,
 CASE WHEN 1 + coalesce(g, 0) <= 0 THEN 0 ELSE coalesce(turnover, 0) * {bps} / 1e4 END AS cost
 FROM {days} d LEFT JOIN {tag}_g g ON g.variant = d.variant AND g.t = d.t LEFT JOIN {tag}_to o ON o.variant = d.variant AND o.t = d.t""", days, f"{tag}_g", f"{tag}_to")
    cte(tag, f"""SELECT *, product(1 + coalesce(net, 0)) OVER (PARTITION BY variant ORDER BY t) AS equity FROM (SELECT variant, t, date,
 CASE WHEN b IS NULL OR t <= b THEN gross ELSE 0 END AS gross, CASE WHEN b IS NULL OR t < b THEN turnover ELSE 0 END AS turnover,
 CASE WHEN b IS NULL OR t <= b THEN cost ELSE 0 END AS cost, CASE WHEN b IS NULL OR t < b THEN (1 + gross) * (1 - cost) - 1 WHEN t = b THEN -1 END AS net,
 CAST(reb AND (b IS NULL OR t < b) AS INTEGER) AS rebalanced, CAST(b IS NOT NULL AS INTEGER) AS blown_up
 FROM (SELECT *, min(CASE WHEN 1 + gross <= 0 OR cost >= 1 THEN t END) OVER (PARTITION BY variant) AS b FROM {tag}_raw))""", f"{tag}_raw")


drift_ctes("dr", "dr_targets", "dr_days", 5)
drift_ctes("bm", "bm_targets", "bm_days", 5)
DRIFT_COLS = ("gross", "turnover", "cost", "net")
LOG_EQ = "round(ln(nullif(equity, 0)), 6) AS log_equity"
log_eq = lambda: F.round(F.ln(F.nullif("equity", F.lit(0.0))), 6).alias("log_equity")


def drift_inputs(t):
    t.keep_panel()
    s = t.scores().withColumnRenamed("model", "variant")
    days = s.select("variant", "t", "date").distinct()
    first = days.groupBy("variant").agg(F.min("t").alias("_t0"))
    on = s.join(F.broadcast(first), "variant").where(F.pmod(F.col("t") - F.col("_t0"), F.lit(4)) == 0)
    targets = P.weights_from_forecasts(on, ["variant", "t"], 4, 4).select("variant", "t", "symbol", "weight")
    return targets, t.panel().select("symbol", "t", change("adj_close", 1).alias("ret")), days


def drift_daily(t):
    """Four names a side, rebalanced every fourth week, weights drifting between."""
    targets, rets, days = drift_inputs(t)
    return G.drifting(targets, rets, days, 5.0)


@query("g3_drifting_backtest", sql(f"SELECT variant, t, date, {R(*DRIFT_COLS)}, {LOG_EQ}, rebalanced FROM dr", "dr"))
def g3(t):
    return drift_daily(t).select("variant", "t", "date", *rnd(*DRIFT_COLS), log_eq(), "rebalanced")


@query("g4_blow_up", sql("SELECT variant, max(blown_up) AS blown_up, min(CASE WHEN net = -1 THEN date END) AS blown_on, count(net) AS days_alive FROM dr GROUP BY variant", "dr"))
def g4(t):
    """Which books lose everything, and when."""
    return drift_daily(t).groupBy("variant").agg(F.max("blown_up").alias("blown_up"), F.min(F.when(F.col("net") == -1, F.col("date"))).alias("blown_on"),
                                                 F.count("net").alias("days_alive"))


def benchmark_daily(t):
    t.keep_panel()
    days = t.scores(("rev5",)).select(F.lit("benchmark").alias("variant"), "t", "date").distinct()
    first = days.select(F.min("t")).scalar()
    reb = days.where(F.pmod(F.col("t") - first, F.lit(4)) == 0).select("variant", "t")
    symbols = t.sectors().select("symbol")
    targets = G.equal_weight_targets(symbols, reb, symbols.select(F.count("*")).scalar())
    return G.drifting(targets, t.panel().select("symbol", "t", change("adj_close", 1).alias("ret")), days, 5.0)


@query("g5_benchmark", sql(f"SELECT variant, t, date, {R(*DRIFT_COLS)}, {LOG_EQ} FROM bm", "bm"))
def g5(t):
    return benchmark_daily(t).select("variant", "t", "date", *rnd(*DRIFT_COLS), log_eq())


# ------------------------------------------------------------------ decile buy and hold

H, ND, T0 = 4, 5, 53
cte("dp_grid", "SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t) AS px FROM grid", "grid")
cte("dp_picks", f"""SELECT *, {qcut_sql('r', 'n', ND)} AS decile FROM (SELECT model AS variant, t AS p, s.symbol, g.x AS p0, row_number() OVER (PARTITION BY model, t ORDER BY score, s.symbol) AS r,
 count(*) OVER (PARTITION BY model, t) AS n FROM scores s JOIN (SELECT symbol AS sy, t AS gt, x FROM grid) g ON g.sy = s.symbol AND g.gt = s.t
 WHERE t >= {T0} AND (t - {T0}) % {H} = 0 AND t + {H} <= (SELECT max(t) FROM cal) AND x IS NOT NULL) WHERE n >= {2 * ND}""", "scores", "grid", "cal")
cte("dp_held", f"SELECT k.*, g.t, g.px / k.p0 AS growth FROM dp_picks k JOIN dp_grid g ON g.symbol = k.symbol AND g.t BETWEEN p + 1 AND p + {H}", "dp_picks", "dp_grid")
cte("dp_val", f"SELECT variant, p, t, avg(growth) FILTER (WHERE decile = {ND}) AS l, avg(growth) FILTER (WHERE decile = 1) AS s FROM dp_held GROUP BY ALL", "dp_held")
cte("dp_cnt", f"SELECT variant, p, max(n) AS n, count(*) FILTER (WHERE decile = {ND}) AS nl, count(*) FILTER (WHERE decile = 1) AS ns FROM dp_picks GROUP BY ALL", "dp_picks")
cte("dp_turn", f"""SELECT variant, p, sum(abs(d)) AS turnover FROM (SELECT variant, p, symbol, sum(w) AS d FROM (
 SELECT variant, p, symbol, CASE WHEN decile = {ND} THEN 1.0 / nl ELSE -1.0 / ns END AS w FROM dp_picks JOIN dp_cnt USING (variant, p) WHERE decile IN (1, {ND})
 UNION ALL SELECT variant, p + {H}, symbol, -growth * CASE WHEN decile = {ND} THEN 1.0 / nl ELSE -1.0 / ns END FROM dp_held JOIN dp_cnt USING (variant, p)
  WHERE decile IN (1, {ND}) AND t = p + {H}) GROUP BY ALL) GROUP BY ALL""", "dp_picks", "dp_cnt", "dp_held")
cte("dp_period", f"""SELECT v.variant, v.p, a.date, l - 1 AS long, s - 1 AS short, l - s AS spread, n, turnover, turnover * 5 / 1e4 AS cost, l - s - turnover * 5 / 1e4 AS net,
 b.date AS first_day, c.date AS last_day FROM dp_val v JOIN dp_cnt USING (variant, p) JOIN dp_turn USING (variant, p) JOIN cal a ON a.t = v.p JOIN cal b ON b.t = v.p + 1
 JOIN cal c ON c.t = v.p + {H} WHERE v.t = v.p + {H}""", "dp_val", "dp_cnt", "dp_turn", "cal")
cte("dp_daily", """SELECT v.variant, c.date, v.t, g AS gross, g - CASE WHEN v.t = v.p + 1 THEN cost ELSE 0 END AS net FROM (SELECT *, l - s - coalesce(lag(l - s) OVER
 (PARTITION BY variant, p ORDER BY t), 0) AS g FROM dp_val) v JOIN dp_period q ON q.variant = v.variant AND q.p = v.p JOIN cal c ON c.t = v.t""", "dp_val", "dp_period", "cal")


def decile_run(t):
    """Quintile books held four weeks."""
    t.keep_panel()
    s = t.scores().withColumnRenamed("model", "variant").select("variant", "t", "symbol", "score")
    return G.decile_backtest(s, t.panel(), t.calendar(), H, T0, ND, 5.0)


PCOLS = ("long", "short", "spread", "turnover", "cost", "net")


@query("g6_decile_periods", sql(f"SELECT variant, date, {R(*PCOLS)}, n, first_day, last_day FROM dp_period", "dp_period"))
def g6(t):
    return decile_run(t)["periods"].select("variant", "date", *rnd(*PCOLS), "n", "first_day", "last_day")


@query("g6_decile_daily", sql(f"SELECT variant, date, {R('gross', 'net')} FROM dp_daily", "dp_daily"))
def g6d(t):
    return decile_run(t)["daily"].select("variant", "date", *rnd("gross", "net"))


@query("g6_decile_table", sql(f"SELECT variant, c.date, decile, round(avg(growth - 1), 6) AS ret FROM dp_held h JOIN cal c ON c.t = h.p WHERE h.t = h.p + {H} GROUP BY ALL", "dp_held", "cal"))
def g6t(t):
    return decile_run(t)["deciles"].select("variant", "date", "decile", *rnd("ret"))


LO_D, HI_D = "1997-01-01", "1999-12-31"


@query("g10_window_daily", sql(f"SELECT variant, date, round(net, 6) AS net FROM ls WHERE date BETWEEN DATE '{LO_D}' AND DATE '{HI_D}'", "ls"))
def g10(t):
    return G.window_daily(ls_daily(t), LO_D, HI_D).select("variant", "date", *rnd("net"))


@query("g10_window_periods", sql(f"""WITH q AS (SELECT * FROM dp_period WHERE date BETWEEN DATE '{LO_D}' AND DATE '{HI_D}'), s AS (SELECT variant, min(first_day) AS a, max(last_day) AS z FROM q GROUP BY variant)
SELECT d.variant, d.date, round(d.net, 6) AS net FROM dp_daily d JOIN s ON s.variant = d.variant AND d.date BETWEEN a AND z""", "dp_daily"))
def g10p(t):
    return G.window_periods(decile_run(t), LO_D, HI_D)["daily"].select("variant", "date", *rnd("net"))


@query("g11_volatility_filter", sql("SELECT l.variant, l.date, round(CASE WHEN m.market_vol > 1.0 THEN net ELSE 0 END, 6) AS net FROM ls l LEFT JOIN mktvol m ON m.t = l.t - 1", "ls", "mktvol"))
def g11(t):
    return G.volatility_filter(ls_daily(t), market_volatility(t.panel(), 20, 52), 1.0).select("variant", "date", *rnd("net"))


# ------------------------------------------------------------------ strategy grid

KS, BPS = (3, 5, 8), (0.0, 10.0)
GRID_SQL = ", ".join(f"('{m}', {k}, {b})" for m in ("rev5", "mom", "str", "wstr") for k in KS for b in BPS)
cte("grid_variants", f"SELECT model || '_' || k || '_' || CAST(b AS INTEGER) AS variant, model, k, b FROM (VALUES {GRID_SQL}) v(model, k, b)")
cte("gr_dates", "SELECT variant, date, t, b FROM ls_dates d JOIN (SELECT variant AS v2, model, b FROM grid_variants) g ON g.model = d.variant", "ls_dates", "grid_variants")
cte("gr_dates2", "SELECT v2 AS variant, d.date, d.t, g.b FROM ls_dates d JOIN (SELECT variant AS v2, model, b FROM grid_variants) g ON g.model = d.variant", "ls_dates", "grid_variants")
cte("gr_book", """SELECT g.variant, p.t, p.symbol, p.fwd, CASE WHEN lo <= k THEN -1.0 / k ELSE 1.0 / k END::DOUBLE AS w FROM placed p JOIN grid_variants g ON g.model = p.model
 JOIN gr_dates2 d ON d.variant = g.variant AND d.t = p.t WHERE n >= 2 * k AND (lo <= k OR hi <= k)""", "placed", "grid_variants", "gr_dates2")
cte("gr_turn", turnover_sql("gr_book", "gr_dates2"), "gr_book", "gr_dates2")
cte("gr", """SELECT d.variant, d.date, d.t, coalesce(g, 0) AS gross, coalesce(turnover, 0) AS turnover, coalesce(g, 0) - coalesce(turnover, 0) * b / 1e4 AS net
 FROM gr_dates2 d LEFT JOIN (SELECT variant, t, sum(w * coalesce(fwd, 0)) AS g FROM gr_book GROUP BY ALL) p ON p.variant = d.variant AND p.t = d.t
 LEFT JOIN gr_turn u ON u.variant = d.variant AND u.t = d.t""", "gr_dates2", "gr_book", "gr_turn")


def variants(t):
    rows = [(f"{m}_{k}_{int(b)}", m, k, b) for m in ("rev5", "mom", "str", "wstr") for k in KS for b in BPS]
    return t.spark.createDataFrame(rows, "variant string, model string, k int, cost_bps double")


def grid_daily(t):
    """24 variants in one job: names are ranked once per model, then meet the short variant list."""
    t.keep_panel()
    placed = P.two_way_places(t.scores(), ["model", "t"])
    v = F.broadcast(variants(t))
    k = F.col("k")
    hit = (F.col("n") >= 2 * k) & ((F.col("lo") <= k) | (F.col("hi") <= k))
    w = F.when(F.col("lo") <= k, -1.0 / k).otherwise(1.0 / k)
    book = cut_lineage(placed.join(v, "model").where(hit).select("variant", "t", "symbol", "fwd", w.alias("weight")))
    dates = G.book_dates(t.scores(), ["model"]).join(v, "model").select("variant", "t", "date", "cost_bps")
    return G.long_short(book, dates, F.col("cost_bps"))


@query("g12_strategy_grid", sql(f"SELECT variant, date, {R('gross', 'turnover', 'net')} FROM gr", "gr"))
def g12(t):
    return grid_daily(t).select("variant", "date", *rnd("gross", "turnover", "net"))


@query("g12_banded_grid")
def g12b(t):
    """Banded variants of every model in one job: each is walked alone over its few candidate rows per date."""
    t.keep_panel()
    rows = [(f"{m}_{k}_{x}", m, k, x) for m in ("rev5", "mom", "str", "wstr") for k in (3, 5) for x in (5, 10)]
    v = F.broadcast(t.spark.createDataFrame(rows, "variant string, model string, k int, exit_k int"))
    s = cut_lineage(known(t).join(v, "model"))
    w = P.banded_weights(P.band_candidates(s, ["variant", "t"], "k", "exit_k"))
    book = w.join(s.select("variant", "t", "symbol", "fwd"), ["variant", "t", "symbol"])
    return G.long_short(book, G.book_dates(s)).select("variant", "date", *rnd("gross", "turnover", "net"))


@query("g13_cost_per_year", sql("SELECT variant, round(avg(turnover) * 5 / 1e4 * 52 / 1, 6) AS cost_per_year FROM ls GROUP BY variant", "ls"))
def g13(t):
    m = ls_daily(t).groupBy("variant").agg(F.avg("turnover").alias("turnover")).withColumn("every", F.lit(1))
    return m.select("variant", F.round(G.cost_per_year("turnover", "every", 5.0, 52), 6).alias("cost_per_year"))
