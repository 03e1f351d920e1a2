"""Performance and research statistics over the books."""

from pyspark.sql import functions as F

from ..functions.crosssection import safe_corr, wide_percentiles
from ..functions.frames import ahead, change
from ..functions.normal import A, B, C, D, E_CONST, EULER_GAMMA, LOW, TAIL, TAIL_P
from ..operators import stats as J
from ..operators.features import market_volatility
from .block_e_evaluate import R, known, rnd
from .block_fg_books import H, decile_run, benchmark_daily, drift_daily, grid_daily, ls_daily
from .registry import query
from .sqltext import cte, sql

PERF = ("mean_daily", "log_annual", "annual_vol", "sharpe", "max_drawdown", "hit_rate")


def perf_sql(rel: str, by: str = "variant", v: str = "net") -> str:
    return f"""SELECT {by}, avg({v}) AS mean_daily, CASE WHEN max_by(eq, date) > 0 THEN ln(max_by(eq, date)) * 52.0 / count(*) END AS log_annual,
 stddev_samp({v}) * sqrt(52.0) AS annual_vol, avg({v}) / nullif(stddev_samp({v}), 0) * sqrt(52.0) AS sharpe, min(eq / nullif(pk, 0) - 1) AS max_drawdown,
 count(*) FILTER (WHERE {v} > 0) / greatest(count(*) FILTER (WHERE {v} <> 0), 1) AS hit_rate, count(*) AS days
FROM (SELECT *, max(eq) OVER (PARTITION BY {by} ORDER BY date) AS pk FROM (SELECT *, product(1 + {v}) OVER (PARTITION BY {by} ORDER BY date) AS eq
 FROM {rel} WHERE {v} IS NOT NULL)) GROUP BY {by}"""


cte("ls_perf", perf_sql("ls"), "ls")


def perf(daily, by=("variant",)):
    """perf_stats with the annual return as a log: these toy books compound to astronomic levels."""
    return J.perf_stats(daily, "net", by, 52).withColumn("log_annual", F.ln(1 + F.col("annual_return")))


@query("j1_perf_stats", sql(f"SELECT variant, {R(*PERF)}, days FROM ls_perf", "ls_perf"))
def j1(t):
    """The flagship: reversal and trend books, long/short after costs, one row of statistics per book."""
    return perf(ls_daily(t)).select("variant", *rnd(*PERF), "days")


def drift_stats_sql(rel: str) -> str:
    return f"""SELECT variant, CASE WHEN b THEN NULL ELSE ln(eq) END AS log_total, CASE WHEN b THEN -1 ELSE pow(eq, 52.0 / n) - 1 END AS annual_return,
 CASE WHEN NOT b THEN sd * sqrt(52.0) END AS annual_vol, CASE WHEN NOT b THEN m / nullif(sd, 0) * sqrt(52.0) END AS sharpe, CASE WHEN NOT b THEN least(dd, 0) END AS max_drawdown,
 avg_turnover, n_rebalances, CAST(b AS INTEGER) AS blown_up FROM (SELECT variant, max(blown_up) = 1 AS b, count(*) AS n, stddev_samp(net) AS sd, avg(net) AS m,
 max_by(equity, t) AS eq, min(equity / greatest(pk, 1) - 1) AS dd, coalesce(avg(turnover) FILTER (WHERE rebalanced = 1), 0) AS avg_turnover, CAST(sum(rebalanced) AS BIGINT) AS n_rebalances
 FROM (SELECT *, max(equity) OVER (PARTITION BY variant ORDER BY t) AS pk FROM {rel}) GROUP BY variant)"""


cte("dr_stats", drift_stats_sql("dr"), "dr")
cte("bm_stats", drift_stats_sql("bm"), "bm")
DS = ("log_total", "annual_return", "annual_vol", "sharpe", "max_drawdown", "avg_turnover")


def log_total(d):
    return J.drift_stats(d, 52).withColumn("log_total", F.when(F.col("blown_up") == 0, F.ln(1 + F.col("total_return"))))


@query("j2_drift_stats", sql(f"SELECT variant, {R(*DS)}, n_rebalances, blown_up FROM dr_stats UNION ALL SELECT variant, {R(*DS)}, n_rebalances, blown_up FROM bm_stats", "dr_stats", "bm_stats"))
def j2(t):
    d = drift_daily(t).unionByName(benchmark_daily(t))
    return log_total(d).select("variant", *rnd(*DS), "n_rebalances", "blown_up")


@query("j3_period_stats", sql(f"""SELECT variant, round(avg(spread) * 52.0 / {H}, 6) AS annual_gross, round(avg(spread) / stddev_samp(spread) * sqrt(52.0 / {H}), 6) AS sharpe_gross,
 round(avg(net) * 52.0 / {H}, 6) AS annual_net, round(avg(net) / stddev_samp(net) * sqrt(52.0 / {H}), 6) AS sharpe_net, round(avg(turnover), 6) AS turnover, count(*) AS rebalances
FROM dp_period GROUP BY variant""", "dp_period"))
def j3(t):
    s = J.period_stats(decile_run(t)["periods"], H, 52)
    return s.select("variant", *rnd("annual_gross", "sharpe_gross", "annual_net", "sharpe_net", "turnover"), "rebalances")


CUTS = [("first", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("last", "2000-01-01", "2001-12-31"), ("short", "1998-01-01", "1998-03-01")]
cte("cut_days", "SELECT l.*, c.name FROM ls l JOIN (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in CUTS) + ") c(name, a, b) ON l.date BETWEEN a AND b", "ls")


@query("j5_stats_by_range", sql("SELECT variant, name, " + R(*PERF) + ", days FROM (" + perf_sql("cut_days", "variant, name") + ") WHERE days > 20", "cut_days"))
def j5(t):
    cuts = t.spark.createDataFrame(CUTS, "name string, start string, end string").select(
        "name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return J.by_range(ls_daily(t), cuts, "net", 52).withColumn("log_annual", F.ln(1 + F.col("annual_return"))).select("variant", "name", *rnd(*PERF), "days")


@query("j6_yearly", sql("SELECT variant, CAST(year(date) AS INTEGER) AS year, round(CASE WHEN product(1 + net) > 0 THEN ln(product(1 + net)) END, 6) AS log_ret FROM ls GROUP BY ALL", "ls"))
def j6(t):
    up = 1 + F.col("ret")
    return J.yearly(ls_daily(t)).select("variant", "year", F.round(F.when(up > 0, F.ln(up)), 6).alias("log_ret"))


@query("j7_equity_drawdown", sql("""SELECT variant, date, round(ln(eq), 6) AS log_equity, round(eq / greatest(max(eq) OVER (PARTITION BY variant ORDER BY date), 1) - 1, 6) AS drawdown
FROM (SELECT variant, date, product(1 + net) OVER (PARTITION BY variant ORDER BY date) AS eq FROM gr) WHERE eq > 0""", "gr"))
def j7(t):
    """Equity and drawdown of every grid variant, the first peak being the starting capital."""
    d = J.with_equity(grid_daily(t), "net", start_at_one=True).where("equity > 0")
    return d.select("variant", "date", F.round(F.ln("equity"), 6).alias("log_equity"), *rnd("drawdown"))


@query("j8_volatility_buckets", sql("""WITH v AS (SELECT l.*, m.market_vol AS vol FROM ls l JOIN mktvol m ON m.t = l.t - 1 WHERE m.market_vol IS NOT NULL),
e AS (SELECT variant, quantile_cont(vol, 0.2) AS a, quantile_cont(vol, 0.4) AS b, quantile_cont(vol, 0.6) AS c, quantile_cont(vol, 0.8) AS d FROM v GROUP BY variant)
SELECT variant, CAST(1 + CAST(vol > a AS INTEGER) + CAST(vol > b AS INTEGER) + CAST(vol > c AS INTEGER) + CAST(vol > d AS INTEGER) AS INTEGER) AS bucket,
 round(avg(gross), 6) AS gross, round(avg(net), 6) AS net, count(*) AS days FROM v JOIN e USING (variant) GROUP BY ALL""", "ls", "mktvol"))
def j8(t):
    d = ls_daily(t)
    return J.volatility_buckets(d, market_volatility(t.panel(), 20, 52)).select("variant", "bucket", *rnd("gross", "net"), "days")


@query("j9_side_by_side", sql(" UNION ALL ".join(f"SELECT '{n}' AS stat, " + ", ".join(f"round(max(CASE WHEN variant = '{v}' THEN {n} END), 6)::DOUBLE AS {v}" for v in ("mom", "rev5", "str", "wstr"))
       + " FROM ls_perf" for n in (*PERF, "days")), "ls_perf"))
def j9(t):
    s = J.side_by_side(perf(ls_daily(t)), ("mom", "rev5", "str", "wstr"), (*PERF, "days"))
    return s.select("stat", *rnd("mom", "rev5", "str", "wstr"))


cte("two", """SELECT n AS date, a.net AS x, b.net AS y, (a.net + b.net) / 2 AS blend FROM (SELECT * FROM ls WHERE variant = 'str') a JOIN (SELECT * FROM ls WHERE variant = 'mom') b USING (date)
 JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS n FROM cal) c ON c.date = a.date WHERE n IS NOT NULL""", "ls", "cal")
cte("two_long", "SELECT 'str' AS variant, date, x AS net FROM two UNION ALL SELECT 'mom', date, y FROM two UNION ALL SELECT 'blend', date, blend FROM two", "two")


@query("j10_blend", sql("SELECT p.variant, " + R(*PERF) + ", days, (SELECT round(corr(x, y), 6) FROM two) AS correlation FROM (" + perf_sql("two_long") + ") p", "two_long"))
def j10(t):
    """Two books re-dated to the earning day, aligned, correlated and blended."""
    d = J.redate_next(ls_daily(t).select("variant", "date", "net"), t.calendar())
    one = lambda v, n: d.where(F.col("variant") == v).select("date", F.col("net").alias(n))
    both = one("str", "x").join(one("mom", "y"), "date").withColumn("blend", (F.col("x") + F.col("y")) / 2)
    long = both.select("date", F.col("x").alias("str"), F.col("y").alias("mom"), "blend").unpivot(["date"], ["str", "mom", "blend"], "variant", "net")
    stats = perf(long)
    corr = both.agg(F.round(safe_corr("x", "y"), 6).alias("correlation"))
    return stats.select("variant", *rnd(*PERF), "days").join(F.broadcast(corr))


def cdf_sql(z: str) -> str:
    k = f"(1.0 / (1.0 + {TAIL_P} * abs({z})))"
    poly = "(" + " + ".join(f"({c}) * pow({k}, {i + 1})" for i, c in enumerate(TAIL)) + ")"
    tail = f"(exp(-({z}) * ({z}) / 2.0) / 2.5066282746310002 * {poly})"
    return f"CASE WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END"


def _poly(co, x):
    return "(" + " + ".join(f"({c!r}) * pow({x}, {len(co) - 1 - i})" for i, c in enumerate(co)) + ")"


def ppf_sql(p: str) -> str:
    q, r = f"(({p}) - 0.5)", f"((({p}) - 0.5) * (({p}) - 0.5))"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    one = (1.0,)
    return (f"CASE WHEN {p} < {LOW} THEN {_poly(C, lo)} / {_poly(D + one, lo)} WHEN {p} > {1 - LOW} THEN -{_poly(C, hi)} / {_poly(D + one, hi)} "
            f"ELSE {_poly(A, r)} * {q} / {_poly(B + one, r)} END")


MOM = """SELECT variant, count(*) AS n, avg(net) / nullif(stddev_samp(net), 0) AS sr,
 avg(pow(net - mu, 3)) / nullif(pow(avg(pow(net - mu, 2)), 1.5), 0) AS skew, avg(pow(net - mu, 4)) / nullif(pow(avg(pow(net - mu, 2)), 2), 0) AS kurt
 FROM (SELECT *, avg(net) OVER (PARTITION BY variant) AS mu FROM {}) GROUP BY variant"""
cte("ls_mom", MOM.format("ls"), "ls")
cte("gr_mom", MOM.format("gr"), "gr")
Z = "((sr - {}) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))"


@query("j11_probabilistic_sharpe", sql(f"SELECT variant, n, {R('sr', 'skew', 'kurt')}, round({cdf_sql(Z.format('0'))}, 6) AS psr FROM ls_mom", "ls_mom"))
def j11(t):
    m = J.moments(ls_daily(t))
    return m.select("variant", "n", *rnd("sr", "skew", "kurt"), F.round(J.probabilistic(F.lit(0.0)), 6).alias("psr"))


DSR = ("sr", "sharpe_annual", "hurdle", "hurdle_annual", "psr_zero", "dsr")


@query("j12_deflated_sharpe", sql(f"""WITH a AS (SELECT arg_max(variant, sr) AS variant, max(sr) AS sr, arg_max(n, sr) AS n, arg_max(skew, sr) AS skew, arg_max(kurt, sr) AS kurt,
 count(*) AS trials, var_samp(sr) AS v FROM gr_mom WHERE sr IS NOT NULL),
h AS (SELECT *, sqrt(v) * ((1 - {EULER_GAMMA}) * {ppf_sql('1 - 1.0 / trials')} + {EULER_GAMMA} * {ppf_sql(f'1 - 1.0 / (trials * {E_CONST})')}) AS hurdle FROM a)
SELECT variant, trials, round(sr, 6) AS sr, round(sr * sqrt(52.0), 6) AS sharpe_annual, round(hurdle, 6) AS hurdle, round(hurdle * sqrt(52.0), 6) AS hurdle_annual,
 round({cdf_sql(Z.format('0'))}, 6) AS psr_zero, round({cdf_sql(Z.format('hurdle'))}, 6) AS dsr FROM h""", "gr_mom"))
def j12(t):
    """The best of the grid against the luck of 24 tries."""
    return J.deflated(J.moments(grid_daily(t)), 52).select("variant", "trials", *rnd(*DSR))


@query("j13_mean_decile", sql(f"""SELECT variant, decile, round(avg(ret) * 52.0 / {H}, 6) AS annual FROM (SELECT variant, p, decile, avg(growth - 1) AS ret FROM dp_held
 WHERE t = p + {H} GROUP BY ALL) GROUP BY ALL""", "dp_held"))
def j13(t):
    return decile_run(t)["deciles"].groupBy("variant", "decile").agg(F.round(F.avg("ret") * (52 / H), 6).alias("annual"))


@query("j14_return_levels", sql("""SELECT round(median(abs(ret)), 6) AS median_abs_return, (SELECT round(avg(fwd), 6) FROM rets WHERE fwd IS NOT NULL) AS mean_target,
 (SELECT round(avg(fwd * fwd), 6) FROM rets WHERE fwd IS NOT NULL) AS zero_mse FROM rets WHERE ret IS NOT NULL""", "rets"))
def j14(t):
    """Typical move, mean target and the error of forecasting zero; the pooled median is read off distributed ranks."""
    p = t.keep_panel().panel().select("date", "symbol", F.abs(change("adj_close", 1)).alias("a"), ahead("adj_close", 1).alias("fwd"))
    med = wide_percentiles(p.select("date", "symbol", "a"), [], "a", [0.5], ["date", "symbol"], ["median_abs_return"])
    rest = p.agg(F.round(F.avg("fwd"), 6).alias("mean_target"), F.round(F.avg(F.col("fwd") * F.col("fwd")), 6).alias("zero_mse"))
    return med.select(*rnd("median_abs_return")).join(F.broadcast(rest))
