"""Features over the weekly brand panel (lookbacks scaled to weeks) and the wide supplier universe."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.crosssection import wide_percentiles, wide_rank
from ..functions.frames import change, ratio, rolling, shift
from ..operators import features as X
from .registry import query
from .sqltext import cte, sql

NAMES = ["ret_1", "ret_4", "ret_5", "ret_13", "vol_8", "vol_13", "volume_z", "hi52"]
HIGH, VOL = 52, 13
W = "WINDOW w AS (PARTITION BY symbol ORDER BY t)"


def roll(agg: str, n: int, lag: int = 0) -> str:
    f = f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1 + lag} PRECEDING AND {lag if lag else 'CURRENT'} {'PRECEDING' if lag else 'ROW'})"
    x = agg[agg.index("(") + 1:-1]
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN {agg} OVER {f} END"


cte("feats", f"""SELECT date, t, symbol, x, volume, ret, fwd, ret AS ret_1, x / lag(x, 4) OVER w - 1 AS ret_4,
  x / lag(x, 5) OVER w - 1 AS ret_5, x / lag(x, 13) OVER w - 1 AS ret_13, {roll('stddev_samp(ret)', 8)} AS vol_8,
  {roll('stddev_samp(ret)', 13)} AS vol_13,
  (volume - {roll('avg(volume)', 13)}) / nullif({roll('stddev_samp(volume)', 13)}, 0) AS volume_z,
  x / {roll('max(x)', 52)} - 1 AS hi52 FROM rets {W}""", "rets")
_rank = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN ((rank() OVER (PARTITION BY date, {n} IS NULL ORDER BY {n}) + (count(*) OVER "
                  f"(PARTITION BY date, {n}) - 1) / 2.0) - 0.5) / count({n}) OVER (PARTITION BY date) - 0.5 END AS {n}" for n in NAMES)
cte("ranked", f"SELECT date, t, symbol, fwd, {_rank} FROM feats WHERE x IS NOT NULL", "feats")
R6 = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
r6 = lambda names: [F.round(n, 6).alias(n) for n in names]


def feats(t, keep=("date", "symbol", "t"), panel=None):
    return X.build_features(t.panel() if panel is None else panel, NAMES, keep, HIGH, VOL)


@query("b1_daily_return", sql("SELECT date, symbol, ret FROM (SELECT *, x / lag(x) OVER (PARTITION BY symbol ORDER BY t) - 1 AS ret FROM grid_d) WHERE x IS NOT NULL", "grid_d"))
def b1(t):
    """Daily brand bars have gaps: a return never bridges one."""
    return t.panel("day").select("date", "symbol", change("adj_close", 1).alias("ret"))


@query("b2_past_return", sql(f"SELECT date, symbol, r FROM (SELECT date, symbol, x, x / lag(x, 5) OVER w - 1 AS r FROM grid_d {W}) WHERE x IS NOT NULL", "grid_d"))
def b2(t):
    return t.panel("day").select("date", "symbol", X.past_return("adj_close", 5).alias("r"))


@query("b3_rolling_vol", sql("SELECT date, symbol, round(vol_13, 6) AS vol FROM feats WHERE x IS NOT NULL", "feats"))
def b3(t):
    p = t.panel().withColumn("ret", change("adj_close", 1))
    return p.select("date", "symbol", F.round(X.rolling_vol("ret", 13), 6).alias("vol"))


@query("b4_volume_zscore", sql("SELECT date, symbol, round(volume_z, 6) AS z FROM feats WHERE x IS NOT NULL", "feats"))
def b4(t):
    return t.panel().select("date", "symbol", F.round(X.volume_zscore("volume", VOL), 6).alias("z"))


@query("b5_high_distance", sql("SELECT date, symbol, hi52 FROM feats WHERE x IS NOT NULL", "feats"))
def b5(t):
    return t.panel().select("date", "symbol", X.high_distance("adj_close", HIGH).alias("hi52"))


@query("b6_feature_by_name", sql("SELECT date, symbol, ret_13, round(vol_8, 6) AS vol_8 FROM feats WHERE x IS NOT NULL", "feats"))
def b6(t):
    return X.build_features(t.panel(), ["ret_13", "vol_8", "ret_13"], ("date", "symbol")).withColumn("vol_8", F.round("vol_8", 6))


@query("b7_feature_table", sql(f"SELECT date, symbol, t, {R6(NAMES)} FROM feats WHERE x IS NOT NULL", "feats"))
def b7(t):
    return feats(t).select("date", "symbol", "t", *r6(NAMES))


@query("b8_rank_normalise", sql(f"SELECT date, symbol, {R6(NAMES)} FROM ranked", "ranked"))
def b8(t):
    return X.rank_normalise(feats(t, ("date", "symbol")), NAMES).select("date", "symbol", *r6(NAMES))


@query("b8_rank_normalise_wide", sql("""SELECT date, symbol, round((rank() OVER (PARTITION BY date ORDER BY score)
 + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date) - 0.5, 6) AS r
FROM srets WHERE score IS NOT NULL""", "srets"))
def b8w(t):
    """The same rank over a universe that grows with the data: no task holds a whole date."""
    s = t.supplier_panel().select("date", "symbol", (-change("adj_close", 1)).alias("score"))
    r = wide_rank(s, ["date"], "score", ["symbol"])
    return r.select("date", "symbol", F.round((F.col("rank") - 0.5) / F.col("size") - 0.5, 6).alias("r"))


WLAGS = X.LAGS


@query("b9_lagged_returns", sql("SELECT date, symbol, " + ", ".join(f"R{m}" for m in WLAGS) + " FROM (SELECT date, symbol, "
       + ", ".join(f"x / lag(x, {m}) OVER w - 1 AS R{m}" for m in WLAGS) + f" FROM grid {W}) WHERE "
       + " AND ".join(f"R{m} IS NOT NULL" for m in WLAGS), "grid"))
def b9(t):
    return X.lagged_returns(t.panel(), WLAGS, ("date", "symbol"))


cte("mktvol", """SELECT date, t, mkt, CASE WHEN count(mkt) OVER f = 20 THEN stddev_samp(mkt) OVER f * sqrt(52.0) END AS market_vol
  FROM (SELECT date, t, avg(ret) AS mkt FROM rets GROUP BY date, t) WINDOW f AS (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "rets")


@query("b10_market_volatility", sql("SELECT date, round(market_vol, 6) AS market_vol FROM mktvol", "mktvol"))
def b10(t):
    return X.market_volatility(t.panel(), 20, 52).select("date", F.round("market_vol", 6).alias("market_vol"))


@query("b11_trading_time_return", sql(f"""SELECT date, symbol, round(ret * ({roll('avg(volume)', 10, 1)} / nullif(volume, 0)), 6) AS r,
 x IS NOT NULL AS ok FROM rets QUALIFY ok""", "rets").replace("SELECT date, symbol, round(ret", "SELECT date, symbol, r FROM (SELECT date, symbol, round(ret").replace(" FROM rets QUALIFY ok", " FROM rets) WHERE ok"))
def b11(t):
    p = t.panel().withColumn("ret", change("adj_close", 1))
    return p.select("date", "symbol", F.round(X.trading_time_returns(p, 10), 6).alias("r"))


@query("b12_trend_signals", sql("SELECT date, symbol, mom, str, wstr FROM score_cols WHERE x IS NOT NULL", "score_cols"))
def b12(t):
    s = X.trend_signals("adj_close", 52, 4, 1)
    return t.panel().select("date", "symbol", s["MOM"].alias("mom"), s["STR"].alias("str"), s["WSTR"].alias("wstr"))


@query("b13_dollar_volume", sql(f"SELECT date, symbol, round(dv, 4) AS dv FROM (SELECT date, symbol, x, {roll('avg(d)', 20)} AS dv FROM (SELECT *, x * volume AS d FROM grid)) WHERE x IS NOT NULL", "grid"))
def b13(t):
    p = t.panel().withColumn("d", F.col("adj_close") * F.col("volume"))
    return p.select("date", "symbol", F.round(rolling(F.avg, "d", 20), 4).alias("dv"))


@query("b14_rebased", sql("SELECT date, symbol, x / arg_min(x, t) OVER (PARTITION BY symbol) * 100 AS rebased FROM grid WHERE x IS NOT NULL", "grid"))
def b14(t):
    return t.panel().select("date", "symbol", X.rebased().alias("rebased"))


@query("b14_rebased_index", sql("SELECT date, round(avg(r), 6) AS idx FROM (SELECT date, x / arg_min(x, t) OVER (PARTITION BY symbol) * 100 AS r FROM grid WHERE x IS NOT NULL) GROUP BY date", "grid"))
def b14i(t):
    return (t.panel().select("date", X.rebased().alias("r")).groupBy("date").agg(F.round(F.avg("r"), 6).alias("idx")))


PRUNED_FROM = "2001-07-02"


def pruned(t, names, start):
    """Feature rows from `start` on, reading only the dates the lookback needs."""
    cal = t.calendar()
    first = X.lookback_date(cal, start, X.rows_needed(names, HIGH, VOL))
    return feats(t, panel=t.panel(start=str(first))).where(F.col("date") >= F.lit(start).cast("date"))


@query("b15_lookback_pruned_scan", sql(f"SELECT date, symbol, t, {R6(NAMES)} FROM feats WHERE x IS NOT NULL AND date >= DATE '{PRUNED_FROM}'", "feats"))
def b15(t):
    """Same rows as the full scan, from a scan cut to the lookback."""
    return pruned(t, NAMES, PRUNED_FROM).select("date", "symbol", "t", *r6(NAMES))


@query("b16_latest_features", sql(f"SELECT date, symbol, {R6(NAMES)} FROM ranked WHERE date = (SELECT max(date) FROM cal)", "ranked"))
def b16(t):
    last = str(t.calendar().agg(F.max("date").alias("d")).first()["d"])
    f = pruned(t, NAMES, last).where(F.col("date") == F.lit(last).cast("date")).drop("t")
    return X.rank_normalise(f, NAMES).select("date", "symbol", *r6(NAMES))


@query("b17_sector_rank", sql("""SELECT date, f.symbol, sector, round(((rank() OVER (PARTITION BY date, sector, ret_5 IS NULL ORDER BY ret_5)
 + (count(*) OVER (PARTITION BY date, sector, ret_5) - 1) / 2.0) - 0.5) / count(ret_5) OVER (PARTITION BY date, sector) - 0.5, 6) AS ret_5
FROM feats f JOIN sectors USING (symbol) WHERE x IS NOT NULL""", "feats", "sectors").replace("round(((rank()", "round(CASE WHEN ret_5 IS NOT NULL THEN ((rank()").replace("- 0.5, 6) AS ret_5", "- 0.5 END, 6) AS ret_5"))
def b17(t):
    f = X.build_features(t.panel(), ["ret_5"], ("date", "symbol")).join(t.sectors().select("symbol", "sector"), "symbol")
    return (X.rank_normalise(f, ["ret_5"], ("date", "sector"))
            .select("date", "symbol", "sector", F.round("ret_5", 6).alias("ret_5")))


@query("b18_feature_histogram", sql("""WITH c AS (SELECT quantile_cont(ret_5, 0.005) AS lo, quantile_cont(ret_5, 0.995) AS hi FROM feats WHERE ret_5 IS NOT NULL)
SELECT CAST(least(79, floor((greatest(lo, least(hi, ret_5)) - lo) / (hi - lo) * 80)) AS BIGINT) AS bin, count(*) AS rows
FROM feats, c WHERE ret_5 IS NOT NULL GROUP BY 1""", "feats"))
def b18(t):
    """Clipped histogram; the clip percentiles are exact and found without gathering the column."""
    f = X.build_features(t.panel(), ["ret_5"], ("date", "symbol")).dropna()
    edges = wide_percentiles(f, [], "ret_5", [0.005, 0.995], ["date", "symbol"], ["lo", "hi"])
    x = F.greatest("lo", F.least("hi", "ret_5"))
    bin_ = F.least(F.lit(79), F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 80)).cast("bigint")
    return f.join(F.broadcast(edges)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("rows"))
