"""Labels and datasets."""

from pyspark.sql import functions as F

from ..functions.frames import ahead, change, shift
from ..operators import features as X
from ..operators import labels as L
from .block_b_features import NAMES, R6, VOL, HIGH, WLAGS, W, feats, r6
from .registry import query
from .sqltext import cte, sql


@query("c1_forward_return", sql(f"SELECT date, symbol, lead(x, 5) OVER w / x - 1 AS fwd5, lead(x) OVER w / x - 1 AS fwd1 FROM grid_d {W}", "grid_d").replace("SELECT date, symbol, lead", "SELECT date, symbol, fwd5, fwd1 FROM (SELECT date, symbol, x, lead").replace(f"FROM grid_d {W}", f"FROM grid_d {W}) WHERE x IS NOT NULL"))
def c1(t):
    return t.panel("day").select("date", "symbol", L.forward_return(h=5).alias("fwd5"), L.forward_return(h=1).alias("fwd1"))


cte("labels1", """SELECT *, CASE WHEN fwd IS NOT NULL THEN CAST(fwd > median(fwd) OVER (PARTITION BY date) AS DOUBLE) END AS y,
  CASE WHEN fwd4 IS NOT NULL THEN CAST(fwd4 > median(fwd4) OVER (PARTITION BY date) AS DOUBLE) END AS y4
  FROM (SELECT *, lead(x, 4) OVER (PARTITION BY symbol ORDER BY t) / x - 1 AS fwd4 FROM rets)""", "rets")


@query("c2_median_label", sql("SELECT date, symbol, y, y4 FROM labels1 WHERE x IS NOT NULL", "labels1"))
def c2(t):
    p = t.panel().select("date", "symbol", ahead("adj_close", 1).alias("fwd"), ahead("adj_close", 4).alias("fwd4"))
    return p.select("date", "symbol", L.median_label("fwd").alias("y"), L.median_label("fwd4").alias("y4"))


@query("c2_median_label_wide", sql("""SELECT date, symbol, CASE WHEN fwd IS NOT NULL THEN CAST(fwd > median(fwd) OVER (PARTITION BY date) AS DOUBLE) END AS y
FROM srets WHERE x IS NOT NULL""", "srets"))
def c2w(t):
    """Beats-the-median over the growing universe, with a distributed median."""
    p = t.supplier_panel().select("date", "symbol", ahead("adj_close", 1).alias("fwd"))
    return L.median_label_wide(p, "fwd", ["date"], ["symbol"]).select("date", "symbol", "y")


@query("c3_up_label", sql("SELECT date, symbol, CAST(fwd > 0 AS INTEGER) AS up FROM rets WHERE fwd IS NOT NULL", "rets"))
def c3(t):
    p = t.panel().select("date", "symbol", ahead("adj_close", 1).alias("fwd")).where("fwd IS NOT NULL")
    return p.select("date", "symbol", L.up_label().alias("up"))


@query("c4_leaky_feature", sql("SELECT date, symbol, ret_5, fwd AS leaky_ret_next FROM feats WHERE x IS NOT NULL", "feats"))
def c4(t):
    """Deliberately wrong: tomorrow's return as a feature."""
    p = t.panel()
    return p.select("date", "symbol", X.past_return("adj_close", 5).alias("ret_5"), ahead("adj_close", 1).alias("leaky_ret_next"))


cte("dataset", "SELECT date, t, symbol, " + ", ".join(NAMES) + """, target FROM (SELECT f.*, lead(x, 4) OVER (PARTITION BY symbol ORDER BY t) / x - 1 AS target
  FROM feats f) WHERE target IS NOT NULL AND """ + " AND ".join(f"{n} IS NOT NULL" for n in NAMES), "feats")


def dataset(t, h=4):
    """Features and the h-week target computed in one pass over the panel: no join needed."""
    p = t.panel().withColumn("ret", change("adj_close", 1))
    cols = [X.feature(n, HIGH, VOL).alias(n) for n in NAMES]
    return p.select("date", "symbol", "t", *cols, ahead("adj_close", h).alias("target")).dropna()


@query("c5_make_dataset", sql(f"SELECT date, symbol, {R6(NAMES)}, target FROM dataset", "dataset"))
def c5(t):
    """Features joined to a separate target table, incomplete rows dropped."""
    target = t.panel().select("date", "symbol", ahead("adj_close", 4).alias("target"))
    return L.make_dataset(feats(t), target, NAMES).select("date", "symbol", *r6(NAMES), "target")


@query("c6_make_panel", sql("SELECT date, symbol, t, " + ", ".join(f"R{m}" for m in WLAGS) + ", fwd, y FROM (SELECT date, symbol, t, fwd, y, "
       + ", ".join(f"x / lag(x, {m}) OVER w - 1 AS R{m}" for m in WLAGS) + f" FROM labels1 {W}) WHERE "
       + " AND ".join(f"R{m} IS NOT NULL" for m in WLAGS), "labels1"))
def c6(t):
    return L.make_panel(t.panel(), WLAGS)


@query("c7_label_uniqueness", sql("""WITH l AS (SELECT symbol, t FROM (SELECT symbol, t, x, lead(x, 5) OVER (PARTITION BY symbol ORDER BY t) AS z FROM grid) WHERE x IS NOT NULL AND z IS NOT NULL)
SELECT a.symbol, a.t, round(avg(1.0 / c.n), 6) AS uniqueness FROM l a, LATERAL (SELECT unnest(generate_series(a.t + 1, a.t + 5)) AS d) s
JOIN (SELECT symbol, d, count(*) AS n FROM l, LATERAL (SELECT unnest(generate_series(l.t + 1, l.t + 5)) AS d) GROUP BY symbol, d) c ON c.symbol = a.symbol AND c.d = s.d
GROUP BY a.symbol, a.t""", "grid"))
def c7(t):
    labels = t.panel().select("symbol", "t", ahead("adj_close", 5).alias("f")).where("f IS NOT NULL")
    return L.label_uniqueness(labels, 5).select("symbol", "t", F.round("uniqueness", 6).alias("uniqueness"))
