"""Books and backtests against plain day loops and hand cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import backtest as G
from tidepanel.operators import portfolio as P
from tidepanel.operators import stats as J


def frames(spark, R, T):
    n, k = R.shape
    rets = spark.createDataFrame([(f"S{j}", i, float(R[i, j])) for i in range(n) for j in range(k) if R[i, j] == R[i, j]], "symbol string, t int, ret double")
    targets = spark.createDataFrame([("v", i, f"S{j}", float(w[j])) for i, w in T.items() for j in range(k)], "variant string, t int, symbol string, weight double")
    days = spark.range(n).select(F.lit("v").alias("variant"), F.col("id").cast("int").alias("t"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"))
    return targets, rets, days


def loop(R, T, bps):
    """Day by day: drift, then trade at the close."""
    R = np.nan_to_num(R)
    w, out, dead = np.zeros(R.shape[1]), [], False
    for i in range(len(R)):
        if dead:
            out.append((np.nan, 0.0))
            continue
        g = float(w @ R[i]) if i else 0.0
        if 1 + g <= 0:
            dead = True
            out.append((-1.0, 0.0))
            continue
        w = w * (1 + R[i]) / (1 + g) if i else w
        turn = 0.0
        if i in T:
            turn = float(np.abs(T[i] - w).sum())
            w = T[i].copy()
        out.append(((1 + g) * (1 - bps / 1e4 * turn) - 1, turn))
    return np.array(out)


@pytest.mark.parametrize("seed,scale", [(0, 0.02), (1, 0.05), (2, 0.9)])
def test_drifting_equals_day_loop(spark, seed, scale):
    rng = np.random.default_rng(seed)
    R = rng.normal(0, scale, (25, 5))
    R[7, 2] = np.nan
    T = {i: rng.permutation([0.5, 0.5, -0.5, -0.5, 0.0]) for i in range(0, 25, 6)}
    got = G.drifting(*frames(spark, R, T), 10.0).orderBy("t").toPandas()
    want = loop(R, T, 10.0)
    assert np.allclose(got["net"].astype(float), want[:, 0], equal_nan=True)
    assert np.allclose(got["turnover"], want[:, 1])


def test_blow_up(spark):
    R = np.array([[0.0, 0.0], [0.1, 1.5], [0.2, 0.3]])
    d = G.drifting(*frames(spark, R, {0: np.array([0.0, -1.0])}), 0.0).orderBy("t").toPandas()
    assert d["net"].tolist()[1] == -1.0 and np.isnan(d["net"].iloc[2]) and d["equity"].tolist() == [1.0, 0.0, 0.0] and d["blown_up"].eq(1).all()
    s = J.drift_stats(G.drifting(*frames(spark, R, {0: np.array([0.0, -1.0])}), 0.0)).first()
    assert s["total_return"] == -1.0 and s["sharpe"] is None and s["blown_up"] == 1


def test_long_short_by_hand(spark):
    rows = [("v", 0, "2020-01-01", s, x, r) for s, x, r in zip("ABCDEF", [6., 5., 4., 3., 2., 1.], [.1, .2, .0, .0, .3, -.1])]
    rows += [("v", 1, "2020-01-02", s, x, r) for s, x, r in zip("ABCDEF", [1., 5., 4., 3., 2., 6.], [.1, .1, .0, .0, .2, .2])]
    s = spark.createDataFrame(rows, "variant string, t int, date string, symbol string, score double, fwd double")
    w = P.daily_weights(s, ["variant", "t"], 2)
    d = G.long_short(w.where("weight != 0"), G.book_dates(s), 10.0).orderBy("t").toPandas()
    assert np.allclose(d["gross"], [0.15 - 0.1, 0.15 - 0.15]) and np.allclose(d["turnover"], [2.0, 2.0])
    assert np.allclose(d["net"], d["gross"] - d["turnover"] * 10 / 1e4)
    assert np.allclose(w.groupBy("t").agg(F.sum("weight")).toPandas().iloc[:, 1], 0)


def walk(scores, k, exit_k):
    """Banded book, straight from its description."""
    longs, shorts, out = [], [], []
    for t, day in scores.groupby("t"):
        order = day.sort_values(["score", "symbol"], ascending=[False, True])["symbol"].tolist()
        if len(order) < 2 * k:
            longs, shorts = [], []
            continue
        longs = [s for s in longs if s in order[:exit_k]]
        shorts = [s for s in shorts if s in order[::-1][:exit_k]]
        for s in order:
            if len(longs) < k and s not in longs and s not in shorts:
                longs.append(s)
        for s in order[::-1]:
            if len(shorts) < k and s not in shorts and s not in longs:
                shorts.append(s)
        out += [(t, s, 1 / k) for s in longs] + [(t, s, -1 / k) for s in shorts]
    return set(out)


@pytest.mark.parametrize("k,exit_k", [(2, 2), (3, 5), (3, 8), (2, 20)])
def test_banded_equals_walk(spark, k, exit_k):
    rng = np.random.default_rng(k * 10 + exit_k)
    rows = [("v", t, f"S{j:02d}", float(np.round(rng.normal(), 1))) for t in range(40) for j in range(14) if rng.random() > (0.75 if t in (9, 20) else 0.1)]
    pdf = pd.DataFrame(rows, columns=["variant", "t", "symbol", "score"])
    df = spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("int")).withColumn("k", F.lit(k)).withColumn("exit_k", F.lit(exit_k))
    got = {(r["t"], r["symbol"], r["weight"]) for r in P.banded_weights(P.band_candidates(df, ["variant", "t"], k, exit_k)).collect()}
    assert got == walk(pdf, k, exit_k)


def test_forecast_weights_checks(spark):
    rows = [("d", s, x) for s, x in zip("ABCDE", [1.0, 1.0, 2.0, float("nan"), 0.5])]
    df = spark.createDataFrame(rows, "date string, symbol string, score double")
    w = {r["symbol"]: r["weight"] for r in P.weights_from_forecasts(df, ["date"], 1, 2).collect()}
    assert w == {"C": 1.0, "A": 0.0, "B": -0.5, "E": -0.5, "D": 0.0}
    assert P.weights_from_forecasts(df, ["date"], 3, 3).count() == 0
    assert P.forecast_problems(df, ["date"], 6).first()["forecasts"] == 4
    with pytest.raises(ValueError):
        P.weights_from_forecasts(df, ["date"], 1.5, 2)


def test_decile_book_adds_up(spark, toy):
    df, _ = toy
    cal = df.select("date", "t").distinct()
    s = df.select(F.lit("v").alias("variant"), "t", "symbol", F.pmod(F.hash("symbol"), F.lit(100)).cast("double").alias("score"))
    r = G.decile_backtest(s, df, cal, 5, 10, 5, 5.0)
    p, d = r["periods"].toPandas(), r["daily"].toPandas()
    assert len(p) == 29 and abs(p["spread"].sum() - d["gross"].sum()) < 1e-9 and abs(p["net"].sum() - d["net"].sum()) < 1e-9
    assert abs(p.sort_values("date")["turnover"].iloc[0] - 2.0) < 1e-12


def test_perf_stats_by_hand(spark):
    r = [0.1, -0.05, 0.0, 0.02]
    df = spark.createDataFrame([("v", f"2020-01-0{i + 1}", x) for i, x in enumerate(r)], "variant string, date string, net double")
    s = J.perf_stats(df, "net").first()
    eq = np.cumprod(1 + np.array(r))
    assert abs(s["max_drawdown"] - (eq / np.maximum.accumulate(eq) - 1).min()) < 1e-12
    assert abs(s["hit_rate"] - 2 / 3) < 1e-12 and abs(s["annual_return"] - (eq[-1] ** (252 / 4) - 1)) < 1e-6


def test_probabilistic_sharpe_at_its_own_level(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("v", float(x)) for x in rng.normal(0.001, 0.01, 500)], "variant string, net double")
    m = J.moments(df)
    assert abs(m.select(J.probabilistic(F.col("sr"))).first()[0] - 0.5) < 1e-6


def test_run_backtest(spark):
    rng = np.random.default_rng(4)
    R, X = rng.normal(0, 0.03, (17, 6)), rng.normal(size=(17, 6))
    X[5, :4] = np.nan                                            # too few forecasts on a rebalance day: hold
    T = {}
    for i in range(0, 17, 5):
        if np.isfinite(X[i]).sum() >= 4:
            w, order = np.zeros(6), np.argsort(-X[i])
            w[order[:2]], w[order[-2:]] = 0.5, -0.5
            T[i] = w
    _, rets, days = frames(spark, R, {0: np.zeros(6)})
    rows = [("v", i, f"S{j}", float(X[i, j])) for i in range(17) for j in range(6)]
    s = spark.createDataFrame(rows, "variant string, t int, symbol string, score double").join(days.select("t", "date"), "t")
    got = G.run_backtest(s, rets, 2, 2, 5, 20.0).orderBy("t").toPandas()
    want = loop(R, T, 20.0)
    assert sorted(T) == [0, 10, 15] and np.allclose(got["net"], want[:, 0]) and np.allclose(got["turnover"], want[:, 1])
    with pytest.raises(ValueError):
        G.run_backtest(s, rets, 0, 0, 5, 20.0)
