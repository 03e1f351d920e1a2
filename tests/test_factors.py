"""Fits, states, eigenportfolios against dense NumPy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import eigen as EI
from tidepanel.operators import factors as H

CFG = H.FactorConfig(window=20, corr_window=40, var_explained=0.6, min_kappa=8.4)


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(0, 0.01, (90, 2))
    R = f @ rng.normal(0.7, 0.4, (2, 15)) + rng.normal(0, 0.01, (90, 15))
    rows = [(f"S{j:02d}", i, float(R[i, j])) for i in range(90) for j in range(15) if not (j == 4 and 60 <= i < 63)]
    return spark.createDataFrame(rows, "symbol string, t int, ret double").cache(), R


@pytest.mark.parametrize("rows", [2000, 5])
def test_eigen_fit_has_its_properties(returns, rows):
    df, R = returns
    w = EI.day_blocks(df, CFG).cache()
    days = EI.eigen_days(w, CFG, rows=rows).where("t in (50, 70)").cache()
    fit = EI.eigen_fit(w, days, CFG, rows).toPandas()
    assert set(fit["t"]) == {50, 70}
    lam = {r["t"]: np.array(r["eigenvalues"]) for r in days.collect()}
    for t, cols in ((50, list(range(15))), (70, [j for j in range(15) if j != 4])):
        X = R[t - 39:t + 1][:, cols]
        g = fit[fit["t"] == t].set_index("symbol").loc[[f"S{j:02d}" for j in cols]]
        Q = np.vstack(g["q"])
        m = Q.shape[1]
        # a correlation matrix has trace n; the factors' own variances are its largest eigenvalues, and they do not covary
        assert abs(lam[t].sum() - len(cols)) < 1e-8 and (np.diff(lam[t]) <= 1e-9).all()
        assert np.allclose(np.cov(X @ Q, rowvar=False), np.diag(lam[t][:m]), atol=1e-7)
        assert np.allclose((Q * X.std(axis=0, ddof=1)[:, None] ** 2).T @ Q, np.eye(m), atol=1e-7)
        assert ((Q * X.std(axis=0, ddof=1)[:, None]).sum(axis=0) >= -1e-9).all()
        shares = lam[t].cumsum() / len(cols)
        assert shares[m - 1] >= 0.6 and (m == 1 or shares[m - 2] < 0.6)
        Y = X[-20:]
        F_ = Y @ Q
        B = np.linalg.lstsq(np.column_stack([np.ones(20), F_]), Y, rcond=None)[0]
        assert np.allclose(np.vstack(g["beta"]), B[1:].T, atol=1e-6) and np.allclose(g["alpha"], B[0], atol=1e-9)
        path = np.cumsum(Y - np.column_stack([np.ones(20), F_]) @ B, axis=0)
        b = [np.polyfit(path[:-1, i], path[1:, i], 1)[0] for i in range(len(cols))]
        assert np.allclose(g["b"], b, atol=1e-6)


def test_blocks_hold_a_return_twice_and_every_whole_window_is_used(spark, returns):
    df, R = returns
    blocks = EI.day_blocks(df, CFG)
    known = df.count()
    assert blocks.agg(F.sum(F.size("r"))).first()[0] <= 2 * known
    days = EI.eigen_days(blocks, CFG, stride=3, offset=1).toPandas().set_index("t")
    whole = lambda t: 14 if t - 39 <= 62 and t >= 60 else 15
    assert dict(days["n_stocks"]) == {t: whole(t) for t in range(39, 90) if t % 3 == 1}
    flat = df.where("symbol = 'S01'").select(F.lit("FLAT").alias("symbol"), "t", F.lit(0.01).alias("ret"))
    more = EI.eigen_days(EI.day_blocks(df.unionByName(flat), CFG), CFG, stride=3, offset=1).toPandas().set_index("t")
    assert dict(more["n_stocks"]) == dict(days["n_stocks"])         # a stock that never moves has no correlation
    assert EI.eigen_days(EI.day_blocks(df.where("t < 30"), CFG), CFG).count() == 0


def test_factor_book_has_no_exposure(spark, returns):
    df, R = returns
    w = EI.day_blocks(df, CFG)
    fit = EI.eigen_fit(w, EI.eigen_days(w, CFG, stride=25), CFG).where("t = 50")
    states = spark.createDataFrame([("S01", 50, 1), ("S02", 50, -1), ("S09", 50, 1)], "symbol string, t int, state int")
    book = {r["symbol"]: r["weight"] for r in EI.factor_book(states, fit, CFG).collect()}
    q = fit.toPandas().set_index("symbol")
    pos = {"S01": 0.05, "S02": -0.05, "S09": 0.05}
    g = sum(p * np.array(q.loc[s, "beta"]) for s, p in pos.items())
    for s in q.index:
        assert abs(book[s] - (pos.get(s, 0.0) - float(np.array(q.loc[s, "q"]) @ g))) < 1e-9


def test_ou_recovery(spark):
    """A simulated AR(1) path gives back its speed, level and spread."""
    rng = np.random.default_rng(0)
    b, m, sig, n = 0.9, 0.3, 0.02, 4000
    x = [m]
    for _ in range(n - 1):
        x.append(m + b * (x[-1] - m) + sig * rng.normal())
    cfg = H.FactorConfig(window=n)
    r = H.ou_from_paths(spark.createDataFrame([(x,)], "path array<double>"), cfg).first()
    assert abs(r["kappa"] + np.log(b) * 252) < 4 and abs(r["m"] - m) < 0.02 and abs(r["sigma_eq"] - sig / np.sqrt(1 - b * b)) < 0.01


def test_state_rules(spark):
    """Open beyond 1.25 when eligible, close inside 0.75 / 0.50, flat on an unknown score or a missing day."""
    steps = [(-1.2, True, 0), (-1.3, False, 0), (-1.3, True, 1), (-0.6, False, 1), (-0.4, True, 0), (1.3, True, -1), (0.8, True, -1), (0.7, True, 0),
             (2.0, True, -1), (None, True, 0), (-2.0, True, 1), (1.5, True, 0)]
    rows = [("A", i, s, ok) for i, (s, ok, _) in enumerate(steps)]
    df = spark.createDataFrame(rows + [("B", 0, -2.0, True), ("B", 2, -1.0, True)], "symbol string, t int, s double, eligible boolean")
    days = spark.range(12).select(F.col("id").cast("int").alias("t"))
    got = H.trade_states(df, days, H.FactorConfig()).orderBy("symbol", "t").collect()
    assert [r["state"] for r in got if r["symbol"] == "A"] == [s for _, _, s in steps]
    assert [r["state"] for r in got if r["symbol"] == "B"] == [1, 0]
