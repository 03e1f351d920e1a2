"""States along a key against a plain walk, with hot keys and gaps; linear models of many windows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.statescan import _AFTER, _ALL, compose, scan_states
from tidepanel.operators import factors as H
from tidepanel.operators import window_models as W

CFG = H.FactorConfig()


def rule(before):
    return H._next(before, F.col("s"), F.col("ok"), CFG)


def plain(state, s, ok):
    if s is None:
        return 0
    if state == 0:
        return 0 if not ok else 1 if s < -CFG.s_open else -1 if s > CFG.s_open else 0
    if (state == 1 and s > -CFG.s_close_long) or (state == -1 and s < CFG.s_close_short):
        return 0
    return state


def test_maps_compose():
    rnd = np.random.default_rng(0)
    codes = rnd.integers(0, 27, 300).astype(np.uint8)
    got = compose(codes)
    for start in (0, 1, 2):
        at = start
        for c, g in zip(codes, got):
            at = _ALL[c][at]
            assert _ALL[g][start] == at
    assert all(_ALL[_AFTER[g, f]][x] == _ALL[g][_ALL[f][x]] for g in range(27) for f in range(27) for x in range(3))


@pytest.mark.parametrize("parts", [1, 7])
def test_states_equal_a_plain_walk(spark, parts):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice([None, rnd.uniform(-2.5, 2.5), rnd.uniform(-2.5, 2.5)]), rnd.random() < 0.8, "x")
            for k in ("A", "B", None, "C") for i in range(400) if rnd.random() < 0.95 or k == "B"]
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, i int, s double, ok boolean, state string").repartition(parts)
        got = {(r["k"], r["i"]): r["state"] for r in scan_states(df, ["k"], ["i"], rule, "i").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state, last = 0, (None, None)
    assert len(got) == len(rows)
    for k, i, s, ok, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state = plain(state if (k, i - 1) == last else 0, s, ok)
        last = (k, i)
        assert got[k, i] == state
    assert scan_states(df.limit(0), ["k"], ["i"], rule, "i").count() == 0


def test_one_hot_key_is_spread_and_linear(spark):
    n = 200_000
    df = spark.range(2 * n).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.sin(F.col("id") * 0.37) * 2).alias("s"), F.lit(True).alias("ok"))
    scan_states(df.where("i < 1000"), ["k"], ["i"], rule, "i").count()
    took = []
    for rows in (n, 2 * n):
        t0 = time.time()
        out = scan_states(df.where(F.col("i") < rows), ["k"], ["i"], rule, "i")
        assert out.count() == rows
        took.append(time.time() - t0)
    assert took[1] < 4 * took[0] + 2
    s = np.sin(np.arange(n) * 0.37) * 2
    state, want = 0, []
    for v in s.tolist():
        state = plain(state, v, True)
        want.append(state)
    got = np.array([r["state"] for r in out.where(F.col("i") < n).orderBy("i").select("state").collect()])
    assert (got == np.array(want)).all()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # small partitions are joined up to a size
    sizes = [r["count"] for r in df.repartitionByRange("k", "i").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * n * 0.6


# --- linear models of many windows

@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    days, names = 90, 6
    x = rng.normal(0, 1, (days, names, 3))
    x[:, :, 2] = 1.5        # no spread
    y = x[:, :, 0] * 0.5 - x[:, :, 1] * 0.2 + rng.normal(0, 0.5, (days, names)) + 3
    rows = [(f"2020-{1 + d // 28:02d}-{1 + d % 28:02d}", f"S{j}", *map(float, x[d, j]), float(y[d, j]) if (d, j) != (5, 2) else None, float(y[d, j] > 3)) for d in range(days) for j in range(names)]
    df = spark.createDataFrame(rows, "d string, symbol string, a double, b double, c double, y double, up double").withColumn("date", F.to_date("d")).repartition(3).cache()
    w = [("p1", "2020-01-01", "2020-01-20"), ("p2", "2020-01-15", "2020-03-03"), ("p3", "2020-01-01", "2020-01-10"), ("p3", "2020-02-01", "2020-02-20"), ("none", "2021-01-01", "2021-02-01")]
    win = spark.createDataFrame(w, "key string, lo string, hi string").select("key", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    return df, win, df.toPandas(), w


def own_rows(pdf, w, key, label):
    inside = np.zeros(len(pdf), bool)
    for k, lo, hi in w:
        inside |= (k == key) & (pdf["d"] >= lo) & (pdf["d"] <= hi)
    p = pdf[inside].dropna(subset=[label])
    return p[["a", "b", "c"]].to_numpy(), p[label].to_numpy()


def test_ridge_of_windows_equals_normal_equations(sample):
    df, win, pdf, w = sample
    got = {r["key"]: r for r in W.ridge_windows(df, win, ["a", "b", "c"], "y", 2.0).collect()}
    assert set(got) == {"p1", "p2", "p3"}
    for key, r in got.items():
        x, y = own_rows(pdf, w, key, "y")
        s = np.where(x.std(0) > 1e-12, x.std(0), 1)
        z = (x - x.mean(0)) / s
        beta = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (y - y.mean())) / s
        assert r["n"] == len(y) and np.allclose(r["coef"], beta, atol=1e-9) and abs(r["intercept"] - (y.mean() - beta @ x.mean(0))) < 1e-9


def test_logit_of_windows_is_at_the_minimum(spark, sample):
    df, win, pdf, w = sample
    tracker = spark.sparkContext.statusTracker()

    def jobs(windows):
        group = f"logit-{windows.count()}"
        spark.sparkContext.setJobGroup(group, group)
        fits = W.logit_windows(df, windows, ["a", "b", "c"], "up")
        n = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return n, fits
    n_all, fits = jobs(win)
    assert jobs(win.where("key = 'p1'"))[0] >= n_all - 2       # as many jobs for one window as for all
    assert [f["key"] for f in fits] == ["p1", "p2", "p3"]
    for f in fits:
        x, y = own_rows(pdf, w, f["key"], "up")
        s = np.where(x.std(0) > 1e-12, x.std(0), 1)
        b = np.array(f["coef"]) * s
        p = 1 / (1 + np.exp(-(f["intercept"] + x @ np.array(f["coef"]))))
        z = (x - x.mean(0)) / s
        assert f["n"] == len(y) and abs((y - p).sum()) < 1e-5 and np.abs(z.T @ (y - p) - b).max() < 1e-5


def test_forecasts_and_ranges(spark, sample):
    df, win, pdf, _ = sample
    spans = spark.createDataFrame([("p1", "2020-02-01", "2020-02-05"), ("p2", "2020-02-05", "2020-02-06")], "key string, lo string, hi string").select(
        "key", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    fits = W.ridge_windows(df, win, ["a", "b", "c"], "y")
    out = W.apply_windows(df, fits, spans, ["a", "b", "c"], "f", ("date", "symbol"))
    assert out.count() == (5 + 2) * 6 and out.where("f IS NULL").count() == 0
    cal = df.select("date").distinct()
    days = df.where("d <= '2020-01-10' OR d >= '2020-02-01'").select(F.lit(1).alias("fold"), "date")
    assert sorted((r["key"], str(r["lo"]), str(r["hi"])) for r in W.date_ranges(days, "fold", cal).collect()) == [
        (1, "2020-01-01", "2020-01-10"), (1, "2020-02-01", max(pdf["d"]))]


def test_bars_order_events_by_time_and_whole_id(spark):
    from tidepanel.streaming.bars import event_bars
    rows = [(i, "2020-01-01 00:00:01", float(i)) for i in (7 + 4096, 7, 7 + 2 * 4096, 2 ** 62, -5)]
    e = spark.createDataFrame(rows, "event_id long, ts string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "'a' event_type", "value")
    bars = event_bars(e.repartition(4), late=None)
    got = bars.first()
    assert (got["open"], got["close"]) == (-5.0, float(2 ** 62))
    assert "SortAggregate" not in bars._jdf.queryExecution().executedPlan().toString()
