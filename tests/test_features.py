"""Calendar shifts, gaps and no look-ahead, against plain pandas on a wide table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.frames import ahead, change
from tidepanel.operators import charts as C
from tidepanel.operators import features as X
from tidepanel.operators import labels as L
from tidepanel.operators import splits as S
from tidepanel.sources import bars as B
from tidepanel.sources import sinks

NAMES = ["ret_1", "ret_5", "vol_10", "volume_z", "hi52"]


def wide(df, col):
    return df.select("t", "symbol", col).toPandas().pivot(index="t", columns="symbol", values=col).astype(float)


def test_features_match_pandas(toy):
    df, P = toy
    f = X.build_features(df, NAMES, high_window=30, volume_window=12).cache()
    R = P / P.shift(1) - 1
    for name, want in {"ret_1": R, "ret_5": P / P.shift(5) - 1, "vol_10": R.rolling(10, min_periods=10).std(),
                       "hi52": P / P.rolling(30, min_periods=30).max() - 1}.items():
        got = wide(f, name)
        assert np.allclose(got.to_numpy(), want.where(P.notna()).to_numpy(), equal_nan=True, atol=1e-10), name


def test_no_look_ahead(spark, toy):
    """Rewriting every row after t0 leaves features up to t0 as they were; the leaky feature moves."""
    df, _ = toy
    t0 = 120
    later = df.withColumn("adj_close", F.when(F.col("t") > t0, F.col("adj_close") * (1 + F.col("t") % 7)).otherwise(F.col("adj_close")))
    keep = lambda d: (X.rank_normalise(X.build_features(d, NAMES, high_window=30, volume_window=12), NAMES).where(F.col("t") <= t0)
                      .orderBy("t", "symbol").toPandas())
    pd.testing.assert_frame_equal(keep(df), keep(later))
    leak = lambda d: d.select("t", "symbol", ahead("adj_close", 1).alias("x")).where(F.col("t") == t0).orderBy("symbol").toPandas()["x"]
    assert not np.allclose(leak(df), leak(later), equal_nan=True)


def test_charts_no_look_ahead(toy):
    df, _ = toy
    p = df.select("date", "symbol", "t", "adj_close", F.lit(0.99).alias("open_r"), F.lit(1.02).alias("high_r"), F.lit(0.97).alias("low_r"), "volume")
    later = p.withColumn("adj_close", F.when(F.col("t") > 100, F.col("adj_close") * 3).otherwise(F.col("adj_close")))
    draw = lambda d: C.pixels(C.chart_windows(d, 5), 5).where("t <= 100").select("t", "symbol", "pixels").orderBy("t", "symbol").collect()
    assert draw(p) == draw(later)


def test_make_panel_keeps_unlabelled_last_day(toy):
    df, P = toy
    p = L.make_panel(df, (1, 2, 5)).toPandas()
    assert p["t"].max() == len(P) - 1 and p.loc[p["t"] == len(P) - 1, "y"].isna().all()
    fwd = P.shift(-1) / P - 1
    want = fwd.gt(fwd.median(axis=1), axis=0).astype(float).where(fwd.notna())
    for r in p.sample(60, random_state=1).itertuples():
        w = want.loc[r.t, r.symbol]
        assert (np.isnan(w) and np.isnan(r.y)) or w == r.y


def test_names_and_lookback():
    assert X.feature_names(5, "vol_63") == ["ret_1", "ret_5", "ret_63", "vol_21", "vol_63", "volume_z", "hi52"]
    assert X.rows_needed(["ret_10"]) == 11 and X.rows_needed(["hi52"]) == 252 and X.rows_needed([]) == 2
    with pytest.raises(ValueError):
        X.feature("momentum")
    with pytest.raises(ValueError):
        change("x", 0)


def test_label_uniqueness_single_line(spark):
    n, h = 200, 5
    df = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").cast("int").alias("t"))
    u = L.label_uniqueness(df, h).agg(F.avg("uniqueness")).first()[0]
    load = np.zeros(n + h + 1)
    for i in range(n):
        load[i + 1:i + h + 1] += 1
    assert abs(u - np.mean([np.mean(1 / load[i + 1:i + h + 1]) for i in range(n)])) < 1e-12


def test_purged_fold_sizes(spark):
    cal = spark.range(20).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"), F.col("id").cast("int").alias("t"))
    n = lambda k, h, e: [r[0] for r in S.purged_folds(cal, k, h, e).where("role = 'train'").groupBy("fold").count().orderBy("fold").select("count").collect()]
    assert n(4, 2, 0) == [13, 11, 11, 13] and n(4, 1, 3) == [12, 11, 11, 14]
    assert n(4, 0, 0) == [15, 15, 15, 15]


def test_split_errors(spark, toy):
    df, _ = toy
    cal = B.calendar(df)
    d = lambda i: str(cal.where(F.col("t") == i).first()["date"])
    ok = S.time_split(df, cal, d(50), d(55), 5)
    assert ok.where("split = 'train'").agg(F.max("t")).first()[0] == 50 and ok.where("split = 'test'").agg(F.min("t")).first()[0] == 55
    for a, b in ((d(50), d(54)), (d(50), d(49)), ("2019-01-01", d(20)), (d(158), "2030-01-01")):
        with pytest.raises(ValueError):
            S.time_split(df, cal, a, b, 5)
    assert str(S.embargo_start(cal, d(50), 5)) == d(55)
    with pytest.raises(ValueError):
        S.embargo_start(cal, d(159), 5)


def test_sources_and_sinks(spark, toy, tmp_path):
    df, _ = toy
    bars = df.select("date", "symbol", *[F.col("adj_close").alias(c) for c in ("open", "high", "low", "close", "adj_close")], "volume")
    sinks.write_bars(bars, str(tmp_path / "bars"))
    assert B.read_bars(spark, str(tmp_path / "bars")).count() == df.count()
    bars.coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "csv"))
    assert B.read_bars(spark, str(tmp_path / "csv"), "csv").agg(F.sum("volume")).first()[0] == df.agg(F.sum("volume")).first()[0]
    with pytest.raises(ValueError, match="missing columns"):
        B.read_bars(spark, str(tmp_path / "bars"), columns=("date", "symbol", "close", "spread"))
    store = str(tmp_path / "store")
    two = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "variant string, x double")
    sinks.replace_variants(two, store)
    sinks.replace_variants(spark.createDataFrame([("a", 9.0)], "variant string, x double"), store)
    assert sinks.load_variant(spark, store, "a").first()["x"] == 9.0 and sinks.load_variant(spark, store, "b").first()["x"] == 2.0
    with pytest.raises(ValueError):
        sinks.load_variant(spark, store, "c")


def test_resample_counts_back(spark):
    n = 42
    df = spark.range(n).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"), F.lit("A").alias("symbol"), F.col("id").cast("int").alias("t"),
                               (F.col("id") + 1.0).alias("adj_close"), F.lit(0.5).alias("open_r"), F.lit(2.0).alias("high_r"), F.lit(0.25).alias("low_r"), F.lit(10.0).alias("volume"))
    r = B.resample(df, B.calendar(df), 4).orderBy("date").toPandas()
    assert len(r) == 10 and r["volume"].eq(40).all() and r["adj_close"].tolist() == [6.0 + 4 * i for i in range(10)]
    assert np.allclose(r["open_r"] * r["adj_close"], [(3 + 4 * i) / 2 for i in range(10)])
    assert np.allclose(r["high_r"] * r["adj_close"], [2 * (6 + 4 * i) for i in range(10)])
