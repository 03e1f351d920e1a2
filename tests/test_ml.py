"""Spark ML dataflow: leakage-free periods, importances, stores."""

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import ml as M
from tidepanel.operators import splits as S
from tidepanel.operators.labels import make_panel

LAGS = (1, 2, 5)
RN = [f"R{m}" for m in LAGS]


@pytest.fixture(scope="module")
def panel(toy):
    return make_panel(toy[0], LAGS).cache()


def test_walk_forward_covers_every_traded_day_once(panel):
    periods = S.study_periods(panel, 60, 40)
    p = M.walk_forward(panel, periods, RN, ("logit", "forest")).cache()
    first = periods.agg(F.min("trade_start")).first()[0]
    traded = panel.where(F.col("date") >= F.lit(first))
    assert p.count() == traded.count() == p.select("date", "symbol").distinct().count()
    assert p.where("logit < 0 OR logit > 1 OR forest < 0 OR forest > 1").count() == 0
    last = periods.orderBy("period").collect()
    assert all(a["trade_end"] < b["trade_start"] and b["train_end"] < b["trade_start"] for a, b in zip(last, last[1:]))


def test_permutation_importance_finds_the_used_feature(panel):
    rows = panel.select("date", "symbol", *RN, (F.col("R5") * 3).alias("target"))
    m = M.fit_linear(rows, RN)
    imp = {r["feature"]: r["mse_increase"] for r in M.permutation_importance(m, rows, RN, "target", 2).collect()}
    assert imp["R5"] > 0.01 and abs(imp["R1"]) < imp["R5"] / 100 and abs(imp["R2"]) < imp["R5"] / 100


def test_noise_is_normal_and_fixed_by_key(panel):
    a = M.noise_columns(panel.select("date", "symbol"), 2)
    s = a.agg(F.avg("noise_0").alias("m"), F.stddev("noise_0").alias("s"), F.corr("noise_0", "noise_1").alias("c")).first()
    assert abs(s["m"]) < 0.1 and abs(s["s"] - 1) < 0.1 and abs(s["c"]) < 0.1
    b = M.noise_columns(panel.select("date", "symbol").repartition(7), 2)
    assert a.exceptAll(b).count() == 0


def test_saved_strategy_checks_its_features(spark, panel, tmp_path):
    m = M.fit_linear(panel.dropna().withColumn("target", F.col("fwd")), RN)
    M.save_strategy(spark, m, str(tmp_path / "s"), {"features": RN, "lookback": 6})
    again, manifest = M.load_strategy(spark, str(tmp_path / "s"), RN)
    assert manifest["lookback"] == 6
    a, b = (x.transform(panel).agg(F.sum("prediction")).first()[0] for x in (m, again))
    assert a == b
    with pytest.raises(ValueError):
        M.load_strategy(spark, str(tmp_path / "s"), RN[:2])


def test_model_names_and_sizes():
    with pytest.raises(ValueError):
        M._whole("trees", 2.7)
    with pytest.raises(ValueError):
        M._whole("depth", True)
