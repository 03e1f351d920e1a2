"""Correlations with a side that never moves."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.crosssection import safe_corr


@pytest.mark.parametrize("a", [6.0, 6.1])
def test_a_constant_side_has_no_correlation(spark, a):
    """h10: every week needs the same number of factors."""
    df = spark.createDataFrame([(a, float(y)) for y in (1, 2, 4, 7)] + [(9.0, None), (None, 3.0)], "a double, b double").repartition(3)
    assert df.agg(safe_corr("a", "b")).first()[0] is None
    assert df.agg(safe_corr("b", "a")).first()[0] is None


def test_correlation_over_windows_and_pairs(spark):
    rows = [(0, 1.0, 2.0), (1, 1.0, 5.0), (2, 1.0, 1.0), (3, 2.0, 4.0), (4, 5.0, None), (5, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "t int, a double, b double")
    got = [r[0] for r in df.select("t", safe_corr("a", "b", Window.orderBy("t").rowsBetween(-2, 0)).alias("c")).orderBy("t").select("c").collect()]
    assert got[:3] == [None, None, None]
    assert got[3] == pytest.approx(0.2773500981) and got[4] == pytest.approx(1.0) and got[5] == pytest.approx(1.0)
    pairs = df.where("b IS NOT NULL")
    assert df.agg(safe_corr("a", "b")).first()[0] == pytest.approx(pairs.agg(F.corr("a", "b")).first()[0])
