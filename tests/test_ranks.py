"""Distributed ranks against pandas, with heavy ties and a hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.crosssection import avg_rank, ceil_group, qcut_group, rank_corr, wide_percentiles, wide_rank
from tidepanel.functions.normal import expected_best, normal_cdf, normal_ppf


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))
    x = np.where(rng.random(n) < 0.35, 0.25, np.round(rng.normal(size=n), 2))      # one value holds a third of the rows
    pdf = pd.DataFrame({"g": g, "x": x, "d": rng.integers(0, 50, n), "k": np.arange(n)})
    pdf.loc[pdf.sample(40, random_state=0).index, "x"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return sdf.cache(), pdf


@pytest.mark.parametrize("by", [["g"], []])
def test_wide_rank_matches_pandas(skewed, by):
    sdf, pdf = skewed
    got = wide_rank(sdf, by, "x", ["d", "k"]).toPandas().set_index("k").sort_index()
    p = pdf.dropna().sort_values(["x", "d", "k"]).copy()
    grp = p.groupby(by) if by else p.groupby(lambda _: 0)
    p["place"] = grp.cumcount() + 1
    p["rank"] = grp["x"].rank()
    p["size"] = grp["x"].transform("size")
    p = p.set_index("k").sort_index()
    assert len(got) == len(p)
    for c in ("place", "rank", "size"):
        assert (got[c].to_numpy() == p[c].to_numpy()).all(), c


def test_no_task_holds_a_group_or_a_value(spark):
    """Half the rows share one value in one group: every range still gets its share, and no exchange is on the group."""
    df = spark.range(4000).selectExpr("'g' AS g", "IF(id % 2 = 0, 0.5D, id / 4000D) AS x", "id AS k")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = wide_rank(df, ["g"], "x", ["k"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert "hashpartitioning(g#" not in plan and "hashpartitioning(_part#" in plan
    assert got.count() == 4000 and max(sizes) < 1200


def test_correlation_of_nothing_is_zero(spark):
    """Ranks built to be uncorrelated: exactly 0 in every order of the rows."""
    a, b = [2, 2, 1, 1, 3, 3], [1, 2, 1, 2, 1, 2]
    rows = [(i, (x - 1) * 2 + 1.5, (y - 1) * 3 + 2.0) for i, (x, y) in enumerate(zip(a, b))]
    for seed in range(4):
        df = spark.createDataFrame(rows, "i int, a double, b double").orderBy(F.rand(seed)).repartition(3)
        assert df.agg(rank_corr("a", "b")).first()[0] == 0.0


def test_narrow_rank_matches_pandas(skewed):
    sdf, pdf = skewed
    got = sdf.select("k", avg_rank("x", ["g"]).alias("r")).toPandas().set_index("k").sort_index()["r"]
    want = pdf.set_index("k").sort_index().groupby("g")["x"].rank()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_wide_percentiles(skewed):
    sdf, pdf = skewed
    got = wide_percentiles(sdf, ["g"], "x", [0.1, 0.5, 0.93], ["d", "k"], ["p", "q", "r"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].quantile([0.1, 0.5, 0.93]).unstack()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_group_rules(spark):
    for n in (10, 23, 57, 130):
        s = pd.Series(range(1, n + 1), dtype=float)
        df = spark.range(1, n + 1).select(F.col("id"), qcut_group("id", F.lit(n), 10).alias("q"), ceil_group("id", F.lit(n), 10).alias("c")).toPandas().sort_values("id")
        assert (df["q"].to_numpy() == (pd.qcut(s, 10, labels=False) + 1).to_numpy()).all()
        assert (df["c"].to_numpy() == np.ceil(s / n * 10).to_numpy()).all()


def test_normal_functions(spark):
    from statistics import NormalDist
    nd = NormalDist()
    r = spark.range(1, 200).select((F.col("id") / 200).alias("p")).select("p", normal_ppf("p").alias("z")).select("p", "z", normal_cdf("z").alias("back")).collect()
    assert max(abs(x["z"] - nd.inv_cdf(x["p"])) for x in r) < 1e-7
    assert max(abs(x["back"] - x["p"]) for x in r) < 1e-6
    best = spark.range(1).select(expected_best(F.lit(1000), F.lit(1.0)).alias("b")).first()["b"]
    assert abs(best - 3.26) < 0.01
