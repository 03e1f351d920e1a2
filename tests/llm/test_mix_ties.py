"""Equal rows at the cut of a mix: only as many as the target allows."""

import pytest
from pyspark.sql import functions as F

from tidepanel.llm.mixing import plan_mix


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_rows_meet_the_target(spark, parts):
    text = "ten words of one text that is repeated very often"
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"),
                                    F.lit(text).alias("text")).repartition(parts)
    plan = plan_mix(docs).toPandas()
    assert len(plan) == 3000
    got = plan.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert got["target"].tolist() == pytest.approx([5000, 10000, 15000])
    assert (abs(got["taken"] - got["target"]) <= 5).all()


def test_a_tie_between_other_rows(spark):
    """A hot tie somewhere in the order, null sources among them; the target is met within half a document."""
    rows = [(None, "s" if i % 2 else None, "same text here") for i in range(900)] + [(i, "s" if i % 2 else None, "w " * (i % 9 + 1)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    for weights in ((1, 2, 3), (3, 1), (2, 5), (1, 9)):
        plan = plan_mix(docs, weights=weights, slice_rows=50).toPandas().fillna({"source": "-"})
        assert len(plan) == 1500
        for _, g in plan.groupby("source"):
            assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 4.5


def test_no_row_of_the_last_slice_fits(spark):
    """Documents of one size larger than what is left: the cut falls before them, and the rest is still taken."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * 700) for i in range(40)], "doc_id long, source string, text string")
    for slice_rows in (1, 3, 1000):
        for _, g in plan_mix(docs, weights=(2, 3), slice_rows=slice_rows).toPandas().groupby("source"):
            assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 350
