"""The order of trades inside a bar is exact."""

import pytest
from pyspark.sql import functions as F

from tidepanel.sources import bars as B

def rows(spark, data):
    return spark.createDataFrame(data, "symbol string, place int, order_id long, line int, part long, px double").withColumn("ord", B.trade_order(*map(F.col, ("place", "order_id", "line", "part"))))


def test_many_lines_and_large_numbers_keep_their_order(spark):
    """Lines beyond eight, parts equal modulo 131,072 and orders far above 32 bits, in every place of the key."""
    keys = [(p, o, n, q) for p in (0, 6, 30) for o in (1, 2, 1 << 40, B.ORDERS - 1) for n in (1, 7, 8, 9, 64, B.LINES - 1)
            for q in (5, 5 + 131072, B.PARTS - 1)]
    data = [("A", *k, float(i)) for i, k in enumerate(sorted(keys))]
    got = [r["px"] for r in rows(spark, data[::-1]).orderBy("ord").collect()]
    assert got == [float(i) for i in range(len(data))]
    b = B.ohlc(rows(spark, data).withColumn("q", F.lit(1.0)), ["symbol"], "px", "ord", "q")
    r = b.first()
    assert (r["open"], r["close"]) == (0.0, float(len(data) - 1))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("bad", [(0, B.ORDERS, 1, 1), (0, 1, B.LINES, 1), (0, 1, 1, B.PARTS), (0, -1, 1, 1)])
def test_numbers_out_of_bounds_are_an_error(spark, bad):
    with pytest.raises(Exception, match="too large"):
        rows(spark, [("A", *bad, 1.0)]).select("ord").collect()
