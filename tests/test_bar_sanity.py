"""Bars none of which is flat, and no bars."""

import datetime as dt

from tidepanel.operators.quality import bar_sanity


def test_no_flat_bar_means_no_flattest_symbol(spark):
    bar = lambda symbol, high: (dt.date(2020, 1, 1), symbol, 1.0, high, 1.0, 1.0)
    schema = "date date, symbol string, open double, high double, low double, close double"
    moving = spark.createDataFrame([bar("A", 2.0), bar("B", 3.0)], schema)
    assert tuple(bar_sanity(moving).first()) == (2, 0, 0, 0, 0, None)
    assert bar_sanity(moving.unionByName(spark.createDataFrame([bar("A", 1.0)], schema))).first()["flattest"] == "A"
    assert tuple(bar_sanity(moving.limit(0)).first()) == (0, 0, 0, 0, 0, None)
