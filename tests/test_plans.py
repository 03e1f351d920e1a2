"""Physical plans: what must reach the scan, and what must not appear."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidepanel.sources.tables import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_range_reaches_the_scan_and_columns_are_pruned(spark):
    p = plan(Tables(spark, SF).bars(start="1997-01-06", end="1999-01-04"))
    assert "GreaterThanOrEqual(l_shipdate,1997-01-06" in p and "l_tax" not in p and "p_name" not in p


def test_bars_use_hash_aggregation_with_a_partial_step(spark):
    p = plan(Tables(spark, SF).bars())
    assert "SortAggregate" not in p and "partial_min_by" in p


def test_column_pruned_panel_scan_drops_the_order_key(spark):
    p = plan(entry.queries()["a2_pruned_volume"](spark, SF))
    assert "l_extendedprice" not in p and "l_orderkey" not in p


def test_top_k_is_limited_before_the_shuffle(spark):
    p = plan(entry.queries()["f2_wide_picks"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_ranks_share_one_shuffle(spark):
    """Eight ranked features: one exchange by date after the one by symbol."""
    p = plan(entry.queries()["b8_rank_normalise"](spark, SF))
    assert p.count("REPARTITION_BY_COL") == 1 and p.count("Exchange hashpartitioning(date") <= 3     # bars, calendar, ranks


@pytest.mark.parametrize("name", ["a8_densify", "b8_rank_normalise", "c6_make_panel", "d8_purged_folds", "f8_fund_hedged_book", "k1_order_proposal"])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(entry.queries()[name](spark, SF))
