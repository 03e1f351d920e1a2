"""Registered queries against DuckDB at a small scale. PANEL_ALL=1 runs every query; the default is one or two of
each block. `tools/check_oracle.py` does the same from the command line at any scale."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.01"
QUICK = ["a13_resample_4", "a14_bars_daily", "a15_splice_repair", "a29_secret_scan", "b1_daily_return", "b8_rank_normalise", "b8_rank_normalise_wide",
         "c2_median_label_wide", "d8_purged_folds", "e9_score_table", "e13_decile_returns_wide", "f2_wide_picks", "f6_borrow_weights",
         "g3_drifting_backtest", "g6_decile_periods", "g12_strategy_grid", "h5_s_scores", "f8_fund_hedged_book", "g8_trade_log", "i3_rasterise",
         "j1_perf_stats", "j12_deflated_sharpe", "k1_order_proposal", "k2_orders_for_targets", "l1_stream_bars", "l3_stateful_signal"]
NAMES = list(entry.oracle_sql()) if os.environ.get("PANEL_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_duckdb(spark, con, name):
    _, _, _, msg = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert msg in ("ok", "EMPTY ok"), msg


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
