"""Registered queries against their SQL on the smallest tables.

By default one query per topic runs; ``ALL_QUERIES=1`` runs every one.
"""

import os
from itertools import product

import pytest
from conftest import SF
from oracle_check import compare, connect

import __spark_entry__ as entry
from tickloom.plans.queries import trading

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = ["a1_resample_30min", "a1_daily_by_brand", "a3_cascade", "a6_bar_report", "w2_ema", "w5_series_quantiles", "w16_vwap",
          "d1_trend_signal", "d9_dynamic_regime_trailing", "p6_filter_chain", "d13_trade_log", "d14_barriers_trailing", "a13_extended_pack",
          "d19_meanrev_sweep", "j2_asof_backward", "s7_candle_payloads", "a24_profit_thresholds", "d22_month_folds", "r3_stream_bars"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, con, name):
    error, rows = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert error is None
    assert rows > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n.startswith(("d25_b", "d23", "s12"))])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["symbol", "trend", "range", "high_vol"]


def test_bars_of_the_middle_third_are_replaced_by_newer_ones(spark, con):
    name = "s9_merge_append_thirds"
    error, rows = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert error is None and rows > 0


def test_the_reference_grid_is_swept_whole(spark):
    """Every combination of app2/config.json; some of them equal their own sweep of one combination."""
    got = QUERIES["d19_meanrev_full_grid"](spark, SF).collect()
    want = set(product([10, 14, 20], [20, 25, 30, 35], [65, 70, 75, 80], [14, 20, 30], [1.5, 2.0, 2.5], [10, 15, 20, 25, 30]))
    symbols = {r.symbol for r in got}
    assert len(want) == 2160 and len(got) == 2160 * len(symbols) and symbols
    assert {(r.symbol, (r.rsi_len, r.rsi_low, r.rsi_high, r.bb_len, r.bb_k, r.gap)) for r in got} == set(product(symbols, want))
    for n, low, high, bb, k, gap in [(10, 35, 65, 14, 1.5, 10), (20, 30, 70, 20, 2.0, 30)]:
        alone = trading.d19(spark, SF, {"rsi_low": [low], "rsi_high": [high], "rsi_len": [n], "boll_window": [bb], "boll_mult": [k], "min_gap_bars": [gap]}).collect()
        same = {r.symbol: r for r in got if (r.rsi_len, r.rsi_low, r.rsi_high, r.bb_len, r.bb_k, r.gap) == (n, low, high, bb, k, gap)}
        for r in alone:
            assert [x for c, x in r.asDict().items() if c != "combo"] == pytest.approx([x for c, x in same[r.symbol].asDict().items() if c != "combo"], abs=1e-6, nan_ok=True)  # registered queries round
