"""Registered queries: all plans build; a sample (all with TICKLOOM_ALL=1) equals its DuckDB oracle."""

import os

import pytest
from check import compare, duck
from market_helpers import SF

import __spark_entry__ as entry

SAMPLE = ["ind02_ema", "ind05_kama", "vol08_vwap_signals", "pat07_harami", "pat15_symmetrical_triangle", "cry02_ad_divergence", "vpa04_continuous_divergence", "trd08_reversals", "src03_kline_decode",
          "dq02_ohlc_errors", "rel20_alerts", "agg19_suspicious_ips", "agg21_latency_percentiles", "join02_co_occurrence", "pipe06_subscriptions", "conf01_confidence", "val02_rolling_window", "str05_tick_bars"]


def names():
    return sorted(entry.oracle_sql()) if os.environ.get("TICKLOOM_ALL") else SAMPLE


@pytest.mark.parametrize("name", names())
def test_oracle(name, spark):
    n, error = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert error is None, error


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "idx", "sma", "bb_upper", "bb_lower"] and df.count() > 0
