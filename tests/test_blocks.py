"""Cutting series into blocks must not change any result."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.operators import averages as av
from tickloom.operators import breakouts, candles, classic, confidence, crypto, gaps
from tickloom.operators import joins, momentum, trend, validation, volatility, volprice, volume

OPERATORS = {
    "sma": lambda b: av.sma(b, 10), "ema": lambda b: av.ema(b, 9), "ema_seeded": lambda b: av.ema(b, 9, seed="sma"), "wma": lambda b: av.wma(b, 10),
    "kama": lambda b: av.kama(b, 10), "tema": lambda b: av.tema(b, 5), "rsi": momentum.rsi, "macd": momentum.macd, "stochastic": momentum.stochastic, "cci": momentum.cci,
    "bollinger": volatility.bollinger, "atr": volatility.atr, "keltner": volatility.keltner, "chaikin": volatility.chaikin_vol, "hist_vol": volatility.hist_vol,
    "obv": volume.obv, "vroc": volume.vroc, "vwap": lambda b: volume.vwap(b, "week"), "ad_line": volume.ad_line, "spikes": volume.volume_spikes, "composite": volume.volume_composite,
    "candles": candles.candlestick_patterns, "breakouts": breakouts.breakout_patterns, "classic": classic.classic_patterns, "gaps": gaps.gaps,
    "ad_divergence": crypto.ad_divergence, "psych_levels": lambda b: crypto.crypto_psych_levels(b, 0.5), "ma_levels": crypto.crypto_ma_levels, "pump_dump": crypto.pump_dump,
    "pv_divergence": volprice.pv_divergence, "continuous": volprice.continuous_divergence, "unusual": volprice.unusual_volume, "by_price": volprice.volume_by_price,
    "profile": volprice.volume_profile, "strength": volprice.volume_signal_strength, "reversals": trend.reversals, "levels": trend.sr_levels, "hp": trend.hp_filter,
    "mann_kendall": trend.mann_kendall, "adx": trend.adx,
    "drawdown": lambda b: validation.max_drawdown(momentum.roc(b, 1).withColumn("ret", F.col("roc") / 10000).filter("ret is not null"), ["symbol"], ["ts"]),
    "outcomes": lambda b: joins.outcomes(fr.index_bars(b).select("symbol", "timeframe", F.col("idx").alias("entry_idx"), F.lit("bullish").alias("direction")), b),
    "return_stats": lambda b: confidence.return_stats(candles.candlestick_patterns(b, groups=["soldiers", "morning_star"]).withColumn("pattern_id", F.concat_ws(":", "symbol", "pattern_name", "end_idx")), b),
}


def shape(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}") if abs(v) > 1e-7 else 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, shape(x)) for k, x in v.items()))
    return v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(shape(r[c]) for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_same_result_in_short_blocks(name, spark, tables, small_blocks):
    bars = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    from tickloom.operators.bars import ticks_to_bars
    from tickloom.sources.adapters import ticks_from_events

    bars = ticks_to_bars(ticks_from_events(bars).filter("symbol in ('view', 'click')"), "1h")
    whole = rows(OPERATORS[name](bars))
    cut = small_blocks(lambda: rows(OPERATORS[name](bars)), 50)
    assert len(whole) == len(cut)
    for a, b in zip(whole, cut):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert x == pytest.approx(y, rel=1e-5, abs=1e-6)
            elif not isinstance(x, tuple):
                assert x == y


def test_positions_do_not_depend_on_partitions(tables):
    a = {(r.symbol, r.ts, r.idx, r.n) for r in fr.index_bars(tables.hourly).collect()}
    b = {(r.symbol, r.ts, r.idx, r.n) for r in fr.index_bars(tables.hourly.repartition(13, "close")).collect()}
    assert a == b


def test_symbols_do_not_mix(tables):
    one = tables.hourly.filter("symbol = 'view'")
    alone = {(r.ts, round(r.ema, 9) if r.ema else None) for r in av.ema(one, 5).collect()}
    together = {(r.ts, round(r.ema, 9) if r.ema else None) for r in av.ema(tables.hourly, 5).filter("symbol = 'view'").collect()}
    assert alone == together
