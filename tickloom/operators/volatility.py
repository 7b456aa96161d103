"""Volatility indicators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.recurrence import Calc, Smooth, chain
from tickloom.operators.averages import safe_div, span_alpha
from tickloom.schemas import positive, require


def bollinger(bars: DataFrame, period: int = 20, std_dev: float = 2.0, ddof: int = 1) -> DataFrame:
    require(bars, "close")
    positive(period=period, std_dev=std_dev)
    w = fr.last_rows(period)
    spread = (F.stddev_samp if ddof == 1 else F.stddev_pop)("close").over(w)
    df = fr.framed(bars, back=period - 1).withColumns(
        {"bb_middle": fr.full(period, F.avg("close").over(w)), "_sd": spread}
    )
    df = df.withColumns(
        {
            "bb_upper": F.col("bb_middle") + std_dev * F.col("_sd"),
            "bb_lower": F.col("bb_middle") - std_dev * F.col("_sd"),
        }
    )
    return fr.done(fr.core(df.drop("_sd")))


def true_range() -> Column:
    prev = fr.lag("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder-smoothed true range; null for the first ``period`` rows."""
    require(bars, "high", "low", "close")
    positive(period=period)
    a = 1.0 / period
    df = chain(bars, [Calc("_tr", true_range()), Smooth("atr", F.col("_tr"), a)], back=1)
    return df.withColumn("atr", F.when(F.col("idx") >= period, F.col("atr"))).drop("_tr")


def keltner(bars: DataFrame, ema_period: int = 20, atr_period: int = 10, multiplier: float = 2.0) -> DataFrame:
    require(bars, "high", "low", "close")
    positive(ema_period=ema_period, atr_period=atr_period, multiplier=multiplier)
    a, b = span_alpha(ema_period), 1.0 / atr_period
    steps = [
        Calc("_tr", true_range()),
        Smooth("kc_middle", F.col("close"), a),
        Smooth("_atr", F.col("_tr"), b),
    ]
    df = chain(bars, steps, back=1)
    width = F.when(F.col("idx") >= atr_period, multiplier * F.col("_atr"))
    df = df.withColumns(
        {"kc_upper": F.col("kc_middle") + width, "kc_lower": F.col("kc_middle") - width}
    )
    return df.drop("_tr", "_atr")


def rolling_std(bars: DataFrame, period: int = 20) -> DataFrame:
    require(bars, "close")
    positive(period=period)
    value = F.stddev_samp("close").over(fr.last_rows(period))
    df = fr.framed(bars, back=period - 1)
    return fr.done(fr.core(df.withColumn("std", fr.full(period, value))))


def chaikin_vol(bars: DataFrame, ema_period: int = 10, roc_period: int = 10) -> DataFrame:
    """Change over ``roc_period`` rows of the smoothed high-low spread, in percent."""
    require(bars, "high", "low")
    positive(ema_period=ema_period, roc_period=roc_period)
    before = fr.lag("_spread", roc_period)
    steps = [
        Smooth("_spread", F.col("high") - F.col("low"), span_alpha(ema_period)),
        Calc("chaikin_vol", 100 * safe_div(F.col("_spread") - before, before)),
    ]
    return chain(bars, steps, back=roc_period).drop("_spread")


def hist_vol(bars: DataFrame, period: int = 20, trading_days: int = 252) -> DataFrame:
    """Annualised standard deviation of log returns, in percent."""
    require(bars, "close")
    positive(period=period, trading_days=trading_days)
    df = fr.framed(bars, back=period + 1)
    df = df.withColumn("_r", F.ln(safe_div(F.col("close"), fr.lag("close"))))
    value = F.stddev_samp("_r").over(fr.last_rows(period)) * math.sqrt(trading_days) * 100
    df = df.withColumn("hist_vol", fr.full(period, value, start=1))
    return fr.done(fr.core(df.drop("_r")))
