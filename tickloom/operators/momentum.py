"""Momentum indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.recurrence import Calc, Smooth, chain
from tickloom.operators.averages import safe_div, span_alpha
from tickloom.schemas import positive, require


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder's RSI; null for the first ``period`` rows and while nothing has moved."""
    require(bars, "close")
    positive(period=period)
    a = 1.0 / period
    move = F.coalesce(F.col("close") - fr.lag("close"), F.lit(0.0))
    steps = [
        Calc("_d", move),
        Smooth("_up", F.greatest("_d", F.lit(0.0)), a),
        Smooth("_down", F.greatest(-F.col("_d"), F.lit(0.0)), a),
    ]
    df = chain(bars, steps, back=1)
    value = 100 * safe_div(F.col("_up"), F.col("_up") + F.col("_down"))
    df = df.withColumn("rsi", F.when(F.col("idx") >= period, value))
    return df.drop("_d", "_up", "_down")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two averages, its own average from the first value on, and the gap."""
    require(bars, "close")
    positive(fast=fast, slow=slow, signal=signal)
    if fast >= slow:
        raise ValueError("fast must be below slow")
    alphas = [span_alpha(p) for p in (fast, slow, signal)]
    steps = [
        Smooth("_f", F.col("close"), alphas[0]),
        Smooth("_s", F.col("close"), alphas[1]),
        Calc("macd", fr.full(slow, F.col("_f") - F.col("_s"))),
        Smooth("signal", F.col("macd"), alphas[2], seed_idx=slow - 1),
    ]
    df = chain(bars, steps).drop("_f", "_s")
    return df.withColumn("histogram", F.col("macd") - F.col("signal"))


def stochastic(bars: DataFrame, k: int = 14, d: int = 3, smooth_k: int = 3) -> DataFrame:
    require(bars, "high", "low", "close")
    positive(k=k, d=d, smooth_k=smooth_k)
    df = fr.framed(bars, back=k + d + smooth_k)
    w = fr.last_rows(k)
    low, high = F.min("low").over(w), F.max("high").over(w)
    df = df.withColumn("_raw", fr.full(k, 100 * safe_div(F.col("close") - low, high - low)))
    df = df.withColumn("stoch_k", _full_mean("_raw", smooth_k))
    df = df.withColumn("stoch_d", _full_mean("stoch_k", d))
    return fr.done(fr.core(df.drop("_raw")))


def _full_mean(col: str, n: int) -> Column:
    """Mean of the last n values, null unless all n are present."""
    w = fr.last_rows(n)
    return F.when(F.count(col).over(w) == n, F.avg(col).over(w))


def williams_r(bars: DataFrame, period: int = 14) -> DataFrame:
    require(bars, "high", "low", "close")
    positive(period=period)
    w = fr.last_rows(period)
    high, low = F.max("high").over(w), F.min("low").over(w)
    value = -100 * safe_div(high - F.col("close"), high - low)
    df = fr.framed(bars, back=period - 1)
    return fr.done(fr.core(df.withColumn("williams_r", fr.full(period, value))))


def roc(bars: DataFrame, period: int = 12) -> DataFrame:
    require(bars, "close")
    positive(period=period)
    before = fr.lag("close", period)
    df = fr.framed(bars, back=period)
    return fr.done(fr.core(df.withColumn("roc", 100 * safe_div(F.col("close") - before, before))))


def cci(bars: DataFrame, period: int = 20, constant: float = 0.015) -> DataFrame:
    """Typical price against its mean, in units of the mean absolute deviation of the frame."""
    require(bars, "high", "low", "close")
    positive(period=period, constant=constant)
    w = fr.last_rows(period)
    df = fr.framed(bars, back=period - 1)
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumns({"_mean": F.avg("_tp").over(w), "_list": F.collect_list("_tp").over(w)})
    mad = F.aggregate("_list", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_mean"))) / period
    value = safe_div(F.col("_tp") - F.col("_mean"), constant * mad)
    df = fr.core(df).withColumn("cci", fr.full(period, value))
    return fr.done(df.drop("_tp", "_mean", "_list"))


def label(col: Column, high: float = 70, low: float = 30,
          names: tuple[str, str, str] = ("overbought", "oversold", "neutral")) -> Column:
    """Name a value by two thresholds."""
    return F.when(col > high, names[0]).when(col < low, names[1]).otherwise(names[2])
