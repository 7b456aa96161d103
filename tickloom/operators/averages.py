"""Moving averages over close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.recurrence import Calc, Smooth, chain, scan, scan_rows
from tickloom.schemas import positive, require


def span_alpha(period: int) -> float:
    return 2.0 / (period + 1)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, F.when(b != 0, b))


def correlation(x: str | Column, y: str | Column, w: WindowSpec | None = None) -> Column:
    """Pearson's correlation over the rows that have both (of a group, or of a window); null where one of them does not vary."""
    xx, yy, xy = (a if w is None else a.over(w) for a in (F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)))
    return safe_div(xy, F.sqrt(xx * yy))


def sma(bars: DataFrame, period: int = 20, col: str = "close", out: str = "sma") -> DataFrame:
    require(bars, col)
    positive(period=period)
    df = fr.framed(bars, back=period - 1)
    return fr.done(fr.core(df.withColumn(out, fr.full(period, F.avg(col).over(fr.last_rows(period))))))


def ema(
    bars: DataFrame, period: int = 20, alpha: float | None = None, seed: str = "first",
    col: str = "close", out: str = "ema",
) -> DataFrame:
    """Null before ``period`` rows. ``seed='sma'`` starts the recurrence from the first full mean."""
    require(bars, col)
    positive(period=period)
    a = span_alpha(period) if alpha is None else alpha
    if not 0 < a <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if seed == "sma":
        start = Calc("_seed", F.avg(col).over(fr.last_rows(period)))
        step = Smooth(out, F.col(col), a, seed_idx=period - 1, seed=F.col("_seed"))
        return chain(bars, [start, step], back=period - 1).drop("_seed")
    df = chain(bars, [Smooth(out, F.col(col), a)])
    return df.withColumn(out, fr.full(period, F.col(out)))


def wma(bars: DataFrame, period: int = 20) -> DataFrame:
    """Weights 1..period, newest heaviest, from two plain frame sums."""
    require(bars, "close")
    positive(period=period)
    w = fr.last_rows(period)
    offset = F.col("pos").cast("double")
    weighted = F.sum(F.col("close") * offset).over(w) - (offset - period) * F.sum("close").over(w)
    value = weighted / (period * (period + 1) / 2)
    df = fr.framed(bars, back=period - 1)
    return fr.done(fr.core(df.withColumn("wma", fr.full(period, value))))


def kama(bars: DataFrame, period: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Adaptive average: the decay follows the efficiency ratio of the last ``period`` moves.

    Starts at row period-1 with close; a frame without any move has ratio 0.
    """
    require(bars, "close")
    positive(period=period, fast=fast, slow=slow)
    if fast >= slow:
        raise ValueError("fast must be below slow")
    hi, lo = span_alpha(fast), span_alpha(slow)
    df = fr.framed(bars, back=period + 1, block_rows=min(scan_rows(1 - hi**2), fr.block_rows_of(bars.sparkSession)))
    df = df.withColumn("_move", F.abs(F.col("close") - fr.lag("close")))
    travel = F.sum("_move").over(fr.last_rows(period))
    ratio = F.coalesce(safe_div(F.abs(F.col("close") - fr.lag("close", period)), travel), F.lit(0.0))
    df = fr.core(df.withColumn("_sc", F.pow(ratio * (hi - lo) + lo, 2)))
    sc = F.when(F.col("idx") >= period, F.col("_sc")).otherwise(F.lit(lo**2))
    b = (
        F.when(F.col("idx") == period - 1, F.col("close"))
        .when(F.col("idx") >= period, F.col("_sc") * F.col("close"))
        .otherwise(F.lit(0.0))
    )
    df = scan(df, "kama", 1 - sc, b).drop("_move", "_sc")
    return fr.done(df.withColumn("kama", F.when(F.col("idx") >= period, F.col("kama"))))


def tema(bars: DataFrame, period: int = 20) -> DataFrame:
    """3*EMA - 3*EMA(EMA) + EMA(EMA(EMA)); null before 2*period rows."""
    require(bars, "close")
    positive(period=period)
    a = span_alpha(period)
    names = ["close", "_e1", "_e2", "_e3"]
    df = chain(bars, [Smooth(y, F.col(x), a) for x, y in zip(names, names[1:])])
    value = 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")
    df = df.withColumn("tema", F.when(F.col("idx") >= 2 * period, value))
    return df.drop("_e1", "_e2", "_e3")


KINDS = {"sma": sma, "ema": ema, "wma": wma, "kama": kama, "tema": tema}


def moving_average(bars: DataFrame, kind: str, **args) -> DataFrame:
    try:
        return KINDS[kind.lower()](bars, **args)
    except KeyError:
        raise ValueError(f"unknown moving average: {kind}") from None
