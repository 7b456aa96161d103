"""Building bars: trades to bars, bars to wider bars, long-form samples to last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import TIMEFRAME_SECONDS, require

_TRUNC = {"1m": "minute", "1h": "hour", "1d": "day", "1w": "week", "1M": "month"}


def bar_start(ts: Column, timeframe: str) -> Column:
    """Start of the bar that holds ``ts``."""
    if timeframe in _TRUNC:
        return F.date_trunc(_TRUNC[timeframe], ts)
    width = TIMEFRAME_SECONDS[timeframe]
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / width) * width)


def ticks_to_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Open, high, low, close and volume per instrument and bar.

    Ties in time are broken by tick_id (not negative). All aggregates combine on the map
    side, so a heavily traded instrument is reduced before the shuffle. The order key is
    one decimal rather than a struct: fixed width keeps the aggregation hash-based, where
    a struct would make Spark sort every trade.
    """
    require(ticks, "symbol", "ts", "price", "size", "tick_id")
    micros = F.unix_micros("ts").cast("decimal(18,0)")
    at = micros * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("tick_id")
    rows = ticks.withColumn("_bar", bar_start(F.col("ts"), timeframe))
    return rows.groupBy("symbol", F.col("_bar").alias("bar")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"),
    ).select(
        "symbol", F.lit(timeframe).alias("timeframe"), F.col("bar").alias("ts"),
        "open", "high", "low", "close", "volume",
    )


def resample(bars: DataFrame, timeframe: str, open_agg: str = "first") -> DataFrame:
    """Wider bars. ``open_agg='last'`` takes the last open of the bucket instead of the first."""
    opening = F.min_by if open_agg == "first" else F.max_by
    return (
        bars.groupBy("symbol", bar_start(F.col("ts"), timeframe).alias("bar"))
        .agg(
            opening("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("bar").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


def last_per_window(samples: DataFrame, timeframe: str, fields: list[str]) -> DataFrame:
    """Last value of each field per window, one column per field; empty windows do not appear.

    ``samples`` is long: symbol, ts, field, value. The field list is given, so the pivot
    needs no extra job to discover it.
    """
    latest = [
        F.max_by(F.when(F.col("field") == f, F.col("value")),
                 F.when(F.col("field") == f, F.col("ts"))).alias(f)
        for f in fields
    ]
    return samples.groupBy("symbol", bar_start(F.col("ts"), timeframe).alias("ts")).agg(*latest)


def latest(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Newest row per key, without sorting the groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("_row")).select(*keys, "_row.*")


def last_n(df: DataFrame, n: int = 20) -> DataFrame:
    """The newest n rows of each series of an indexed frame."""
    return df.filter(F.col("idx") >= F.col("n") - n)

