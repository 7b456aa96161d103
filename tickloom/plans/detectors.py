"""Registry of detectors: functions from bars to pattern rows, and the scan over them."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.operators.breakouts import breakout_patterns
from tickloom.operators.candles import candlestick_patterns
from tickloom.operators.classic import classic_patterns
from tickloom.operators.crypto import crypto_patterns
from tickloom.operators.gaps import gaps
from tickloom.operators.volprice import continuous_divergence, pv_divergence, unusual_volume
from tickloom.schemas import SERIES


@dataclass(frozen=True)
class Detector:
    name: str
    find: Callable[[DataFrame], DataFrame]
    priority: int
    shares_frame: bool = False


REGISTRY: dict[str, Detector] = {}
# Rows before and after a bar that the built-in detectors look at.
REACH_BACK, REACH_AHEAD = 260, 12
# Order of priorities.
PRIORITY = {"critical": 1, "high": 2, "medium": 3, "low": 4}


def register_detector(
    name: str, find: Callable[[DataFrame], DataFrame], priority: str = "medium", shares_frame: bool = False
) -> None:
    """Add a detector. It builds a plan, so the optimizer sees through it.

    One that ``shares_frame`` gets bars already cut into blocks (with copies) and must look no
    further than the shared reach; any other gets plain indexed bars.
    """
    REGISTRY[name] = Detector(name, find, PRIORITY[priority], shares_frame)


def unregister_detector(name: str) -> None:
    REGISTRY.pop(name, None)


register_detector("candlestick", candlestick_patterns, "medium", shares_frame=True)
register_detector("breakout", breakout_patterns, "high", shares_frame=True)
register_detector("classic", classic_patterns, "high", shares_frame=True)
register_detector("gap", gaps, "medium", shares_frame=True)
register_detector("volume", unusual_volume, "medium", shares_frame=True)
register_detector("crypto", crypto_patterns, "critical", shares_frame=True)


def divergences(bars: DataFrame) -> DataFrame:
    """Divergences of price and volume as patterns: those at extrema, and stretches of opposite trends. The strength is the confidence."""
    df = fr.index_bars(bars)
    at = df.select(*SERIES, "idx", "ts")
    stretches = continuous_divergence(df)
    for side in ("start", "end"):
        stretches = stretches.join(at.select(*SERIES, F.col("idx").alias(f"{side}_idx"), F.col("ts").alias(f"{side}_ts")), [*SERIES, f"{side}_idx"])
    both = pv_divergence(df).withColumn("_how", F.lit("")).unionByName(stretches.withColumn("_how", F.lit("_trend")), allowMissingColumns=True)
    return both.select(
        *SERIES, F.lit("volume").alias("pattern_type"), F.concat(F.lit("volume_"), "divergence_type", "_how", F.lit("_divergence")).alias("pattern_name"), F.col("divergence_type").alias("direction"),
        "start_idx", "end_idx", "start_ts", "end_ts", F.col("strength").alias("confidence"), "strength", F.lit(None).cast("double").alias("risk_reward"))


register_detector("divergence", divergences, "medium")


def detect(bars: DataFrame, detectors: Collection[str] | None = None) -> DataFrame:
    """All findings of the chosen detectors, with their ``detector_priority``.

    The bars are cut once for all built-in detectors: one shuffle, reused by every branch.
    """
    df = fr.index_bars(bars)
    cut = fr.framed(df, REACH_BACK, REACH_AHEAD)
    chosen = sorted((d for d in REGISTRY.values() if detectors is None or d.name in detectors), key=lambda d: d.priority)
    parts = [
        d.find(cut if d.shares_frame else df).withColumns({"detector": F.lit(d.name), "detector_priority": F.lit(d.priority)}) for d in chosen
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({
        "strength": F.coalesce("strength", strength_of(F.col("confidence"))) if "strength" in out.columns else strength_of(F.col("confidence")),
        "quality_score": F.lit(None).cast("double") if "quality_score" not in out.columns else F.col("quality_score"),
    })


def strength_of(confidence):
    """Crypto labels as numbers: strong 0.9, moderate 0.6."""
    return F.when(confidence > 0.8, 0.9).otherwise(0.6)


def filter_rank(patterns: DataFrame, top: int = 50, min_confidence: float = 0.6, min_rr: float = 1.5) -> DataFrame:
    """Confident patterns with an acceptable (or unknown) risk/reward, best first, one per
    (type, name, series, start day), ``top`` per series.

    Both ranks are limits, which Spark applies before as well as after the shuffle.
    """
    rr = F.col("risk_reward")
    df = patterns.filter((F.col("confidence") >= min_confidence) & (rr.isNull() | (rr == 0) | (rr >= min_rr)))
    best = [F.desc("confidence"), F.desc(F.coalesce("strength", F.lit(0.0))), F.desc(F.coalesce("quality_score", F.lit(0.0))), F.asc("start_ts"), F.asc("end_idx")]
    per_day = Window.partitionBy("pattern_type", "pattern_name", *SERIES, F.to_date("start_ts")).orderBy(*best)
    df = df.withColumn("_first", F.row_number().over(per_day)).filter("_first = 1").drop("_first")
    per_series = Window.partitionBy(*SERIES).orderBy(*best, "pattern_type", "pattern_name")
    return df.withColumn("rank", F.row_number().over(per_series)).filter(F.col("rank") <= top)


def scan_patterns(bars: DataFrame, detectors: Collection[str] | None = None, top: int = 50) -> DataFrame:
    """Detect, filter, rank and drop duplicates, as one lazy plan."""
    return filter_rank(detect(bars, detectors), top)
