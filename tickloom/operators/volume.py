"""Volume indicators, their per-bar signals and one-row-per-series summaries.

Each indicator is a list of steps, so several can share one frame and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.recurrence import Calc, Running, Smooth, chain
from tickloom.operators.averages import safe_div, span_alpha
from tickloom.schemas import SERIES, require

_ANCHORS = {"session": "day", "week": "week", "month": "month"}


def _divergence(line: str) -> tuple[Column, Column]:
    """Bullish: new 10-bar price low without a new low of the line; bearish: the mirror."""
    w = fr.rows(-10, -1)
    late = F.col("idx") >= 20
    bull = late & (F.col("close") < F.min("close").over(w)) & (F.col(line) > F.min(line).over(w))
    bear = late & (F.col("close") > F.max("close").over(w)) & (F.col(line) < F.max(line).over(w))
    return bull, bear


def _obv_input() -> Calc:
    signed = F.when(F.col("idx") == 0, F.col("volume")).otherwise(
        F.signum(F.col("close") - fr.lag("close")) * F.col("volume")
    )
    return Calc("_signed", signed)


def _obv_steps() -> list:
    bull, bear = _divergence("obv")
    return [
        Smooth("obv_line", F.col("obv"), span_alpha(20)),
        Calc("obv_signal", F.when(bear, -1).when(bull, 1).otherwise(0)),
    ]


def obv(bars: DataFrame) -> DataFrame:
    """On-balance volume with its 20-bar line and divergence signals."""
    require(bars, "close", "volume")
    steps = [_obv_input(), Running({"obv": F.col("_signed")}), *_obv_steps()]
    return chain(bars, steps, back=11).drop("_signed")


def _halves(line: str) -> tuple[Column, Column]:
    """Mean of the newest 20 values and of the 30 before."""
    back = F.col("n") - F.col("idx")
    return F.avg(F.when(back <= 20, F.col(line))), F.avg(
        F.when((back > 20) & (back <= 50), F.col(line))
    )


def _trend(names: tuple[str, str]) -> Column:
    long = F.col("n") >= 50
    return (
        F.when(long & (F.col("_new") > F.col("_old") * 1.05), names[0])
        .when(long & (F.col("_new") < F.col("_old") * 0.95), names[1])
        .otherwise("neutral")
    )


def obv_summary(with_obv: DataFrame) -> DataFrame:
    new, old = _halves("obv")
    stats = fr.per_series(
        with_obv,
        new.alias("_new"),
        old.alias("_old"),
        F.max_by("obv", "idx").alias("last_obv"),
        F.max(F.when((F.col("idx") == F.col("n") - 20) & (F.col("n") > 20), F.col("obv"))).alias("_at"),
    )
    change = safe_div(F.col("last_obv") - F.col("_at"), F.abs("_at")) * 100
    return stats.select(
        *SERIES, "n", "last_obv", _trend(("bullish", "bearish")).alias("trend"),
        F.when(F.col("n") > 20, change).otherwise(0.0).alias("change_pct"),
    )


def _vroc_steps(period: int) -> list:
    before = fr.lag("volume", period)
    prev = fr.lag("vroc")
    w = fr.last_rows(3)
    cur = F.col("vroc")
    return [
        Calc("vroc", 100 * safe_div(F.col("volume") - before, before)),
        Calc("vroc_smooth", F.when(F.count("vroc").over(w) == 3, F.avg("vroc").over(w))),
        Calc("vroc_signal", F.when((prev <= 0) & (cur > 0), 1).when((prev >= 0) & (cur < 0), -1).otherwise(0)),
        Calc("vroc_extreme", F.when(prev.isNotNull() & (cur > 50), "overbought")
             .when(prev.isNotNull() & (cur < -50), "oversold")),
    ]


def vroc(bars: DataFrame, period: int = 14) -> DataFrame:
    """Volume rate of change, its 3-bar mean, zero crossings and extremes."""
    require(bars, "volume")
    return chain(bars, _vroc_steps(period), back=period + 3)


def vroc_summary(with_vroc: DataFrame) -> DataFrame:
    recent = F.when(F.col("n") - F.col("idx") <= 5, F.col("vroc"))
    stats = fr.per_series(
        with_vroc, F.avg(recent).alias("_mean"), F.count(recent).alias("_c"),
        F.max_by("vroc", "idx").alias("current_vroc"),
    )
    ready = (F.col("n") >= 10) & (F.col("_c") == 5)
    trend = (
        F.when(ready & (F.col("_mean") > 10), "increasing_volume")
        .when(ready & (F.col("_mean") < -10), "decreasing_volume")
        .otherwise("neutral")
    )
    return stats.select(*SERIES, "n", "current_vroc", trend.alias("trend"))


def _vwap_steps(anchor: str, anchor_bands: bool = False) -> list:
    reset = ["_anchor"] if anchor in _ANCHORS else []
    start = F.date_trunc(_ANCHORS.get(anchor, "day"), "ts")
    price, v, sd = F.col("_tp"), F.col("volume"), F.col("vwap_sd")
    close, vwap = F.col("close"), F.col("vwap")
    was_close, was_vwap = fr.lag("close"), fr.lag("vwap")
    signal = (
        F.when((F.col("idx") == 0) | vwap.isNull() | sd.isNull(), 0)
        .when((was_close < was_vwap) & (close > vwap), 1)
        .when((was_close > was_vwap) & (close < vwap), -1)
        .when(close <= vwap - 2 * sd, 2)
        .when(close >= vwap + 2 * sd, -2)
        .otherwise(0)
    )
    return [
        Calc("_anchor", start),
        Calc("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3),
        Running({"_cpv": price * v, "_cv": v}, reset),
        Calc("vwap", safe_div(F.col("_cpv"), F.col("_cv"))),
        Running({"_cdev": F.pow(price - vwap, 2) * v, "_cvol": v}, reset if anchor_bands else []),
        Calc("vwap_sd", F.sqrt(safe_div(F.col("_cdev"), F.col("_cvol")))),
        Calc("vwap_signal", signal),
    ]


def vwap(bars: DataFrame, anchor: str = "session", anchor_bands: bool = False) -> DataFrame:
    """Volume-weighted price per session, week, month or over the whole series, with bands.

    The bands accumulate over the whole series unless ``anchor_bands``.
    """
    require(bars, "high", "low", "close", "volume")
    df = chain(bars, _vwap_steps(anchor, anchor_bands), back=2)
    for k in (1, 2):
        df = df.withColumns({
            f"vwap_upper_{k}": F.col("vwap") + k * F.col("vwap_sd"),
            f"vwap_lower_{k}": F.col("vwap") - k * F.col("vwap_sd"),
        })
    return df.drop("_anchor", "_tp", "_cpv", "_cv", "_cdev", "_cvol")


def vwap_position(with_vwap: DataFrame) -> DataFrame:
    """Where the last close stands against the last VWAP and its first band."""
    c, v, sd = F.col("close"), F.col("vwap"), F.col("vwap_sd")
    place = (
        F.when(c > v + sd, "above_upper_band").when(c > v, "above_vwap")
        .when(c < v - sd, "below_lower_band").when(c < v, "below_vwap").otherwise("at_vwap")
    )
    last = with_vwap.filter(F.col("idx") == F.col("n") - 1)
    return last.select(*SERIES, "n", v.alias("current_vwap"), place.alias("price_position"))


def _ad_input() -> Calc:
    spread = F.col("high") - F.col("low")
    flow = F.coalesce(
        safe_div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), spread), F.lit(0.0)
    )
    return Calc("money_flow", flow * F.col("volume"))


def _ad_steps() -> list:
    bull, bear = _divergence("ad")
    ad, line = F.col("ad"), F.col("ad_line")
    up = (fr.lag("ad") < fr.lag("ad_line")) & (ad > line)
    down = (fr.lag("ad") > fr.lag("ad_line")) & (ad < line)
    signal = F.when(bear, -1.0).when(bull, 1.0).when(up, 0.5).when(down, -0.5).otherwise(0.0)
    return [
        Smooth("ad_line", F.col("ad"), span_alpha(3)),
        Calc("ad_signal", signal),
    ]


def ad_line(bars: DataFrame) -> DataFrame:
    """Accumulation/distribution with its 3-bar line and signals."""
    require(bars, "high", "low", "close", "volume")
    steps = [_ad_input(), Running({"ad": F.col("money_flow")}), *_ad_steps()]
    return chain(bars, steps, back=11)


def ad_summary(with_ad: DataFrame) -> DataFrame:
    new, old = _halves("ad")
    stats = fr.per_series(with_ad, new.alias("_new"), old.alias("_old"), F.max_by("ad", "idx").alias("current_ad"))
    return stats.select(*SERIES, "n", "current_ad", _trend(("accumulation", "distribution")).alias("trend"))


def _spike_steps(lookback: int, threshold: float) -> list:
    w = fr.last_rows(lookback)
    v, mean = F.col("volume"), F.col("volume_ma")
    hit = (F.col("idx") >= lookback) & ((v > threshold * mean) | (F.abs("z_score") > 2))
    return [
        Calc("volume_ma", F.avg("volume").over(w)),
        Calc("z_score", safe_div(v - mean, F.stddev_samp("volume").over(w))),
        Calc("is_spike", F.coalesce(hit, F.lit(False)).cast("int")),
    ]


def volume_spikes(bars: DataFrame, lookback: int = 20, threshold: float = 2.0) -> DataFrame:
    """Unusual volume with its magnitude, the price reaction, and whether a cluster starts."""
    require(bars, "close", "volume")
    near = F.sum("is_spike").over(fr.rows(0, 5)) >= 3
    change = safe_div(F.col("close") - fr.lag("close"), fr.lag("close")) * 100
    df = fr.framed(bars, back=lookback, ahead=5)
    for step in _spike_steps(lookback, threshold):
        df = step.apply(df, 0)
    df = df.withColumns({"_near": near, "_change": change})
    df = fr.core(df).withColumn("spike_ratio", safe_div(F.col("volume"), F.col("volume_ma")))
    ratio = F.col("spike_ratio")
    return fr.done(df.filter("is_spike = 1")).select(
        *SERIES, "ts", "idx", "n", "volume", "volume_ma", "spike_ratio", "z_score",
        F.when(ratio > 5, "extreme").when(ratio > 3, "high").when(ratio > 2, "moderate").otherwise("mild")
        .alias("magnitude"),
        F.when(F.col("_change") > 1, "bullish").when(F.col("_change") < -1, "bearish")
        .when(F.col("_change").isNotNull(), "neutral").otherwise("unknown").alias("price_action"),
        F.col("_near").alias("starts_cluster"),
    )


def spike_summary(bars: DataFrame, spikes: DataFrame) -> DataFrame:
    """Frequency in percent, clustering, recent against older spikes, ratios."""
    recent = F.col("n") - F.col("idx") <= 20
    stats = spikes.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("spikes"), F.count_if(recent).alias("_new"),
        F.max("starts_cluster").alias("_cluster"),
        F.avg("spike_ratio").alias("avg_ratio"), F.max("spike_ratio").alias("max_ratio"),
    )
    series = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("spikes", F.lit(0))
    old = F.col("spikes") - F.col("_new")
    trend = (
        F.when(count < 2, "insufficient_data").when(F.col("_new") > old, "increasing")
        .when(F.col("_new") < old, "decreasing").otherwise("stable")
    )
    return series.join(stats, SERIES, "left").select(
        *SERIES, "n", count.alias("spikes"),
        F.when(count == 0, "no_spikes").when(F.col("_cluster"), "clustered").otherwise("none").alias("pattern"),
        (100 * count / F.col("n")).alias("frequency"), trend.alias("trend"), "avg_ratio", "max_ratio",
    )


def volume_composite(bars: DataFrame, anchor: str = "session") -> DataFrame:
    """Mean of the non-zero signals of the last bar, named. All five indicators share one frame."""
    require(bars, "high", "low", "close", "volume")
    sums = Running({"obv": F.col("_signed"), "ad": F.col("money_flow")})
    steps = [
        _obv_input(), _ad_input(), sums, *_obv_steps(), *_ad_steps(),
        *_vroc_steps(14), *_vwap_steps(anchor), *_spike_steps(20, 2.0),
    ]
    last = chain(bars, steps, back=40).filter(F.col("idx") == F.col("n") - 1)
    signals = F.array(*[F.col(c).cast("double") for c in
                        ("obv_signal", "vroc_signal", "vwap_signal", "ad_signal", "is_spike")])
    live = F.filter(signals, lambda s: s != 0)
    mean = F.try_divide(F.aggregate(live, F.lit(0.0), lambda a, s: a + s), F.size(live).cast("double"))
    score = F.coalesce(mean, F.lit(0.0))
    return last.select(*SERIES, "n", score.alias("score"), composite_label(score).alias("signal"))


def composite_label(score: Column) -> Column:
    return (
        F.when(score > 0.5, "strong_buy").when(score > 0, "buy")
        .when(score < -0.5, "strong_sell").when(score < 0, "sell").otherwise("neutral")
    )
