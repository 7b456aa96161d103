"""Crypto detectors: whales, divergences, breakouts, pumps and dumps, support and resistance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.recurrence import Calc, Running
from tickloom.functions.rules import Rule, emit
from tickloom.operators.averages import safe_div
from tickloom.schemas import SERIES, require, risk_reward

# Round price levels by size of the last price.
LEVELS = {
    1.0: [0.001, 0.005, 0.01, 0.05, 0.1, 0.5],
    10.0: [1.0, 5.0, 10.0],
    100.0: [10.0, 25.0, 50.0, 75.0, 100.0],
    float("inf"): [100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 10000.0],
}
MA_PERIODS = (20, 50, 100, 200)


@dataclass(frozen=True)
class CryptoConfig:
    pump: float = 0.20
    dump: float = -0.15
    whale: float = 5.0
    tolerance: float = 0.02


def whales(bars: DataFrame, cfg: CryptoConfig = CryptoConfig()) -> DataFrame:
    require(bars, "open", "close", "volume")
    df = fr.framed(bars, back=20).withColumn("_ratio", safe_div(F.col("volume"), F.avg("volume").over(fr.last_rows(20))))
    ratio, c = F.col("_ratio"), F.col("close")
    change = safe_div(c - F.col("open"), F.col("open"))
    return emit(df, "volume", [Rule(
        "Whale Movement", (F.col("idx") >= 20) & (ratio > cfg.whale),
        F.when(change > 0, "bullish").otherwise("bearish"), F.least(F.lit(0.95), ratio / cfg.whale),
        meta={"volume_multiple": ratio, "price_change_percent": change * 100, "volume_usdt": F.col("volume") * c})])


def ad_divergence(bars: DataFrame) -> DataFrame:
    """10-bar change of the mean price against that of the accumulation line."""
    require(bars, "high", "low", "close", "volume")
    df = fr.framed(bars, back=21)
    spread = F.col("high") - F.col("low")
    flow = safe_div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), spread) * F.col("volume")
    w = fr.last_rows(10)
    steps = [
        Calc("_flow", flow),
        Running({"_cum": F.col("_flow")}),
        Calc("_line", F.when(F.col("_flow").isNotNull(), F.col("_cum"))),
        Calc("_pma", F.avg("close").over(w)),
        Calc("_ama", F.when(F.count("_line").over(w) == 10, F.avg("_line").over(w))),
        Calc("_price", F.col("_pma") - fr.lag("_pma", 10)),
        Calc("_ad", F.col("_ama") - fr.lag("_ama", 10)),
    ]
    for s in steps:
        df = s.apply(df, 0)
    price, ad, c = F.col("_price"), F.col("_ad"), F.col("close")
    strength = safe_div(F.abs(ad), F.abs(price))
    inner = (F.col("idx") >= 20) & (F.col("idx") < F.col("n") - 5)
    shared = {"confidence": F.least(F.lit(0.9), strength * 0.1), "span": 10,
              "meta": {"price_trend": price, "ad_trend": ad, "divergence_strength": strength}}
    return emit(df, "volume", [
        Rule("Accumulation Divergence", inner & (price < 0) & (ad > 0), "bullish", target=c * 1.05, stop=c * 0.97, **shared),
        Rule("Distribution Divergence", inner & (price > 0) & (ad < 0), "bearish", target=c * 0.95, stop=c * 1.03, **shared),
    ])


def crypto_breakouts(bars: DataFrame) -> DataFrame:
    require(bars, "high", "low", "close", "volume")
    w = fr.rows(-20, -1)
    df = fr.framed(bars, back=20).withColumns({
        "_res": F.max("high").over(w), "_sup": F.min("low").over(w),
        "_ratio": safe_div(F.col("volume"), F.avg("volume").over(w)),
    })
    res, sup, ratio, c = F.col("_res"), F.col("_sup"), F.col("_ratio"), F.col("close")
    busy = (F.col("idx") >= 20) & (ratio > 1.5)
    conf = F.least(F.lit(0.9), ratio * 0.2)
    up = busy & (F.col("high") > res) & (c > res)
    down = busy & (F.col("low") < sup) & (c < sup)
    return emit(df, "volume", [
        Rule("Volume Breakout (Bullish)", up, "bullish", conf, target=res + (res - sup) * 0.5, stop=res * 0.98,
             meta={"resistance_level": res, "volume_multiple": ratio, "breakout_strength": safe_div(F.col("high") - res, res)}),
        Rule("Volume Breakdown (Bearish)", ~up & down, "bearish", conf, target=sup - (res - sup) * 0.5, stop=sup * 1.02,
             meta={"support_level": sup, "volume_multiple": ratio, "breakdown_strength": safe_div(sup - F.col("low"), sup)}),
    ])


def _surge(back: int, before: int):
    """Change from the open ``back`` bars ago; mean volume since against ``before`` bars earlier."""
    start = fr.lag("open", back)
    change = safe_div(F.col("close") - start, start)
    usual = F.avg("volume").over(fr.rows(-back - before, -back - 1))
    return change, F.when(F.col("idx") >= back + before, safe_div(F.avg("volume").over(fr.rows(-back, 0)), usual))


def pumps(bars: DataFrame, threshold: float = 0.20) -> DataFrame:
    change, volume = _surge(5, 15)
    df = fr.framed(bars, back=21).withColumns({"_change": change, "_vol": volume})
    ch, v, c = F.col("_change"), F.col("_vol"), F.col("close")
    conf = F.least(F.lit(0.95), ch / threshold * 0.5 + F.least(F.lit(0.4), v / 5))
    return emit(df, "price", [Rule("Crypto Pump", (ch > threshold) & (v > 2), "bearish", conf, span=5,
                                   target=c * 0.85, stop=c * 1.05,
                                   meta={"price_change_percent": ch * 100, "volume_spike_multiple": v})])


def dumps(bars: DataFrame, threshold: float = -0.15) -> DataFrame:
    change, volume = _surge(3, 12)
    df = fr.framed(bars, back=21).withColumns({"_change": change, "_vol": volume})
    ch, v, c = F.col("_change"), F.col("_vol"), F.col("close")
    conf = F.least(F.lit(0.95), F.abs(ch) / abs(threshold) * 0.5 + F.least(F.lit(0.4), v / 4))
    return emit(df, "price", [Rule("Crypto Dump", (ch < threshold) & (v > 1.5), "bullish", conf, span=3,
                                   target=c * 1.10, stop=c * 0.95,
                                   meta={"price_change_percent": ch * 100, "volume_spike_multiple": v})])


def pump_dump(bars: DataFrame) -> DataFrame:
    """A rise of 15 % within bars -10..-5, then a fall of 10 %, both on raised volume."""
    start, top = fr.lag("close", 10), fr.lag("close", 5)
    df = fr.framed(bars, back=31).withColumns({
        "_start": start, "_up": safe_div(top - start, start), "_down": safe_div(F.col("close") - top, top),
        "_pv": F.avg("volume").over(fr.rows(-10, -6)), "_dv": F.avg("volume").over(fr.rows(-5, -1)),
        "_nv": F.when(F.col("idx") >= 30, F.avg("volume").over(fr.rows(-30, -11))),
    })
    up, down, pv, dv, nv = (F.col(x) for x in ("_up", "_down", "_pv", "_dv", "_nv"))
    conf = F.least(F.lit(0.95), up / 0.15 * 0.3 + F.abs(down) / 0.10 * 0.3
                   + F.least(F.lit(0.4), safe_div(pv + dv, nv * 4)))
    hit = (up > 0.15) & (down < -0.10) & (pv > nv * 2) & (dv > nv * 1.5) & (F.col("idx") < F.col("n") - 10)
    return emit(df, "price", [Rule(
        "Pump and Dump Sequence", hit, "bearish", conf, span=10, target=F.col("_start"), stop=F.col("close") * 1.05,
        meta={"pump_change_percent": up * 100, "dump_change_percent": down * 100,
              "pump_volume_multiple": safe_div(pv, nv), "dump_volume_multiple": safe_div(dv, nv)})])


def _level_rows(df: DataFrame, name, kind, confidence, entry, target, stop, meta) -> DataFrame:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("double"))]
    return df.select(
        *SERIES, F.lit("structure").alias("pattern_type"), F.concat(name, kind).alias("pattern_name"),
        F.when(kind == "Support", "bullish").otherwise("bearish").alias("direction"),
        "start_idx", "end_idx", "start_ts", "end_ts", confidence.alias("confidence"), entry.alias("entry_price"),
        target.alias("target_price"), stop.alias("stop_loss"),
        F.create_map(*pairs).cast("map<string,double>").alias("metadata"),
    ).withColumn("risk_reward", risk_reward(F.col("entry_price"), F.col("target_price"), F.col("stop_loss")))


def crypto_psych_levels(bars: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Round levels near the last price that the history touched at least three times."""
    require(bars, "high", "low", "close")
    df = fr.index_bars(bars)
    last = F.col("_last")
    lists = F.lit(None)
    for bound, values in reversed(LEVELS.items()):
        array = F.array(*[F.lit(v) for v in values])
        lists = array if bound == float("inf") else F.when(last < bound, array).otherwise(lists)
    stats = fr.per_series(df, F.max_by("close", "idx").alias("_last"), F.min("ts").alias("_first_ts"),
                          F.max("ts").alias("_last_ts"))
    near = stats.withColumn("_level", F.explode(lists)).filter(F.abs(last - F.col("_level")) / last < tolerance)
    level = F.col("_level")
    later = (F.col("idx") < F.col("n") - 5)
    rows = fr.framed(df, ahead=3).withColumn("_ahead", fr.lead("close", 3))
    rows = fr.attach(fr.core(rows), near)
    at_low = F.abs(F.col("low") - level) / level < tolerance
    at_high = ~at_low & (F.abs(F.col("high") - level) / level < tolerance)
    bounce = (at_low & (F.col("_ahead") > F.col("close") * 1.02)) | (at_high & (F.col("_ahead") < F.col("close") * 0.98))
    found = rows.filter(at_low | at_high).groupBy(*SERIES, "_level", "_last", "_first_ts", "_last_ts", "n").agg(
        F.count(F.lit(1)).alias("_touches"), F.count_if(later & bounce).alias("_bounces")
    ).filter("_touches >= 3").withColumns({
        "start_idx": F.lit(0).cast("long"), "end_idx": F.col("n") - 1, "start_ts": F.col("_first_ts"), "end_ts": F.col("_last_ts"),
    })
    rate = F.col("_bounces") / F.col("_touches")
    kind = F.when(last > level, "Support").otherwise("Resistance")
    return _level_rows(
        found, F.lit("Psychological "), kind, F.least(F.lit(0.9), rate * 0.7 + F.least(F.lit(0.2), F.col("_touches") / 10)),
        last, level * F.when(kind == "Resistance", 1.05).otherwise(0.95), level * F.when(kind == "Support", 0.98).otherwise(1.02),
        {"level_price": level, "touches": F.col("_touches"), "bounces": F.col("_bounces"), "bounce_rate": rate,
         "distance_from_level": F.abs(last - level) / last})


def crypto_ma_levels(bars: DataFrame) -> DataFrame:
    """Moving averages near the last price, touched at least three times in the last 50 bars."""
    require(bars, "close")
    df = fr.index_bars(bars)
    df = df.filter(F.col("idx") >= F.col("n") - 50 - max(MA_PERIODS))
    df = fr.framed(df, back=max(MA_PERIODS), ahead=3)
    df = df.withColumns({f"_ma{p}": fr.full(p, F.avg("close").over(fr.last_rows(p))) for p in MA_PERIODS})
    df = df.withColumns({f"_up{p}": fr.lead(f"_ma{p}", 2) - F.col(f"_ma{p}") for p in MA_PERIODS}
                        | {"_go": fr.lead("close", 2) - F.col("close")})
    points = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_ma{p}").alias("ma"), F.col(f"_up{p}").alias("up"))
                       for p in MA_PERIODS])
    df = fr.core(df).withColumn("m", F.explode(points)).filter(F.col("n") >= F.col("m.p"))
    c, ma, idx, n, p = F.col("close"), F.col("m.ma"), F.col("idx"), F.col("n"), F.col("m.p")
    is_last = idx == n - 1
    touch = F.coalesce((idx >= n - 50) & (idx < n - 1) & (F.abs(c - ma) / ma < 0.03), F.lit(False))
    bounce = touch & (idx < n - 3) & (F.col("_go") * F.col("m.up") > 0)
    found = df.groupBy(*SERIES, "n", p.alias("p")).agg(
        F.count_if(touch).alias("_touches"), F.count_if(bounce).alias("_bounces"),
        F.max(F.when(is_last, c)).alias("_last"), F.max(F.when(is_last, ma)).alias("_ma"),
        F.max(F.when(is_last, F.col("ts"))).alias("end_ts"), F.max(F.when(idx == n - p, F.col("ts"))).alias("start_ts"),
        F.max(F.when(idx == n - 10, ma)).alias("_ma10"),
    )
    last, level = F.col("_last"), F.col("_ma")
    found = found.filter((F.abs(last - level) / level < 0.05) & (F.col("_touches") >= 3)).withColumns(
        {"start_idx": F.col("n") - F.col("p"), "end_idx": F.col("n") - 1})
    rate = F.col("_bounces") / F.col("_touches")
    kind = F.when(last > level, "Support").otherwise("Resistance")
    return _level_rows(
        found, F.concat(F.lit("MA"), F.col("p").cast("string"), F.lit(" Dynamic ")), kind,
        F.least(F.lit(0.85), rate * 0.6 + F.least(F.lit(0.25), F.col("_touches") / 10)), last,
        level * F.when(kind == "Resistance", 1.03).otherwise(0.97), level * F.when(kind == "Support", 0.97).otherwise(1.03),
        {"ma_period": F.col("p"), "ma_level": level, "touches": F.col("_touches"), "bounces": F.col("_bounces"),
         "bounce_rate": rate, "distance_from_ma": F.abs(last - level) / level,
         "ma_slope": F.when(F.col("n") >= 10, safe_div(level - F.col("_ma10"), F.col("_ma10"))).otherwise(0.0)})


def crypto_patterns(bars: DataFrame, cfg: CryptoConfig = CryptoConfig()) -> DataFrame:
    """Every crypto detector under one configuration. The bars are indexed once for all."""
    df = fr.index_bars(bars)
    parts = [
        whales(df, cfg), ad_divergence(df), crypto_breakouts(df), pumps(df, cfg.pump), dumps(df, cfg.dump),
        pump_dump(df), crypto_psych_levels(df, cfg.tolerance), crypto_ma_levels(df),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
