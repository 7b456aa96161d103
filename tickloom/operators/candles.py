"""Candlestick patterns of one, two and three bars."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.rules import Rule, emit
from tickloom.operators.averages import safe_div
from tickloom.schemas import require

GROUPS = (
    "doji", "hammer", "shooting_star", "spinning_top", "engulfing", "harami", "piercing",
    "morning_star", "evening_star", "soldiers",
)


def _shape() -> dict:
    """Named pieces of the current candle and the one or two before it."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    s = {
        "o": o, "h": h, "l": low, "c": c, "move": c - o, "body": F.abs(c - o), "range": h - low,
        "upper": h - F.greatest(o, c), "lower": F.least(o, c) - low,
    }
    for k in (1, 2):
        ok, ck = fr.lag("open", k), fr.lag("close", k)
        s |= {f"o{k}": ok, f"c{k}": ck, f"h{k}": fr.lag("high", k), f"l{k}": fr.lag("low", k),
              f"move{k}": ck - ok, f"body{k}": F.abs(ck - ok), f"mid{k}": (ok + ck) / 2}
    before = F.avg("close").over(fr.rows(-5, -1))
    s |= {"falling": (F.col("idx") >= 5) & (before > c), "rising": (F.col("idx") >= 5) & (before < c)}
    s |= {"low3": F.min("low").over(fr.last_rows(3)), "high3": F.max("high").over(fr.last_rows(3))}
    return s


def _rules(s: dict, min_body: float) -> dict[str, list[Rule]]:
    o, c, h, low = s["o"], s["c"], s["h"], s["l"]
    body, rng, upper, lower = s["body"], s["range"], s["upper"], s["lower"]
    ranged = rng > 0
    grave = ranged & (safe_div(upper, rng) > 0.7)
    dragon = ranged & (safe_div(lower, rng) > 0.7)
    legs = ranged & (safe_div(F.abs(upper - lower), rng) < 0.1)
    doji_name = (
        F.when(grave, "gravestone_doji").when(dragon, "dragonfly_doji")
        .when(legs, "long-legged_doji").otherwise("standard_doji")
    )
    doji_conf = F.when(grave | dragon, 0.8).when(legs, 0.75).otherwise(0.7)
    long_low = (lower > body * 2) & (upper < body * 0.5)
    long_up = (upper > body * 2) & (lower < body * 0.5)

    prev, prev2 = s["move1"], s["move2"]
    big = safe_div(body, s["body1"])
    inside = (
        (body < s["body1"] * 0.5)
        & (F.least(o, c) > F.least(s["o1"], s["c1"]))
        & (F.greatest(o, c) < F.greatest(s["o1"], s["c1"]))
    )
    harami_dir = F.when(s["c1"] > s["o1"], "bearish").otherwise("bullish")
    bull_harami = harami_dir == "bullish"
    star = (s["body1"] < F.abs(prev2) * 0.3)
    star_size = safe_div(s["body1"], F.abs(prev2))
    up3 = (prev2 > 0) & (prev > 0) & (s["move"] > 0)
    down3 = (prev2 < 0) & (prev < 0) & (s["move"] < 0)
    mean_body = (body + s["body1"] + s["body2"]) / 3
    return {
        "doji": [Rule(doji_name, safe_div(body, (o + c) / 2) < min_body, "neutral", doji_conf,
                      meta={"body_size": body, "upper_shadow": upper, "lower_shadow": lower})],
        "hammer": [
            Rule("hammer", long_low & s["falling"], "bullish", 0.7, target=c * 1.02, stop=low * 0.99,
                 meta={"lower_shadow_ratio": safe_div(lower, body)}),
            Rule("inverted_hammer", ~long_low & long_up & s["falling"], "bullish", 0.65,
                 target=c * 1.02, stop=low * 0.99, meta={"upper_shadow_ratio": safe_div(upper, body)}),
        ],
        "shooting_star": [
            Rule("shooting_star", long_up & s["rising"], "bearish", 0.7, target=c * 0.98, stop=h * 1.01,
                 meta={"upper_shadow_ratio": F.coalesce(safe_div(upper, body), F.lit(0.0))}),
        ],
        "spinning_top": [
            Rule("spinning_top",
                 ranged & (safe_div(body, rng) < 0.3) & (safe_div(F.abs(upper - lower), rng) < 0.2),
                 "neutral", 0.6, meta={"body_ratio": safe_div(body, rng)}),
        ],
        "engulfing": [
            Rule("bullish_engulfing", (prev < 0) & (s["move"] > 0) & (o < s["c1"]) & (c > s["o1"]),
                 "bullish", 0.75, span=1, target=c * 1.03, stop=low * 0.98, meta={"engulfing_ratio": big}),
            Rule("bearish_engulfing", (prev > 0) & (s["move"] < 0) & (o > s["c1"]) & (c < s["o1"]),
                 "bearish", 0.75, span=1, target=c * 0.97, stop=h * 1.02, meta={"engulfing_ratio": big}),
        ],
        "harami": [
            Rule(F.concat(harami_dir, F.lit("_harami")), inside, harami_dir, 0.65, span=1,
                 target=c * F.when(bull_harami, 1.02).otherwise(0.98),
                 stop=c * F.when(bull_harami, 0.98).otherwise(1.02), meta={"body_ratio": big}),
        ],
        "piercing": [
            Rule("piercing_line",
                 (prev < 0) & (s["move"] > 0) & (o < s["l1"]) & (c > s["mid1"]) & (c < s["o1"]),
                 "bullish", 0.7, span=1, target=c * 1.03, stop=low * 0.98,
                 meta={"penetration": safe_div(c - s["c1"], s["body1"])}),
            Rule("dark_cloud_cover",
                 (prev > 0) & (s["move"] < 0) & (o > s["h1"]) & (c < s["mid1"]) & (c > s["o1"]),
                 "bearish", 0.7, span=1, target=c * 0.97, stop=h * 1.02,
                 meta={"penetration": safe_div(s["o1"] - c, s["body1"])}),
        ],
        "morning_star": [
            Rule("morning_star", (prev2 < 0) & star & (s["move"] > 0) & (c > s["mid2"]), "bullish", 0.8,
                 span=2, target=c * 1.04, stop=s["low3"] * 0.98, meta={"star_size": star_size}),
        ],
        "evening_star": [
            Rule("evening_star", (prev2 > 0) & star & (s["move"] < 0) & (c < s["mid2"]), "bearish", 0.8,
                 span=2, target=c * 0.96, stop=s["high3"] * 1.02, meta={"star_size": star_size}),
        ],
        "soldiers": [
            Rule("three_white_soldiers",
                 up3 & (s["c1"] > s["c2"]) & (c > s["c1"]) & (s["o1"] > s["o2"]) & (o > s["o1"]),
                 "bullish", 0.85, span=2, target=c * 1.05, stop=s["low3"] * 0.97,
                 meta={"avg_body_size": mean_body}),
            Rule("three_black_crows",
                 down3 & (s["c1"] < s["c2"]) & (c < s["c1"]) & (s["o1"] < s["o2"]) & (o < s["o1"]),
                 "bearish", 0.85, span=2, target=c * 0.95, stop=s["high3"] * 1.03,
                 meta={"avg_body_size": mean_body}),
        ],
    }


def candlestick_patterns(
    bars: DataFrame, min_body: float = 0.001, groups: Collection[str] = GROUPS
) -> DataFrame:
    """All candlestick patterns, or the named groups only, from one sort of the bars."""
    require(bars, "open", "high", "low", "close")
    df = fr.framed(bars, back=6)
    rules = _rules(_shape(), min_body)
    return emit(df, "candlestick", [r for g in GROUPS if g in groups for r in rules[g]])
