"""Stored patterns: saving, outcomes, performance, search, classification, retention."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from tickloom.schemas import SERIES, require

# Candlestick names by direction.
BULLISH = ["hammer", "inverted_hammer", "bullish_engulfing", "morning_star", "three_white_soldiers", "bullish_harami", "tweezer_bottom"]
BEARISH = ["shooting_star", "hanging_man", "bearish_engulfing", "evening_star", "three_black_crows", "bearish_harami", "tweezer_top"]


def direction_of(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.isin(*BULLISH), "bullish").when(n.isin(*BEARISH), "bearish").otherwise("neutral")


def volume_direction(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike("breakout|accumulation|pocket_pivot"), "bullish").when(n.rlike("distribution|climax"), "bearish").otherwise("neutral")


def route_alerts(patterns: DataFrame) -> DataFrame:
    """Alert priority by confidence and the channels it goes to."""
    c = F.col("confidence")
    priority = F.when(c >= 0.9, "critical").when(c >= 0.8, "high").when(c >= 0.7, "medium").otherwise("low")
    db, ws, mail = F.lit("database"), F.lit("websocket"), F.lit("email")
    channels = F.when(c >= 0.9, F.array(db, ws, mail)).when(c >= 0.8, F.array(db, ws)).otherwise(F.array(db))
    return patterns.withColumns({"priority": priority, "channels": channels})


def match_subscriptions(patterns: DataFrame, subs: DataFrame, salts: int = 16) -> DataFrame:
    """Patterns of interest per subscriber; an empty symbol or type list means all.

    Both lists become join keys with '*' for all, so the match is an equality. Everything
    matches '*', so keys carry a salt: patterns pick one, subscriptions have all.
    """
    any_ = F.array(F.lit("*"))

    def listed(c: str) -> Column:
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(any_)

    s = subs.select("subscriber", F.coalesce("min_confidence", F.lit(0.0)).alias("_min"), F.explode(listed("symbols")).alias("_sym"), listed("pattern_types").alias("_types"))
    s = s.select("subscriber", "_min", "_sym", F.explode("_types").alias("_type")).distinct()
    s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    p = patterns.withColumns({"_salt": F.pmod(F.xxhash64("pattern_id"), F.lit(salts)).cast("int"), "_sym": F.explode(F.array(F.col("symbol"), F.lit("*")))})
    p = p.withColumn("_type", F.explode(F.array(F.col("pattern_type"), F.lit("*"))))
    hit = p.join(s, ["_salt", "_sym", "_type"]).filter(F.col("confidence") >= F.col("_min"))
    return hit.drop("_salt", "_sym", "_type", "_min").dropDuplicates(["subscriber", "pattern_id"])


def match_counts(patterns: DataFrame, subs: DataFrame) -> DataFrame:
    """Per subscriber, how many rows :func:`match_subscriptions` has for it: subscriber, matches. Pairs are counted, not listed.

    Patterns and thresholds of a key (symbol or '*', type or '*') are ordered by confidence; a subscriber's keys meet no pattern
    twice, so their counts add up. Pairs are listed for the rest only: patterns whose id stands for several symbols or types, and
    subscribers that name symbols or types in some rows and all in others.
    """
    key, any_ = ["_sym", "_type"], F.lit("*")

    def listed(c: str) -> Column:
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.array(any_))

    s = subs.select("subscriber", F.coalesce("min_confidence", F.lit(0.0)).alias("_at"), F.explode(listed("symbols")).alias("_sym"), listed("pattern_types").alias("_types"))
    s = s.select("subscriber", "_at", "_sym", F.explode("_types").alias("_type")).filter("_sym is not null and _type is not null")
    own = Window.partitionBy("subscriber")
    kind = F.concat((F.col("_sym") == "*").cast("int"), (F.col("_type") == "*").cast("int"))
    s = s.groupBy("subscriber", *key).agg(F.min("_at").alias("_at")).withColumn("_mixed", F.min(kind).over(own) != F.max(kind).over(own))

    p = patterns.filter("confidence is not null").groupBy("pattern_id", "symbol", "pattern_type").agg(F.max("confidence").alias("confidence"))
    p = p.withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy("pattern_id")) > 1)

    points = p.filter("not _several").withColumn("_sym", F.explode(F.array_distinct(F.array("symbol", any_))))
    points = points.withColumn("_type", F.explode(F.array_distinct(F.array("pattern_type", any_)))).filter("_sym is not null and _type is not null")
    points = points.groupBy(*key, F.col("confidence").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    plain = s.filter("not _mixed")
    # Confidences lie between 0 and 1; all beyond share the outer slices. A slice is ordered by itself, slices are summed.
    cut = F.floor(F.greatest(F.lit(-1.0), F.least(F.col("_at"), F.lit(2.0))) * 4096)
    both = points.unionByName(plain.select(*key, "_at").distinct().withColumn("_n", F.lit(0).cast("long"))).withColumn("_slice", cut)
    above = Window.partitionBy(*key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = both.groupBy(*key, "_slice").agg(F.sum("_n").alias("_c")).select(*key, "_slice", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*key, "_slice").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.withColumn("_in", F.sum("_n").over(inside)).filter("_n = 0").join(offsets, [*key, "_slice"])
    counted = plain.join(ranked.select(*key, "_at", (F.col("_off") + F.col("_in")).alias("matches")), [*key, "_at"])

    def criteria(rows: DataFrame) -> DataFrame:
        return rows.select("subscriber", F.array("_sym").alias("symbols"), F.array("_type").alias("pattern_types"), F.col("_at").alias("min_confidence"))

    rest = match_subscriptions(p.filter("_several"), criteria(plain)).unionByName(match_subscriptions(p, criteria(s.filter("_mixed"))))
    rest = rest.groupBy("subscriber").agg(F.count(F.lit(1)).alias("matches"))
    return counted.select("subscriber", "matches").unionByName(rest).groupBy("subscriber").agg(F.sum("matches").alias("matches")).filter("matches > 0")


def retention_days(confidence: Column) -> Column:
    """Days a pattern is kept: long for high confidence (tiers inferred)."""
    return F.when(confidence >= 0.8, 180).otherwise(30)


def to_store(patterns: DataFrame, detected_at: Column) -> DataFrame:
    """Give each finding a key-derived id (so a repeated save is the same row), duration, status and expiry."""
    require(patterns, *SERIES, "pattern_type", "pattern_name", "start_ts", "end_ts", "confidence")
    key = F.concat_ws("|", "symbol", "timeframe", "pattern_type", "pattern_name", F.unix_micros("start_ts").cast("string"), F.unix_micros("end_ts").cast("string"))
    return patterns.withColumns({
        "pattern_id": F.sha2(key, 256), "status": F.lit("detected"), "detected_at": detected_at,
        "duration_seconds": F.unix_seconds("end_ts") - F.unix_seconds("start_ts"),
        "expires_at": detected_at + F.make_dt_interval(retention_days(F.col("confidence"))),
        "tags": F.col("tags") if "tags" in patterns.columns else F.array().cast("array<string>"),
    })


def apply_outcomes(patterns: DataFrame, updates: DataFrame) -> DataFrame:
    """Set status, outcome and return (updates: pattern_id, status, outcome, ret, at); finished patterns get end and duration."""
    u = updates.select("pattern_id", F.col("status").alias("_st"), F.col("outcome").alias("_out"), F.col("ret").alias("_ret"), F.col("at").alias("_at"))
    df = patterns.join(u, "pattern_id", "left")
    done = F.coalesce(F.col("_st").isin("completed", "failed"), F.lit(False))
    return df.withColumns({
        "status": F.coalesce("_st", "status"), "actual_outcome": F.coalesce("_out", "actual_outcome"), "actual_return": F.coalesce("_ret", "actual_return"),
        "end_ts": F.when(done, F.col("_at")).otherwise(F.col("end_ts")),
        "duration_seconds": F.when(done, F.unix_seconds("_at") - F.unix_seconds("start_ts")).otherwise(F.col("duration_seconds")),
    }).drop("_st", "_out", "_ret", "_at")


def pattern_perf(patterns: DataFrame) -> DataFrame:
    """Performance rows of finished patterns."""
    r = F.col("actual_return")
    df = patterns.filter(F.col("status").isin("completed", "failed"))
    up, down = r > 0, r <= 0
    t = F.unix_seconds("end_ts") - F.unix_seconds("start_ts")
    return df.select(
        "pattern_id", F.coalesce(up, F.lit(False)).alias("hit_target"), F.coalesce(down, F.lit(False)).alias("hit_stop_loss"),
        F.when(up, r).alias("max_favorable_excursion"), F.when(down, F.abs(r)).alias("max_adverse_excursion"),
        F.when(up, t).alias("time_to_target"), F.when(down, t).alias("time_to_stop"), F.lit(None).cast("double").alias("follow_through_rate"), F.lit(False).alias("false_breakout"))


def perf_score(perf: DataFrame) -> DataFrame:
    """Score in [0, 1] from hits, excursions, follow-through and false breakout."""

    def step(c: str) -> Column:
        return F.when(F.col(c) > 0.1, 0.2).when(F.col(c) > 0.05, 0.1).otherwise(0.0)

    score = (
        0.5 + F.when(F.col("hit_target"), 0.3).when(F.col("hit_stop_loss"), -0.2).otherwise(0.0)
        + step("max_favorable_excursion") - step("max_adverse_excursion")
        + F.coalesce(F.col("follow_through_rate") * 0.2, F.lit(0.0)) - F.when(F.col("false_breakout"), 0.15).otherwise(0.0)
    )
    return perf.withColumn("performance_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def merge_perf(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values replace old ones field by field, rows without a partner stay; scores are recomputed."""
    fields = [c for c in old.columns if c not in ("pattern_id", "performance_score")]
    n = new.select("pattern_id", *[F.col(c).alias(f"_n_{c}") for c in fields if c in new.columns])
    df = old.join(n, "pattern_id", "full_outer")
    merged = df.select("pattern_id", *[(F.coalesce(f"_n_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in fields])
    return perf_score(merged)


def matches(flt: Mapping) -> Column:
    """Condition of a filter: pattern_types, pattern_names, directions, symbols, timeframes, statuses,
    min_confidence, max_confidence, min_strength, start, end, tags."""
    ok = F.lit(True)
    for key, col in (("pattern_types", "pattern_type"), ("pattern_names", "pattern_name"), ("directions", "direction"),
                     ("symbols", "symbol"), ("timeframes", "timeframe"), ("statuses", "status")):
        if flt.get(key):
            ok = ok & F.col(col).isin(*flt[key])
    for key, test in (("min_confidence", lambda v: F.col("confidence") >= v), ("max_confidence", lambda v: F.col("confidence") <= v),
                      ("min_strength", lambda v: F.col("strength") >= v), ("start", lambda v: F.col("detected_at") >= F.lit(v).cast("timestamp")),
                      ("end", lambda v: F.col("detected_at") <= F.lit(v).cast("timestamp"))):
        if flt.get(key) is not None:
            ok = ok & test(flt[key])
    if flt.get("tags"):
        ok = ok & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in flt["tags"]]))
    return ok


def find_patterns(patterns: DataFrame, flt: Mapping, sort: str = "detected_at", descending: bool = True, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Filtered, sorted slice and the total."""
    hits = patterns.filter(matches(flt))
    order = F.desc(sort) if descending else F.asc(sort)
    return hits.orderBy(order, "pattern_id").offset(offset).limit(limit), hits.agg(F.count(F.lit(1)).alias("total"))


def active(patterns: DataFrame, symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
    flt = {"statuses": ["active", "detected", "confirmed"], "symbols": symbol and [symbol], "timeframes": timeframe and [timeframe]}
    return patterns.filter(matches(flt)).orderBy(F.desc("detected_at"), "pattern_id")


def multi_find(patterns: DataFrame, filters: Mapping[str, Mapping]) -> DataFrame:
    """Several filters in one scan; each hit is tagged with its ``query``."""
    names = F.array_compact(F.array(*[F.when(matches(f), F.lit(k)) for k, f in filters.items()]))
    return patterns.withColumn("query", F.explode(names))


def classify(patterns: DataFrame, market: DataFrame) -> DataFrame:
    """Confirmation flags, risk level, bias and action. Market: symbol, trend_direction, volume_confirmation, rsi, market_phase.

    The bias score is the equal-weight mean of the three flags, the confidence factors and the
    risk (formula inferred; 0.7 and more is strong, over 0.5 is a bias).
    """
    df = patterns.join(market, "symbol", "left")
    trend = F.coalesce(F.col("trend_direction") == F.col("direction"), F.lit(False))
    volume = F.coalesce("volume_confirmation", F.lit(False))
    momentum = F.coalesce((F.col("rsi") > 30) & (F.col("rsi") < 70), F.lit(False))
    rr = F.col("risk_reward")
    risk = F.when(rr.isNull() | (rr == 0), "medium").when(rr >= 3, "low").when(rr >= 2, "medium").otherwise("high")
    factors = F.array_compact(F.array(F.when(F.col("confidence") >= 0.8, F.col("confidence")), F.when(F.col("strength") >= 0.7, F.col("strength"))))
    mean = F.coalesce(F.try_divide(F.aggregate(factors, F.lit(0.0), lambda a, x: a + x), F.size(factors).cast("double")), F.lit(0.5))
    safety = F.when(F.col("risk_level") == "low", 1.0).when(F.col("risk_level") == "medium", 0.5).otherwise(0.0)
    df = df.withColumns({"trend_alignment": trend, "volume_ok": volume, "momentum_ok": momentum, "risk_level": risk, "_factors": mean})
    score = (F.col("trend_alignment").cast("int") + F.col("volume_ok").cast("int") + F.col("momentum_ok").cast("int") + F.col("_factors") + safety) / 5
    df = df.withColumn("classification_score", score).drop("_factors")
    s, d = F.col("classification_score"), F.col("direction")
    side = F.when(d == "bullish", "buy").when(d == "bearish", "sell")
    bias = F.when(side.isNull() | (s <= 0.5), "neutral").when(s > 0.7, F.concat(F.lit("strong_"), side)).otherwise(side)
    action = F.when(F.col("bias").endswith("buy"), "enter_long").when(F.col("bias").endswith("sell"), "enter_short").otherwise("wait")
    return df.withColumn("bias", bias).withColumn("suggested_action", action)


def expire(patterns: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and expired patterns; a pattern without an expiry is kept."""
    gone = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    return patterns.filter(~gone), patterns.filter(gone)


def archive(patterns: DataFrame, as_of: Column, path: str | None = None, days: int = 365) -> tuple[DataFrame, DataFrame]:
    """Split off patterns older than ``days``; with a path they are written there by month first."""
    old = F.coalesce(F.col("detected_at") < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
    moved = patterns.filter(old)
    if path:
        moved.withColumn("month", F.date_format("detected_at", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)
    return patterns.filter(~old), moved


def annotations(patterns: DataFrame) -> DataFrame:
    """Entry, target and stop lines of each pattern as rows."""

    def line(col: str, label: str, colour: str) -> Column:
        p = F.col(col)
        return F.when(p.isNotNull() & (p != 0), F.struct(F.lit("horizontal_line").alias("type"), p.alias("price"), F.lit(label).alias("label"), F.lit(colour).alias("color")))

    rows = F.array_compact(F.array(line("entry_price", "Entry", "#0000ff"), line("target_price", "Target", "#00ff00"), line("stop_loss", "Stop Loss", "#ff0000")))
    return patterns.select("pattern_id", "symbol", "pattern_name", F.explode(rows).alias("a")).select("pattern_id", "symbol", "pattern_name", "a.*")


