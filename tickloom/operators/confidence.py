"""Confidence of a pattern from five components, its explanation, and weight learning.

Inputs are flat columns; a column that is absent or null leaves its factor out.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.stats import pooled_t, t_p_value
from tickloom.operators.averages import correlation
from tickloom.schemas import SERIES, require

# Default weights.
WEIGHTS = {
    "statistical_significance": 0.30,
    "historical_success": 0.25,
    "volume_confirmation": 0.20,
    "timeframe_alignment": 0.15,
    "market_condition": 0.10,
}
# Base score by market condition.
CONDITION_SCORE = {
    "strong_trend": 0.7,
    "weak_trend": 0.6,
    "ranging": 0.5,
    "volatile": 0.4,
    "calm": 0.6,
    "breakout": 0.75,
    "reversal": 0.65,
}


def normalise(weights: Mapping[str, float]) -> dict[str, float]:
    """Rescale to a sum of one when it is off by more than 0.01."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if abs(total - 1) > 0.01 else dict(weights)


def _opt(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _factor(*cases: tuple[Column, float]) -> Column:
    """First matching factor, 1 when none matches or the inputs are missing."""
    out = None
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(1.0)


def return_stats(patterns: DataFrame, bars: DataFrame) -> DataFrame:
    """Mean and variance of the bar returns inside each pattern, and of the whole series.

    Range sums come from cumulative sums at both ends of the pattern.
    """
    require(patterns, "pattern_id", *SERIES, "start_idx", "end_idx")
    df = fr.framed(bars, back=1).withColumn("_r", F.try_divide(F.col("close") - fr.lag("close"), fr.lag("close")))
    r = F.coalesce("_r", F.lit(0.0))
    df = fr.running_sums(df, {"_s": r, "_q": r * r}).filter("core")
    history = fr.per_series(df, F.count("_r").alias("n2"), F.avg("_r").alias("m2"), F.var_samp("_r").alias("v2")).drop("n")
    ends = F.array(F.struct(F.lit(1.0).alias("sign"), F.col("end_idx").alias("idx")), F.struct(F.lit(-1.0).alias("sign"), F.col("start_idx").alias("idx")))
    at = patterns.select("pattern_id", *SERIES, "start_idx", "end_idx", F.explode(ends).alias("e")).select("*", "e.sign", "e.idx").drop("e")
    at = at.join(df.select(*SERIES, "idx", "_s", "_q"), [*SERIES, "idx"])
    g = at.groupBy("pattern_id", *SERIES, "start_idx", "end_idx").agg(F.sum(F.col("sign") * F.col("_s")).alias("_s"), F.sum(F.col("sign") * F.col("_q")).alias("_q"))
    n = F.col("end_idx") - F.col("start_idx")
    mean = F.try_divide(F.col("_s"), n.cast("double"))
    spread = F.greatest(F.lit(0.0), F.col("_q") - n * mean * mean)
    g = g.select("pattern_id", *SERIES, n.alias("n1"), mean.alias("m1"), F.try_divide(spread, (n - 1).cast("double")).alias("v1"), F.sqrt(F.try_divide(spread, n.cast("double"))).alias("sd1"))
    return g.join(history, SERIES)


def statistical_significance(df: DataFrame) -> DataFrame:
    """Adds ``statistical_significance``. Reads n1, m1, v1, sd1, n2, m2, v2 (:func:`return_stats`), points, r_squared."""
    n1, m1, v1, sd1, n2, m2, v2 = (_opt(df, c) for c in ("n1", "m1", "v1", "sd1", "n2", "m2", "v2"))
    t, free = pooled_t(n1, m1, v1, n2, m2, v2)
    usable = (n1 >= 2) & (n2 > 30)
    df = df.withColumn("_p", t_p_value(F.when(usable, t), F.when(usable, free)))
    p = F.col("_p")
    base = F.when(p < 0.01, 0.95).when(p < 0.05, 0.85).when(p < 0.10, 0.75).when(p.isNotNull(), 0.5 + (0.1 - p) * 2).otherwise(0.5)
    sharpe = F.when((n1 >= 2) & (sd1 > 0), F.least(F.lit(1.0), 0.7 + m1 / sd1 * 0.15))
    points, r2 = _opt(df, "points"), _opt(df, "r_squared")
    score = base * F.coalesce(sharpe, F.lit(1.0)) * _factor((points >= 5, 1.1), (points >= 3, 1.05)) * _factor((r2 > 0.9, 1.15), (r2 > 0.7, 1.05))
    return df.withColumn("statistical_significance", F.least(F.lit(1.0), score)).withColumnRenamed("_p", "p_value")


def historical_success(df: DataFrame) -> Column:
    rate, size, recent = _opt(df, "historical_success_rate"), _opt(df, "sample_size"), _opt(df, "recent_performance")
    ret, ratio = _opt(df, "avg_return"), _opt(df, "win_loss_ratio")
    sized = F.when(rate.isNotNull(), rate * _factor((size < 10, 0.7), (size < 30, 0.85), (size > 100, 1.1))).otherwise(0.5)
    mixed = F.when(recent > F.coalesce(rate, F.lit(0.5)), sized * 0.7 + recent * 0.3).otherwise(sized)
    score = mixed * _factor((ret > 0.05, 1.2), (ret > 0.02, 1.1), (ret < -0.02, 0.8)) * _factor((ratio > 2.0, 1.15), (ratio > 1.5, 1.05), (ratio < 1.0, 0.9))
    return F.least(F.lit(1.0), score)


def volume_confirmation(df: DataFrame) -> Column:
    v, mean = _opt(df, "volume"), _opt(df, "avg_volume")
    kind = F.lower(F.coalesce(_opt(df, "pattern_type", "string"), F.lit("")))
    usual = F.coalesce(mean, v)
    r = F.when(v.isNotNull(), F.when(usual > 0, v / usual).otherwise(1.0))
    surge = F.when(r > 2.0, 0.95).when(r > 1.5, 0.85).when(r > 1.2, 0.75).otherwise(0.4 + r * 0.2)
    calm = F.when((r >= 0.8) & (r <= 1.5), 0.8).when(r > 1.5, 0.7).otherwise(0.5)
    base = F.when(r.isNull(), 0.5).when(kind.contains("breakout") | kind.contains("reversal"), surge).otherwise(calm)
    trend, d = _opt(df, "volume_trend", "string"), _opt(df, "direction", "string")
    f = _factor(((trend == "increasing") & (d == "bullish"), 1.15), ((trend == "decreasing") & (d == "bearish"), 1.1), (trend == "diverging", 0.85))
    return F.least(F.lit(1.0), base * f * _factor((_opt(df, "at_poc", "boolean"), 1.1)) * _factor((_opt(df, "above_vwap", "boolean"), 1.05)))


def aligned_share(signals: DataFrame, patterns: DataFrame) -> DataFrame:
    """Share of timeframe signals that agree with a pattern's direction; 1d and 4h count half as much again.

    Signals: pattern_id, tf, tf_direction.
    """
    weight = F.when(F.col("tf").isin("1d", "4h"), 1.5).otherwise(1.0)
    both = signals.join(patterns.select("pattern_id", "direction"), "pattern_id")
    agreed = F.sum(F.when(F.col("tf_direction") == F.col("direction"), weight).otherwise(0.0))
    return both.groupBy("pattern_id").agg((agreed / F.count(F.lit(1))).alias("alignment_ratio"))


def timeframe_alignment(df: DataFrame) -> Column:
    ratio, higher, zones = _opt(df, "alignment_ratio"), _opt(df, "higher_timeframe_trend", "string"), _opt(df, "confluence_zones")
    d = F.coalesce(_opt(df, "direction", "string"), F.lit("neutral"))
    base = F.coalesce(0.3 + ratio * 0.7, F.lit(0.5))
    f = _factor((higher == d, 1.2), (higher == "neutral", 1.0), (higher.isNotNull(), 0.7))
    return F.least(F.lit(1.0), base * f * _factor((zones >= 3, 1.15), (zones >= 2, 1.08)))


def market_label(df: DataFrame) -> Column:
    """Market condition; ranging without market data."""
    strength, vol = F.coalesce(_opt(df, "trend_strength"), F.lit(0.0)), F.coalesce(_opt(df, "volatility"), F.lit(0.15))
    return (
        F.when(strength > 0.7, "strong_trend").when(strength > 0.4, "weak_trend").when(vol > 0.25, "volatile").when(vol < 0.1, "calm")
        .when(_opt(df, "is_breakout", "boolean"), "breakout").when(_opt(df, "is_reversal", "boolean"), "reversal").otherwise("ranging")
    )


def market_condition(df: DataFrame) -> Column:
    label = market_label(df)
    base = F.lit(0.5)
    for k, v in CONDITION_SCORE.items():
        base = F.when(label == k, v).otherwise(base)
    kind = F.lower(F.coalesce(_opt(df, "pattern_type", "string"), F.lit("")))
    brk, vol, strength = kind.contains("breakout"), _opt(df, "volatility"), _opt(df, "trend_strength")
    d, td, phase = _opt(df, "direction", "string"), _opt(df, "trend_direction", "string"), _opt(df, "market_phase", "string")
    by_vol = F.when(vol > 0.3, F.when(brk, 0.85).otherwise(0.9)).when(vol < 0.1, F.when(brk, 1.1).otherwise(1.05)).otherwise(1.0)
    by_trend = F.when(strength > 0.7, F.when(d.eqNullSafe(td), 1.15).otherwise(0.85)).otherwise(1.0)
    by_phase = _factor((phase.isin("accumulation", "markup") & (d == "bullish"), 1.1), (phase.isin("distribution", "markdown") & (d == "bearish"), 1.1))
    return F.least(F.lit(1.0), base * by_vol * by_trend * by_phase)


def consistency_bonus(scores: list[Column]) -> Column:
    """Bonus for even high scores, malus for scattered ones (population deviation)."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    sd = F.sqrt(sum((F.pow(s - mean, 2) for s in scores[1:]), F.pow(scores[0] - mean, 2)) / len(scores))
    return F.when((mean > 0.7) & (sd < 0.15), 0.1).when((mean > 0.6) & (sd < 0.2), 0.05).when(sd > 0.3, -0.05).otherwise(0.0)


def level(score: Column) -> Column:
    return F.when(score >= 0.9, "VERY_HIGH").when(score >= 0.75, "HIGH").when(score >= 0.6, "MEDIUM").when(score >= 0.4, "LOW").otherwise("VERY_LOW")


def recommendation(score: Column) -> Column:
    return F.when(score >= 0.8, "STRONG_SIGNAL").when(score >= 0.65, "MODERATE_SIGNAL").when(score >= 0.5, "WEAK_SIGNAL").otherwise("NO_ACTION")


def combine(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Overall score, level and recommendation from the five component columns."""
    w = normalise(weights or WEIGHTS)
    scores = [F.col(k) for k in WEIGHTS]
    used = {k: v for k, v in w.items() if k in WEIGHTS}
    mean = sum((F.col(k) * v for k, v in used.items()), F.lit(0.0)) / sum(used.values())
    df = df.withColumn("overall_score", F.least(F.lit(1.0), mean * (1 + consistency_bonus(scores))))
    s = F.col("overall_score")
    return df.withColumns({"confidence_level": level(s), "recommendation": recommendation(s)})


def confidence(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """All components and the overall score; expressions only but for the p-value."""
    parts = {"historical_success": historical_success(df), "volume_confirmation": volume_confirmation(df),
             "timeframe_alignment": timeframe_alignment(df), "market_condition": market_condition(df), "condition_label": market_label(df)}
    return combine(statistical_significance(df.withColumns(parts)), weights)


def explain(scored: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Component, score, weight, contribution, share in percent, and whether it is a strength or a warning.

    Five entries per pattern, ranked inside the row: no shuffle.
    """
    w = normalise(weights or WEIGHTS)
    items = F.array(*[F.struct((-F.col(k) * w.get(k, 0.0)).alias("neg"), F.lit(k).alias("component"), F.col(k).alias("score"), F.lit(float(w.get(k, 0.0))).alias("weight")) for k in WEIGHTS])
    df = scored.select("pattern_id", "overall_score", F.posexplode(F.array_sort(items)).alias("pos", "c"))
    add = -F.col("c.neg")
    s = F.col("c.score")
    role = F.when((F.col("pos") < 3) & (s > 0.7), "key_factor").when((F.col("pos") >= 3) & (s < 0.4), "warning")
    return df.select("pattern_id", F.col("c.component").alias("component"), s.alias("score"), F.col("c.weight").alias("weight"), add.alias("contribution"),
                     F.when(F.col("overall_score") > 0, 100 * add / F.col("overall_score")).otherwise(0.0).alias("percentage"), role.alias("role"))


def component_success(outcomes: DataFrame) -> DataFrame:
    """Successes credited to each component: outcomes that succeeded while its score was over 0.6."""
    return outcomes.select(F.stack(F.lit(len(WEIGHTS)), *[x for k in WEIGHTS for x in (F.lit(k), F.col(k))]).alias("component", "score"), "success").groupBy("component").agg(
        F.count_if(F.col("success") & (F.col("score") > 0.6)).alias("successes"))


def update_weights(weights: Mapping[str, float], perf: DataFrame) -> DataFrame:
    """Move each weight a tenth of the way to its share of successes, clip to [0.05, 0.5], renormalise."""
    spark = perf.sparkSession
    w = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "component string, weight double")
    total = perf.agg(F.sum("successes").alias("_all")).withColumn("_one", F.lit(1))
    df = w.join(perf, "component", "left").withColumn("_one", F.lit(1)).join(total, "_one")
    moved = F.col("weight") + (F.col("successes") / F.col("_all") - F.col("weight")) * 0.1
    keep = F.col("successes").isNull() | (F.col("_all") <= 0)
    df = df.withColumn("weight", F.when(keep, F.col("weight")).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.5), moved))))
    sums = df.agg(F.sum("weight").alias("_sum")).withColumn("_one", F.lit(1))
    scaled = F.when(F.abs(F.col("_sum") - 1) > 0.01, F.col("weight") / F.col("_sum")).otherwise(F.col("weight"))
    return df.join(sums, "_one").select("component", scaled.alias("weight"))


class Learner:
    """Online weights of one learner: a gradient step per outcome, a review of the last 50 every 100."""

    def __init__(self, rate: float = 0.01):
        self.rate, self.n = rate, 0
        self.w = np.array(list(WEIGHTS.values()))
        self.recent: list[np.ndarray] = []

    def _fix(self) -> None:
        total = self.w.sum()
        if abs(total - 1) > 0.01:
            self.w = self.w / total

    def see(self, scores: np.ndarray, overall: float, success: bool) -> None:
        self.w = self.w + (float(success) - overall) * scores * self.rate
        self._fix()
        self.n += 1
        self.recent = [*self.recent[-49:], (scores > 0.6) == success]
        if self.n % 100 == 0:
            hit = np.mean(self.recent, axis=0)
            self.w = self.w * np.where(hit > 0.7, 1.05, np.where(hit < 0.5, 0.95, 1.0))
            self._fix()


def learn(outcomes: DataFrame, key: str = "pattern_name", order: tuple[str, ...] = ("observed_at", "pattern_id"), rate: float = 0.01) -> DataFrame:
    """Final weights per learner after its outcomes in order.

    Each step depends on the one before, so a learner is one sequential pass; rows stream through
    sorted partitions in Arrow batches and only the weights and fifty flags are held.
    """
    require(outcomes, key, *order, *WEIGHTS, "overall_score", "success")
    names = list(WEIGHTS)
    cols = [key, *order, *names, "overall_score", "success"]
    df = outcomes.select(*cols).repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        current, learner = None, None

        def result() -> pd.DataFrame:
            return pd.DataFrame([[current, learner.n, *learner.w]], columns=[key, "outcomes", *names])

        for pdf in batches:
            for k, scores, overall, success in zip(pdf[key], pdf[names].to_numpy(dtype=float), pdf["overall_score"], pdf["success"]):
                if k != current:
                    if learner is not None:
                        yield result()
                    current, learner = k, Learner(rate)
                learner.see(scores, overall, bool(success))
        if learner is not None:
            yield result()

    return df.mapInPandas(run, f"{key} string, outcomes long, " + ", ".join(f"{n} double" for n in names))


def learning_metrics(outcomes: DataFrame, key: str = "pattern_name", order: tuple[str, ...] = ("observed_at", "pattern_id")) -> DataFrame:
    """Accuracy, means and correlation per learner, and the change from the first 50 to the last 50 outcomes."""
    df = outcomes.withColumns({"symbol": F.col(key), "timeframe": F.lit(""), "ts": F.col(order[0]),
                               "_hit": ((F.col("overall_score") > 0.6) == F.col("success")).cast("double")})
    df = fr.index_rows(df, order)
    c, r = F.col("overall_score"), F.col("ret")
    early, late = F.col("idx") < 50, F.col("idx") >= F.col("n") - 50

    def corr(when: Column) -> Column:
        v = correlation(F.when(when, c), F.when(when, r))
        return F.when(~F.isnan(v), v)

    def acc(when: Column) -> Column:
        return F.avg(F.when(when, F.col("_hit")))

    long = F.max("n") > 100
    return df.groupBy(F.col("symbol").alias(key)).agg(
        F.max("n").alias("total_predictions"), F.avg("_hit").alias("accuracy"), F.avg(c).alias("avg_confidence"), F.avg(r).alias("avg_return"),
        corr(F.lit(True)).alias("confidence_correlation"), F.when(long, acc(late) - acc(early)).alias("accuracy_change"), F.when(long, corr(late) - corr(early)).alias("correlation_change"))
