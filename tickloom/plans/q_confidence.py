"""Confidence components, combination, explanation, learning."""

from pyspark.sql import functions as F

from tickloom.operators import candles as ca
from tickloom.operators import confidence as co
from tickloom.plans.catalog import query, rounded
from tickloom.plans.q_patterns import CANDLE
from tickloom.plans.sql import HOURLY, PATTERNS, t_two_sided

INPUT = """ci AS (SELECT pattern_id, direction, k, (k % 97) / 97 AS hsr, k % 150 AS ss, (k * 7 % 97) / 97 AS rp, (k % 17 - 5) / 100 AS ar, (k % 30) / 10 AS wl,
  CASE k % 4 WHEN 0 THEN 'breakout' WHEN 1 THEN 'reversal' ELSE pattern_type END AS kind, (k % 25) * 10 AS vol, 100 AS av, ['increasing', 'decreasing', 'diverging', 'flat'][k % 4 + 1] AS vt, k % 5 = 0 AS poc, k % 7 = 0 AS vw,
  ['bullish', 'bearish', 'neutral'][k % 3 + 1] AS ht, k % 5 AS zones, (k % 11) / 10 AS ts, (k % 40) / 100 AS vo, ['bullish', 'bearish'][k % 2 + 1] AS td, ['accumulation', 'markdown', 'none'][k % 3 + 1] AS ph, k % 9 = 0 AS brk, k % 10 = 0 AS rev
  FROM patterns JOIN pk ON pattern_id = CAST(k AS VARCHAR))"""


def inputs(t):
    k = F.col("start_idx")

    def pick(i, *names):
        return F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))

    return t.patterns.select(
        "pattern_id", "symbol", "timeframe", "direction", "pattern_name", "start_idx", (k % 97 / 97).alias("historical_success_rate"), (k % 150).alias("sample_size"), (k * 7 % 97 / 97).alias("recent_performance"),
        ((k % 17 - 5) / 100).alias("avg_return"), (k % 30 / 10).alias("win_loss_ratio"), F.when(k % 4 == 0, "breakout").when(k % 4 == 1, "reversal").otherwise(F.col("pattern_type")).alias("pattern_type"),
        (k % 25 * 10).alias("volume"), F.lit(100).alias("avg_volume"), pick(k % 4, "increasing", "decreasing", "diverging", "flat").alias("volume_trend"), (k % 5 == 0).alias("at_poc"), (k % 7 == 0).alias("above_vwap"),
        pick(k % 3, "bullish", "bearish", "neutral").alias("higher_timeframe_trend"), (k % 5).alias("confluence_zones"), (k % 11 / 10).alias("trend_strength"), (k % 40 / 100).alias("volatility"),
        pick(k % 2, "bullish", "bearish").alias("trend_direction"), pick(k % 3, "accumulation", "markdown", "none").alias("market_phase"), (k % 9 == 0).alias("is_breakout"), (k % 10 == 0).alias("is_reversal"))


HIST = """least(1, (CASE WHEN rp > hsr THEN (hsr * sf) * 0.7 + rp * 0.3 ELSE hsr * sf END) * CASE WHEN ar > 0.05 THEN 1.2 WHEN ar > 0.02 THEN 1.1 WHEN ar < -0.02 THEN 0.8 ELSE 1 END
  * CASE WHEN wl > 2.0 THEN 1.15 WHEN wl > 1.5 THEN 1.05 WHEN wl < 1.0 THEN 0.9 ELSE 1 END)"""
VOL = """least(1, CASE WHEN kind LIKE '%breakout%' OR kind LIKE '%reversal%' THEN CASE WHEN r > 2.0 THEN 0.95 WHEN r > 1.5 THEN 0.85 WHEN r > 1.2 THEN 0.75 ELSE 0.4 + r * 0.2 END ELSE CASE WHEN r BETWEEN 0.8 AND 1.5 THEN 0.8 WHEN r > 1.5 THEN 0.7 ELSE 0.5 END END
  * CASE WHEN vt = 'increasing' AND direction = 'bullish' THEN 1.15 WHEN vt = 'decreasing' AND direction = 'bearish' THEN 1.1 WHEN vt = 'diverging' THEN 0.85 ELSE 1 END * CASE WHEN poc THEN 1.1 ELSE 1 END * CASE WHEN vw THEN 1.05 ELSE 1 END)"""
ALIGN = """least(1, coalesce(0.3 + ratio * 0.7, 0.5) * CASE WHEN ht = direction THEN 1.2 WHEN ht = 'neutral' THEN 1 ELSE 0.7 END * CASE WHEN zones >= 3 THEN 1.15 WHEN zones >= 2 THEN 1.08 ELSE 1 END)"""
LABEL = "CASE WHEN ts > 0.7 THEN 'strong_trend' WHEN ts > 0.4 THEN 'weak_trend' WHEN vo > 0.25 THEN 'volatile' WHEN vo < 0.1 THEN 'calm' WHEN brk THEN 'breakout' WHEN rev THEN 'reversal' ELSE 'ranging' END"
MARKET = f"""least(1, CASE {LABEL} WHEN 'strong_trend' THEN 0.7 WHEN 'weak_trend' THEN 0.6 WHEN 'volatile' THEN 0.4 WHEN 'calm' THEN 0.6 WHEN 'breakout' THEN 0.75 WHEN 'reversal' THEN 0.65 ELSE 0.5 END
  * CASE WHEN vo > 0.3 THEN CASE WHEN kind LIKE '%breakout%' THEN 0.85 ELSE 0.9 END WHEN vo < 0.1 THEN CASE WHEN kind LIKE '%breakout%' THEN 1.1 ELSE 1.05 END ELSE 1 END
  * CASE WHEN ts > 0.7 THEN CASE WHEN direction = td THEN 1.15 ELSE 0.85 END ELSE 1 END * CASE WHEN ph = 'accumulation' AND direction = 'bullish' THEN 1.1 WHEN ph = 'markdown' AND direction = 'bearish' THEN 1.1 ELSE 1 END)"""
TF = """tfs AS (SELECT pattern_id, direction, unnest(['1h', '4h', '1d']) AS tf, unnest([['bullish', 'bearish', 'neutral'][k % 3 + 1], ['bullish', 'bearish', 'neutral'][k // 3 % 3 + 1], ['bullish', 'bearish', 'neutral'][k // 9 % 3 + 1]]) AS td FROM ci),
al AS (SELECT pattern_id, sum(CASE WHEN td = direction THEN CASE WHEN tf IN ('1d', '4h') THEN 1.5::DOUBLE ELSE 1 END ELSE 0 END) / count(*) AS ratio FROM tfs GROUP BY 1)"""
PARTS = f"""{INPUT}, {TF}, cf AS (SELECT ci.*, ratio, vol / av AS r, CASE WHEN ss < 10 THEN 0.7 WHEN ss < 30 THEN 0.85 WHEN ss > 100 THEN 1.1 ELSE 1 END AS sf FROM ci JOIN al USING (pattern_id)),
sc AS (SELECT pattern_id, direction, 0.5::DOUBLE AS s1, CAST({HIST} AS DOUBLE) AS s2, CAST({VOL} AS DOUBLE) AS s3, CAST({ALIGN} AS DOUBLE) AS s4, CAST({MARKET} AS DOUBLE) AS s5, {LABEL} AS label FROM cf),
ms AS (SELECT *, (s1 + s2 + s3 + s4 + s5) / 5 AS m FROM sc), sd AS (SELECT *, sqrt((pow(s1 - m, 2) + pow(s2 - m, 2) + pow(s3 - m, 2) + pow(s4 - m, 2) + pow(s5 - m, 2)) / 5) AS sd FROM ms),
ov AS (SELECT *, CASE WHEN m > 0.7 AND sd < 0.15 THEN 0.1 WHEN m > 0.6 AND sd < 0.2 THEN 0.05 WHEN sd > 0.3 THEN -0.05 ELSE 0 END AS bonus FROM sd),
os AS (SELECT *, least(1, (s1 * 0.3 + s2 * 0.25 + s3 * 0.2 + s4 * 0.15 + s5 * 0.1) * (1 + bonus)) AS overall FROM ov)"""


def scored(t, weights=None):
    p = inputs(t)
    k = F.col("start_idx")
    names = F.array(F.lit("bullish"), F.lit("bearish"), F.lit("neutral"))
    signals = p.select("pattern_id", F.stack(F.lit(3), F.lit("1h"), F.get(names, (k % 3).cast("int")), F.lit("4h"), F.get(names, (F.floor(k / 3) % 3).cast("int")),
                                             F.lit("1d"), F.get(names, (F.floor(k / 9) % 3).cast("int"))).alias("tf", "tf_direction"))
    return co.confidence(p.join(co.aligned_share(signals, p), "pattern_id"), weights)


@query("conf01_confidence", f"WITH {PATTERNS}, {PARTS} SELECT pattern_id, round(overall, 9) AS overall_score FROM os")
def _(t):
    return rounded(scored(t), ["pattern_id"], 9, overall_score="overall_score")


@query("conf02_custom_weights", f"""WITH {PATTERNS}, {PARTS} SELECT pattern_id, round(least(1, (s1 + s2 * 2 + s3 + s4 * 0.5 + s5 * 0.5) / 5 * (1 + bonus)), 9) AS overall_score FROM ov""")
def _(t):
    w = dict(zip(co.WEIGHTS, (1.0, 2.0, 1.0, 0.5, 0.5)))
    return rounded(scored(t, w), ["pattern_id"], 9, overall_score="overall_score")


# Returns inside each three-bar pattern against those of its whole series, by a pooled t-test.
SIGNIFICANCE = f"""fo AS (SELECT symbol, 'morning_star' AS pattern_name, idx FROM s WHERE mv2 < 0 AND abs(mv1) < abs(mv2) * 0.3 AND mv > 0 AND close > (o2 + c2) / 2
UNION ALL SELECT symbol, 'evening_star', idx FROM s WHERE mv2 > 0 AND abs(mv1) < abs(mv2) * 0.3 AND mv < 0 AND close < (o2 + c2) / 2
UNION ALL SELECT symbol, 'three_white_soldiers', idx FROM s WHERE mv2 > 0 AND mv1 > 0 AND mv > 0 AND c1 > c2 AND close > c1 AND o1 > o2 AND open > o1
UNION ALL SELECT symbol, 'three_black_crows', idx FROM s WHERE mv2 < 0 AND mv1 < 0 AND mv < 0 AND c1 < c2 AND close < c1 AND o1 < o2 AND open < o1),
re AS (SELECT symbol, idx, close / lag(close) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS r FROM bars),
hi AS (SELECT symbol, count(r) AS n2, avg(r) AS m2, var_samp(r) AS v2 FROM re GROUP BY 1),
pa AS (SELECT fo.symbol, pattern_name, fo.idx, avg(r) AS m1, var_samp(r) AS v1, stddev_pop(r) AS sd1 FROM fo JOIN re ON re.symbol = fo.symbol AND re.idx BETWEEN fo.idx - 1 AND fo.idx GROUP BY ALL),
te AS (SELECT *, (m1 - m2) / sqrt((v1 + v2 * (n2 - 1)) / n2 * (0.5 + 1 / n2)) AS t FROM pa JOIN hi USING (symbol)),
sg AS (SELECT *, {t_two_sided('t', 'n2')} AS p FROM te)"""


@query("conf03_statistical_significance", f"""WITH {HOURLY}, {CANDLE}, {SIGNIFICANCE}
SELECT symbol || ':' || pattern_name || ':' || idx AS pattern_id, round(p, 5) AS p_value, round(CAST(least(1, CASE WHEN p < 0.01 THEN 0.95 WHEN p < 0.05 THEN 0.85 WHEN p < 0.1 THEN 0.75 ELSE 0.5 + (0.1 - p) * 2 END
  * CASE WHEN sd1 > 0 THEN least(1, 0.7 + m1 / sd1 * 0.15) ELSE 1 END * 1.05) AS DOUBLE), 5) AS statistical_significance FROM sg""")
def _(t):
    found = ca.candlestick_patterns(t.hourly, groups=["morning_star", "evening_star", "soldiers"])
    found = found.withColumn("pattern_id", F.concat_ws(":", "symbol", "pattern_name", "end_idx"))
    stats = co.return_stats(found, t.hourly)
    df = co.statistical_significance(stats.withColumn("points", F.lit(3)))
    return rounded(df, ["pattern_id"], 5, p_value="p_value", statistical_significance="statistical_significance")


@query("conf04_historical_success", f"WITH {PATTERNS}, {PARTS} SELECT pattern_id, round(s2, 6) AS historical_success FROM os")
def _(t):
    p = inputs(t)
    return rounded(p.withColumn("historical_success", co.historical_success(p)), ["pattern_id"], historical_success="historical_success")


@query("conf05_volume_confirmation", f"WITH {PATTERNS}, {PARTS} SELECT pattern_id, round(s3, 6) AS volume_confirmation FROM os")
def _(t):
    p = inputs(t)
    return rounded(p.withColumn("volume_confirmation", co.volume_confirmation(p)), ["pattern_id"], volume_confirmation="volume_confirmation")


@query("conf06_timeframe_alignment", f"WITH {PATTERNS}, {PARTS} SELECT pattern_id, round(s4, 6) AS timeframe_alignment FROM os")
def _(t):
    return rounded(scored(t), ["pattern_id"], timeframe_alignment="timeframe_alignment")


@query("conf07_market_condition", f"WITH {PATTERNS}, {PARTS} SELECT pattern_id, label AS condition_label, round(s5, 6) AS market_condition FROM os")
def _(t):
    p = inputs(t)
    return rounded(p.withColumns({"market_condition": co.market_condition(p), "condition_label": co.market_label(p)}), ["pattern_id", "condition_label"], market_condition="market_condition")


@query("conf08_consistency_bonus", f"WITH {PATTERNS}, {PARTS} SELECT CAST(bonus AS DOUBLE) AS bonus, count(*) AS patterns FROM os GROUP BY 1")
def _(t):
    bonus = co.consistency_bonus([F.col(c) for c in co.WEIGHTS])
    return scored(t).groupBy(bonus.alias("bonus")).agg(F.count(F.lit(1)).alias("patterns"))


@query("conf09_level_recommendation", f"""WITH {PATTERNS}, {PARTS} SELECT CASE WHEN overall >= 0.9 THEN 'VERY_HIGH' WHEN overall >= 0.75 THEN 'HIGH' WHEN overall >= 0.6 THEN 'MEDIUM' WHEN overall >= 0.4 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence_level,
  CASE WHEN overall >= 0.8 THEN 'STRONG_SIGNAL' WHEN overall >= 0.65 THEN 'MODERATE_SIGNAL' WHEN overall >= 0.5 THEN 'WEAK_SIGNAL' ELSE 'NO_ACTION' END AS recommendation, count(*) AS patterns FROM os GROUP BY 1, 2""")
def _(t):
    return scored(t).groupBy("confidence_level", "recommendation").agg(F.count(F.lit(1)).alias("patterns"))


EXPLAIN = """ex AS (SELECT pattern_id, overall, unnest(['statistical_significance', 'historical_success', 'volume_confirmation', 'timeframe_alignment', 'market_condition']) AS component, unnest([s1, s2, s3, s4, s5]) AS score, unnest([0.3, 0.25, 0.2, 0.15, 0.1]::DOUBLE[]) AS w FROM os)"""


@query("conf10_explanation", f"""WITH {PATTERNS}, {PARTS}, {EXPLAIN} SELECT pattern_id, component, round(score * w, 9) AS contribution, round(100 * score * w / overall, 7) AS percentage FROM ex""")
def _(t):
    df = co.explain(scored(t))
    return rounded(df, ["pattern_id", "component"], 9, contribution="contribution", percentage=F.round("percentage", 7))


def judged(t):
    done = t.patterns.filter("actual_outcome is not null").select("pattern_id", (F.col("actual_outcome") == "success").alias("success"), F.col("actual_return").alias("ret"), F.col("detected_at").alias("observed_at"))
    return scored(t).join(done, "pattern_id")


@query("conf11_weight_update", f"""WITH {PATTERNS}, {PARTS}, {EXPLAIN}, s AS (SELECT component, any_value(w) AS w, count(*) FILTER (p.actual_outcome = 'success' AND score > 0.6) AS c FROM ex JOIN patterns p USING (pattern_id) WHERE p.actual_outcome IS NOT NULL GROUP BY 1),
m AS (SELECT component, greatest(0.05, least(0.5, w + (c / (SELECT sum(c) FROM s) - w) * 0.1)) AS w FROM s), z AS (SELECT sum(w) AS t FROM m)
SELECT component, round(CASE WHEN abs(t - 1) > 0.01 THEN w / t ELSE w END, 6) AS weight FROM m, z""")
def _(t):
    perf = co.component_success(judged(t))
    return rounded(co.update_weights(co.WEIGHTS, perf), ["component"], weight="weight")


@query("conf12_online_learning")
def _(t):
    df = co.learn(judged(t))
    return rounded(df, ["pattern_name", "outcomes"], **{c: c for c in co.WEIGHTS})


@query("conf13_learning_metrics", f"""WITH {PATTERNS}, {PARTS}, j AS (SELECT p.pattern_name, o.overall AS c, p.actual_return AS r, ((o.overall > 0.6) = (p.actual_outcome = 'success'))::INT AS hit,
  row_number() OVER (PARTITION BY p.pattern_name ORDER BY p.detected_at, p.pattern_id) - 1 AS i, count(*) OVER (PARTITION BY p.pattern_name) AS n FROM os o JOIN patterns p USING (pattern_id) WHERE p.actual_outcome IS NOT NULL)
SELECT pattern_name, any_value(n) AS total_predictions, round(avg(hit), 6) AS accuracy, round(avg(c), 6) AS avg_confidence, round(avg(r), 6) AS avg_return, round(corr(c, r), 6) AS confidence_correlation,
  round(CASE WHEN any_value(n) > 100 THEN avg(hit) FILTER (i >= n - 50) - avg(hit) FILTER (i < 50) END, 6) AS accuracy_change FROM j GROUP BY 1""")
def _(t):
    df = co.learning_metrics(judged(t))
    return rounded(df, ["pattern_name", "total_predictions"], **{c: c for c in ("accuracy", "avg_confidence", "avg_return", "confidence_correlation", "accuracy_change")})
