"""Back-test folds and validation metrics."""

from pyspark.sql import functions as F

from tickloom.operators import joins as jo
from tickloom.operators import validation as va
from tickloom.plans.catalog import query, rounded
from tickloom.plans.q_aggregates import outcomes as stored
from tickloom.plans.q_joins import ENTRIES, entries, predictions
from tickloom.plans.sql import HOURLY, PATTERNS, t_two_sided


def results(t):
    return jo.outcomes(entries(t), t.hourly)


METRICS = """SELECT {key}, count(*) AS total_patterns, count(*) FILTER (said AND success) AS tp, count(*) FILTER (said AND NOT success) AS fp, count(*) FILTER (NOT said AND NOT success) AS tn, count(*) FILTER (NOT said AND success) AS fn,
  coalesce(sqrt(252.0::DOUBLE) * (avg(ret) FILTER (said) - 0.02::DOUBLE / 252) / nullif(stddev_pop(ret) FILTER (said), 0), 0) AS sharpe_ratio,
  CASE WHEN sum(-ret) FILTER (said AND ret < 0) > 0 THEN coalesce(sum(ret) FILTER (said AND ret > 0), 0) / sum(-ret) FILTER (said AND ret < 0) WHEN count(*) FILTER (said AND ret > 0) > 0 THEN NULL ELSE 0 END AS profit_factor,
  coalesce(count(*) FILTER (said AND ret > 0) / nullif(count(*) FILTER (said), 0), 0) AS win_rate, coalesce(avg(ret) FILTER (said), 0) AS avg_return FROM {src} GROUP BY ALL"""
SAID = "sd AS (SELECT *, confidence > 0.6 AS said FROM oc)"


def rates(src: str = "m") -> str:
    return f"""rt AS (SELECT *, (tp + tn) / total_patterns AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce((tp * tn - fp * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM {src}),
rf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM rt)"""


@query("val01_out_of_sample", f"""WITH {HOURLY}, {ENTRIES}, {SAID}, m AS ({METRICS.format(key="symbol", src="sd")}), {rates()}
SELECT symbol, total_patterns, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(win_rate, 6) AS win_rate, round(avg_return, 5) AS avg_return FROM rf""")
def _(t):
    df = va.validate(results(t), ["symbol"])
    return rounded(df, ["symbol", "total_patterns", "tp", "fp", "tn", "fn"], accuracy="accuracy", precision="precision", recall="recall", f1_score="f1_score", win_rate="win_rate", avg_return=F.round("avg_return", 5))


def folded(test: str) -> str:
    return f"""WITH {HOURLY}, {ENTRIES}, {SAID}, {test}, fo AS (SELECT sd.*, f.fold FROM sd JOIN f ON sd.symbol = f.symbol AND sd.idx >= f.a AND sd.idx < f.b), m AS ({METRICS.format(key="symbol, fold", src="fo")}), {rates()}
SELECT symbol, fold, total_patterns, tp, fp, tn, fn, round(f1_score, 6) AS f1_score, round(avg_return, 5) AS avg_return FROM rf"""


def fold_rows(t, folds):
    df = va.validate(va.in_folds(results(t), folds), ["symbol", "fold"])
    return rounded(df, ["symbol", "fold", "total_patterns", "tp", "fp", "tn", "fn"], f1_score="f1_score", avg_return=F.round("avg_return", 5))


LEN = "SELECT symbol, count(*) AS n FROM bars GROUP BY 1"


@query("val02_rolling_window", folded(f"f AS (SELECT symbol, fold, fold * 20 + 100 AS a, fold * 20 + 120 AS b FROM ({LEN}), range(0, 10000) r(fold) WHERE fold * 20 < n - 120)"))
def _(t):
    return fold_rows(t, va.rolling_folds(t.hourly))


@query("val03_walk_forward", folded(f"f AS (SELECT symbol, fold, fold * 40 + 300 AS a, fold * 40 + 380 AS b FROM ({LEN}), range(0, 10000) r(fold) WHERE fold * 40 + 380 <= n)"))
def _(t):
    return fold_rows(t, va.walk_forward_folds(t.hourly, 300, 80, 40))


@query("val03_walk_forward_ranges", f"""WITH {HOURLY}, l AS ({LEN}) SELECT symbol, fold, greatest(0, CAST(ceil((200 + fold * 30 - 400) / 30.0::DOUBLE) AS BIGINT)) * 30 AS train_start, 200 + fold * 30 AS train_end, 260 + fold * 30 AS test_end FROM l, range(0, 10000) r(fold) WHERE 260 + fold * 30 <= n""")
def _(t):
    return va.walk_forward_folds(t.hourly, 200, 60, 30).select("symbol", "fold", "train_start", "train_end", "test_end")


@query("val04_time_series_split", folded(f"f AS (SELECT symbol, fold, n - (5 - fold) * (n // 6) AS a, n - (4 - fold) * (n // 6) AS b FROM ({LEN}), range(0, 5) r(fold))"))
def _(t):
    return fold_rows(t, va.ts_split(t.hourly))


@query("val05_outcomes", f"WITH {HOURLY}, {ENTRIES} SELECT symbol, direction, count(*) AS patterns, count(*) FILTER (success) AS successes, round(avg(ret), 5) AS mean_return FROM oc GROUP BY 1, 2")
def _(t):
    return results(t).groupBy("symbol", "direction").agg(F.count(F.lit(1)).alias("patterns"), F.count_if("success").alias("successes"), F.round(F.avg("ret"), 5).alias("mean_return"))


@query("val06_confusion_matrix", f"""WITH {HOURLY}, {ENTRIES}, {SAID}, m AS ({METRICS.format(key="symbol", src="sd")}), {rates()} SELECT symbol, tn, fp, fn, tp, round(mcc, 6) AS mcc FROM rf""")
def _(t):
    return rounded(va.validate(results(t), ["symbol"]), ["symbol", "tn", "fp", "fn", "tp"], mcc="mcc")


@query("val07_sharpe", f"WITH {HOURLY}, {ENTRIES} SELECT symbol, round(coalesce(sqrt(252.0::DOUBLE) * (avg(ret) - 0.02::DOUBLE / 252) / nullif(stddev_pop(ret), 0), 0), 5) AS sharpe_ratio FROM oc GROUP BY 1")
def _(t):
    return results(t).groupBy("symbol").agg(F.round(va.sharpe(F.col("ret")), 5).alias("sharpe_ratio"))


@query("val08_max_drawdown", f"""WITH {PATTERNS}, c AS (SELECT symbol, sum(ln(1 + actual_return)) OVER o AS l FROM patterns WHERE actual_return IS NOT NULL WINDOW o AS (PARTITION BY symbol ORDER BY detected_at, pattern_id ROWS UNBOUNDED PRECEDING) ),
r AS (SELECT *, row_number() OVER () AS rn FROM c), q AS (SELECT symbol, detected_at, pattern_id, sum(ln(1 + actual_return)) OVER (PARTITION BY symbol ORDER BY detected_at, pattern_id ROWS UNBOUNDED PRECEDING) AS l FROM patterns WHERE actual_return IS NOT NULL),
p AS (SELECT symbol, exp(l - max(l) OVER (PARTITION BY symbol ORDER BY detected_at, pattern_id ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM q) SELECT symbol, round(min(dd), 6) AS max_drawdown FROM p GROUP BY 1""")
def _(t):
    return rounded(va.max_drawdown(stored(t), ["symbol"], ["observed_at", "pattern_id"]), ["symbol"], max_drawdown="max_drawdown")


@query("val09_profit_factor", f"WITH {HOURLY}, {ENTRIES} SELECT symbol, round(sum(ret) FILTER (ret > 0) / sum(-ret) FILTER (ret < 0), 5) AS profit_factor FROM oc GROUP BY 1")
def _(t):
    return results(t).groupBy("symbol").agg(F.round(va.profit_factor(F.col("ret")), 5).alias("profit_factor"))


@query("val10_degradation", f"""WITH {PATTERNS}, o AS (SELECT pattern_type, pattern_name, actual_outcome = 'success' AS s, actual_return AS r, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY pattern_type, pattern_name) AS n FROM patterns
  WHERE actual_outcome IS NOT NULL WINDOW w AS (PARTITION BY pattern_type, pattern_name ORDER BY detected_at, pattern_id)),
g AS (SELECT pattern_type, pattern_name, avg(s::INT) FILTER (i >= n - 10) AS cur, avg(s::INT) FILTER (i < n - 10) AS old, count(*) FILTER (i >= n - 10 AND NOT s) AS recent_failures, avg(r) FILTER (i >= n - 10) AS m1, var_samp(r) FILTER (i >= n - 10) AS v1,
  avg(r) FILTER (i < n - 10) AS m2, var_samp(r) FILTER (i < n - 10) AS v2, any_value(n) AS n FROM o GROUP BY 1, 2),
h AS (SELECT *, coalesce((cur - old) / nullif(old, 0), 0) AS rate, (m1 - m2) / sqrt((v1 * 9 + v2 * (n - 11)) / (n - 2) * (0.1 + 1 / (n - 10))) AS t FROM g),
i AS (SELECT *, {t_two_sided('t', '(n - 2)')} AS p FROM h),
j AS (SELECT *, CASE WHEN rate < -0.2 AND p < 0.05 THEN 'degrading' WHEN rate > 0.2 AND p < 0.05 THEN 'improving' WHEN abs(rate) > 0.3 THEN 'unstable' ELSE 'stable' END AS status FROM i)
SELECT pattern_type, pattern_name, recent_failures, round(cur, 6) AS current_performance, round(old, 6) AS historical_avg, round(rate, 6) AS degradation_rate, round(t, 5) AS t_statistic, round(p, 6) AS p_value, status,
  round(m1 - 2.2621571628 * sqrt(v1 / 10), 6) AS ci_lower, round(m1 + 2.2621571628 * sqrt(v1 / 10), 6) AS ci_upper,
  CASE status WHEN 'degrading' THEN 'success rate fell by ' || round(-rate * 100, 1) || ' %: trade smaller or not at all' WHEN 'improving' THEN 'success rate rose by ' || round(rate * 100, 1) || ' %: its confidence may weigh more'
    WHEN 'unstable' THEN 'success rate moved by ' || round(abs(rate) * 100, 1) || ' % without significance: be careful' ELSE 'no change that matters' END AS recommendation FROM j""")
def _(t):
    df = va.degradation(stored(t))
    return rounded(df, ["pattern_type", "pattern_name", "recent_failures", "status", "recommendation"], t_statistic=F.round("t_statistic", 5),
                   **{c: c for c in ("current_performance", "historical_avg", "degradation_rate", "p_value", "ci_lower", "ci_upper")})


VARIANTS = f"""g AS (SELECT avg(actual_return) FILTER (pattern_type = 'chart') AS a, avg(actual_return) FILTER (pattern_type = 'volume') AS b, count(*) FILTER (pattern_type = 'chart') AS na, count(*) FILTER (pattern_type = 'volume') AS nb,
  var_samp(actual_return) FILTER (pattern_type = 'chart') AS va, var_samp(actual_return) FILTER (pattern_type = 'volume') AS vb FROM patterns WHERE actual_return IS NOT NULL),
h AS (SELECT *, (a - b) / sqrt((va * (na - 1) + vb * (nb - 1)) / (na + nb - 2) * (1 / na + 1 / nb)) AS t, na + nb - 2 AS df, (b - a) / abs(a) AS gain FROM g),
i AS (SELECT *, {t_two_sided('t', 'df')} AS p FROM h)"""


@query("val11_ab_test", f"""WITH {PATTERNS}, {VARIANTS}
SELECT round(a, 6) AS a_performance, round(b, 6) AS b_performance, round(gain, 6) AS improvement, na AS sample_size_a, nb AS sample_size_b, round(p, 6) AS p_value, p < 0.05 AS is_significant,
  CASE WHEN p < 0.05 AND gain > 0.1 THEN 'adopt B: better by ' || round(gain * 100, 1) || ' %' WHEN p < 0.05 AND gain < -0.1 THEN 'keep A: B is worse by ' || round(-gain * 100, 1) || ' %' ELSE 'undecided: test on' END AS recommendation FROM i""")
def _(t):
    s = stored(t)
    df = va.ab_test(s.filter("pattern_type = 'chart'"), s.filter("pattern_type = 'volume'"))
    return rounded(df, ["sample_size_a", "sample_size_b", "is_significant", "recommendation"], a_performance="a_performance", b_performance="b_performance", improvement="improvement", p_value="p_value")


@query("val12_fp_fn_analysis", f"""WITH {PATTERNS}, v AS (SELECT confidence, confidence > 0.6 AND actual_outcome <> 'success' AS fp, confidence <= 0.6 AND actual_outcome = 'success' AS fn FROM patterns WHERE actual_outcome IS NOT NULL),
w AS (SELECT count(*) AS n, count(*) FILTER (fp) AS a, count(*) FILTER (fn) AS b, avg(confidence) FILTER (fp) AS ca, avg(confidence) FILTER (fn) AS cb FROM v)
SELECT a AS false_positives, b AS false_negatives, round(a / n, 6) AS false_positive_rate, round(b / n, 6) AS false_negative_rate, round(ca, 6) AS avg_fp_confidence, round(cb, 6) AS avg_fn_confidence,
  array_to_string(list_filter([CASE WHEN a > b * 2 THEN 'raise the threshold: ' || a || ' false positives to ' || b || ' false negatives' END, CASE WHEN b > a * 2 THEN 'lower the threshold: ' || b || ' false negatives to ' || a || ' false positives' END,
    CASE WHEN a > 0 AND ca > 0.7 THEN 'rules too loose: false positives have a mean confidence of ' || round(ca, 2) END], lambda x: x IS NOT NULL), '; ') AS advice FROM w""")
def _(t):
    df = va.fp_fn(*predictions(t)).withColumn("advice", F.array_join("recommendations", "; "))
    return rounded(df, ["false_positives", "false_negatives", "advice"], false_positive_rate="false_positive_rate", false_negative_rate="false_negative_rate", avg_fp_confidence="avg_fp_confidence", avg_fn_confidence="avg_fn_confidence")


@query("val12_common_mistakes", f"""WITH {PATTERNS}, v AS (SELECT CASE WHEN confidence > 0.6 AND actual_outcome <> 'success' THEN 'false_positive' WHEN confidence <= 0.6 AND actual_outcome = 'success' THEN 'false_negative' END AS verdict, pattern_name FROM patterns WHERE actual_outcome IS NOT NULL),
c AS (SELECT verdict, pattern_name, count(*) AS count, row_number() OVER (PARTITION BY verdict ORDER BY count(*) DESC, pattern_name) AS rank FROM v WHERE verdict IS NOT NULL GROUP BY 1, 2) SELECT * FROM c WHERE rank <= 5""")
def _(t):
    return va.common_mistakes(*predictions(t))


@query("val13_performance_report", f"""WITH {HOURLY}, {ENTRIES}, {SAID}, f AS (SELECT symbol, fold, fold * 20 + 100 AS a, fold * 20 + 120 AS b FROM ({LEN}), range(0, 10000) r(fold) WHERE fold * 20 < n - 120),
fo AS (SELECT sd.*, f.fold FROM sd JOIN f ON sd.symbol = f.symbol AND sd.idx >= f.a AND sd.idx < f.b), m AS ({METRICS.format(key="symbol, fold", src="fo")}), {rates()}
SELECT count(*) AS total_validations, round(avg(accuracy), 6) AS avg_accuracy, round(avg(f1_score), 6) AS avg_f1_score, round(avg(win_rate), 6) AS avg_win_rate, arg_min(symbol || ':' || fold, (-f1_score, symbol, fold)) AS best, arg_min(symbol || ':' || fold, (f1_score, symbol, fold)) AS worst,
  CASE WHEN stddev_pop(f1_score) / avg(f1_score) < 0.1 THEN 0.9 WHEN stddev_pop(f1_score) / avg(f1_score) < 0.2 THEN 0.7 WHEN stddev_pop(f1_score) / avg(f1_score) < 0.3 THEN 0.5 ELSE 0.3 END::DOUBLE AS stability_score FROM rf""")
def _(t):
    folds = va.validate(va.in_folds(results(t), va.rolling_folds(t.hourly)), ["symbol", "fold"])
    df = va.performance_report(folds, ["symbol", "fold"])
    named = df.withColumns({"best": F.concat_ws(":", "best_symbol", F.col("best_fold").cast("string")), "worst": F.concat_ws(":", "worst_symbol", F.col("worst_fold").cast("string"))})
    return rounded(named, ["total_validations", "best", "worst", "stability_score"], avg_accuracy="avg_accuracy", avg_f1_score="avg_f1_score", avg_win_rate="avg_win_rate")
