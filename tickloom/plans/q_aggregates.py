"""Resampling, pattern statistics, metric and call-log analytics."""

from pyspark.sql import functions as F

from tickloom.operators import aggregates as ag
from tickloom.operators import bars as ba
from tickloom.operators import logs as lg
from tickloom.operators import volume as vm
from tickloom.plans.catalog import query, rounded
from tickloom.plans.q_volume import OBV, divergence
from tickloom.plans.sql import CALLS, HOURLY, PATTERNS, TICKS
from tickloom.streaming import sinks

def as_of():
    return F.lit("2000-06-01").cast("timestamp")


def now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


NOW_SQL = "TIMESTAMP '2024-01-20 12:00:00'"


def ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("agg01_resample", f"""WITH {HOURLY} SELECT symbol, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume,
  arg_max(open, ts) AS last_open FROM bars GROUP BY 1, 2""")
def _(t):
    a = ba.resample(t.hourly, "1d")
    b = ba.resample(t.hourly, "1d", open_agg="last").select("symbol", "ts", F.col("open").alias("last_open"))
    return a.join(b, ["symbol", "ts"]).select("symbol", ntz("ts"), "open", "high", "low", "close", "volume", "last_open")


@query("agg02_window_last_pivot", f"""WITH {TICKS} SELECT symbol, date_trunc('minute', ts) AS ts, arg_max(price, ts) AS price, arg_max(size, ts) AS size FROM ticks GROUP BY 1, 2""")
def _(t):
    long = t.ticks.select("symbol", "ts", F.stack(F.lit(2), F.lit("price"), F.col("price"), F.lit("size"), F.col("size")).alias("field", "value"))
    return ba.last_per_window(long, "1m", ["price", "size"]).select("symbol", ntz("ts"), "price", "size")


@query("agg03_ticks_to_bars", f"WITH {HOURLY} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def _(t):
    return t.hourly.select("symbol", ntz("ts"), "open", "high", "low", "close", "volume")


@query("agg03_five_minute_bars", f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, arg_min(price, (ts, tick_id)) AS open, arg_max(price, (ts, tick_id)) AS close, sum(size) AS volume FROM ticks GROUP BY 1, 2""")
def _(t):
    return ba.ticks_to_bars(t.ticks, "5m").select("symbol", ntz("ts"), "open", "close", "volume")


@query("agg04_pattern_statistics", f"""WITH {PATTERNS} SELECT pattern_type, pattern_name, timeframe, symbol, count(*) AS total, count(*) FILTER (actual_outcome = 'success') AS successful, count(*) FILTER (actual_outcome = 'failure') AS failed,
  round(count(*) FILTER (actual_outcome = 'success') / count(*), 6) AS success_rate, round(avg(nullif(confidence, 0)), 6) AS avg_confidence, round(avg(actual_return), 6) AS avg_return, round(avg(nullif(duration_seconds, 0)), 4) AS avg_duration,
  round(avg(nullif(risk_reward, 0)), 6) AS avg_risk_reward, round(max(actual_return), 6) AS best_return, round(min(actual_return), 6) AS worst_return, round(CASE WHEN count(actual_return) > 1 THEN stddev_pop(actual_return) END, 6) AS std_dev_return,
  max(detected_at) AS last_occurrence FROM patterns GROUP BY 1, 2, 3, 4""")
def _(t):
    df = ag.pattern_statistics(t.patterns)
    nums = ("success_rate", "avg_confidence", "avg_return", "avg_risk_reward", "best_return", "worst_return", "std_dev_return")
    return df.select("pattern_type", "pattern_name", "timeframe", "symbol", "total", "successful", "failed", ntz("last_occurrence"), F.round("avg_duration", 4).alias("avg_duration"),
                     *[F.round(c, 6).alias(c) for c in nums])


FINISHED = "patterns WHERE status IN ('completed', 'failed') AND detected_at >= TIMESTAMP '2000-06-01' - to_days(365)"


@query("agg05_pattern_performance", f"""WITH {PATTERNS} SELECT symbol, count(*) AS total_patterns, count(*) FILTER (actual_outcome = 'success') AS successful, count(*) FILTER (actual_outcome = 'failure') AS failed,
  round(count(*) FILTER (actual_outcome = 'success') / count(*), 6) AS success_rate, round(avg(actual_return), 6) AS avg_return, round(max(actual_return), 6) AS best_return, round(min(actual_return), 6) AS worst_return,
  count(*) FILTER (pattern_type = 'chart') AS charts, count(*) FILTER (direction = 'bullish') AS bullish FROM {FINISHED} GROUP BY 1""")
def _(t):
    df = ag.pattern_performance(t.patterns, as_of(), 365)
    zero = F.lit(0)
    return df.select("symbol", "total_patterns", "successful", "failed", *[F.round(c, 6).alias(c) for c in ("success_rate", "avg_return", "best_return", "worst_return")],
                     F.coalesce(F.try_element_at("patterns_by_type", F.lit("chart")), zero).alias("charts"), F.coalesce(F.try_element_at("patterns_by_direction", F.lit("bullish")), zero).alias("bullish"))


@query("agg06_daily_distribution", f"""WITH {PATTERNS}, g AS (SELECT s.symbol, CAST(TIMESTAMP '2000-06-01' - to_days(30) AS DATE) + CAST(i AS INTEGER) AS day FROM (SELECT DISTINCT symbol FROM patterns) s CROSS JOIN (SELECT unnest(range(30)) AS i))
SELECT g.symbol, strftime(g.day, '%Y-%m-%d') AS day, count(p.pattern_id) AS patterns FROM g LEFT JOIN patterns p ON p.symbol = g.symbol AND CAST(p.detected_at AS DATE) = g.day GROUP BY 1, 2""")
def _(t):
    return ag.daily_distribution(t.patterns, as_of(), 30).select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "patterns")


@query("agg07_trending", f"""WITH {PATTERNS}, r AS (SELECT * FROM patterns WHERE detected_at >= TIMESTAMP '2000-06-01' - to_hours(168)), d AS (SELECT pattern_type, pattern_name, direction, count(*) AS c FROM r GROUP BY 1, 2, 3),
e AS (SELECT pattern_type, pattern_name, arg_max(direction, (c, direction)) AS dominant_direction, string_agg(direction || ':' || c, ',' ORDER BY direction) AS directions FROM d GROUP BY 1, 2)
SELECT pattern_type, pattern_name, count(*) AS occurrences, count(DISTINCT symbol) AS unique_symbols, round(avg(confidence), 8) AS avg_confidence, any_value(dominant_direction) AS dominant_direction, any_value(directions) AS directions,
  array_to_string(list_sort(list_distinct(list(symbol)))[1:10], ',') AS symbols
FROM r JOIN e USING (pattern_type, pattern_name) GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY occurrences DESC, pattern_type, pattern_name LIMIT 20""")
def _(t):
    df = ag.trending(t.patterns, as_of(), 168)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("direction_distribution")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    df = df.withColumns({"directions": listed, "symbols": F.array_join("symbols", ",")})
    return rounded(df, ["pattern_type", "pattern_name", "occurrences", "unique_symbols", "dominant_direction", "directions", "symbols"], 8, avg_confidence="avg_confidence")


@query("agg08_nonzero_averages", f"""WITH {PATTERNS} SELECT symbol, round(avg(nullif(confidence, 0)), 6) AS avg_confidence, round(avg(nullif(duration_seconds, 0)) / 3600, 6) AS avg_duration_hours FROM {FINISHED} GROUP BY 1""")
def _(t):
    return rounded(ag.pattern_performance(t.patterns, as_of(), 365), ["symbol"], avg_confidence="avg_confidence", avg_duration_hours="avg_duration_hours")


OUTCOMES = "oc AS (SELECT pattern_name, actual_outcome = 'success' AS success, actual_return AS ret, duration_seconds // 3600 AS duration_bars FROM patterns WHERE actual_outcome IS NOT NULL)"


def outcomes(t):
    return t.patterns.filter("actual_outcome is not null").select("pattern_id", "symbol", "pattern_type", "pattern_name", "confidence", (F.col("actual_outcome") == "success").alias("success"),
                                                                 F.col("actual_return").alias("ret"), F.floor(F.col("duration_seconds") / 3600).alias("duration_bars"), F.col("detected_at").alias("observed_at"))


@query("agg09_success_tracker", f"""WITH {PATTERNS}, {OUTCOMES} SELECT pattern_name, count(*) AS total, count(*) FILTER (success) AS successful, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(ret), 6) AS avg_return,
  round(max(ret), 6) AS max_return, round(min(ret), 6) AS min_return, round(avg(duration_bars), 6) AS avg_duration_bars FROM oc GROUP BY 1""")
def _(t):
    return rounded(ag.track_success(outcomes(t)), ["pattern_name", "total", "successful"], **{c: c for c in ("success_rate", "avg_return", "max_return", "min_return", "avg_duration_bars")})


@query("agg10_tracker_summary", f"""WITH {PATTERNS}, {OUTCOMES}, s AS (SELECT pattern_name, count(*) AS n, count(*) FILTER (success) AS w FROM oc GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_patterns, count(*) AS unique_patterns, round(sum(w) / sum(n), 6) AS overall_success_rate, arg_min(pattern_name, (-w / n, pattern_name)) AS best, arg_min(pattern_name, (w / n, pattern_name)) AS worst FROM s""")
def _(t):
    return rounded(ag.tracker_summary(ag.track_success(outcomes(t))), ["total_patterns", "unique_patterns", "best", "worst"], overall_success_rate="overall_success_rate")


@query("agg11_symbol_comparison", f"""WITH {HOURLY}, {OBV}, s AS (SELECT symbol, idx, n, {divergence("obv")} AS s FROM o), l AS (SELECT symbol, arg_max(s, idx) FILTER (s <> 0) AS s FROM s GROUP BY 1)
SELECT count(*) FILTER (s > 0) AS bullish, count(*) FILTER (s < 0) AS bearish, count(*) FILTER (s = 0) AS neutral, CASE WHEN sum(s) > 0 THEN 'bullish' WHEN sum(s) < 0 THEN 'bearish' ELSE 'neutral' END AS consensus FROM l""")
def _(t):
    df = vm.obv(t.hourly).filter("obv_signal <> 0")
    return ag.compare_symbols(df.groupBy("symbol").agg(F.max_by("obv_signal", "idx").alias("signal")))


def metric_events(t):
    k = F.col("size").cast("long")
    kind = F.get(F.array(*[F.lit(x) for x in ("counter", "gauge", "timing", "histogram")]), (k % 4).cast("int"))
    tags = F.when(k % 3 == 0, F.create_map(F.lit("zone"), F.col("symbol"), F.lit("app"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    return t.ticks.select(kind.alias("kind"), F.col("symbol").alias("name"), tags.alias("tags"), F.col("price").alias("value"), "ts")


@query("agg12_metric_summary", f"""WITH {TICKS}, m AS (SELECT ['counter', 'gauge', 'timing', 'histogram'][CAST(size AS BIGINT) % 4 + 1] AS kind, symbol || CASE WHEN CAST(size AS BIGINT) % 3 = 0 THEN '[app=x,zone=' || symbol || ']' ELSE '' END AS metric, price, ts FROM ticks)
SELECT kind, metric, round(CASE kind WHEN 'counter' THEN sum(price) WHEN 'gauge' THEN arg_max(price, ts) END, 4) AS value, CASE WHEN kind IN ('timing', 'histogram') THEN count(*) END AS count,
  round(CASE WHEN kind IN ('timing', 'histogram') THEN avg(price) END, 5) AS avg, CASE WHEN kind IN ('timing', 'histogram') THEN max(price) END AS max FROM m GROUP BY 1, 2""")
def _(t):
    return ag.metrics_summary(metric_events(t)).select("kind", "metric", F.round("value", 4).alias("value"), "count", F.round("avg", 5).alias("avg"), "max")


@query("agg13_ingestion_dashboard", f"""WITH {TICKS} SELECT round(sum(price) FILTER (symbol = 'view'), 3) AS total_requests, round(100 * sum(price) FILTER (symbol = 'click') / sum(price) FILTER (symbol = 'view'), 5) AS success_rate,
  round(avg(price) FILTER (symbol = 'signup'), 5) AS avg_request_time, round(sum(price) FILTER (symbol = 'error'), 3) AS failed_requests FROM ticks""")
def _(t):
    names = {"view": "ingestion_requests_total", "click": "ingestion_requests_successful", "signup": "ingestion_request_duration_seconds", "error": "ingestion_requests_failed_total"}
    events = t.ticks.select(F.coalesce(*[F.when(F.col("symbol") == k, v) for k, v in names.items()]).alias("name"), F.col("price").alias("value"))
    df = ag.ingestion_dashboard(events)
    return df.select(F.round("total_requests", 3).alias("total_requests"), F.round("success_rate", 5).alias("success_rate"), F.round("avg_request_time", 5).alias("avg_request_time"), F.round("failed_requests", 3).alias("failed_requests"))


@query("agg14_topic_throughput", f"""WITH {TICKS}, l AS (SELECT symbol AS topic, date_trunc('hour', ts) AS ws, CAST(size AS BIGINT) * 1000 AS bytes, price AS latency, CAST(size AS BIGINT) % 10 = 0 AS failed FROM ticks)
SELECT topic, ws AS window_start, count(*) FILTER (NOT failed) AS messages_sent, count(*) FILTER (failed) AS messages_failed, round(coalesce(sum(bytes) FILTER (NOT failed), 0) / 3600 / 1048576, 8) AS mb_per_sec,
  round(avg(latency) FILTER (NOT failed), 5) AS avg_latency_ms, round(100.0::DOUBLE * count(*) FILTER (failed) / count(*), 5) AS error_rate_percent FROM l GROUP BY 1, 2""")
def _(t):
    k = F.col("size").cast("long")
    log = t.ticks.select(F.col("symbol").alias("topic"), "ts", (k * 1000).alias("bytes"), F.col("price").alias("latency_ms"), (k % 10 == 0).alias("failed"))
    return ag.topic_throughput(log, "1 hour").select("topic", ntz("window_start"), "messages_sent", "messages_failed", F.round("mb_per_sec", 8).alias("mb_per_sec"),
                                                     F.round("avg_latency_ms", 5).alias("avg_latency_ms"), F.round("error_rate_percent", 5).alias("error_rate_percent"))


RECENT = f"calls WHERE ts > {NOW_SQL} - to_hours(240)"


@query("agg15_usage_statistics", f"""WITH {CALLS} SELECT count(*) AS total_requests, count(*) FILTER (status_code < 400) AS successful_requests, count(*) FILTER (status_code >= 400) AS error_requests, round(avg(response_time_ms), 4) AS avg_response_time,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT ip_address) AS unique_ips, CAST(sum(request_size + response_size) AS BIGINT) AS data_transferred FROM {RECENT}""")
def _(t):
    df = lg.usage_stats(t.calls, now(), 240)
    return df.select("total_requests", "successful_requests", "error_requests", F.round("avg_response_time", 4).alias("avg_response_time"), "unique_users", "unique_ips", "data_transferred")


@query("agg15_top_endpoints", f"WITH {CALLS} SELECT method || ' ' || endpoint AS endpoint, count(*) AS count FROM {RECENT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return lg.top_endpoints(t.calls, now(), 240)


@query("agg15_error_breakdown", f"WITH {CALLS} SELECT status_code, count(*) AS count FROM {RECENT} AND status_code >= 400 GROUP BY 1")
def _(t):
    return lg.error_breakdown(t.calls, now(), 240)


TOP = "array_to_string(list_transform(list_sort(list({{'c': -c, 'v': {v}}}))[1:10], lambda z: z.v || '=' || -z.c), ',')"


def pairs(col: str, name: str):
    return F.array_join(F.transform(col, lambda e: F.concat_ws("=", e[name].cast("string"), e["count"].cast("string"))), ",")


@query("agg16_endpoint_analytics", f"""WITH {CALLS}, u AS (SELECT method, endpoint, user_id, count(*) AS c FROM calls WHERE user_id IS NOT NULL GROUP BY 1, 2, 3), v AS (SELECT method, endpoint, count(*) AS unique_users, {TOP.format(v="user_id")} AS top_users FROM u GROUP BY 1, 2),
h AS (SELECT method, endpoint, string_agg(h || ':' || c, ',' ORDER BY h) AS hours FROM (SELECT method, endpoint, strftime(ts, '%H') AS h, count(*) AS c FROM calls GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT method, endpoint, string_agg(s || ':' || c, ',' ORDER BY s) AS codes FROM (SELECT method, endpoint, CAST(status_code AS VARCHAR) AS s, count(*) AS c FROM calls GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT method, endpoint, count(*) AS total_calls, count(*) FILTER (status_code < 400) AS success_calls, count(*) FILTER (status_code >= 400) AS error_calls, round(avg(response_time_ms), 4) AS avg_response_time,
  round(count(*) FILTER (status_code >= 400) / count(*), 6) AS error_rate, max(ts) AS last_called, any_value(hours) AS hours, any_value(codes) AS codes, any_value(unique_users) AS unique_users, any_value(top_users) AS top_users
FROM calls JOIN v USING (method, endpoint) JOIN h USING (method, endpoint) JOIN s USING (method, endpoint) GROUP BY 1, 2""")
def _(t):
    df = lg.endpoint_stats(t.calls)
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return df.select("method", "endpoint", "total_calls", "success_calls", "error_calls", F.round("avg_response_time", 4).alias("avg_response_time"), F.round("error_rate", 6).alias("error_rate"), ntz("last_called"),
                     flat("hourly_distribution").alias("hours"), flat("status_code_distribution").alias("codes"), "unique_users", pairs("top_users", "user_id").alias("top_users"))


@query("agg16_endpoint_users", f"WITH {CALLS} SELECT method, endpoint, user_id, count(*) AS count FROM calls WHERE user_id IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return lg.endpoint_users(t.calls)


@query("agg16_merged_sketches", f"WITH {CALLS} SELECT method, endpoint, count(*) AS calls, count(*) FILTER (status_code >= 400) AS errors, round(avg(response_time_ms), 4) AS avg_response_time, true AS users_near, true AS ranks_near FROM calls GROUP BY 1, 2")
def _(t):
    """Sketches of each day, merged and held against the exact figures: users within 3 %, ranks of the percentiles within 1.5 %."""
    keys = ["method", "endpoint"]
    merged = lg.merged_sketches(lg.call_sketches(t.calls), keys)
    exact = t.calls.groupBy(*keys).agg(F.count_distinct("user_id").alias("_u"))
    ranks = t.calls.join(merged.select(*keys, "p50", "p95"), keys).groupBy(*keys).agg(*[F.avg((F.col("response_time_ms") <= F.col(p)).cast("double")).alias(f"_{p}") for p in ("p50", "p95")])
    near = (F.abs(F.col("_p50") - 0.5) <= 0.015) & (F.abs(F.col("_p95") - 0.95) <= 0.015)
    return merged.join(exact, keys).join(ranks, keys).select(*keys, "calls", "errors", F.round("avg_response_time", 4).alias("avg_response_time"),
                                                             (F.abs(F.col("unique_users") - F.col("_u")) <= 0.03 * F.col("_u")).alias("users_near"), near.alias("ranks_near"))


@query("agg17_user_analytics", f"""WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM calls WHERE user_id IS NOT NULL),
e AS (SELECT user_id, method || ' ' || endpoint AS e, count(*) AS c FROM r GROUP BY 1, 2), f AS (SELECT user_id, count(*) AS unique_endpoints, {TOP.format(v="e")} AS favorites FROM e GROUP BY 1),
d AS (SELECT user_id, count(*) AS active_days, max(c) AS most_calls_a_day FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, count(*) AS total_requests, min(ts) AS first_request, max(ts) AS last_request, round(avg(response_time_ms), 4) AS avg_response_time, round(count(*) FILTER (status_code >= 400) / count(*), 6) AS error_rate,
  any_value(active_days) AS active_days, any_value(most_calls_a_day) AS most_calls_a_day, any_value(unique_endpoints) AS unique_endpoints, any_value(favorites) AS favorites, max(ts) FILTER (rn = 10) AS tenth_last
FROM r JOIN f USING (user_id) JOIN d USING (user_id) GROUP BY 1""")
def _(t):
    df = lg.user_stats(t.calls)
    return df.select("user_id", "total_requests", ntz("first_request"), ntz("last_request"), F.round("avg_response_time", 4).alias("avg_response_time"), F.round("error_rate", 6).alias("error_rate"),
                     "active_days", "most_calls_a_day", "unique_endpoints", pairs("favorite_endpoints", "endpoint").alias("favorites"), F.get("recent_activity", F.lit(9))["ts"].cast("timestamp_ntz").alias("tenth_last"))


@query("agg17_user_activity", f"""WITH {CALLS} SELECT user_id, 'endpoint' AS section, method || ' ' || endpoint AS value, count(*) AS count FROM calls WHERE user_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT user_id, 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM calls WHERE user_id IS NOT NULL GROUP BY ALL""")
def _(t):
    return lg.user_activity(t.calls)


def violations(t):
    return t.calls.filter("status_code = 404")


@query("agg18_rate_violations", f"""WITH {CALLS}, v AS (SELECT * FROM calls WHERE status_code = 404)
SELECT 'ip' AS section, CAST(ip AS VARCHAR) AS key, count FROM (SELECT ip_address AS ip, count(*) AS count FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*) FROM v GROUP BY 2 UNION ALL SELECT 'endpoint', endpoint, count(*) FROM v GROUP BY 2""")
def _(t):
    return lg.violation_patterns(violations(t))


@query("agg18_violation_totals", f"WITH {CALLS} SELECT count(*) AS total_violations, count(*) FILTER (ts > {NOW_SQL} - to_hours(1)) AS recent_violations FROM calls WHERE status_code = 404")
def _(t):
    return lg.violation_stats(violations(t), now())


@query("agg19_suspicious_ips", f"""WITH {CALLS}, h AS (SELECT ip_address, count(*) OVER (PARTITION BY ip_address ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS c, status_code FROM calls)
SELECT ip_address, count(*) AS requests, max(c) AS max_requests_per_hour, round(count(*) FILTER (status_code >= 400) / count(*), 6) AS error_rate, max(c) > 4 AS suspicious_activity,
  count(*) FILTER (status_code >= 400) / count(*) > 0.5 AND count(*) > 10 AS high_error_rate FROM h GROUP BY 1 HAVING suspicious_activity OR high_error_rate""")
def _(t):
    return rounded(lg.suspicious_ips(t.calls, limit=4), ["ip_address", "requests", "max_requests_per_hour", "suspicious_activity", "high_error_rate"], error_rate="error_rate")


@query("agg20_slow_calls", f"""WITH {CALLS} SELECT event_id, round(response_time_ms, 4) AS response_time_ms, response_time_ms > 5000 AS alert, CASE WHEN response_time_ms > 10000 THEN 'high' WHEN response_time_ms > 5000 THEN 'medium' END AS severity
FROM calls WHERE response_time_ms > 1000""")
def _(t):
    return rounded(lg.slow_calls(t.calls), ["event_id", "alert", "severity"], 4, response_time_ms="response_time_ms")


@query("agg21_latency_percentiles", f"""WITH {CALLS}, s AS (SELECT endpoint, list_sort(list(response_time_ms)) AS l, count(*) AS n FROM calls GROUP BY 1)
SELECT endpoint, n, {", ".join(f"round(l[CAST(floor(n * {q}::DOUBLE) AS BIGINT) + 1], 6) AS p{p}" for q, p in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))} FROM s WHERE n >= 10""")
def _(t):
    return rounded(lg.latency_percentiles(t.calls, ["endpoint"]), ["endpoint", "n"], **{c: c for c in ("p50", "p90", "p95", "p99")})


@query("agg22_slow_queries", f"""WITH {CALLS} SELECT endpoint || ':' || ip_address AS signature, count(*) AS calls, round(avg(response_time_ms), 4) AS mean_ms, round(max(response_time_ms), 4) AS max_ms, round(stddev_samp(response_time_ms), 4) AS sd_ms
FROM calls GROUP BY 1 HAVING avg(response_time_ms) > 2500""")
def _(t):
    log = t.calls.select(F.concat_ws(":", "endpoint", F.col("ip_address").cast("string")).alias("signature"), F.col("response_time_ms").alias("ms"))
    return rounded(lg.slow_queries(log, 2500), ["signature", "calls"], 4, mean_ms="mean_ms", max_ms="max_ms", sd_ms="sd_ms")


@query("agg23_security_score", f"""WITH {CALLS}, u AS (SELECT count(*) FILTER (status_code >= 400) / count(*) AS er, avg(response_time_ms) AS m FROM {RECENT}), v AS (SELECT count(*) FILTER (ts > {NOW_SQL} - to_hours(1)) AS r FROM calls WHERE status_code = 404)
SELECT greatest(0, 100 - CASE WHEN er > 0.1 THEN 20 ELSE 0 END - CASE WHEN m > 1000 THEN 10 ELSE 0 END - CASE WHEN r > 10 THEN 15 ELSE 0 END) AS security_score, round(er, 4) AS error_rate, round(m, 4) AS avg_response_time, r AS recent_violations FROM u, v""")
def _(t):
    df = lg.security_score(lg.usage_stats(t.calls, now(), 240), lg.violation_stats(violations(t), now()))
    return rounded(df, ["security_score", "recent_violations"], 4, error_rate="error_rate", avg_response_time="avg_response_time")


@query("agg24_audit_search", f"WITH {CALLS} SELECT event_id, endpoint AS category FROM calls WHERE endpoint = '/error' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 100")
def _(t):
    log = t.calls.withColumn("category", F.col("endpoint"))
    return lg.search_audit(log, "/error", start="2024-01-05", end="2024-01-25").select("event_id", "category")


@query("agg24_audit_log_read", f"WITH {CALLS} SELECT endpoint AS category, count(*) AS events FROM calls GROUP BY 1")
def _(t):
    path = sinks.folder(t.spark)
    t.calls.withColumn("category", F.col("endpoint")).select("ts", "category", "user_id", "event_id").write.json(path)
    return lg.read_audit(t.spark, path).groupBy("category").agg(F.count(F.lit(1)).alias("events"))


@query("agg25_alert_summary", f"""WITH {CALLS}, s AS (SELECT CASE WHEN response_time_ms > 10000 THEN 'high' ELSE 'medium' END AS s FROM calls WHERE response_time_ms > 5000
  UNION ALL SELECT 'high' FROM calls GROUP BY ip_address HAVING count(*) > 10 AND count(*) FILTER (status_code >= 400) / count(*) > 0.5)
SELECT count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, 0 AS low, count(*) AS total FROM s""")
def _(t):
    return lg.alert_summary(lg.call_alerts(t.calls))


@query("agg25_alerts_by_severity", f"WITH {CALLS} SELECT endpoint AS subject, ts FROM calls WHERE response_time_ms > 10000 ORDER BY ts DESC LIMIT 50")
def _(t):
    return lg.alerts_by(lg.call_alerts(t.calls), "high").select("subject", ntz("ts"))


@query("agg26_usage_export", f"""WITH {CALLS}
SELECT 'usage_statistics' AS section, 'total_requests' AS name, count(*) FILTER (ts > {NOW_SQL} - to_hours(24)) AS value FROM calls
UNION ALL SELECT 'rate_violations', 'total_violations', count(*) FROM calls WHERE status_code = 404
UNION ALL SELECT 'endpoint_stats', method || ' ' || endpoint || ' calls', count(*) FROM calls GROUP BY method, endpoint
UNION ALL SELECT 'endpoint_stats', method || ' ' || endpoint || ' errors', count(*) FILTER (status_code >= 400) FROM calls GROUP BY method, endpoint
UNION ALL SELECT 'alerts', 'slow_response', count(*) FROM calls WHERE response_time_ms > 5000""")
def _(t):
    part = lambda name: F.get_json_object("document", f"$.{name}")
    end = F.concat_ws(" ", part("method"), part("endpoint"))
    entry = lambda name, value: F.struct(name.alias("name"), value.cast("long").alias("value"))
    out = lg.export_usage(t.calls, violations(t), now()).withColumn("e", F.explode(
        F.when(F.col("section") == "usage_statistics", F.array(entry(F.lit("total_requests"), part("total_requests"))))
        .when(F.col("section") == "rate_violations", F.array(entry(F.lit("total_violations"), part("total_violations"))))
        .when(F.col("section") == "endpoint_stats", F.array(entry(F.concat_ws(" ", end, F.lit("calls")), part("calls")), entry(F.concat_ws(" ", end, F.lit("errors")), part("errors"))))
        .otherwise(F.array(entry(F.lit("total"), part("total"))))))
    slow = lg.slow_calls(t.calls).filter("alert").agg(F.count(F.lit(1)).alias("value")).select(F.lit("alerts").alias("section"), F.lit("slow_response").alias("name"), "value")
    return out.filter("section <> 'alerts'").select("section", "e.name", "e.value").unionByName(slow)

