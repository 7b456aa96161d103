"""API call log analytics.

Calls: ts, endpoint, method, status_code, response_time_ms, user_id, ip_address, request_size, response_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.aggregates import histogram
from tickloom.schemas import require


def _n() -> Column:
    return F.count(F.lit(1))


def _errors() -> Column:
    return F.count_if(F.col("status_code") >= 400)


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two one-row tables in one row."""
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").drop("_one")


def since_hours(df: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return df.filter(F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours)))


def top_counts(df: DataFrame, col: Column, k: int) -> DataFrame:
    """The k most frequent values."""
    return df.groupBy(col.alias("value")).agg(_n().alias("count")).orderBy(F.desc("count"), "value").limit(k)


def usage_stats(calls: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """One row of totals, latency, traffic and distinct users and addresses."""
    df = since_hours(calls, as_of, hours)
    t = F.col("response_time_ms")
    return df.agg(
        _n().alias("total_requests"), F.count_if(F.col("status_code") < 400).alias("successful_requests"), _errors().alias("error_requests"),
        F.avg(t).alias("avg_response_time"), F.min(t).alias("min_response_time"), F.max(t).alias("max_response_time"),
        F.count_distinct("user_id").alias("unique_users"), F.count_distinct("ip_address").alias("unique_ips"),
        F.coalesce(F.sum(F.coalesce("request_size", F.lit(0)) + F.coalesce("response_size", F.lit(0))), F.lit(0)).alias("data_transferred"))


def top_endpoints(calls: DataFrame, as_of: Column, hours: int = 1, k: int = 10) -> DataFrame:
    name = F.concat_ws(" ", "method", "endpoint")
    return top_counts(since_hours(calls, as_of, hours), name, k).withColumnRenamed("value", "endpoint")


def error_breakdown(calls: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    return since_hours(calls, as_of, hours).filter("status_code >= 400").groupBy("status_code").agg(_n().alias("count"))


def value_counts(df: DataFrame, keys: list[str], col: Column, name: str = "value") -> DataFrame:
    """How often each value occurs with each key, a row for each: the whole distribution, whatever its size."""
    return df.filter(col.isNotNull()).groupBy(*keys, col.alias(name)).agg(_n().alias("count"))


def leading(counts: DataFrame, keys: list[str], name: str, out: str, k: int) -> DataFrame:
    """Per key the k most frequent values with their counts, and how many values there are. Rows past the rank go before they are listed."""
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), name)
    top = counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", name, "count"))).alias("_l"))
    listed = listed.select(*keys, F.transform("_l", lambda e: F.struct(e[name].alias(name), e["count"].alias("count"))).alias(out))
    return listed.join(counts.groupBy(*keys).agg(_n().alias(f"{out}_total")), keys)


def endpoint_stats(calls: DataFrame, top: int = 10) -> DataFrame:
    """Counts, latency, histograms by hour and status, and the ``top`` users per method and endpoint; endpoint_users has all users."""
    require(calls, "endpoint", "method", "status_code", "response_time_ms", "ts")
    keys = ["method", "endpoint"]
    main = calls.groupBy(*keys).agg(
        _n().alias("total_calls"), F.count_if(F.col("status_code") < 400).alias("success_calls"), _errors().alias("error_calls"),
        F.avg("response_time_ms").alias("avg_response_time"), (_errors() / _n()).alias("error_rate"), F.max("ts").alias("last_called"))
    hours = histogram(calls.withColumn("_h", F.lpad(F.hour("ts").cast("string"), 2, "0")), keys, "_h", "hourly_distribution")
    codes = histogram(calls, keys, "status_code", "status_code_distribution")
    users = leading(endpoint_users(calls), keys, "user_id", "top_users", top).withColumnRenamed("top_users_total", "unique_users")
    return main.join(hours, keys).join(codes, keys).join(users, keys, "left").withColumn("unique_users", F.coalesce("unique_users", F.lit(0)))


def endpoint_users(calls: DataFrame) -> DataFrame:
    """Calls of each user per method and endpoint."""
    return value_counts(calls, ["method", "endpoint"], F.col("user_id"), "user_id")


def user_stats(calls: DataFrame, recent: int = 10, top: int = 10) -> DataFrame:
    """Per user: totals, first and last call, error rate, favourite endpoints, active days, recent calls; user_activity has all counts.

    The recent calls come from a ranked window; Spark drops rows past the rank before the shuffle.
    """
    df = calls.filter("user_id is not null")
    main = df.groupBy("user_id").agg(_n().alias("total_requests"), F.min("ts").alias("first_request"), F.max("ts").alias("last_request"),
                                     F.avg("response_time_ms").alias("avg_response_time"), (_errors() / _n()).alias("error_rate"))
    ends = value_counts(df, ["user_id"], F.concat_ws(" ", "method", "endpoint"), "endpoint")
    days = df.groupBy("user_id", F.to_date("ts").alias("_d")).agg(_n().alias("_c")).groupBy("user_id").agg(_n().alias("active_days"), F.max("_c").alias("most_calls_a_day"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("endpoint"))
    last = df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= recent)
    row = F.struct("_rn", "ts", "endpoint", "method", "status_code", "response_time_ms")
    last = last.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("recent_activity"))
    favourites = leading(ends, ["user_id"], "endpoint", "favorite_endpoints", top).withColumnRenamed("favorite_endpoints_total", "unique_endpoints")
    return main.join(favourites, "user_id").join(days, "user_id").join(last, "user_id")


def user_activity(calls: DataFrame) -> DataFrame:
    """Calls of each user by endpoint and by day, as sections of one table."""
    df = calls.filter("user_id is not null")
    kinds = F.array(F.struct(F.lit("endpoint").alias("section"), F.concat_ws(" ", "method", "endpoint").alias("value")), F.struct(F.lit("day").alias("section"), F.date_format("ts", "yyyy-MM-dd").alias("value")))
    return df.withColumn("_k", F.explode(kinds)).groupBy("user_id", "_k.section", "_k.value").agg(_n().alias("count"))


def call_sketches(calls: DataFrame) -> DataFrame:
    """A row per endpoint and day that later rows can be merged with: counts, and sketches of latencies, users and the busiest users.

    Kept per day, they answer for any span of days without the calls; their size does not depend on the number of calls.
    """
    require(calls, "endpoint", "method", "status_code", "response_time_ms", "ts", "user_id")
    return calls.groupBy("method", "endpoint", F.to_date("ts").alias("day")).agg(
        _n().alias("calls"), _errors().alias("errors"), F.sum("response_time_ms").alias("total_ms"), F.kll_sketch_agg_double("response_time_ms", 800).alias("latencies"),
        F.hll_sketch_agg("user_id", 14).alias("users"), F.expr("approx_top_k_accumulate(user_id)").alias("busiest"))


def merged_sketches(sketches: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """Counts, mean and approximate percentiles of latency, distinct users and busiest users of the days in ``sketches`` per key."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), (F.sum("total_ms") / F.sum("calls")).alias("avg_response_time"),
        F.kll_merge_agg_double("latencies", 800).alias("_l"), F.hll_union_agg("users").alias("_u"), F.expr("approx_top_k_combine(busiest)").alias("_b"))
    marks = {f"p{int(q * 100)}": F.kll_sketch_get_quantile_double("_l", F.lit(q)) for q in (0.5, 0.9, 0.95, 0.99)}
    return merged.withColumns(marks | {"unique_users": F.hll_sketch_estimate("_u"), "top_users": F.expr(f"approx_top_k_estimate(_b, {top})")}).drop("_l", "_u", "_b")


def violation_stats(violations: DataFrame, as_of: Column) -> DataFrame:
    """Totals and the last hour."""
    return violations.agg(_n().alias("total_violations"), F.count_if(F.col("ts") > as_of - F.expr("interval 1 hour")).alias("recent_violations"))


def violation_patterns(violations: DataFrame, k: int = 10) -> DataFrame:
    """Top addresses, and counts by hour and endpoint, as sections of one table."""
    ips = top_counts(violations, F.col("ip_address"), k).select(F.lit("ip").alias("section"), F.col("value").cast("string").alias("key"), "count")
    hours = violations.groupBy(F.hour("ts").cast("string").alias("key")).agg(_n().alias("count")).select(F.lit("hour").alias("section"), "key", "count")
    ends = violations.filter("endpoint is not null").groupBy(F.col("endpoint").alias("key")).agg(_n().alias("count")).select(F.lit("endpoint").alias("section"), "key", "count")
    return ips.unionByName(hours).unionByName(ends)


def suspicious_ips(calls: DataFrame, limit: int = 100) -> DataFrame:
    """Addresses with more than ``limit`` calls in some trailing hour, or failing more often than not.

    Counts per address and minute come first; the trailing hour then runs over at most sixty
    minute rows per hour, however many calls one address makes. Within the minute that starts
    an hour the older seconds must not count, so seconds are the unit of the pre-aggregate.
    """
    require(calls, "ip_address", "ts", "status_code")
    sec = F.unix_seconds("ts")
    per = calls.filter("ip_address is not null").groupBy("ip_address", sec.alias("_sec")).agg(_n().alias("_c"), _errors().alias("_e"))
    # Hours overlap their neighbour by one, so an address spreads over as many tasks as it has hours.
    both = F.explode(F.array(F.floor(F.col("_sec") / 3600), F.floor(F.col("_sec") / 3600) + 1))
    cut = per.withColumn("_hour", both)
    w = Window.partitionBy("ip_address", "_hour").orderBy("_sec").rangeBetween(-3599, 0)
    own = F.col("_hour") == F.floor(F.col("_sec") / 3600)
    busiest = cut.withColumn("_run", F.sum("_c").over(w)).filter(own).groupBy("ip_address").agg(
        F.max("_run").alias("max_requests_per_hour"), F.sum("_c").alias("requests"), F.sum("_e").alias("errors"))
    rate = F.col("errors") / F.col("requests")
    failing = (rate > 0.5) & (F.col("requests") > 10)
    busy = F.col("max_requests_per_hour") > limit
    return busiest.filter(failing | busy).select("ip_address", "requests", "max_requests_per_hour", rate.alias("error_rate"),
                                                 busy.alias("suspicious_activity"), failing.alias("high_error_rate"))


def slow_calls(calls: DataFrame, slow_ms: float = 1000, alert_ms: float = 5000, high_ms: float = 10000) -> DataFrame:
    t = F.col("response_time_ms")
    level = F.when(t > high_ms, "high").when(t > alert_ms, "medium")
    return calls.filter(t > slow_ms).withColumns({"alert": t > alert_ms, "severity": level})


def latency_percentiles(calls: DataFrame, keys: list[str], parts: int = 256) -> DataFrame:
    """Values at positions int(n*q) of the sorted latencies; groups of fewer than ten drop out.

    Exact without sorting a group in one task: distinct values are counted, the counts are accumulated range by range, and the
    running total finds each position. Ranges are cut at quantiles of the distinct values, so each holds about as many, outliers or not.
    """
    t = F.col("response_time_ms")
    counts = calls.groupBy(*keys, t.alias("v")).agg(_n().alias("c")).filter("v is not null")
    size = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.percentile_approx("v", [k / parts for k in range(1, parts)], 10 * parts).alias("_cuts")).filter("n >= 10")
    df = counts.join(size, keys).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("v")))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(*keys, "_b").agg(F.sum("c").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = F.sum("c").over(Window.partitionBy(*keys, "_b").orderBy("v"))
    df = df.withColumn("_in", inside).join(shift, [*keys, "_b"]).withColumn("_cum", F.col("_off") + F.col("_in"))
    marks = {f"p{int(q * 100)}": F.min(F.when(F.col("_cum") > F.floor(F.col("n") * q), F.col("v"))).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)}
    return df.groupBy(*keys).agg(F.max("n").alias("n"), *marks.values())


def slow_queries(log: DataFrame, min_ms: float = 1000, k: int | None = None) -> DataFrame:
    """Query signatures by mean time above the limit."""
    require(log, "signature", "ms")
    g = log.groupBy("signature").agg(_n().alias("calls"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), F.sum("ms").alias("total_ms"), F.stddev_samp("ms").alias("sd_ms"))
    df = g.filter(F.col("mean_ms") > min_ms).orderBy(F.desc("mean_ms"), "signature")
    return df.limit(k) if k else df


def security_score(usage: DataFrame, violations: DataFrame) -> DataFrame:
    """100 less 20 for errors over 10 %, 10 for a mean over a second, 15 for more than ten recent violations."""
    df = beside(usage, violations)
    rate = F.col("error_requests") / F.greatest("total_requests", F.lit(1))
    score = 100 - F.when(rate > 0.1, 20).otherwise(0) - F.when(F.col("avg_response_time") > 1000, 10).otherwise(0) - F.when(F.col("recent_violations") > 10, 15).otherwise(0)
    return df.select(F.greatest(F.lit(0), score).alias("security_score"), rate.alias("error_rate"), "avg_response_time", "recent_violations")


def search_audit(log: DataFrame, category: str | None = None, user_id=None, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
    """Audit events by category, user and time, newest first."""
    if category:
        log = log.filter(F.col("category") == category)
    if user_id is not None:
        log = log.filter(F.col("user_id") == user_id)
    if start:
        log = log.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        log = log.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return log.orderBy(F.desc("ts"), "event_id").limit(limit)


def read_audit(spark, path: str) -> DataFrame:
    """JSON lines; broken lines drop out."""
    schema = "ts timestamp, level string, category string, event_type string, user_id bigint, ip_address string, event_id bigint"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def call_alerts(calls: DataFrame) -> DataFrame:
    """Slow-response and failing-address alerts with a severity."""
    slow = slow_calls(calls).filter("alert").select(F.lit("slow_response").alias("alert_type"), "severity", "ts", F.col("endpoint").alias("subject"))
    ips = suspicious_ips(calls).join(calls.groupBy("ip_address").agg(F.max("ts").alias("ts")), "ip_address")
    kinds = F.array_compact(F.array(F.when(F.col("suspicious_activity"), F.struct(F.lit("suspicious_activity").alias("t"), F.lit("medium").alias("s"))),
                                    F.when(F.col("high_error_rate"), F.struct(F.lit("high_error_rate").alias("t"), F.lit("high").alias("s")))))
    ip = ips.withColumn("k", F.explode(kinds)).select(F.col("k.t").alias("alert_type"), F.col("k.s").alias("severity"), "ts", F.col("ip_address").cast("string").alias("subject"))
    return slow.unionByName(ip)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts by severity, all three listed in one row."""
    s = F.col("severity")
    return alerts.agg(F.count_if(s == "high").alias("high"), F.count_if(s == "medium").alias("medium"), F.count_if(s == "low").alias("low"), _n().alias("total"))


def alerts_by(alerts: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    df = alerts.filter(F.col("severity") == severity) if severity else alerts
    return df.orderBy(F.desc("ts"), "alert_type", "subject").limit(limit)


def export_usage(calls: DataFrame, violations: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Usage, alert counts, violations and each endpoint as lines of JSON with their section; nothing is gathered into one row."""
    def lines(section: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.to_json(F.struct("*")).alias("document"))

    ends = calls.groupBy("method", "endpoint").agg(_n().alias("calls"), _errors().alias("errors"))
    return lines("usage_statistics", usage_stats(calls, as_of, hours)).unionByName(lines("endpoint_stats", ends)).unionByName(
        lines("alerts", alert_summary(call_alerts(calls)))).unionByName(lines("rate_violations", violation_stats(violations, as_of)))
