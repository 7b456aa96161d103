"""Statistics over stored patterns, metric events and message logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schemas import require


def _given(col: str) -> Column:
    """The value, null when zero: absent and zero count alike in the averages."""
    return F.when(F.col(col) != 0, F.col(col))


def _count() -> Column:
    return F.count(F.lit(1))


def _won() -> Column:
    return F.count_if(F.col("actual_outcome") == "success")


def _lost() -> Column:
    return F.count_if(F.col("actual_outcome") == "failure")


def histogram(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Map value -> count per key, counted before it is collected: the map is as long as the number
    of distinct values, not of rows."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("string").alias("_k")).agg(_count().alias("_v"))
    entry = F.struct("_k", "_v")
    entries = F.array_sort(F.collect_list(entry))
    grouped = counts.groupBy(*keys) if keys else counts.groupBy()
    return grouped.agg(F.map_from_entries(entries).alias(out))


def pattern_statistics(patterns: DataFrame) -> DataFrame:
    """Counts, success rate and averages per type, name, timeframe and symbol."""
    require(patterns, "pattern_type", "pattern_name", "timeframe", "symbol", "actual_outcome", "actual_return")
    ok = F.col("actual_outcome") == "success"
    bad = F.col("actual_outcome") == "failure"
    return patterns.groupBy("pattern_type", "pattern_name", "timeframe", "symbol").agg(
        _count().alias("total"), _won().alias("successful"), _lost().alias("failed"), (_won() / _count()).alias("success_rate"),
        F.avg(_given("confidence")).alias("avg_confidence"), F.avg("actual_return").alias("avg_return"), F.avg(_given("duration_seconds")).alias("avg_duration"),
        F.avg(_given("risk_reward")).alias("avg_risk_reward"), F.max("actual_return").alias("best_return"), F.min("actual_return").alias("worst_return"),
        F.when(F.count("actual_return") > 1, F.stddev_pop("actual_return")).alias("std_dev_return"),
        F.max("detected_at").alias("last_occurrence"), F.max(F.when(ok, F.col("detected_at"))).alias("last_success"), F.max(F.when(bad, F.col("detected_at"))).alias("last_failure"))


def finished_since(patterns: DataFrame, as_of: Column, days: int) -> DataFrame:
    return patterns.filter(F.col("status").isin("completed", "failed") & (F.col("detected_at") >= as_of - F.make_dt_interval(F.lit(days))))


def pattern_performance(patterns: DataFrame, as_of: Column, days: int = 30, symbol: str | None = None, pattern_type: str | None = None) -> DataFrame:
    """Outcome statistics of the finished patterns of the last ``days``, one row per symbol."""
    df = finished_since(patterns, as_of, days)
    if symbol:
        df = df.filter(F.col("symbol") == symbol)
    if pattern_type:
        df = df.filter(F.col("pattern_type") == pattern_type)
    zero = F.lit(0.0)
    main = df.groupBy("symbol").agg(
        _count().alias("total_patterns"), _won().alias("successful"), _lost().alias("failed"),
        (_count() - _won() - _lost()).alias("pending"), (_won() / _count()).alias("success_rate"),
        F.coalesce(F.avg("actual_return"), zero).alias("avg_return"), F.coalesce(F.max("actual_return"), zero).alias("best_return"), F.coalesce(F.min("actual_return"), zero).alias("worst_return"),
        F.coalesce(F.avg(_given("confidence")), zero).alias("avg_confidence"), F.coalesce(F.avg(_given("duration_seconds")) / 3600, zero).alias("avg_duration_hours"))
    return main.join(histogram(df, ["symbol"], "pattern_type", "patterns_by_type"), "symbol").join(histogram(df, ["symbol"], "direction", "patterns_by_direction"), "symbol")


def daily_distribution(patterns: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Detections per symbol on each of the last ``days`` days, zero where none."""
    first = F.to_date(as_of - F.make_dt_interval(F.lit(days)))
    df = patterns.filter(F.col("detected_at") >= as_of - F.make_dt_interval(F.lit(days)))
    counts = df.groupBy("symbol", F.to_date("detected_at").alias("day")).agg(_count().alias("patterns"))
    grid = patterns.select("symbol").distinct().withColumn("day", F.explode(F.sequence(first, F.date_add(first, days - 1))))
    return grid.join(counts, ["symbol", "day"], "left").select("symbol", "day", F.coalesce("patterns", F.lit(0)).alias("patterns"))


def trending(patterns: DataFrame, as_of: Column, hours: int = 24, min_occurrences: int = 3, top: int = 20, listed: int = 10) -> DataFrame:
    """The most frequent patterns of the last hours with their symbols and dominant direction.

    Symbols and directions are counted first, so what is collected is one entry per distinct value.
    """
    keys = ["pattern_type", "pattern_name"]
    df = patterns.filter(F.col("detected_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    cells = df.groupBy(*keys, "symbol", "direction").agg(_count().alias("c"), F.sum("confidence").alias("s"))
    symbols = cells.groupBy(*keys).agg(
        F.sum("c").alias("occurrences"), F.count_distinct("symbol").alias("unique_symbols"), (F.sum("s") / F.sum("c")).alias("avg_confidence"))
    # the listed symbols are ranked first, so that at most ten of a pattern are gathered
    each = Window.partitionBy(*keys).orderBy("symbol")
    some = cells.select(*keys, "symbol").distinct().withColumn("_r", F.row_number().over(each)).filter(F.col("_r") <= listed)
    some = some.groupBy(*keys).agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
    symbols = symbols.join(some, keys)
    dirs = cells.groupBy(*keys, "direction").agg(F.sum("c").alias("c"))
    first = F.struct("c", F.col("direction"))
    dominant = dirs.groupBy(*keys).agg(F.max_by("direction", first).alias("dominant_direction"),
                                       F.map_from_entries(F.array_sort(F.collect_list(F.struct("direction", "c")))).alias("direction_distribution"))
    ranked = symbols.filter(F.col("occurrences") >= min_occurrences).join(dominant, keys)
    return ranked.orderBy(F.desc("occurrences"), *keys).limit(top)


def track_success(outcomes: DataFrame) -> DataFrame:
    """Success rate and returns per pattern name."""
    require(outcomes, "pattern_name", "success", "ret", "duration_bars")
    return outcomes.groupBy("pattern_name").agg(
        _count().alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.coalesce(F.col("success"), F.lit(False))).alias("failed"),
        (F.count_if("success") / _count()).alias("success_rate"), F.avg(F.coalesce("ret", F.lit(0.0))).alias("avg_return"),
        F.max("ret").alias("max_return"), F.min("ret").alias("min_return"), F.avg(F.coalesce("duration_bars", F.lit(0))).alias("avg_duration_bars"))


def tracker_summary(stats: DataFrame) -> DataFrame:
    """Totals, overall rate, best and worst pattern (first by name among equals)."""
    return stats.agg(
        F.sum("total").alias("total_patterns"), _count().alias("unique_patterns"), (F.sum("successful") / F.sum("total")).alias("overall_success_rate"),
        F.min(F.struct(-F.col("success_rate"), F.col("pattern_name")))["pattern_name"].alias("best"),
        F.min(F.struct("success_rate", "pattern_name"))["pattern_name"].alias("worst"))


def compare_symbols(signals: DataFrame) -> DataFrame:
    """Bullish, bearish and neutral counts of the latest signals and the consensus by their sum."""
    s = F.col("signal")
    total = F.sum("signal")
    return signals.agg(F.count_if(s > 0).alias("bullish"), F.count_if(s < 0).alias("bearish"), F.count_if(s == 0).alias("neutral"),
                       F.when(total > 0, "bullish").when(total < 0, "bearish").otherwise("neutral").alias("consensus"))


def metric_key(name: str, tags: str) -> Column:
    """name[k=v,...] with sorted tags."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(tags) > 0, F.concat(F.col(name), F.lit("["), F.array_join(pairs, ","), F.lit("]"))).otherwise(F.col(name))


def metrics_summary(events: DataFrame) -> DataFrame:
    """Counters summed, gauges last, timings and histograms as count, min, max, mean."""
    require(events, "kind", "name", "tags", "value", "ts")
    timed = F.col("kind").isin("timing", "histogram")
    g = events.withColumn("metric", metric_key("name", "tags")).groupBy("kind", "metric").agg(
        _count().alias("_n"), F.sum("value").alias("_s"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.avg("value").alias("_m"), F.max_by("value", "ts").alias("_last"))
    return g.select("kind", "metric", F.when(F.col("kind") == "counter", F.col("_s")).when(F.col("kind") == "gauge", F.col("_last")).alias("value"),
                    F.when(timed, F.col("_n")).alias("count"), F.when(timed, F.col("_lo")).alias("min"), F.when(timed, F.col("_hi")).alias("max"), F.when(timed, F.col("_m")).alias("avg"))


def ingestion_dashboard(events: DataFrame) -> DataFrame:
    """One row of request totals, success rate, mean timings and error counters."""
    name, v = F.col("name"), F.col("value")

    def total(n: str) -> Column:
        return F.coalesce(F.sum(F.when(name == n, v)), F.lit(0.0))

    def mean(n: str) -> Column:
        return F.coalesce(F.avg(F.when(name == n, v)), F.lit(0.0))

    requests, done = total("ingestion_requests_total"), total("ingestion_requests_successful")
    return events.agg(
        requests.alias("total_requests"), F.coalesce(F.try_divide(done * 100, requests), F.lit(0.0)).alias("success_rate"),
        mean("ingestion_request_duration_seconds").alias("avg_request_time"), mean("ingestion_transformation_duration_seconds").alias("avg_transformation_time"),
        total("ingestion_validation_errors_total").alias("validation_errors"), total("ingestion_transformation_errors_total").alias("transformation_errors"),
        total("ingestion_requests_failed_total").alias("failed_requests"))


def topic_throughput(log: DataFrame, window: str = "1 minute") -> DataFrame:
    """Messages, bytes, latency, errors and lag per topic and time window."""
    require(log, "topic", "ts", "bytes", "latency_ms", "failed")
    seconds = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    ok = ~F.col("failed")
    g = log.groupBy("topic", F.window("ts", window).alias("w")).agg(
        F.count_if(ok).alias("messages_sent"), F.count_if("failed").alias("messages_failed"), F.sum(F.when(ok, F.col("bytes"))).alias("bytes_sent"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))
    sent, failed = F.col("messages_sent"), F.col("messages_failed")
    return g.select("topic", F.col("w.start").alias("window_start"), "messages_sent", "messages_failed", F.coalesce("bytes_sent", F.lit(0)).alias("bytes_sent"),
                    (sent / seconds).alias("msg_per_sec"), (F.coalesce("bytes_sent", F.lit(0)) / seconds / 1048576).alias("mb_per_sec"), "avg_latency_ms", "max_latency_ms",
                    (100 * failed / F.greatest(F.lit(1), sent + failed)).alias("error_rate_percent"))
