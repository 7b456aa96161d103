"""Streaming operators, run to the end of the stored tables."""

from pyspark.sql import functions as F

from tickloom.operators.candles import candlestick_patterns
from tickloom.plans import scan
from tickloom.plans.catalog import query, rounded
from tickloom.plans.q_indicators import MOVES, RANGE
from tickloom.plans.q_patterns import CANDLE
from tickloom.plans.q_quality import DEDUPED, landed
from tickloom.plans.q_store import SUBS, subscriptions
from tickloom.plans.sql import HOURLY, PATTERNS, TICKS, smooth
from tickloom.sources import raw
from tickloom.sources.adapters import patterns_from_orders, ticks_from_events
from tickloom.streaming import live, sinks

def as_of():
    return F.lit("2024-02-01").cast("timestamp")


def live_ticks(t):
    return ticks_from_events(live.table_stream(t.spark, t.path, "events"))


def bar_stream(t):
    return sinks.sliced(t.hourly, "ts")


@query("str01_ingest", f"WITH {TICKS} SELECT upper(symbol) AS symbol, count(*) AS quotes, round(sum(price), 2) AS total FROM ticks WHERE CAST(size AS BIGINT) NOT IN (60, 61) GROUP BY 1")
def _(t):
    out = sinks.drained(live.ingest_stream(raw.quote_records(live_ticks(t)), as_of()))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("quotes"), F.round(F.sum("last_price"), 2).alias("total"))


@query("str02_pattern_scan", f"""WITH {HOURLY}, {CANDLE} SELECT symbol, 'bullish_engulfing' AS pattern_name, count(*) AS hits FROM s WHERE mv1 < 0 AND mv > 0 AND open < c1 AND close > o1 GROUP BY 1
UNION ALL SELECT symbol, 'bearish_engulfing', count(*) FROM s WHERE mv1 > 0 AND mv < 0 AND open > c1 AND close < o1 GROUP BY 1""")
def _(t):
    root, marks = sinks.folder(t.spark), sinks.folder(t.spark)
    live.scan_stream(bar_stream(t), root, marks, lambda b: candlestick_patterns(b, groups=["engulfing"]), every=None).awaitTermination()
    return scan.read(t.spark, root, "patterns").groupBy("symbol", "pattern_name").agg(F.count(F.lit(1)).alias("hits"))


SLICES = "sl AS (SELECT *, least(floor((epoch(ts) - 1704067200) / (8 * 86400)), 3)::BIGINT AS slice FROM ticks)"


@query("str03_micro_batches", f"""WITH {TICKS}, {SLICES}, z AS (SELECT slice, count(*) AS n FROM sl GROUP BY 1), k AS (SELECT slice, n, unnest(range(0, (n + 999) // 1000)) AS chunk FROM z)
SELECT slice AS batch_id, chunk, least(1000, n - chunk * 1000)::BIGINT AS records FROM k""")
def _(t):
    path, marks = sinks.folder(t.spark), sinks.folder(t.spark)
    live.buffered(sinks.sliced(t.ticks, "ts"), path, marks, every=None).awaitTermination()
    return t.spark.read.parquet(path).groupBy(F.col("batch_id").cast("long").alias("batch_id"), "chunk").agg(F.count(F.lit(1)).alias("records"))


@query("str04_deduplicate", DEDUPED)
def _(t):
    return sinks.drained(live.dedupe_stream(sinks.sliced(landed(t), "arrived_at"))).select("symbol", "data_type", "tick_id")


@query("str05_tick_bars", f"""WITH {HOURLY} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(t):
    out = sinks.drained(live.bars_stream(live_ticks(t), "1 hour", "10 minutes", "1h"))
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


@query("str06_live_ema", f"""WITH {HOURLY}, {smooth("e", "bars", "close", "(2.0::DOUBLE / 21)")}, {RANGE}, {smooth("a", "tr", "tr", "(1.0::DOUBLE / 14)")},
{MOVES}, mv AS (SELECT symbol, idx, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM moves), {smooth("u", "mv", "up", "(1.0::DOUBLE / 14)")}, {smooth("l", "mv", "down", "(1.0::DOUBLE / 14)")},
{smooth("f", "bars", "close", "(2.0::DOUBLE / 13)")}, {smooth("s", "bars", "close", "(2.0::DOUBLE / 27)")}, m AS (SELECT symbol, idx, f.y - s.y AS y FROM f JOIN s USING (symbol, idx)), {smooth("g", "m", "y", "(2.0::DOUBLE / 10)", 25)}
SELECT e.symbol, b.ts, CASE WHEN b.idx >= 19 THEN round(e.y, 6) END AS ema, CASE WHEN b.idx >= 14 THEN round(a.y, 6) END AS atr, CASE WHEN b.idx >= 14 AND u.y + l.y > 0 THEN round(100 * u.y / (u.y + l.y), 6) END AS rsi,
  CASE WHEN b.idx >= 25 THEN round(m.y, 6) END AS macd, CASE WHEN b.idx >= 25 THEN round(g.y, 6) END AS signal
FROM e JOIN bars b USING (symbol, idx) JOIN a USING (symbol, idx) JOIN u USING (symbol, idx) JOIN l USING (symbol, idx) JOIN m USING (symbol, idx) LEFT JOIN g USING (symbol, idx)
WHERE b.ts < (SELECT max(ts) FROM bars) - INTERVAL 2 HOUR""")
def _(t):
    out = sinks.drained(live.ema_stream(bar_stream(t)))
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(c, 6).alias(c) for c in ("ema", "atr", "rsi", "macd", "signal")])


@query("str07_consumer_lag", f"WITH {TICKS} SELECT symbol AS topic, count(*) AS messages, round(max(epoch_ms(TIMESTAMP '2024-02-01') - epoch_us(ts) // 1000) / 1000, 3) AS max_lag_seconds FROM ticks GROUP BY 1")
def _(t):
    df = live.message_lag(t.ticks.withColumn("topic", F.col("symbol")), as_of())
    return rounded(df, ["topic", "messages"], 3, max_lag_seconds="max_lag_seconds")


@query("str07_offset_lag", f"""WITH {TICKS}, {SLICES}, c AS (SELECT slice, symbol, count(*) AS messages FROM sl GROUP BY 1, 2)
SELECT slice AS batch_id, symbol AS topic, messages, sum(messages) OVER (PARTITION BY symbol)::BIGINT AS high_water_mark, sum(messages) OVER (PARTITION BY symbol ORDER BY slice)::BIGINT AS position,
  (sum(messages) OVER (PARTITION BY symbol) - sum(messages) OVER (PARTITION BY symbol ORDER BY slice))::BIGINT AS lag FROM c""")
def _(t):
    path, marks = sinks.folder(t.spark), sinks.folder(t.spark)
    live.buffered(sinks.sliced(t.ticks, "ts"), path, marks, every=None).awaitTermination()
    count = F.count(F.lit(1)).alias("messages")
    read = t.spark.read.parquet(path).groupBy(F.col("batch_id").cast("long").alias("batch_id"), F.col("symbol").alias("topic")).agg(count)
    return live.offset_lag(read, t.ticks.groupBy(F.col("symbol").alias("topic")).agg(count))


@query("str08_symbol_partitions", f"WITH {TICKS} SELECT symbol, 1 AS partitions, count(*) AS rows FROM ticks GROUP BY 1")
def _(t):
    spread = live.by_symbol(t.ticks).withColumn("_p", F.spark_partition_id())
    return spread.groupBy("symbol", "_p").agg(F.count(F.lit(1)).alias("_n")).groupBy("symbol").agg(F.count(F.lit(1)).alias("partitions"), F.sum("_n").alias("rows"))


@query("str09_alerts", f"""WITH {PATTERNS}, {SUBS}, m AS (SELECT sub, confidence FROM sb JOIN patterns p ON (len(syms) = 0 OR list_contains(syms, p.symbol)) AND (len(types) = 0 OR list_contains(types, p.pattern_type)) AND confidence >= mc)
SELECT channel, count(*) AS alerts FROM (SELECT 'database' AS channel FROM m UNION ALL SELECT 'websocket' FROM m WHERE confidence >= 0.8 UNION ALL SELECT 'email' FROM m WHERE confidence >= 0.9) GROUP BY 1""")
def _(t):
    patterns = patterns_from_orders(live.table_stream(t.spark, t.path, "orders"))
    out = sinks.drained(live.alert_stream(patterns, live.alert_classes(subscriptions(t))).select("subscriber", "members", "pattern_id", "channel", "priority"))
    return out.groupBy("channel").agg(F.sum("members").alias("alerts"))
