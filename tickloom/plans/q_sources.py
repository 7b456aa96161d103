"""Sources and sinks."""

from pyspark.sql import functions as F

from tickloom.plans.catalog import query, rounded
from tickloom.plans.sql import DAILY, HOURLY, TICKS
from tickloom.sources import messages as ms
from tickloom.sources import raw, storage
from tickloom.sources import vendor as vd
from tickloom.streaming import sinks


@query("src01_time_series_decode", f"""
WITH {DAILY} SELECT symbol, count(*) AS points, min(strftime(ts, '%Y-%m-%d')) AS first_day, CAST(sum(CAST(volume AS BIGINT)) AS BIGINT) AS volume,
  round(avg(close), 2) AS mean_close FROM bars WHERE month(ts) <> 1 GROUP BY 1""")
def _(t):
    rows, _ = vd.decode_time_series(raw.time_series_payloads(t.daily))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("points"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
                                      F.sum("volume").alias("volume"), F.round(F.avg(F.col("close_price").cast("double")), 2).alias("mean_close"))


@query("src01_time_series_errors", f"""
WITH {DAILY} SELECT symbol, 'API Note (likely rate limit): call frequency' AS error, count(DISTINCT year(ts)) AS responses FROM bars WHERE month(ts) = 1 GROUP BY 1""")
def _(t):
    _, bad = vd.decode_time_series(raw.time_series_payloads(t.daily))
    return bad.groupBy("symbol", "error").agg(F.count(F.lit(1)).alias("responses"))


@query("src02_quote_decode", f"""
WITH {TICKS} SELECT symbol, tick_id, price AS bid_price, round(price + 0.01, 2) AS ask_price, CAST(size AS BIGINT) AS last_size, size / 10 AS change_percent FROM ticks WHERE size <> 7""")
def _(t):
    rows, _ = vd.decode_quote(raw.quote_payloads(t.ticks))
    return rows.select("symbol", "tick_id", F.col("bid_price").cast("double").alias("bid_price"), F.col("ask_price").cast("double").alias("ask_price"),
                       "last_size", F.col("change_percent").cast("double").alias("change_percent"))


@query("src03_kline_decode", f"""
WITH {HOURLY} SELECT symbol, ts, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume, 12 AS trades FROM bars""")
def _(t):
    df = vd.decode_klines(raw.kline_payloads(t.hourly))
    return df.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "trades")


PAIR = "'P' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN 'BTC' ELSE 'USDT' END"
TICKERS = f"""tk AS (SELECT {PAIR} AS symbol, CAST(sum(l_extendedprice) AS DOUBLE) AS qv, sum(l_extendedprice) / sum(l_quantity) AS price,
  100 * (sum(l_extendedprice) / sum(l_quantity) - any_value(p_retailprice)) / any_value(p_retailprice) AS pct, count(*) AS trades
  FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey)"""


def tickers(t):
    return vd.decode_tickers(raw.ticker_payloads(t.read("part"), t.read("lineitem")))


@query("src04_ticker_decode", f"WITH {TICKERS} SELECT symbol, round(qv, 2) AS quote_volume, trades FROM tk")
def _(t):
    return rounded(tickers(t), ["symbol", "trades"], 2, quote_volume="quote_volume")


@query("src05_active_symbols", f"""
SELECT {PAIR} AS symbol, CASE p_partkey % 7 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'BNB' WHEN 3 THEN 'ADA' WHEN 4 THEN 'SOL' WHEN 5 THEN 'XRP' ELSE 'TRX' END AS base_asset,
  'USDT' AS quote_asset FROM part WHERE p_size % 5 <> 0 AND p_partkey % 3 <> 0 ORDER BY 1 LIMIT 50""")
def _(t):
    return vd.active_symbols(raw.exchange_info_payloads(t.read("part")), "USDT").select("symbol", "base_asset", "quote_asset")


@query("rel14_popular_pairs", f"""
SELECT symbol FROM (SELECT {PAIR} AS symbol, 0 AS k FROM part WHERE p_size % 5 <> 0 AND p_partkey % 7 < 5
  UNION ALL SELECT b || 'USDT', 1 FROM (SELECT unnest(['BTC', 'ETH', 'BNB', 'ADA', 'SOL', 'DOGE', 'DOT', 'AVAX', 'MATIC', 'LTC']) AS b)) ORDER BY k, symbol LIMIT 50""")
def _(t):
    return vd.popular_pairs(vd.active_symbols(raw.exchange_info_payloads(t.read("part")), limit=None))


@query("rel15_volume_leaders", f"WITH {TICKERS} SELECT symbol, round(qv, 1) AS quote_volume FROM tk WHERE symbol LIKE '%USDT' ORDER BY qv DESC, symbol LIMIT 20")
def _(t):
    return rounded(vd.volume_leaders(tickers(t)), ["symbol"], 1, quote_volume="quote_volume")


LEADERS = """up AS (SELECT 'gainers' AS section, symbol, pct FROM tk WHERE symbol LIKE '%USDT' AND qv > 1000000 ORDER BY round(pct, 4) DESC, symbol LIMIT 20),
down AS (SELECT 'losers' AS section, symbol, pct FROM tk WHERE symbol LIKE '%USDT' AND qv > 1000000 ORDER BY round(pct, 4), symbol LIMIT 20)"""


@query("rel16_gainers_losers", f"WITH {TICKERS}, {LEADERS} SELECT section, symbol, round(pct, 2) AS pct FROM up UNION ALL SELECT section, symbol, round(pct, 2) FROM down")
def _(t):
    return rounded(vd.price_leaders(tickers(t)), ["section", "symbol"], 2, pct="price_change_percent")


@query("rel17_market_overview", f"""WITH {TICKERS}, {LEADERS} SELECT 'total_pairs' AS section, NULL AS symbol, CAST(count(*) AS DOUBLE) AS value FROM tk
UNION ALL (SELECT 'volume_leaders', symbol, round(qv, 2) FROM tk WHERE symbol LIKE '%USDT' ORDER BY qv DESC, symbol LIMIT 20)
UNION ALL SELECT section, symbol, round(pct, 2) FROM up UNION ALL SELECT section, symbol, round(pct, 2) FROM down""")
def _(t):
    return rounded(vd.market_overview(tickers(t)), ["section", "symbol"], 2, value="value")


@query("src06_ticker_stream_decode", f"""WITH {TICKS} SELECT symbol, round(price, 4) AS price, size AS volume, epoch_us(ts) // 1000 AS at_ms FROM ticks
WHERE CAST(size AS BIGINT) % 7 <> 0 AND CAST(size AS BIGINT) % 11 <> 0""")
def _(t):
    df = vd.decode_ticker_stream(raw.ticker_messages(t.ticks))
    return df.select("symbol", "price", "volume", F.unix_millis("ts").alias("at_ms"))


@query("src07_kline_stream_decode", f"WITH {HOURLY} SELECT symbol, epoch_ms(ts) AS at_ms, round(close, 4) AS close, volume FROM bars WHERE CAST(volume AS BIGINT) % 2 = 0")
def _(t):
    df = vd.decode_kline_stream(raw.kline_messages(t.hourly))
    return df.select("symbol", F.unix_millis("ts").alias("at_ms"), "close", "volume")


def bus(t):
    """Trades sent as a stream to a folder of JSON lines, stopped and started again once: the folder."""
    path, marks = sinks.folder(t.spark), sinks.folder(t.spark)
    ticks = sinks.sliced(t.ticks, "ts")
    for _ in range(2):
        ms.write_stream(ticks, "raw_data", marks, path=path, once=True).awaitTermination()
    return path


@query("src08_message_source", f"WITH {TICKS} SELECT symbol, ts, round(price, 6) AS price, size, tick_id FROM ticks")
def _(t):
    got = ms.read_stream(t.spark, "raw_data", "symbol string, ts timestamp, price double, size double, tick_id bigint", path=bus(t), max_files=2)
    return sinks.drained(got).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("price", 6).alias("price"), "size", "tick_id")


@query("src09_message_sink", f"WITH {TICKS} SELECT symbol AS key, 'raw_data' AS topic, count(*) AS messages, count(*) AS distinct_ids, count(*) AS stamped, round(sum(price), 2) AS total FROM ticks GROUP BY 1")
def _(t):
    sent = t.spark.read.schema("topic string, key string, value string").json(bus(t))
    part = lambda name: F.get_json_object("value", f"$.{name}")
    return sent.groupBy("key", "topic").agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct(part("message_id")).alias("distinct_ids"), F.count(part("timestamp")).alias("stamped"),
        F.round(F.sum(part("price").cast("double")), 2).alias("total"))


@query("src10_series_sink", f"""WITH {HOURLY} SELECT 'market_data' AS data_type, '1h' AS granularity, strftime(ts, '%Y-%m-%d') AS date, count(*) AS bars, count(DISTINCT (symbol, ts)) AS keys, round(sum(close), 3) AS closes, round(sum(volume), 3) AS volume FROM bars GROUP BY 3""")
def _(t):
    back = sinks.written(t.spark, lambda path: storage.write_bars(t.hourly, path))
    return back.groupBy("data_type", "granularity", F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("bars"), F.count_distinct("symbol", "ts").alias("keys"), F.round(F.sum("close"), 3).alias("closes"), F.round(F.sum("volume"), 3).alias("volume"))


@query("src11_last_records", f"WITH {TICKS} SELECT symbol, tick_id, price FROM ticks ORDER BY ts DESC, tick_id DESC LIMIT 100")
def _(t):
    return storage.last_records(t.ticks, 100, tie="tick_id").select("symbol", "tick_id", "price")


@query("src12_composite_sink", f"WITH {HOURLY} SELECT s AS sink, symbol, count(*) AS bars, round(sum(close), 3) AS closes, max(ts) AS newest FROM bars CROSS JOIN (SELECT unnest(['a', 'b']) AS s) GROUP BY 1, 2")
def _(t):
    a, b = sinks.folder(t.spark), sinks.folder(t.spark)
    storage.fan_out(t.hourly, [lambda d: storage.write_bars(d, a), lambda d: storage.write_bars(d, b)])
    both = t.spark.read.parquet(a).withColumn("sink", F.lit("a")).unionByName(t.spark.read.parquet(b).withColumn("sink", F.lit("b")))
    return both.groupBy("sink", "symbol").agg(F.count(F.lit(1)).alias("bars"), F.round(F.sum("close"), 3).alias("closes"), F.max("ts").cast("timestamp_ntz").alias("newest"))


@query("src13_backup_sink", f"WITH {HOURLY} SELECT 'backup' AS sink, symbol, count(*) AS bars, round(sum(close), 3) AS closes, max(ts) AS newest FROM bars GROUP BY 2")
def _(t):
    path = sinks.folder(t.spark)

    def broken(df):
        raise OSError("primary store is away")

    took = storage.write_with_fallback(t.hourly, broken, lambda d: storage.write_bars(d, path), max_retries=2, backoff=0.0)
    return t.spark.read.parquet(path).groupBy(F.lit(took).alias("sink"), "symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.round(F.sum("close"), 3).alias("closes"), F.max("ts").cast("timestamp_ntz").alias("newest"))


@query("src14_upsert_bars", f"""
WITH {HOURLY} SELECT symbol, idx, round(CASE WHEN idx >= n - 100 THEN close * 1.03 ELSE close END, 5) AS close FROM bars
UNION ALL SELECT symbol || '_new', idx, round(close * 1.03, 5) FROM bars WHERE idx >= n - 100""")
def _(t):
    from tickloom.functions import frames as fr

    base = fr.index_bars(t.hourly)
    late = base.filter(F.col("idx") >= F.col("n") - 100)
    both = late.unionByName(late.withColumn("symbol", F.concat("symbol", F.lit("_new"))))
    versions = F.explode(F.sequence(F.lit(1), F.lit(3)))
    updates = both.withColumn("version", versions).withColumn("close", F.col("close") * (1 + F.col("version") / 100))
    return rounded(storage.upsert_bars(base, updates), ["symbol", "idx"], 5, close="close")


@query("src15_upsert_catalog", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer
UNION ALL SELECT -1 - c_custkey, c_name, 'VIP' FROM customer WHERE c_custkey % 10 = 0""")
def _(t):
    base = t.read("customer").select("c_custkey", "c_name", "c_mktsegment")
    vip = base.filter("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("VIP"))
    updates = vip.unionByName(vip.withColumn("c_custkey", -1 - F.col("c_custkey")))
    return storage.upsert(base, updates, ["c_custkey"])

