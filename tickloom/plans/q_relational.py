"""Filters, paging, search, scanner and alerts."""

from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.operators import averages as av
from tickloom.operators import relational as re
from tickloom.operators.bars import latest
from tickloom.plans.catalog import query, rounded
from tickloom.plans.sql import DAILY, HOURLY, PATTERNS, TICKS, lag, last


@query("rel01_date_range", f"WITH {DAILY} SELECT symbol, count(*) AS bars, round(sum(close), 2) AS total FROM bars WHERE ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1998-03-01' GROUP BY 1")
def _(t):
    return re.between_dates(t.daily, "1997-03-01", "1998-02-28").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.round(F.sum("close"), 2).alias("total"))


@query("rel02_symbol_bars", f"WITH {HOURLY} SELECT ts, open, close, volume FROM bars WHERE symbol = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def _(t):
    return re.bars(t.hourly, "view", "2024-01-05", "2024-01-20 12:00:00").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "close", "volume")


@query("rel03_recent_bars", f"WITH {HOURLY} SELECT symbol, ts, close FROM bars WHERE symbol IN ('view', 'click', 'error') AND ts >= TIMESTAMP '2024-01-10'")
def _(t):
    return re.recent_bars(t.hourly, ["view", "click", "error"], "2024-01-10").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")


@query("rel04_latest_indicator", f"""WITH {HOURLY}, i AS (SELECT symbol, idx, ts, unnest(['sma', 'roc']) AS indicator, unnest([CASE WHEN idx >= 19 THEN avg(close) {last(20)} END, 100 * (close - {lag('close', 12)}) / {lag('close', 12)}]) AS value FROM bars)
SELECT symbol, indicator, round(arg_max(value, ts), 5) AS value, max(ts) AS ts FROM i GROUP BY 1, 2""")
def _(t):
    from tickloom.operators.momentum import roc

    df = roc(av.sma(t.hourly, 20), 12)
    long = df.select("symbol", "ts", F.stack(F.lit(2), F.lit("sma"), F.col("sma"), F.lit("roc"), F.col("roc")).alias("indicator", "value"))
    return latest(long, ["symbol", "indicator"]).select("symbol", "indicator", F.round("value", 5).alias("value"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("rel05_high_confidence", f"WITH {PATTERNS} SELECT pattern_id, symbol, round(confidence, 4) AS confidence FROM patterns WHERE confidence >= 0.9 AND detected_at >= TIMESTAMP '1999-01-01'")
def _(t):
    return rounded(re.high_confidence(t.patterns, 0.9, "1999-01-01"), ["pattern_id", "symbol"], 4, confidence="confidence")


@query("rel06_page", f"WITH {PATTERNS} SELECT pattern_id, symbol FROM patterns ORDER BY entry_price DESC, pattern_id DESC LIMIT 50 OFFSET 100")
def _(t):
    rows, _ = re.page(t.patterns, 3, 50, ["entry_price", "pattern_id"], descending=True)
    return rows.select("pattern_id", "symbol")


@query("rel06_page_total", "SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages, 3 AS page, count(*) > 150 AS has_next, true AS has_prev FROM orders")
def _(t):
    return re.page(t.patterns, 3, 50, ["pattern_id"])[1]


@query("rel07_price_volume_filter", f"WITH {HOURLY} SELECT symbol, ts, close, volume FROM bars WHERE close BETWEEN 20 AND 100 AND volume >= 50 AND volume <= 200")
def _(t):
    return re.filter_bars(t.hourly, 20, 100, 50, 200).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "volume")


def listing(t):
    return t.read("part").select(F.concat(F.lit("PX"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("name"), F.col("p_brand").alias("exchange"), F.col("p_type").alias("sector"))


@query("rel08_catalog_search", "SELECT 'PX' || p_partkey AS symbol, p_name AS name FROM part WHERE lower(p_name) LIKE '%widget%' AND p_brand = 'Brand#17'")
def _(t):
    return re.search_catalog(listing(t), "WIDGET", "Brand#17").select("symbol", "name")


@query("rel09_ranked_search", """SELECT 'PX' || p_partkey AS symbol, CAST(CASE WHEN p_partkey = 17 THEN 1.0 ELSE 0.8 END AS DOUBLE) AS score FROM part WHERE 'px' || p_partkey LIKE '%px17%' OR lower(p_name) LIKE '%px17%'
ORDER BY score DESC, symbol LIMIT 10""")
def _(t):
    return re.rank_symbols(listing(t), "px17").select("symbol", "score")


@query("rel10_news_filter", "SELECT event_id AS news_id FROM events WHERE event_type IN ('view', 'click') AND value > 50")
def _(t):
    news = t.read("events").select(F.col("event_id").alias("news_id"), F.array("event_type", F.lit("ALL")).alias("symbols"), F.when(F.col("value") > 50, "positive").otherwise("negative").alias("sentiment"), F.col("ts").alias("published_at"))
    return re.filter_news(news, "view", "positive").select("news_id").unionByName(re.filter_news(news, "click", "positive").select("news_id"))


@query("rel11_trade_filter", f"WITH {TICKS} SELECT tick_id, price FROM ticks WHERE symbol = 'purchase' AND size >= 50 AND tick_id % 2 = 0")
def _(t):
    trades = t.ticks.withColumn("side", F.when(F.col("tick_id") % 2 == 0, "buy").otherwise("sell"))
    return re.filter_trades(trades, "purchase", 50, "buy").select("tick_id", "price")


SIGNALS = """sg AS (SELECT symbol, ['pattern', 'technical', 'news'][start_idx % 3 + 1] AS signal_type, ['strong', 'moderate', 'weak'][start_idx // 3 % 3 + 1] AS strength, confidence FROM patterns WHERE status = 'active')"""


@query("rel18_scanner", f"""WITH {PATTERNS}, {SIGNALS}, w AS (SELECT symbol, least(100, avg(confidence * 100 * CASE strength WHEN 'strong' THEN 1.5::DOUBLE WHEN 'moderate' THEN 1.2::DOUBLE ELSE 1 END
  * CASE signal_type WHEN 'pattern' THEN 1.3::DOUBLE WHEN 'technical' THEN 1.2::DOUBLE ELSE 1 END)) AS score, count(*) AS signals, bool_or(signal_type = 'news') AS has FROM sg GROUP BY 1)
SELECT symbol, round(score, 5) AS score, signals FROM w WHERE score > 30 AND has AND symbol LIKE '%1%'""")
def _(t):
    k = F.col("start_idx")
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    signals = t.patterns.filter("status = 'active'").select("symbol", F.get(names("pattern", "technical", "news"), (k % 3).cast("int")).alias("signal_type"),
                                                            F.get(names("strong", "moderate", "weak"), (F.floor(k / 3) % 3).cast("int")).alias("strength"), "confidence")
    universe = t.patterns.select("symbol", F.lower("symbol").alias("name"), F.lit("crypto").alias("sector")).distinct()
    return rounded(re.scan(signals, universe, "sym1", "crypto", "news"), ["symbol", "signals"], 5, score="score")


@query("rel19_watchlist", f"""WITH {HOURLY}, w AS (SELECT DISTINCT user_id AS u, event_type AS s FROM events WHERE value > 300)
SELECT u AS user, symbol, count(*) AS bars, round(max(high), 4) AS high FROM w JOIN bars ON symbol = s GROUP BY 1, 2""")
def _(t):
    lists = t.read("events").filter("value > 300").groupBy(F.col("user_id").alias("user")).agg(F.collect_set("event_type").alias("symbols")).withColumn("name", F.lit("main"))
    return re.watchlist_bars(lists, t.hourly).groupBy("user", "symbol").agg(F.count(F.lit(1)).alias("bars"), F.round(F.max("high"), 4).alias("high"))


ALERTS = [
    ("price_threshold", '{"operator": ">", "value": 40.0}'),
    ("price_threshold", '{"operator": "<", "value": 40.0}'),
    ("volume_spike", '{"multiplier": 1.2, "timeframe": "1h"}'),
    ("volatility_spike", '{"threshold": 45.0, "window": "4h"}'),
    ("moving_average_cross", '{"fast_ma": 5, "slow_ma": 20, "direction": "bullish"}'),
    ("pattern_detected", '{"pattern_type": "doji", "min_confidence": 0.7}'),
]


@query("rel20_alerts", f"""WITH {HOURLY}, f AS (SELECT symbol, idx, close, volume, avg(volume) {last(20)} AS av, stddev_samp(close) {last(20)} AS vol, avg(close) {last(5)} AS m5, avg(close) {last(20)} AS m20,
  abs(close - open) / ((close + open) / 2) < 0.001 AS doji, n FROM bars),
g AS (SELECT *, {lag('m5')} AS p5, {lag('m20')} AS p20 FROM f),
a AS (SELECT symbol, idx, unnest([1, 2, 3, 4, 5, 6]) AS alert, unnest([close > 40, close < 40, volume > av * 1.2, vol > 45, p5 <= p20 AND m5 > m20, doji]) AS hit FROM g)
SELECT alert, symbol, count(*) FILTER (hit) AS triggered FROM a GROUP BY 1, 2""")
def _(t):
    w = fr.last_rows(20)
    df = fr.framed(t.hourly, back=22).withColumns({
        "avg_volume": F.avg("volume").over(w), "volatility": F.stddev_samp("close").over(w), "fast_ma": F.avg("close").over(fr.last_rows(5)), "slow_ma": F.avg("close").over(w)})
    df = df.withColumns({"prev_fast_ma": fr.lag("fast_ma"), "prev_slow_ma": fr.lag("slow_ma")})
    doji = F.abs(F.col("close") - F.col("open")) / ((F.col("close") + F.col("open")) / 2) < 0.001
    feats = fr.core(df).withColumns({"pattern_types": F.when(doji, F.array(F.lit("doji"))).otherwise(F.array().cast("array<string>")), "pattern_confidence": F.lit(0.7)})
    rules = F.array(*[F.struct(F.lit(i + 1).alias("alert"), F.lit(k).alias("alert_type"), F.lit(c).alias("condition_data")) for i, (k, c) in enumerate(ALERTS)])
    alerts = t.hourly.select("symbol").distinct().select("symbol", F.inline(rules))
    return re.evaluate_alerts(alerts, feats).groupBy("alert", "symbol").agg(F.count_if("triggered").alias("triggered"))

