"""Vendor-shaped payloads and landed records written from the tables, to feed the decoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    """Plain decimal text with four places."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(24,4)").cast("string")


def time_series_payloads(bars: DataFrame) -> DataFrame:
    """One response per symbol and month; the first month of each year is an error note."""
    point = F.create_map(F.lit("1. open"), text("open"), F.lit("2. high"), text("high"), F.lit("3. low"), text("low"),
                         F.lit("4. close"), text("close"), F.lit("5. volume"), F.col("volume").cast("long").cast("string"))
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("k"), point.alias("v"))
    g = bars.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.map_from_entries(F.collect_list(entry)).alias("s"))
    good = F.to_json(F.struct(F.create_map(F.lit("2. Symbol"), F.col("symbol")).alias("Meta Data"), F.col("s").alias("Time Series (Daily)")))
    note = F.to_json(F.create_map(F.lit("Note"), F.lit("call frequency")))
    return g.select("symbol", F.when(F.month("month") == 1, note).otherwise(good).alias("payload"))


def quote_payloads(ticks: DataFrame) -> DataFrame:
    """One quote response per trade; the trade id rides along."""
    q = F.create_map(F.lit("05. price"), text("price"), F.lit("06. volume"), F.col("size").cast("long").cast("string"),
                     F.lit("09. change"), text(F.col("price") / 100), F.lit("10. change percent"), F.concat(text(F.col("size") / 10), F.lit("%")))
    body = F.when(F.col("size") == 7, F.to_json(F.create_map(F.lit("Error Message"), F.lit("Invalid API call"))))
    return ticks.select("symbol", "tick_id", "ts", F.coalesce(body, F.to_json(F.struct(q.alias("Global Quote")))).alias("payload"))


def kline_payloads(bars: DataFrame) -> DataFrame:
    """Arrays of 12-field klines, one response per symbol and day."""
    ms = F.unix_millis("ts").cast("string")
    k = F.array(ms, text("open"), text("high"), text("low"), text("close"), text("volume"), (F.unix_millis("ts") + 3599999).cast("string"),
                text(F.col("volume") * F.col("close")), F.lit("12"), text(F.col("volume") / 2), text(F.col("volume") * F.col("close") / 2), F.lit("0"))
    return bars.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(k)).alias("payload")).select("symbol", "payload")


def pair_name() -> Column:
    """Exchange-style name of a part: brand letters, key, and USDT or (every third) BTC."""
    quote = F.when(F.col("p_partkey") % 3 == 0, "BTC").otherwise("USDT")
    return F.concat(F.lit("P"), F.col("p_partkey").cast("string"), quote)


def ticker_payloads(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """24-hour ticker objects, one per traded part."""
    sold = lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("v"), F.sum("l_extendedprice").alias("qv"),
                                              F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("hi"),
                                              F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("lo"), F.count(F.lit(1)).alias("c"))
    df = part.join(sold, F.col("p_partkey") == F.col("l_partkey"))
    last = F.col("qv") / F.col("v")
    change = last - F.col("p_retailprice")
    o = F.struct(
        pair_name().alias("symbol"), text(last).alias("lastPrice"), text(change).alias("priceChange"), text(100 * change / F.col("p_retailprice")).alias("priceChangePercent"),
        text("hi").alias("highPrice"), text("lo").alias("lowPrice"), text("p_retailprice").alias("openPrice"), text("v").alias("volume"), text("qv").alias("quoteVolume"),
        F.lit(1704067200000).alias("openTime"), F.lit(1704153599999).alias("closeTime"), F.col("c").alias("count"))
    return df.select(F.to_json(o).alias("payload"))


def exchange_info_payloads(part: DataFrame) -> DataFrame:
    """Exchange-info responses, a thousand symbols at most in each."""
    base = F.element_at(F.array(*[F.lit(b) for b in ("BTC", "ETH", "BNB", "ADA", "SOL", "XRP", "TRX")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    s = F.struct(
        pair_name().alias("symbol"), F.when(F.col("p_size") % 5 == 0, "BREAK").otherwise("TRADING").alias("status"), base.alias("baseAsset"),
        F.when(F.col("p_partkey") % 3 == 0, "BTC").otherwise("USDT").alias("quoteAsset"), F.lit(8).alias("baseAssetPrecision"), F.lit(6).alias("quotePrecision"),
        F.array(F.create_map(F.lit("filterType"), F.lit("LOT_SIZE"), F.lit("minQty"), F.col("p_size").cast("string"))).alias("filters"))
    g = part.groupBy(F.floor(F.col("p_partkey") / 1000).alias("g")).agg(F.collect_list(s).alias("symbols"))
    return g.select(F.to_json(F.struct("symbols")).alias("payload"))


def ticker_messages(ticks: DataFrame) -> DataFrame:
    """Live ticker events; every seventh size value is another event, every eleventh broken text."""
    o = F.struct(F.when(F.col("size") % 7 == 0, "trade").otherwise("24hrTicker").alias("e"), F.unix_millis("ts").alias("E"), F.col("symbol").alias("s"),
                 text("price").alias("c"), text("size").alias("P"), text(F.col("price") + 1).alias("h"), text("price").alias("l"), text("size").alias("v"),
                 text(F.col("price") * F.col("size")).alias("q"))
    return ticks.select(F.when(F.col("size") % 11 == 0, "{broken").otherwise(F.to_json(o)).alias("value"))


def kline_messages(bars: DataFrame) -> DataFrame:
    """Kline events; bars with an even volume are closed."""
    k = F.struct(F.col("symbol").alias("s"), F.unix_millis("ts").alias("t"), (F.unix_millis("ts") + 3599999).alias("T"), F.col("timeframe").alias("i"),
                 text("open").alias("o"), text("high").alias("h"), text("low").alias("l"), text("close").alias("c"), text("volume").alias("v"),
                 (F.col("volume") % 2 == 0).alias("x"))
    return bars.select(F.to_json(F.struct((F.unix_millis("ts") + 5).alias("E"), k.alias("k"))).alias("value"))


def ohlc_records(ticks: DataFrame) -> DataFrame:
    """Landed OHLC text records with the usual faults, decided by the size of the trade."""
    k, p = F.col("size").cast("int"), F.col("price")
    stamp = (
        F.when(k % 29 == 0, "31/12/2023").when(k % 5 == 1, F.date_format("ts", "yyyy-MM-dd"))
        .when(k % 5 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k % 5 == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k % 5 == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return ticks.select(
        "tick_id",
        F.when(k % 10 == 0, F.concat("symbol", F.lit("$"))).when(k % 10 == 1, F.concat(F.lit("  "), "symbol", F.lit(" "))).when(k == 33, "").when(k == 34, "averylongsymbol").otherwise(F.col("symbol")).alias("symbol"),
        stamp.alias("timestamp"),
        F.when(k % 13 == 0, "-1").when(k % 17 == 0, "abc").when(k == 44, "2000000").when(k == 45, "0.00001").otherwise(p.cast("string")).alias("open_price"),
        F.when(k % 11 == 0, (p * 0.5).cast("string")).otherwise((p * 2).cast("string")).alias("high_price"),
        (p * 0.5).cast("string").alias("low_price"),
        F.when(k % 7 == 0, (p * 1.6).cast("string")).otherwise(p.cast("string")).alias("close_price"),
        F.when(k == 50, "-5").when(k == 51, "many").when(k == 52, "20000000000").when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string")).alias("volume"))


def quote_records(ticks: DataFrame) -> DataFrame:
    k, p = F.col("size").cast("int"), F.col("price")
    return ticks.select(
        "tick_id", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), p.cast("string").alias("last_price"),
        F.when(k == 60, "x").otherwise(p.cast("string")).alias("bid_price"), F.when(k % 9 == 0, (p * 0.5).cast("string")).otherwise((p + 1).cast("string")).alias("ask_price"),
        F.when(k == 61, "-1").otherwise(k.cast("string")).alias("last_size"))


def news_records(events: DataFrame) -> DataFrame:
    """News text records; event ids decide the faults."""
    k = F.col("event_id") % 100
    return events.select(
        "event_id", F.upper("event_type").alias("symbol"), F.when(k == 1, "").otherwise(F.concat(F.lit("Report "), F.col("event_id").cast("string"))).alias("headline"),
        F.when(k == 2, "ftp://x.org/a").when(k == 3, F.concat(F.lit("https://n.org/"), F.repeat(F.lit("a"), 2000))).otherwise(F.concat(F.lit("https://n.org/"), F.col("event_id").cast("string"))).alias("url"),
        F.when(k == 4, F.lit(None).cast("string")).otherwise("wire").alias("source"),
        F.when(k == 5, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("published_at"),
        F.when(k == 6, "1.5").when(k == 7, "good").when(k == 8, F.lit(None).cast("string")).otherwise(((F.col("user_id") % 21 - 10) / 10).cast("string")).alias("sentiment_score"))
