"""Decoding landed vendor responses: time series, quotes, klines, tickers, exchange info, live events.

Every decoder takes a DataFrame with a JSON text column and works on batch and streaming input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import require

_TOP = "map<string,string>"
_POINTS = "map<string,map<string,string>>"


def _field(point: Column, word: str) -> Column:
    """Value of the first key that contains ``word``."""
    return F.get(F.map_values(F.map_filter(point, lambda k, v: F.lower(k).contains(word))), F.lit(0))


def envelope_error(top: Column) -> Column:
    """The vendor's error or rate-limit note, null for a good response."""
    return (
        F.when(top.isNull(), "Invalid JSON")
        .when(F.map_contains_key(top, "Error Message"), F.concat(F.lit("API Error: "), F.try_element_at(top, F.lit("Error Message"))))
        .when(F.map_contains_key(top, "Note"), F.concat(F.lit("API Note (likely rate limit): "), F.try_element_at(top, F.lit("Note"))))
    )


def decode_time_series(raw: DataFrame, granularity: str = "daily") -> tuple[DataFrame, DataFrame]:
    """Points of ``{"... Time Series ...": {ts: {"1. open": ...}}}`` and the failed responses.

    ``raw`` has symbol, payload. Points that lack a field or do not parse are dropped.
    """
    require(raw, "symbol", "payload")
    df = raw.withColumn("_top", F.from_json("payload", _TOP))
    series = F.get(F.map_values(F.map_filter("_top", lambda k, v: k.contains("Time Series"))), F.lit(0))
    df = df.withColumns({"_series": series, "error": envelope_error(F.col("_top"))})
    df = df.withColumn("error", F.when(F.col("error").isNull() & F.col("_series").isNull(), "No time series data found in response").otherwise(F.col("error")))
    fmt = "yyyy-MM-dd" if granularity in ("daily", "weekly", "monthly") else "yyyy-MM-dd HH:mm:ss"
    good = df.filter("error is null").select("symbol", F.explode(F.from_json("_series", _POINTS)).alias("_ts", "_p"))

    def price(word: str) -> Column:
        return _field(F.col("_p"), word).try_cast("decimal(18,4)")

    rows = good.select(
        "symbol", F.try_to_timestamp("_ts", F.lit(fmt)).alias("ts"), price("open").alias("open_price"), price("high").alias("high_price"),
        price("low").alias("low_price"), price("close").alias("close_price"), _field(F.col("_p"), "volume").try_cast("bigint").alias("volume"),
        price("adjusted").alias("adjusted_close"), F.lit(granularity).alias("granularity"),
    ).dropna(subset=["ts", "open_price", "high_price", "low_price", "close_price", "volume"])
    return rows, df.filter("error is not null").select("symbol", "error")


def decode_quote(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quote rows from ``{"Global Quote": {...}}``: bid is the last price, ask one cent more."""
    require(raw, "symbol", "payload")
    df = raw.withColumn("_top", F.from_json("payload", _TOP))
    df = df.withColumn("_q", F.from_json(F.try_element_at("_top", F.lit("Global Quote")), _TOP))
    empty = F.col("_q").isNull() | (F.size("_q") == 0)
    df = df.withColumn("error", F.coalesce(envelope_error(F.col("_top")), F.when(empty, "No quote data found in response")))
    q = F.col("_q")

    def part(key: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(q, F.lit(key)), F.lit(default))

    last = part("05. price", "0").try_cast("decimal(18,4)")
    keep = [c for c in raw.columns if c not in ("symbol", "payload")]
    good = df.filter("error is null").select(
        "symbol", *keep, last.alias("bid_price"), (last + F.lit("0.01").cast("decimal(18,4)")).cast("decimal(18,4)").alias("ask_price"),
        F.lit(0).cast("long").alias("bid_size"), F.lit(0).cast("long").alias("ask_size"), last.alias("last_price"),
        part("06. volume", "0").try_cast("bigint").alias("last_size"), part("09. change", "0").try_cast("decimal(18,4)").alias("change"),
        F.rtrim(part("10. change percent", "0%"), F.lit("%")).try_cast("decimal(18,4)").alias("change_percent"))
    return good.dropna(subset=["last_price"]), df.filter("error is not null").select("symbol", "error")


def _millis(c: Column) -> Column:
    return F.timestamp_millis(c.try_cast("bigint"))


def decode_klines(raw: DataFrame) -> DataFrame:
    """Rows of positional 12-field arrays; ``raw`` has symbol, payload (array of arrays)."""
    require(raw, "symbol", "payload")
    df = raw.select("symbol", F.explode(F.from_json("payload", "array<array<string>>")).alias("k"))
    k = F.col("k")
    num = {1: "open", 2: "high", 3: "low", 4: "close", 5: "volume", 7: "quote_volume", 9: "taker_base_volume", 10: "taker_quote_volume"}
    return df.select(
        "symbol", _millis(F.get(k, F.lit(0))).alias("ts"), _millis(F.get(k, F.lit(6))).alias("close_time"),
        *[F.get(k, F.lit(i)).try_cast("double").alias(name) for i, name in num.items()],
        F.get(k, F.lit(8)).try_cast("bigint").alias("trades")).dropna(subset=["ts", "open", "high", "low", "close"])


_TICKER = (
    "symbol string, lastPrice string, priceChange string, priceChangePercent string, highPrice string, lowPrice string, "
    "openPrice string, volume string, quoteVolume string, openTime bigint, closeTime bigint, count bigint"
)


def decode_tickers(raw: DataFrame) -> DataFrame:
    """24-hour ticker rows; ``raw`` has payload, one object each."""
    require(raw, "payload")
    t = raw.select(F.from_json("payload", _TICKER).alias("t")).select("t.*").filter("symbol is not null")
    num = {"lastPrice": "price", "priceChange": "price_change", "priceChangePercent": "price_change_percent", "highPrice": "high_price",
           "lowPrice": "low_price", "openPrice": "open_price", "volume": "volume", "quoteVolume": "quote_volume"}
    return t.select("symbol", *[F.col(a).try_cast("double").alias(b) for a, b in num.items()],
                    F.timestamp_millis("openTime").alias("open_time"), F.timestamp_millis("closeTime").alias("close_time"), F.col("count").alias("trades"))


_INFO = (
    "symbols array<struct<symbol:string,status:string,baseAsset:string,quoteAsset:string,baseAssetPrecision:int,"
    "quotePrecision:int,filters:array<map<string,string>>>>"
)


def active_symbols(info: DataFrame, quote_asset: str | None = None, limit: int | None = 50) -> DataFrame:
    """Symbols that trade, optionally of one quote asset, the first ``limit`` by name."""
    require(info, "payload")
    s = info.select(F.explode(F.from_json("payload", _INFO)["symbols"]).alias("s")).select("s.*").filter("status = 'TRADING'")
    df = s.select("symbol", F.col("baseAsset").alias("base_asset"), F.col("quoteAsset").alias("quote_asset"), "status",
                  F.col("baseAssetPrecision").alias("base_precision"), F.col("quotePrecision").alias("quote_precision"), "filters")
    if quote_asset:
        df = df.filter(F.col("quote_asset") == quote_asset)
    return df.orderBy("symbol").limit(limit) if limit else df


def decode_ticker_stream(messages: DataFrame) -> DataFrame:
    """Updates from ``24hrTicker`` events; other events and broken messages drop out.

    Event fields differ by case only (e and E), so they are read as map keys, not columns.
    """
    require(messages, "value")
    m = messages.select(F.from_json(F.col("value").cast("string"), _TOP).alias("m"))
    m = m.filter(F.try_element_at("m", F.lit("e")) == "24hrTicker")

    def at(k: str) -> Column:
        return F.try_element_at(F.col("m"), F.lit(k))

    num = {"c": "price", "P": "price_change_percent", "h": "high_price", "l": "low_price", "v": "volume", "q": "quote_volume"}
    return m.select(at("s").alias("symbol"), _millis(at("E")).alias("ts"), *[at(a).try_cast("double").alias(b) for a, b in num.items()])


def decode_kline_stream(messages: DataFrame, closed_only: bool = True) -> DataFrame:
    """Bar updates from kline events, by default of closed bars only."""
    require(messages, "value")
    m = messages.select(F.from_json(F.col("value").cast("string"), _TOP).alias("m"))
    m = m.select(F.try_element_at("m", F.lit("E")).alias("event"), F.from_json(F.try_element_at("m", F.lit("k")), _TOP).alias("k"))

    def at(k: str) -> Column:
        return F.try_element_at(F.col("k"), F.lit(k))

    num = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
    out = m.filter("k is not null").select(
        at("s").alias("symbol"), at("i").alias("timeframe"), _millis(at("t")).alias("ts"), _millis(at("T")).alias("close_time"),
        *[at(a).try_cast("double").alias(b) for a, b in num.items()], at("x").try_cast("boolean").alias("is_closed"),
        _millis(F.col("event")).alias("event_time"))
    return out.filter("is_closed") if closed_only else out


# Majors, and pairs that are always listed.
POPULAR_BASES = ["BTC", "ETH", "BNB", "ADA", "SOL", "DOGE", "DOT", "AVAX", "MATIC", "LTC"]
MUST_INCLUDE = [b + "USDT" for b in POPULAR_BASES]


def popular_pairs(symbols: DataFrame, bases: Sequence[str] = POPULAR_BASES, must: Sequence[str] = MUST_INCLUDE, limit: int = 50) -> DataFrame:
    """Pairs of the majors against USDT or BTC, then the fixed list, ``limit`` rows."""
    spark = symbols.sparkSession
    listed = symbols.filter(F.col("base_asset").isin(*bases) & F.col("quote_asset").isin("USDT", "BTC")).select("symbol", F.lit(0).alias("_k"))
    fixed = spark.createDataFrame([(m, 1) for m in must], "symbol string, _k int")
    both = listed.unionByName(fixed).groupBy("symbol").agg(F.min("_k").alias("_k"))
    return both.orderBy("_k", "symbol").limit(limit).select("symbol")


def volume_leaders(tickers: DataFrame, quote: str = "USDT", n: int = 20) -> DataFrame:
    return tickers.filter(F.col("symbol").endswith(quote)).orderBy(F.desc("quote_volume"), "symbol").limit(n)


def price_leaders(tickers: DataFrame, min_volume: float = 1_000_000, n: int = 20, quote: str = "USDT") -> DataFrame:
    """Top gainers and losers by percent change among liquid pairs."""
    liquid = tickers.filter(F.col("symbol").endswith(quote) & (F.col("quote_volume") > min_volume))
    up = liquid.orderBy(F.desc("price_change_percent"), "symbol").limit(n).withColumn("section", F.lit("gainers"))
    down = liquid.orderBy("price_change_percent", "symbol").limit(n).withColumn("section", F.lit("losers"))
    return up.unionByName(down)


def market_overview(tickers: DataFrame, min_volume: float = 1_000_000, n: int = 20) -> DataFrame:
    """Pair count, volume leaders, gainers and losers as sections of one table."""
    total = tickers.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("total_pairs").alias("section"), F.lit(None).cast("string").alias("symbol"), "value")
    lead = volume_leaders(tickers, n=n).select(F.lit("volume_leaders").alias("section"), "symbol", F.col("quote_volume").alias("value"))
    moves = price_leaders(tickers, min_volume, n).select("section", "symbol", F.col("price_change_percent").alias("value"))
    return total.unionByName(lead).unionByName(moves)
