"""Filters, paging, search, scanner and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import require


def _day(d: str) -> Column:
    return F.lit(d).cast("timestamp")


def between_dates(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows of the calendar days start..end. Bare comparisons, so a stored table prunes by them."""
    return df.filter((F.col(ts) >= _day(start)) & (F.col(ts) < _day(end) + F.expr("interval 1 day")))


def bars(df: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """Bars of one symbol in a time range, newest first."""
    hit = (F.col("symbol") == symbol) & (F.col("ts") >= _day(start)) & (F.col("ts") <= _day(end))
    return df.filter(hit).orderBy(F.desc("ts"))


def recent_bars(df: DataFrame, symbols: Sequence[str] | DataFrame, since: str) -> DataFrame:
    """Bars since a time of the listed symbols; a long list comes as a DataFrame."""
    df = df.filter(F.col("ts") >= _day(since))
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select("symbol"), "symbol", "left_semi")
    return df.filter(F.col("symbol").isin(*symbols))


def high_confidence(patterns: DataFrame, min_conf: float, since: str) -> DataFrame:
    hit = (F.col("confidence") >= min_conf) & (F.col("detected_at") >= _day(since))
    return patterns.filter(hit).orderBy(F.desc("confidence"), F.desc("detected_at"), "pattern_id")


def page(df: DataFrame, number: int, size: int, sort: Sequence[str], descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """One page of a sorted table, and one row with total, pages, has_next, has_prev."""
    order = [F.desc(s) if descending else F.asc(s) for s in sort]
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size)
    return rows, total.select("total", pages.alias("pages"), F.lit(number).alias("page"), (pages > number).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def filter_bars(df: DataFrame, min_price: float | None = None, max_price: float | None = None,
                min_volume: float | None = None, max_volume: float | None = None) -> DataFrame:
    c, v = F.col("close"), F.col("volume")
    for bound, keep in ((min_price, lambda b: c >= b), (max_price, lambda b: c <= b), (min_volume, lambda b: v >= b), (max_volume, lambda b: v <= b)):
        if bound is not None:
            df = df.filter(keep(bound))
    return df


def search_catalog(df: DataFrame, q: str | None = None, exchange: str | None = None, sector: str | None = None) -> DataFrame:
    """Substring of symbol or name, with optional exchange and sector."""
    if q:
        df = df.filter(F.lower("symbol").contains(q.lower()) | F.lower("name").contains(q.lower()))
    if exchange:
        df = df.filter(F.col("exchange") == exchange)
    return df.filter(F.col("sector") == sector) if sector else df


def rank_symbols(df: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Search with a score: 1.0 for the exact symbol, else 0.8."""
    hits = search_catalog(df, q)
    score = F.when(F.upper("symbol") == q.upper(), 1.0).otherwise(0.8)
    return hits.withColumn("score", score).orderBy(F.desc("score"), "symbol").limit(limit)


def filter_news(df: DataFrame, symbol: str | None = None, sentiment: str | None = None) -> DataFrame:
    if symbol:
        df = df.filter(F.array_contains("symbols", symbol))
    if sentiment:
        df = df.filter(F.col("sentiment") == sentiment)
    return df.orderBy(F.desc("published_at"), "news_id")


def filter_trades(df: DataFrame, symbol: str | None = None, min_size: float | None = None, side: str | None = None) -> DataFrame:
    if symbol:
        df = df.filter(F.col("symbol") == symbol)
    if min_size is not None:
        df = df.filter(F.col("size") >= min_size)
    if side:
        df = df.filter(F.col("side") == side)
    return df.orderBy(F.desc("ts"), "tick_id")


# Scanner weights.
STRENGTH_WEIGHT = {"strong": 1.5, "moderate": 1.2}
TYPE_WEIGHT = {"pattern": 1.3, "technical": 1.2}


def _weight(col: str, table: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in table.items():
        out = F.when(F.col(col) == k, v).otherwise(out)
    return out


def scan(signals: DataFrame, universe: DataFrame, q: str | None = None, sector: str | None = None,
         signal_type: str | None = None, min_score: float = 30.0) -> DataFrame:
    """Mean weighted confidence of each symbol's signals, capped at 100, filtered and sorted."""
    require(signals, "symbol", "signal_type", "strength", "confidence")
    value = F.col("confidence") * 100 * _weight("strength", STRENGTH_WEIGHT) * _weight("signal_type", TYPE_WEIGHT)
    has = F.bool_or(F.col("signal_type") == signal_type) if signal_type else F.lit(True)
    scores = signals.groupBy("symbol").agg(F.least(F.lit(100.0), F.avg(value)).alias("score"), F.count(F.lit(1)).alias("signals"), has.alias("_has"))
    scores = scores.filter((F.col("score") > min_score) & F.col("_has")).drop("_has")
    rows = search_catalog(scores.join(universe, "symbol"), q, None, sector)
    return rows.orderBy(F.desc("score"), "symbol")


def watchlist_bars(watchlists: DataFrame, bars: DataFrame) -> DataFrame:
    """Each watchlist's bars. The symbol arrays are exploded, then joined; Spark sizes the join."""
    items = watchlists.select("user", F.col("name").alias("watchlist"), F.explode("symbols").alias("symbol"))
    return bars.join(items, "symbol")


_CONDITION = "operator string, value double, pattern_type string, min_confidence double, multiplier double, threshold double, fast_ma int, slow_ma int, direction string"


def evaluate_alerts(alerts: DataFrame, features: DataFrame) -> DataFrame:
    """Alerts joined to their symbol's features, with ``triggered`` by alert type.

    Features: close, volume, avg_volume, volatility, fast_ma, slow_ma, prev_fast_ma, prev_slow_ma,
    pattern_types, pattern_confidence.
    """
    df = alerts.withColumn("c", F.from_json("condition_data", _CONDITION)).join(features, "symbol")
    above = F.when(F.col("c.operator") == ">", F.col("close") > F.col("c.value")).when(F.col("c.operator") == "<", F.col("close") < F.col("c.value"))
    up = (F.col("prev_fast_ma") <= F.col("prev_slow_ma")) & (F.col("fast_ma") > F.col("slow_ma"))
    down = (F.col("prev_fast_ma") >= F.col("prev_slow_ma")) & (F.col("fast_ma") < F.col("slow_ma"))
    kind = F.col("alert_type")
    fired = (
        F.when(kind == "price_threshold", above)
        .when(kind == "volume_spike", F.col("volume") > F.col("avg_volume") * F.col("c.multiplier"))
        .when(kind == "volatility_spike", F.col("volatility") > F.col("c.threshold"))
        .when(kind == "moving_average_cross", F.when(F.col("c.direction") == "bullish", up).otherwise(down))
        .when(kind == "pattern_detected", F.array_contains("pattern_types", F.col("c.pattern_type")) & (F.col("pattern_confidence") >= F.col("c.min_confidence")))
    )
    return df.withColumn("triggered", F.coalesce(fired, F.lit(False))).drop("c")
