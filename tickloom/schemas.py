"""Table schemas and the fixed values the operators share."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A series is one instrument at one bar width.
SERIES = ["symbol", "timeframe"]

# Bar widths in seconds.
TIMEFRAME_SECONDS = {
    "1m": 60,
    "3m": 180,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "6h": 21600,
    "8h": 28800,
    "12h": 43200,
    "1d": 86400,
    "3d": 259200,
    "1w": 604800,
    "1M": 2592000,
}

BAR_SCHEMA = (
    "symbol string, timeframe string, ts timestamp, open double, high double, "
    "low double, close double, volume double"
)
TICK_SCHEMA = (
    "symbol string, ts timestamp, price double, size double, tick_id bigint"
)
QUOTE_SCHEMA = (
    "symbol string, ts timestamp, bid_price double, ask_price double, last_price double, "
    "bid_size bigint, ask_size bigint, last_size bigint, change double, change_percent double"
)
PATTERN_SCHEMA = (
    "pattern_id string, symbol string, timeframe string, pattern_type string, pattern_name string, "
    "direction string, start_idx bigint, end_idx bigint, start_ts timestamp, end_ts timestamp, "
    "confidence double, strength double, quality_score double, entry_price double, "
    "target_price double, stop_loss double, risk_reward double, status string, "
    "detected_at timestamp, actual_outcome string, actual_return double, "
    "duration_seconds bigint, tags array<string>, metadata map<string,double>"
)
NEWS_SCHEMA = (
    "symbol string, headline string, url string, source string, published_at string, "
    "sentiment_score string, relevance_score string"
)


def timeframe_seconds(col: Column | str = "timeframe") -> Column:
    """Bar width in seconds; an unknown label counts as one minute."""
    col = F.col(col) if isinstance(col, str) else col
    pairs = [F.lit(v) for kv in TIMEFRAME_SECONDS.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), F.lit(60)).cast("long")


def require(df, *cols: str) -> None:
    """Fail early, on the driver, when an input lacks a column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def positive(**args: int | float) -> None:
    bad = {k: v for k, v in args.items() if v is None or v <= 0}
    if bad:
        raise ValueError(f"must be positive: {bad}")


def risk_reward(entry, target, stop) -> Column:
    """|target - entry| / |entry - stop|, null without a risk."""
    risk = F.abs(entry - stop)
    return F.try_divide(F.abs(target - entry), F.when(risk != 0, risk))
