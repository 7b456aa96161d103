"""Shared text of the oracle SQL."""

TICKS = """
ticks AS (
  SELECT event_type AS symbol, ts, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_id AS tick_id
  FROM events)"""

LINE_TICKS = """
ticks AS (
  SELECT r_name AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
         l_quantity AS size, l_orderkey * 8 + l_linenumber AS tick_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def bars_cte(unit: str, ticks: str = TICKS) -> str:
    """CTEs ending in bars(symbol, ts, open, high, low, close, volume, idx, n)."""
    return f"""{ticks},
raw_bars AS (
  SELECT symbol, date_trunc('{unit}', ts) AS bar, arg_min(price, (ts, tick_id)) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close,
         sum(size) AS volume
  FROM ticks GROUP BY 1, 2),
bars AS (
  SELECT symbol, bar AS ts, open, high, low, close, volume,
         row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS idx,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM raw_bars)"""


CALM_TICKS = TICKS.replace("value AS price", "500 + value * 0.1 AS price")
HOURLY = bars_cte("hour")
#: Prices that climb by the day, with little noise: both sides have lines, and channels lie between them.
CLIMBING_TICKS = TICKS.replace("value AS price", "100 + 2 * (epoch(ts) - 1704067200) / 86400 + value * 0.1 AS price")
CLIMBING = bars_cte("hour", CLIMBING_TICKS)
CALM = bars_cte("hour", CALM_TICKS)
CALM_MINUTES = bars_cte("minute", CALM_TICKS)
SURGES = bars_cte("minute", TICKS.replace("CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size", "value AS size"))
MINUTELY = bars_cte("minute")
DAILY = bars_cte("day", LINE_TICKS)

CALLS = """
calls AS (
  SELECT event_id, ts, '/' || event_type AS endpoint, CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
    CASE WHEN k % 20 = 0 THEN 500 WHEN k % 10 = 3 THEN 404 ELSE 200 END AS status_code, value * 50 AS response_time_ms,
    CASE WHEN k <> 9 THEN user_id END AS user_id, user_id % 40 AS ip_address, k * 10 AS request_size, k * 100 AS response_size
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

PATTERNS = """
pk AS (
  SELECT *, o_orderkey AS k, o_custkey AS c, ['candlestick', 'chart', 'volume', 'breakout', 'price'][CAST(left(o_orderpriority, 1) AS INTEGER)] AS kind,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'active' ELSE ['failed', 'expired', 'detected', 'confirmed'][o_orderkey % 4 + 1] END AS st,
    o_orderdate + to_hours(o_orderkey % 24) AS det, o_totalprice / 1000 AS entry, CASE WHEN o_custkey % 3 = 1 THEN -1 ELSE 1 END AS sg
  FROM orders),
patterns AS (
  SELECT CAST(k AS VARCHAR) AS pattern_id, 'SYM' || (c % 20) AS symbol, ['1h', '4h', '1d'][k % 3 + 1] AS timeframe, kind AS pattern_type, kind || '_' || (k % 4) AS pattern_name,
    ['bullish', 'bearish', 'neutral'][c % 3 + 1] AS direction, k AS start_idx, k + k % 5 AS end_idx, det - to_hours(k % 5 * 2) AS start_ts, det AS end_ts,
    0.3::DOUBLE + (k * 7 % 70) / 100 AS confidence, CASE WHEN k % 17 <> 0 THEN (k * 13 % 100) / 100 END AS strength, (k * 3 % 10) / 10 AS quality_score,
    entry AS entry_price, entry * (1 + sg * (k % 7) / 50) AS target_price, entry * (1 - sg * (k % 5 + 1) / 100) AS stop_loss,
    (k % 7) / 50 / ((k % 5 + 1) / 100) AS risk_reward, st AS status, det AS detected_at,
    CASE WHEN st = 'completed' AND k % 5 <> 0 THEN 'success' WHEN st IN ('completed', 'failed') THEN 'failure' END AS actual_outcome,
    CASE WHEN st IN ('completed', 'failed') THEN (k * 31 % 2000 - 800) / 10000 END AS actual_return, k % 5 * 7200 AS duration_seconds,
    CASE k % 3 WHEN 0 THEN ['momentum'] WHEN 1 THEN ['reversal', 'volume'] ELSE [] END AS tags, (k % 30) / 10 AS volume_ratio
  FROM pk)"""

SERIES = "PARTITION BY symbol ORDER BY idx"


def frame(start: int, end: int) -> str:
    """OVER clause for rows start..end relative to the current row."""

    def edge(k: int) -> str:
        if k == 0:
            return "CURRENT ROW"
        return f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

    return f"OVER ({SERIES} ROWS BETWEEN {edge(start)} AND {edge(end)})"


def last(n: int) -> str:
    return frame(-(n - 1), 0)


def lag(col: str, k: int = 1) -> str:
    return f"lag({col}, {k}) OVER ({SERIES})"


def lead(col: str, k: int = 1) -> str:
    return f"lead({col}, {k}) OVER ({SERIES})"


def smooth(name: str, source: str, x: str, alpha: str, seed_idx: int = 0, seed: str | None = None) -> str:
    """CTE name(symbol, idx, y): exponential smoothing written as the explicit weighted sum."""
    first = seed or x
    return f"""
{name} AS (
  SELECT t.symbol, t.idx,
         sum(CASE WHEN k.idx = {seed_idx} THEN pow(1 - {alpha}, t.idx - {seed_idx}) * k.{first}
                  ELSE {alpha} * pow(1 - {alpha}, t.idx - k.idx) * k.{x} END) AS y
  FROM {source} t JOIN {source} k ON t.symbol = k.symbol AND k.idx BETWEEN {seed_idx} AND t.idx
  GROUP BY 1, 2)"""


def t_two_sided(t: str, df: str) -> str:
    """P(|T| > |t|) for a whole number of degrees of freedom, by the finite series in the angle's cosine."""
    angle = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    series = lambda first, top, bottom: f"list_reduce(list_transform(list_reverse(range(1, {first})), lambda k: k::DOUBLE), lambda a, k: 1 + {top} / {bottom} * pow(cos({angle}), 2) * a, 1::DOUBLE)"
    even = f"sin({angle}) * {series(f'({df}) // 2', '(2 * k - 1)', '(2 * k)')}"
    odd = f"2 / pi() * ({angle} + CASE WHEN ({df}) > 1 THEN sin({angle}) * cos({angle}) * {series(f'(({df}) - 1) // 2', '(2 * k)', '(2 * k + 1)')} ELSE 0 END)"
    return f"greatest(0, 1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def normal_two_sided(z: str) -> str:
    """P(|Z| > |z|) by the series of positive terms around zero; beyond 10 it is 0 in a double's rounding."""
    x = f"least(abs({z}), 10)"
    series = f"list_reduce(list_transform(list_reverse(range(1, 250)), lambda k: k::DOUBLE), lambda a, k: 1 + pow({x}, 2) / (2 * k + 1) * a, 1::DOUBLE)"
    return f"greatest(0, 1 - 2 * {x} * exp(-pow({x}, 2) / 2) / sqrt(2 * pi()) * {series})"
