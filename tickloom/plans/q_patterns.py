"""Candlestick, breakout, classic, gap and crypto patterns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import breakouts as bo
from tickloom.operators import candles as ca
from tickloom.operators import classic as cl
from tickloom.operators import crypto as cr
from tickloom.operators import gaps as ga
from tickloom.plans.catalog import ORACLES, query
from tickloom.plans.sql import CALM, CALM_MINUTES, CLIMBING, DAILY, HOURLY, SURGES, SERIES, frame, lag, last, lead


def shown(df: DataFrame, *meta: str, digits: int = 5) -> DataFrame:
    """Plain columns of pattern rows, metadata values by name."""
    cols = ["confidence", "entry_price", "target_price", "stop_loss"]
    return df.select(
        "symbol", "pattern_name", "direction", "start_idx", "end_idx",
        *[F.round(c, digits).alias(c) for c in cols],
        *[F.round(F.col("metadata")[m], digits).alias(m) for m in meta],
    )


def found(name: str, direction: str, when: str, conf: str, span: str | int = 0, entry="close", target="NULL::DOUBLE",
          stop="NULL::DOUBLE", src="s", digits: int = 5, **meta: str) -> str:
    extra = "".join(f", round({v}, {digits}) AS {k}" for k, v in meta.items())
    return f"""SELECT symbol, {name} AS pattern_name, {direction} AS direction, idx - {span} AS start_idx, idx AS end_idx,
  round(CAST({conf} AS DOUBLE), {digits}) AS confidence, round({entry}, {digits}) AS entry_price,
  round({target}, {digits}) AS target_price, round({stop}, {digits}) AS stop_loss{extra}
FROM {src} WHERE {when}"""


CANDLE = f"""s AS (SELECT *, close - open AS mv, abs(close - open) AS body, high - low AS rng,
  high - greatest(open, close) AS up, least(open, close) - low AS dn,
  {lag('open')} AS o1, {lag('close')} AS c1, {lag('high')} AS h1, {lag('low')} AS l1, {lag('open', 2)} AS o2, {lag('close', 2)} AS c2,
  {lag('close')} - {lag('open')} AS mv1, {lag('close', 2)} - {lag('open', 2)} AS mv2,
  avg(close) {frame(-5, -1)} AS m5, min(low) {last(3)} AS low3, max(high) {last(3)} AS high3 FROM bars)"""


def candle(*parts: str, base: str = HOURLY) -> str:
    return f"WITH {base}, {CANDLE} " + "\nUNION ALL\n".join(parts)


def candles(t, group: str, *meta: str, bars=None) -> DataFrame:
    return shown(ca.candlestick_patterns(t.hourly if bars is None else bars, groups=[group]), *meta)


DOJI = found(
    """CASE WHEN rng > 0 AND up / nullif(rng, 0) > 0.7 THEN 'gravestone_doji' WHEN rng > 0 AND dn / nullif(rng, 0) > 0.7 THEN 'dragonfly_doji'
  WHEN rng > 0 AND abs(up - dn) / nullif(rng, 0) < 0.1 THEN 'long-legged_doji' ELSE 'standard_doji' END""", "'neutral'",
    "body / ((open + close) / 2) < 0.001",
    """CASE WHEN rng > 0 AND (up / nullif(rng, 0) > 0.7 OR dn / nullif(rng, 0) > 0.7) THEN 0.8
  WHEN rng > 0 AND abs(up - dn) / nullif(rng, 0) < 0.1 THEN 0.75 ELSE 0.7 END""",
    body_size="body", upper_shadow="up", lower_shadow="dn")


@query("pat02_doji", candle(DOJI))
def _(t):
    return candles(t, "doji", "body_size", "upper_shadow", "lower_shadow")


HAMMERS = (
    found("'hammer'", "'bullish'", "dn > body * 2 AND up < body * 0.5 AND idx >= 5 AND m5 > close", "0.7",
          target="close * 1.02", stop="low * 0.99", lower_shadow_ratio="dn / nullif(body, 0)", upper_shadow_ratio="NULL::DOUBLE"),
    found("'inverted_hammer'", "'bullish'", "up > body * 2 AND dn < body * 0.5 AND idx >= 5 AND m5 > close", "0.65",
          target="close * 1.02", stop="low * 0.99", lower_shadow_ratio="NULL::DOUBLE", upper_shadow_ratio="up / nullif(body, 0)"),
)


@query("pat03_hammer", candle(*HAMMERS))
def _(t):
    return candles(t, "hammer", "lower_shadow_ratio", "upper_shadow_ratio")


@query("pat04_shooting_star", candle(found(
    "'shooting_star'", "'bearish'", "up > body * 2 AND dn < body * 0.5 AND idx >= 5 AND m5 < close", "0.7",
    target="close * 0.98", stop="high * 1.01", upper_shadow_ratio="coalesce(up / nullif(body, 0), 0)")))
def _(t):
    return candles(t, "shooting_star", "upper_shadow_ratio")


@query("pat05_spinning_top", candle(found(
    "'spinning_top'", "'neutral'", "rng > 0 AND body / nullif(rng, 0) < 0.3 AND abs(up - dn) / nullif(rng, 0) < 0.2", "0.6",
    body_ratio="body / nullif(rng, 0)")))
def _(t):
    return candles(t, "spinning_top", "body_ratio")


@query("pat06_engulfing", candle(
    found("'bullish_engulfing'", "'bullish'", "mv1 < 0 AND mv > 0 AND open < c1 AND close > o1", "0.75", 1,
          target="close * 1.03", stop="low * 0.98", engulfing_ratio="body / nullif(abs(mv1), 0)"),
    found("'bearish_engulfing'", "'bearish'", "mv1 > 0 AND mv < 0 AND open > c1 AND close < o1", "0.75", 1,
          target="close * 0.97", stop="high * 1.02", engulfing_ratio="body / nullif(abs(mv1), 0)")))
def _(t):
    return candles(t, "engulfing", "engulfing_ratio")


INSIDE = "body < abs(mv1) * 0.5 AND least(open, close) > least(o1, c1) AND greatest(open, close) < greatest(o1, c1)"


@query("pat07_harami", candle(found(
    "CASE WHEN c1 > o1 THEN 'bearish_harami' ELSE 'bullish_harami' END", "CASE WHEN c1 > o1 THEN 'bearish' ELSE 'bullish' END",
    INSIDE, "0.65", 1, target="close * CASE WHEN c1 > o1 THEN 0.98::DOUBLE ELSE 1.02::DOUBLE END",
    stop="close * CASE WHEN c1 > o1 THEN 1.02::DOUBLE ELSE 0.98::DOUBLE END", body_ratio="body / nullif(abs(mv1), 0)")))
def _(t):
    return candles(t, "harami", "body_ratio")


@query("pat08_piercing_line", candle(
    found("'piercing_line'", "'bullish'", "mv1 < 0 AND mv > 0 AND open < l1 AND close > (o1 + c1) / 2 AND close < o1", "0.7", 1,
          target="close * 1.03", stop="low * 0.98", penetration="(close - c1) / nullif(abs(mv1), 0)"),
    found("'dark_cloud_cover'", "'bearish'", "mv1 > 0 AND mv < 0 AND open > h1 AND close < (o1 + c1) / 2 AND close > o1", "0.7", 1,
          target="close * 0.97", stop="high * 1.02", penetration="(o1 - close) / nullif(abs(mv1), 0)")))
def _(t):
    return candles(t, "piercing", "penetration")


@query("pat09_morning_star", candle(found(
    "'morning_star'", "'bullish'", "mv2 < 0 AND abs(mv1) < abs(mv2) * 0.3 AND mv > 0 AND close > (o2 + c2) / 2", "0.8", 2,
    target="close * 1.04", stop="low3 * 0.98", star_size="abs(mv1) / nullif(abs(mv2), 0)")))
def _(t):
    return candles(t, "morning_star", "star_size")


@query("pat10_evening_star", candle(found(
    "'evening_star'", "'bearish'", "mv2 > 0 AND abs(mv1) < abs(mv2) * 0.3 AND mv < 0 AND close < (o2 + c2) / 2", "0.8", 2,
    target="close * 0.96", stop="high3 * 1.02", star_size="abs(mv1) / nullif(abs(mv2), 0)")))
def _(t):
    return candles(t, "evening_star", "star_size")


SOLDIERS = (
    found("'three_white_soldiers'", "'bullish'",
          "mv2 > 0 AND mv1 > 0 AND mv > 0 AND c1 > c2 AND close > c1 AND o1 > o2 AND open > o1", "0.85", 2,
          target="close * 1.05", stop="low3 * 0.97", avg_body_size="(body + abs(mv1) + abs(mv2)) / 3"),
    found("'three_black_crows'", "'bearish'",
          "mv2 < 0 AND mv1 < 0 AND mv < 0 AND c1 < c2 AND close < c1 AND o1 < o2 AND open < o1", "0.85", 2,
          target="close * 0.95", stop="high3 * 1.03", avg_body_size="(body + abs(mv1) + abs(mv2)) / 3"),
)


@query("pat11_three_soldiers", candle(*SOLDIERS))
def _(t):
    return candles(t, "soldiers", "avg_body_size")


@query("pat01_all_candlesticks", f"""
WITH {DAILY}, {CANDLE}, p AS (
SELECT symbol, CASE WHEN rng > 0 AND up / nullif(rng, 0) > 0.7 THEN 'gravestone_doji' WHEN rng > 0 AND dn / nullif(rng, 0) > 0.7 THEN 'dragonfly_doji'
  WHEN rng > 0 AND abs(up - dn) / nullif(rng, 0) < 0.1 THEN 'long-legged_doji' ELSE 'standard_doji' END AS pattern_name
  FROM s WHERE body / ((open + close) / 2) < 0.001
UNION ALL SELECT symbol, 'hammer' FROM s WHERE dn > body * 2 AND up < body * 0.5 AND idx >= 5 AND m5 > close
UNION ALL SELECT symbol, 'inverted_hammer' FROM s WHERE up > body * 2 AND dn < body * 0.5 AND idx >= 5 AND m5 > close
UNION ALL SELECT symbol, 'shooting_star' FROM s WHERE up > body * 2 AND dn < body * 0.5 AND idx >= 5 AND m5 < close
UNION ALL SELECT symbol, 'spinning_top' FROM s WHERE rng > 0 AND body / nullif(rng, 0) < 0.3 AND abs(up - dn) / nullif(rng, 0) < 0.2
UNION ALL SELECT symbol, 'bullish_engulfing' FROM s WHERE mv1 < 0 AND mv > 0 AND open < c1 AND close > o1
UNION ALL SELECT symbol, 'bearish_engulfing' FROM s WHERE mv1 > 0 AND mv < 0 AND open > c1 AND close < o1
UNION ALL SELECT symbol, CASE WHEN c1 > o1 THEN 'bearish_harami' ELSE 'bullish_harami' END FROM s WHERE {INSIDE}
UNION ALL SELECT symbol, 'piercing_line' FROM s WHERE mv1 < 0 AND mv > 0 AND open < l1 AND close > (o1 + c1) / 2 AND close < o1
UNION ALL SELECT symbol, 'dark_cloud_cover' FROM s WHERE mv1 > 0 AND mv < 0 AND open > h1 AND close < (o1 + c1) / 2 AND close > o1
UNION ALL SELECT symbol, 'morning_star' FROM s WHERE mv2 < 0 AND abs(mv1) < abs(mv2) * 0.3 AND mv > 0 AND close > (o2 + c2) / 2
UNION ALL SELECT symbol, 'evening_star' FROM s WHERE mv2 > 0 AND abs(mv1) < abs(mv2) * 0.3 AND mv < 0 AND close < (o2 + c2) / 2
UNION ALL SELECT symbol, 'three_white_soldiers' FROM s WHERE mv2 > 0 AND mv1 > 0 AND mv > 0 AND c1 > c2 AND close > c1 AND o1 > o2 AND open > o1
UNION ALL SELECT symbol, 'three_black_crows' FROM s WHERE mv2 < 0 AND mv1 < 0 AND mv < 0 AND c1 < c2 AND close < c1 AND o1 < o2 AND open < o1)
SELECT symbol, pattern_name, count(*) AS hits FROM p GROUP BY 1, 2""")
def _(t):
    return ca.candlestick_patterns(t.daily).groupBy("symbol", "pattern_name").agg(F.count(F.lit(1)).alias("hits"))


def edge(col: str, op: str, k: int, part: str = "symbol, i") -> str:
    """Strict extremum within a window's rows; neighbours outside it do not count."""
    o = f"OVER (PARTITION BY {part} ORDER BY x)"
    tests = [f"coalesce({col} {op} {f}({col}, {j}) {o}, true)" for j in range(1, k + 1) for f in ("lag", "lead")]
    return " AND ".join(tests)


def windows(size: int, order: int, extra: str = "") -> str:
    """x: one row per (bar i, place x in its window of ``size`` earlier bars) with extremum flags."""
    return f"""
w AS (SELECT t.symbol, t.idx AS i, k.idx - (t.idx - {size}) AS x, k.high AS h, k.low AS l, k.close AS c{extra}
  FROM bars t JOIN bars k ON t.symbol = k.symbol AND k.idx BETWEEN t.idx - {size} AND t.idx - 1 WHERE t.idx >= {size}),
x AS (SELECT *, x BETWEEN 1 AND {size - 2} AND {edge('h', '>', order)} AS pk, x BETWEEN 1 AND {size - 2} AND {edge('l', '<', order)} AS tr FROM w)"""


TRIANGLE = f"""{windows(20, 2)},
a AS (SELECT symbol, i AS idx, avg(h) FILTER (pk) AS pm, avg(l) FILTER (tr) AS tm,
  stddev_pop(h) FILTER (pk) AS psd, stddev_pop(l) FILTER (tr) AS tsd,
  round(regr_slope(h, x) FILTER (pk), 9) AS ps, round(regr_slope(l, x) FILTER (tr), 9) AS tsl,
  max(h) FILTER (pk) AS hi, min(l) FILTER (tr) AS lo,
  max(x) FILTER (pk) AS px, max(x) FILTER (tr) AS tx, arg_max(h, x) FILTER (pk) AS py, arg_max(l, x) FILTER (tr) AS ty,
  arg_min(h, x) FILTER (pk) AS p0, arg_min(l, x) FILTER (tr) AS t0
  FROM x GROUP BY 1, 2 HAVING count(*) FILTER (pk) >= 2 AND count(*) FILTER (tr) >= 2),
s AS (SELECT a.*, b.close, b.volume, py + ps * (idx - px) AS top, ty + tsl * (idx - tx) AS floor FROM a JOIN bars b USING (symbol, idx))"""


@query("pat13_ascending_triangle", f"WITH {CLIMBING}, {TRIANGLE} " + found(
    "'ascending_triangle'", "'bullish'", "psd / pm < 0.02 AND tsl > 0 AND close > pm * (1 + 0.02::DOUBLE)", "0.75", 20,
    target="close + (pm - lo)", stop="pm * 0.98", resistance_level="pm", support_slope="tsl", breakout_volume="volume", digits=4))
def _(t):
    return shown(bo.breakout_patterns(t.climbing, groups=["ascending"]), "resistance_level", "support_slope", "breakout_volume", digits=4)


@query("pat14_descending_triangle", f"WITH {DAILY}, {TRIANGLE} " + found(
    "'descending_triangle'", "'bearish'", "tsd / tm < 0.02 AND ps < 0 AND close < tm * (1 - 0.02::DOUBLE)", "0.75", 20,
    target="close - (hi - tm)", stop="tm * 1.02", support_level="tm", resistance_slope="ps", breakout_volume="volume", digits=4))
def _(t):
    return shown(bo.breakout_patterns(t.daily, groups=["descending"]), "support_level", "resistance_slope", "breakout_volume", digits=4)


UP = "close > top * (1 + 0.02::DOUBLE)"


@query("pat15_symmetrical_triangle", f"WITH {HOURLY}, {TRIANGLE} " + found(
    "'symmetrical_triangle'", f"CASE WHEN {UP} THEN 'bullish' ELSE 'bearish' END",
    f"ps < 0 AND tsl > 0 AND ({UP} OR close < floor * (1 - 0.02::DOUBLE))", "0.7", 20,
    target=f"CASE WHEN {UP} THEN close + (p0 - t0) ELSE close - (p0 - t0) END",
    stop=f"close * CASE WHEN {UP} THEN 0.98::DOUBLE ELSE 1.02::DOUBLE END", resistance_slope="ps", support_slope="tsl", digits=6))
def _(t):
    return shown(bo.breakout_patterns(t.hourly, groups=["symmetrical"]), "resistance_slope", "support_slope", digits=6)


@query("pat16_rectangle", f"""
WITH {CALM}, w AS (SELECT t.symbol, t.idx, any_value(t.close) AS close, max(k.high) AS res, min(k.low) AS sup,
    stddev_samp(k.close) / avg(k.close) AS q, list(k.high) AS hs, list(k.low) AS ls
  FROM bars t JOIN bars k ON t.symbol = k.symbol AND k.idx BETWEEN t.idx - 20 AND t.idx - 1 WHERE t.idx >= 20 GROUP BY 1, 2),
s AS (SELECT * FROM w WHERE q < 0.05 AND len(list_filter(hs, lambda v: abs(v - res) < res * 0.01)) >= 2
  AND len(list_filter(ls, lambda v: abs(v - sup) < sup * 0.01)) >= 2)
""" + found("'rectangle'", "CASE WHEN close > res * (1 + 0.02::DOUBLE) THEN 'bullish' ELSE 'bearish' END",
            "close > res * (1 + 0.02::DOUBLE) OR close < sup * (1 - 0.02::DOUBLE)", "0.8", 20,
            target="CASE WHEN close > res * (1 + 0.02::DOUBLE) THEN close + (res - sup) ELSE close - (res - sup) END",
            stop="CASE WHEN close > res * (1 + 0.02::DOUBLE) THEN sup ELSE res END", resistance="res", support="sup", digits=4))
def _(t):
    return shown(bo.breakout_patterns(t.calm, groups=["rectangle"]), "resistance", "support", digits=4)


SLOPES = f"""s AS (SELECT *, regr_slope(high, idx) {frame(-20, -1)} AS hs, regr_slope(low, idx) {frame(-20, -1)} AS ls,
  {lag('high')} AS ph, {lag('low')} AS pl FROM bars)"""


@query("pat17_wedge", f"WITH {HOURLY}, {SLOPES} " + found(
    "'rising_wedge'", "'bearish'", "idx >= 20 AND hs > 0 AND ls > hs AND close < pl", "0.7", 20, target="close * 0.95", stop="ph",
    upper_slope="hs", lower_slope="ls") + " UNION ALL " + found(
    "'falling_wedge'", "'bullish'", "idx >= 20 AND hs < 0 AND ls < 0 AND hs < ls AND close > ph", "0.7", 20, target="close * 1.05",
    stop="pl", upper_slope="hs", lower_slope="ls"))
def _(t):
    return shown(bo.breakout_patterns(t.hourly, groups=["wedge"]), "upper_slope", "lower_slope")


@query("pat12_all_breakouts", f"""
WITH {HOURLY}, {TRIANGLE}, g AS (SELECT *, regr_slope(high, idx) {frame(-20, -1)} AS hs, regr_slope(low, idx) {frame(-20, -1)} AS ls,
  {lag('high')} AS ph, {lag('low')} AS pl FROM bars),
r AS (SELECT t.symbol, t.idx, any_value(t.close) AS close, max(k.high) AS res, min(k.low) AS sup,
    stddev_samp(k.close) / avg(k.close) AS q, list(k.high) AS hs, list(k.low) AS ls
  FROM bars t JOIN bars k ON t.symbol = k.symbol AND k.idx BETWEEN t.idx - 20 AND t.idx - 1 WHERE t.idx >= 20 GROUP BY 1, 2),
p AS (SELECT symbol, 'ascending_triangle' AS pattern_name FROM s WHERE psd / pm < 0.02 AND tsl > 0 AND close > pm * (1 + 0.02::DOUBLE)
UNION ALL SELECT symbol, 'descending_triangle' FROM s WHERE tsd / tm < 0.02 AND ps < 0 AND close < tm * (1 - 0.02::DOUBLE)
UNION ALL SELECT symbol, 'symmetrical_triangle' FROM s WHERE ps < 0 AND tsl > 0 AND ({UP} OR close < floor * (1 - 0.02::DOUBLE))
UNION ALL SELECT symbol, 'rectangle' FROM r WHERE q < 0.05 AND len(list_filter(hs, lambda v: abs(v - res) < res * 0.01)) >= 2
  AND len(list_filter(ls, lambda v: abs(v - sup) < sup * 0.01)) >= 2 AND (close > res * (1 + 0.02::DOUBLE) OR close < sup * (1 - 0.02::DOUBLE))
UNION ALL SELECT symbol, 'rising_wedge' FROM g WHERE idx >= 20 AND hs > 0 AND ls > hs AND close < pl
UNION ALL SELECT symbol, 'falling_wedge' FROM g WHERE idx >= 20 AND hs < 0 AND ls < 0 AND hs < ls AND close > ph)
SELECT symbol, pattern_name, count(*) AS hits FROM p GROUP BY 1, 2""")
def _(t):
    return bo.breakout_patterns(t.hourly).groupBy("symbol", "pattern_name").agg(F.count(F.lit(1)).alias("hits"))


SHOULDERS = f"""{windows(30, 3)},
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, i ORDER BY x) AS r FROM x WHERE pk),
tri AS (SELECT a.symbol, a.i, a.r, a.x AS x1, b.x AS x2, c.x AS x3, a.h AS h1, b.h AS h2, c.h AS h3
  FROM k a JOIN k b ON a.symbol = b.symbol AND a.i = b.i AND b.r = a.r + 1
  JOIN k c ON a.symbol = c.symbol AND a.i = c.i AND c.r = a.r + 2
  WHERE b.h > a.h AND b.h > c.h AND abs(a.h - c.h) < a.h * 0.03),
nk AS (SELECT t.symbol, t.i, t.r, t.x1, any_value(h1) AS h1, any_value(h2) AS h2, any_value(h3) AS h3,
  (min(w.l) FILTER (w.x >= x1 AND w.x < x2) + min(w.l) FILTER (w.x >= x2 AND w.x < x3)) / 2 AS neck
  FROM tri t JOIN w ON t.symbol = w.symbol AND t.i = w.i GROUP BY 1, 2, 3, 4),
hs AS (SELECT nk.*, b.idx, b.close, row_number() OVER (PARTITION BY nk.symbol, nk.i ORDER BY r) AS first
  FROM nk JOIN bars b ON b.symbol = nk.symbol AND b.idx = nk.i WHERE b.close < neck AND b.idx < b.n - 5),
s AS (SELECT * FROM hs WHERE first = 1)"""


@query("pat19_head_and_shoulders", f"WITH {HOURLY}, {SHOULDERS} " + found(
    "'head_and_shoulders'", "'bearish'", "true", "0.85", "(30 - x1)", target="neck - (h2 - neck)", stop="h3 * 1.02",
    left_shoulder="h1", head="h2", right_shoulder="h3", neckline="neck"))
def _(t):
    return shown(cl.classic_patterns(t.hourly, groups=["head_and_shoulders"]), "left_shoulder", "head", "right_shoulder", "neckline")


POLE = f"""s AS (SELECT *, {lag('close', 20)} AS st, {lag('close', 10)} - {lag('close', 20)} AS pole, max(high) {frame(-10, -1)} AS top,
  min(low) {frame(-10, -1)} AS floor, regr_slope(close, idx) {frame(-10, -1)} AS sl, regr_slope(high, idx) {frame(-10, -1)} AS hs,
  regr_slope(low, idx) {frame(-10, -1)} AS ls, stddev_samp(close) {frame(-10, -1)} / avg(close) {frame(-10, -1)} AS q FROM bars)"""
STRONG = "idx >= 20 AND idx < n - 10 AND abs(pole) / st > 0.05"


def poles(bull: str, bear: str, when: str, bull_if: str, bear_if: str, conf: str, **meta: str) -> str:
    return found(f"'{bull}'", "'bullish'", f"{STRONG} AND {when} AND pole > 0 AND {bull_if} AND close > top", conf, 20,
                 target="close + abs(pole)", stop="floor", **meta) + " UNION ALL " + found(
        f"'{bear}'", "'bearish'", f"{STRONG} AND {when} AND pole < 0 AND {bear_if} AND close < floor", conf, 20,
        target="close - abs(pole)", stop="top", **meta)


@query("pat20_flag", f"WITH {CALM_MINUTES}, {POLE} " + poles(
    "bull_flag", "bear_flag", "q < 0.02", "sl < 0", "sl > 0", "0.75", digits=4, pole_height="abs(pole)", flag_slope="sl"))
def _(t):
    return shown(cl.classic_patterns(t.calm_minutes, groups=["flag"]), "pole_height", "flag_slope", digits=4)


@query("pat21_pennant", f"WITH {HOURLY}, {POLE} " + poles(
    "bull_pennant", "bear_pennant", "hs < 0 AND ls > 0", "true", "true", "0.7", pole_height="abs(pole)", upper_slope="hs", lower_slope="ls"))
def _(t):
    return shown(cl.classic_patterns(t.hourly, groups=["pennant"]), "pole_height", "upper_slope", "lower_slope")


@query("pat18_all_classic", f"""
WITH {HOURLY}, {SHOULDERS.replace("s AS (SELECT * FROM hs", "h1 AS (SELECT * FROM hs")}, {POLE},
p AS (SELECT symbol, 'head_and_shoulders' AS pattern_name FROM h1
UNION ALL SELECT symbol, 'bull_flag' FROM s WHERE {STRONG} AND q < 0.02 AND pole > 0 AND sl < 0 AND close > top
UNION ALL SELECT symbol, 'bear_flag' FROM s WHERE {STRONG} AND q < 0.02 AND pole < 0 AND sl > 0 AND close < floor
UNION ALL SELECT symbol, 'bull_pennant' FROM s WHERE {STRONG} AND hs < 0 AND ls > 0 AND pole > 0 AND close > top
UNION ALL SELECT symbol, 'bear_pennant' FROM s WHERE {STRONG} AND hs < 0 AND ls > 0 AND pole < 0 AND close < floor)
SELECT symbol, pattern_name, count(*) AS hits FROM p GROUP BY 1, 2""")
def _(t):
    return cl.classic_patterns(t.hourly).groupBy("symbol", "pattern_name").agg(F.count(F.lit(1)).alias("hits"))


GAPS = f"""g AS (SELECT *, {lag('close')} AS prev, avg(close) {frame(-5, -1)} AS m5, avg(close) {frame(-10, -1)} AS m10,
  stddev_samp(close) {frame(-10, -1)} AS s10, avg(close) {frame(-10, -6)} AS older, avg(close) {frame(0, 4)} AS nxt,
  min(low) {frame(0, 9)} AS lo, max(high) {frame(0, 9)} AS hi FROM bars),
k AS (SELECT *, open - prev AS gap, idx >= 5 AND idx < n - 5 AND CASE WHEN open > prev THEN close > m5 * 1.02 ELSE close < m5 * 0.98 END AS strong,
  idx < 10 OR s10 / m10 < 0.02 AS quiet, CASE WHEN open > prev THEN m5 > older ELSE m5 < older END AS going,
  CASE WHEN open > prev THEN nxt < close ELSE nxt > close END AS tired FROM g WHERE abs(open - prev) / prev > 0.002),
s AS (SELECT *, CASE WHEN strong AND quiet THEN 'breakaway_gap' WHEN strong AND going THEN 'runaway_gap'
  WHEN strong AND tired THEN 'exhaustion_gap' ELSE 'common_gap' END AS kind FROM k)"""
GAP_DIR = """CASE WHEN kind IN ('breakaway_gap', 'runaway_gap') THEN CASE WHEN gap > 0 THEN 'bullish' ELSE 'bearish' END
  WHEN kind = 'exhaustion_gap' THEN CASE WHEN gap > 0 THEN 'bearish' ELSE 'bullish' END ELSE 'neutral' END"""


@query("pat22_gaps", f"""WITH {HOURLY}, {GAPS}
SELECT symbol, idx AS end_idx, round(gap, 5) AS gap_size, round(100 * abs(gap) / prev, 6) AS gap_percentage, round(open, 5) AS entry_price FROM s""")
def _(t):
    m = F.col("metadata")
    return ga.gaps(t.hourly).select("symbol", "end_idx", F.round(m["gap_size"], 5).alias("gap_size"),
                                    F.round(m["gap_percentage"], 6).alias("gap_percentage"),
                                    F.round("entry_price", 5).alias("entry_price"))


@query("pat23_gap_class", f"WITH {HOURLY}, {GAPS} SELECT symbol, idx AS end_idx, kind AS pattern_name, {GAP_DIR} AS direction FROM s")
def _(t):
    return ga.gaps(t.hourly).select("symbol", "end_idx", "pattern_name", "direction")


@query("pat24_gap_filled", f"""WITH {DAILY}, {GAPS} SELECT symbol, idx AS end_idx,
  CAST(idx < n - 10 AND CASE WHEN gap > 0 THEN lo <= prev ELSE hi >= prev END AS INTEGER) AS filled FROM s""")
def _(t):
    return ga.gaps(t.daily).select("symbol", "end_idx", F.col("metadata")["filled"].cast("int").alias("filled"))


@query("pat25_gap_target", f"""WITH {HOURLY}, {GAPS} SELECT symbol, idx AS end_idx,
  round(close + gap * CASE kind WHEN 'breakaway_gap' THEN 2 WHEN 'runaway_gap' THEN 1 WHEN 'exhaustion_gap' THEN -0.5 ELSE 0 END, 5) AS target_price,
  round(CASE WHEN gap > 0 THEN prev ELSE open * 1.02 END, 5) AS stop_loss FROM s""")
def _(t):
    return ga.gaps(t.hourly).select("symbol", "end_idx", F.round("target_price", 5).alias("target_price"),
                                    F.round("stop_loss", 5).alias("stop_loss"))


WHALE = f"s AS (SELECT *, volume / avg(volume) {last(20)} AS ratio, (close - open) / open AS ch FROM bars)"
WHALES = dict(name="'Whale Movement'", direction="CASE WHEN ch > 0 THEN 'bullish' ELSE 'bearish' END", when="idx >= 20 AND ratio > 2.5",
              conf="least(0.95, ratio / 2.5)", volume_multiple="ratio", price_change_percent="ch * 100", volume_usdt="volume * close")


@query("cry01_whale", f"WITH {HOURLY}, {WHALE} " + found(digits=4, **WHALES))
def _(t):
    return shown(cr.whales(t.hourly, cr.CryptoConfig(whale=2.5)), "volume_multiple", "price_change_percent", "volume_usdt", digits=4)


AD10 = f"""f AS (SELECT *, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS fl FROM bars),
c AS (SELECT *, CASE WHEN fl IS NOT NULL THEN sum(fl) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) END AS ln FROM f),
m AS (SELECT *, avg(close) {last(10)} AS pma, CASE WHEN count(ln) {last(10)} = 10 THEN avg(ln) {last(10)} END AS ama FROM c),
s AS (SELECT *, pma - {lag('pma', 10)} AS pt, ama - {lag('ama', 10)} AS ad FROM m)"""
AD_META = dict(price_trend="pt", ad_trend="ad", divergence_strength="abs(ad) / nullif(abs(pt), 0)", digits=6)


@query("cry02_ad_divergence", f"WITH {HOURLY}, {AD10} " + found(
    "'Accumulation Divergence'", "'bullish'", "idx >= 20 AND idx < n - 5 AND pt < 0 AND ad > 0", "least(0.9, abs(ad) / abs(pt) * 0.1)", 10,
    target="close * 1.05", stop="close * 0.97", **AD_META) + " UNION ALL " + found(
    "'Distribution Divergence'", "'bearish'", "idx >= 20 AND idx < n - 5 AND pt > 0 AND ad < 0", "least(0.9, abs(ad) / abs(pt) * 0.1)", 10,
    target="close * 0.95", stop="close * 1.03", **AD_META))
def _(t):
    return shown(cr.ad_divergence(t.hourly), "price_trend", "ad_trend", "divergence_strength", digits=6)


BREAK = f"""s AS (SELECT *, max(high) {frame(-20, -1)} AS res, min(low) {frame(-20, -1)} AS sup,
  volume / avg(volume) {frame(-20, -1)} AS ratio FROM bars)"""


@query("cry03_volume_breakout", f"WITH {HOURLY}, {BREAK} " + found(
    "'Volume Breakout (Bullish)'", "'bullish'", "idx >= 20 AND ratio > 1.5 AND high > res AND close > res", "least(0.9, ratio * 0.2)",
    target="res + (res - sup) * 0.5", stop="res * 0.98", volume_multiple="ratio") + " UNION ALL " + found(
    "'Volume Breakdown (Bearish)'", "'bearish'", "idx >= 20 AND ratio > 1.5 AND low < sup AND close < sup", "least(0.9, ratio * 0.2)",
    target="sup - (res - sup) * 0.5", stop="sup * 1.02", volume_multiple="ratio"))
def _(t):
    return shown(cr.crypto_breakouts(t.hourly), "volume_multiple")


def surge(back: int, before: int) -> str:
    return f"""s AS (SELECT *, (close - {lag('open', back)}) / {lag('open', back)} AS ch,
  CASE WHEN idx >= {back + before} THEN avg(volume) {frame(-back, 0)} / avg(volume) {frame(-back - before, -back - 1)} END AS v FROM bars)"""


@query("cry04_pump", f"WITH {HOURLY}, {surge(5, 15)} " + found(
    "'Crypto Pump'", "'bearish'", "ch > 0.20 AND v > 2", "least(0.95, ch / 0.20 * 0.5 + least(0.4, v / 5))", 5,
    target="close * 0.85", stop="close * 1.05", price_change_percent="ch * 100", volume_spike_multiple="v"))
def _(t):
    return shown(cr.pumps(t.hourly), "price_change_percent", "volume_spike_multiple")


@query("cry05_dump", f"WITH {HOURLY}, {surge(3, 12)} " + found(
    "'Crypto Dump'", "'bullish'", "ch < -0.15 AND v > 1.5", "least(0.95, abs(ch) / 0.15 * 0.5 + least(0.4, v / 4))", 3,
    target="close * 1.10", stop="close * 0.95", price_change_percent="ch * 100", volume_spike_multiple="v"))
def _(t):
    return shown(cr.dumps(t.hourly), "price_change_percent", "volume_spike_multiple")


@query("cry06_pump_and_dump", f"""WITH {SURGES}, g AS (SELECT *, {lag('close', 10)} AS st, {lag('close', 5)} AS tp,
  avg(volume) {frame(-10, -6)} AS pv, avg(volume) {frame(-5, -1)} AS dv, CASE WHEN idx >= 30 THEN avg(volume) {frame(-30, -11)} END AS nv FROM bars),
s AS (SELECT *, (tp - st) / st AS up, (close - tp) / tp AS down FROM g) """ + found(
    "'Pump and Dump Sequence'", "'bearish'", "up > 0.15 AND down < -0.10 AND pv > nv * 2 AND dv > nv * 1.5 AND idx < n - 10",
    "least(0.95, up / 0.15 * 0.3 + abs(down) / 0.10 * 0.3 + least(0.4, (pv + dv) / (nv * 4)))", 10, target="st", stop="close * 1.05",
    pump_change_percent="up * 100", dump_change_percent="down * 100", pump_volume_multiple="pv / nv"))
def _(t):
    return shown(cr.pump_dump(t.surges), "pump_change_percent", "dump_change_percent", "pump_volume_multiple")


@query("cry07_psychological_levels", f"""
WITH {DAILY}, l AS (SELECT symbol, n, arg_max(close, idx) AS last FROM bars GROUP BY 1, 2),
v AS (SELECT symbol, n, last, unnest(CASE WHEN last < 1 THEN [0.001, 0.005, 0.01, 0.05, 0.1, 0.5]::DOUBLE[] WHEN last < 10 THEN [1, 5, 10]::DOUBLE[]
  WHEN last < 100 THEN [10, 25, 50, 75, 100]::DOUBLE[] ELSE [100, 250, 500, 750, 1000, 2500, 5000, 10000]::DOUBLE[] END) AS lv FROM l),
q AS (SELECT symbol, idx, n, high, low, close, {lead('close', 3)} AS ahead FROM bars),
t AS (SELECT v.*, q.*, abs(low - lv) / lv < 0.5 AS a, abs(low - lv) / lv >= 0.5 AND abs(high - lv) / lv < 0.5 AS b
  FROM v JOIN q ON v.symbol = q.symbol WHERE abs(last - lv) / last < 0.5),
g AS (SELECT symbol, n, last, lv, count(*) AS touches, count(CASE WHEN idx < n - 5 AND ((a AND ahead > close * 1.02) OR (b AND ahead < close * 0.98)) THEN 1 END) AS bounces
  FROM t WHERE a OR b GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)
SELECT symbol, 'Psychological ' || CASE WHEN last > lv THEN 'Support' ELSE 'Resistance' END AS pattern_name,
  CASE WHEN last > lv THEN 'bullish' ELSE 'bearish' END AS direction, 0 AS start_idx, n - 1 AS end_idx,
  round(CAST(least(0.9, bounces / touches * 0.7 + least(0.2, touches / 10)) AS DOUBLE), 5) AS confidence, round(last, 5) AS entry_price,
  round(CASE WHEN last > lv THEN lv * 0.95 ELSE lv * 1.05 END, 5) AS target_price, round(CASE WHEN last > lv THEN lv * 0.98 ELSE lv * 1.02 END, 5) AS stop_loss,
  CAST(touches AS DOUBLE) AS touches, CAST(bounces AS DOUBLE) AS bounces FROM g""")
def _(t):
    return shown(cr.crypto_psych_levels(t.daily, tolerance=0.5), "touches", "bounces")


@query("cry08_moving_average_levels", f"""
WITH {CALM}, m AS ({" UNION ALL ".join(f"SELECT *, {p} AS p, CASE WHEN idx >= {p - 1} THEN avg(close) {last(p)} END AS ma FROM bars WHERE n >= {p}" for p in (20, 50, 100, 200))}),
d AS (SELECT *, lead(close, 2) OVER (PARTITION BY symbol, p ORDER BY idx) - close AS go, lead(ma, 2) OVER (PARTITION BY symbol, p ORDER BY idx) - ma AS up FROM m),
g AS (SELECT symbol, p, n, count(CASE WHEN idx >= n - 50 AND idx < n - 1 AND abs(close - ma) / ma < 0.03 THEN 1 END) AS touches,
  count(CASE WHEN idx >= n - 50 AND idx < n - 3 AND abs(close - ma) / ma < 0.03 AND go * up > 0 THEN 1 END) AS bounces,
  max(CASE WHEN idx = n - 1 THEN close END) AS last, max(CASE WHEN idx = n - 1 THEN ma END) AS ma, max(CASE WHEN idx = n - 10 THEN ma END) AS m10 FROM d GROUP BY 1, 2, 3)
SELECT symbol, 'MA' || p || ' Dynamic ' || CASE WHEN last > ma THEN 'Support' ELSE 'Resistance' END AS pattern_name,
  CASE WHEN last > ma THEN 'bullish' ELSE 'bearish' END AS direction, n - p AS start_idx, n - 1 AS end_idx,
  round(CAST(least(0.85, bounces / touches * 0.6 + least(0.25, touches / 10)) AS DOUBLE), 5) AS confidence, round(last, 5) AS entry_price,
  round(CASE WHEN last > ma THEN ma * 0.97 ELSE ma * 1.03 END, 5) AS target_price, round(CASE WHEN last > ma THEN ma * 0.97 ELSE ma * 1.03 END, 5) AS stop_loss,
  CAST(touches AS DOUBLE) AS touches, CAST(bounces AS DOUBLE) AS bounces, round((ma - m10) / m10, 5) AS ma_slope
FROM g WHERE abs(last - ma) / ma < 0.05 AND touches >= 3""")
def _(t):
    return shown(cr.crypto_ma_levels(t.calm), "touches", "bounces", "ma_slope")


def hourly(name: str, base: str, *changes: tuple[str, str]) -> str:
    """Names and confidences of another query's SQL, over the hourly bars and with other limits."""
    sql = ORACLES[name].replace(base, HOURLY)
    for old, new in changes:
        assert old in sql, old
        sql = sql.replace(old, new)
    return f"SELECT symbol, pattern_name, confidence FROM ({sql})"


ALL_CRYPTO = [
    f"SELECT symbol, pattern_name, confidence FROM (WITH {HOURLY}, {WHALE} {found(**{k: v.replace('2.5', '5') for k, v in WHALES.items()})})",
    hourly("cry02_ad_divergence", HOURLY), hourly("cry03_volume_breakout", HOURLY), hourly("cry04_pump", HOURLY, ("0.20", "0.15")),
    hourly("cry05_dump", HOURLY, ("0.15", "0.12")), hourly("cry06_pump_and_dump", SURGES), hourly("cry07_psychological_levels", DAILY, ("< 0.5", "< 0.02")), hourly("cry08_moving_average_levels", CALM),
]


@query("cry09_all_crypto", f"SELECT symbol, pattern_name, count(*) AS hits, round(avg(confidence), 4) AS mean_confidence FROM ({' UNION ALL '.join(ALL_CRYPTO)}) GROUP BY 1, 2")
def _(t):
    df = cr.crypto_patterns(t.hourly, cr.CryptoConfig(pump=0.15, dump=-0.12))
    return df.groupBy("symbol", "pattern_name").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg(F.round("confidence", 5)), 4).alias("mean_confidence"))
