"""Moving averages, momentum and volatility."""

from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.operators import averages as av
from tickloom.operators import momentum as mo
from tickloom.operators import volatility as vo
from tickloom.operators.bars import last_n
from tickloom.plans.catalog import lines, query
from tickloom.plans.sql import HOURLY, MINUTELY, lag, last, smooth


def simple(expr: str, name: str, digits: int = 6, base: str = HOURLY) -> str:
    return f"WITH {base} SELECT symbol, idx, round({expr}, {digits}) AS {name} FROM bars"


@query("ind01_sma", simple(f"CASE WHEN idx >= 19 THEN avg(close) {last(20)} END", "sma"))
def _(t):
    return lines(av.sma(t.hourly, 20), "sma")


@query("ind02_ema", f"""
WITH {HOURLY}, {smooth("e", "bars", "close", "(2.0::DOUBLE / 21)")}
SELECT symbol, idx, CASE WHEN idx >= 19 THEN round(y, 6) END AS ema FROM e""")
def _(t):
    return lines(av.ema(t.hourly, 20), "ema")


@query("ind03_ema_sma_seeded", f"""
WITH {HOURLY}, s AS (SELECT symbol, idx, close, avg(close) {last(20)} AS first FROM bars),
{smooth("e", "s", "close", "(2.0::DOUBLE / 21)", 19, "first")}
SELECT b.symbol, b.idx, round(y, 6) AS ema FROM bars b LEFT JOIN e USING (symbol, idx)""")
def _(t):
    return lines(av.ema(t.hourly, 20, seed="sma"), "ema")


@query("ind04_wma", f"""
WITH {HOURLY}
SELECT t.symbol, t.idx,
       CASE WHEN t.idx >= 9 THEN round(sum(k.close * (10 - (t.idx - k.idx))) / 55, 6) END AS wma
FROM bars t JOIN bars k ON t.symbol = k.symbol AND k.idx BETWEEN t.idx - 9 AND t.idx
GROUP BY t.symbol, t.idx""")
def _(t):
    return lines(av.wma(t.hourly, 10), "wma")


@query("ind05_kama", f"""
WITH RECURSIVE {HOURLY},
d AS (SELECT *, abs(close - {lag("close")}) AS move, abs(close - {lag("close", 10)}) AS gone FROM bars),
f AS (SELECT symbol, idx, close,
        pow(coalesce(gone / nullif(sum(move) {last(10)}, 0), 0) * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) AS sc
      FROM d),
k AS (
  SELECT symbol, idx, close AS y FROM f WHERE idx = 9
  UNION ALL
  SELECT f.symbol, f.idx, k.y + f.sc * (f.close - k.y) FROM k JOIN f ON f.symbol = k.symbol AND f.idx = k.idx + 1)
SELECT b.symbol, b.idx, CASE WHEN b.idx >= 10 THEN round(y, 6) END AS kama
FROM bars b LEFT JOIN k USING (symbol, idx)""")
def _(t):
    return lines(av.kama(t.hourly, 10), "kama")


@query("ind06_tema", f"""
WITH {HOURLY}, {smooth("e1", "bars", "close", "(2.0::DOUBLE / 11)")},
{smooth("e2", "e1", "y", "(2.0::DOUBLE / 11)")}, {smooth("e3", "e2", "y", "(2.0::DOUBLE / 11)")}
SELECT symbol, idx, CASE WHEN idx >= 20 THEN round(3 * e1.y - 3 * e2.y + e3.y, 6) END AS tema
FROM e1 JOIN e2 USING (symbol, idx) JOIN e3 USING (symbol, idx)""")
def _(t):
    return lines(av.tema(t.hourly, 10), "tema")


@query("ind07_moving_average", simple(f"CASE WHEN idx >= 49 THEN avg(close) {last(50)} END", "sma"))
def _(t):
    return lines(av.moving_average(t.hourly, "sma", period=50), "sma")


MOVES = f"moves AS (SELECT symbol, idx, coalesce(close - {lag('close')}, 0) AS d FROM bars)"


@query("ind08_rsi", f"""
WITH {HOURLY}, {MOVES}, g AS (SELECT symbol, idx, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM moves),
{smooth("u", "g", "up", "(1.0::DOUBLE / 14)")}, {smooth("l", "g", "down", "(1.0::DOUBLE / 14)")}
SELECT symbol, idx, CASE WHEN idx >= 14 THEN round(CASE WHEN l.y > 0 THEN 100 - 100 / (1 + u.y / l.y)
       WHEN u.y > 0 THEN 100 END, 6) END AS rsi
FROM u JOIN l USING (symbol, idx)""")
def _(t):
    return lines(mo.rsi(t.hourly, 14), "rsi")


@query("ind09_macd", f"""
WITH {HOURLY}, {smooth("f", "bars", "close", "(2.0::DOUBLE / 13)")},
{smooth("s", "bars", "close", "(2.0::DOUBLE / 27)")},
m AS (SELECT symbol, idx, f.y - s.y AS y FROM f JOIN s USING (symbol, idx)),
{smooth("g", "m", "y", "(2.0::DOUBLE / 10)", 25)}
SELECT m.symbol, m.idx, CASE WHEN m.idx >= 25 THEN round(m.y, 6) END AS macd,
       round(g.y, 6) AS signal, round(m.y - g.y, 6) AS histogram
FROM m LEFT JOIN g USING (symbol, idx)""")
def _(t):
    return lines(mo.macd(t.hourly), "macd", "signal", "histogram")


@query("ind10_stochastic", f"""
WITH {HOURLY},
r AS (SELECT *, CASE WHEN idx >= 13 THEN 100 * (close - min(low) {last(14)})
        / nullif(max(high) {last(14)} - min(low) {last(14)}, 0) END AS raw FROM bars),
k AS (SELECT *, CASE WHEN count(raw) {last(3)} = 3 THEN avg(raw) {last(3)} END AS stoch_k FROM r)
SELECT symbol, idx, round(stoch_k, 6) AS stoch_k,
       round(CASE WHEN count(stoch_k) {last(3)} = 3 THEN avg(stoch_k) {last(3)} END, 6) AS stoch_d
FROM k""")
def _(t):
    return lines(mo.stochastic(t.hourly), "stoch_k", "stoch_d")


@query("ind11_williams_r", simple(
    f"CASE WHEN idx >= 13 THEN -100 * (max(high) {last(14)} - close) "
    f"/ nullif(max(high) {last(14)} - min(low) {last(14)}, 0) END", "williams_r"))
def _(t):
    return lines(mo.williams_r(t.hourly, 14), "williams_r")


@query("ind12_roc", simple(f"100 * (close - {lag('close', 12)}) / {lag('close', 12)}", "roc", 5))
def _(t):
    return lines(mo.roc(t.hourly, 12), "roc", digits=5)


@query("ind13_cci", f"""
WITH {HOURLY}, p AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
m AS (SELECT *, avg(tp) {last(20)} AS mean FROM p)
SELECT t.symbol, t.idx, CASE WHEN t.idx >= 19 THEN
       round((any_value(t.tp) - any_value(t.mean)) / nullif(0.015 * avg(abs(k.tp - t.mean)), 0), 5) END AS cci
FROM m t JOIN m k ON t.symbol = k.symbol AND k.idx BETWEEN t.idx - 19 AND t.idx
GROUP BY t.symbol, t.idx""")
def _(t):
    return lines(mo.cci(t.hourly, 20), "cci", digits=5)


def bands(sd: str) -> str:
    return f"""
WITH {HOURLY}, m AS (SELECT symbol, idx, avg(close) {last(20)} AS a, {sd}(close) {last(20)} AS s FROM bars)
SELECT symbol, idx, CASE WHEN idx >= 19 THEN round(a, 6) END AS bb_middle,
       CASE WHEN idx >= 19 THEN round(a + 2 * s, 6) END AS bb_upper,
       CASE WHEN idx >= 19 THEN round(a - 2 * s, 6) END AS bb_lower FROM m"""


@query("ind14_bollinger", bands("stddev_samp"))
def _(t):
    return lines(vo.bollinger(t.hourly, 20), "bb_middle", "bb_upper", "bb_lower")


@query("ind15_bollinger_population", bands("stddev_pop"))
def _(t):
    return lines(vo.bollinger(t.hourly, 20, ddof=0), "bb_middle", "bb_upper", "bb_lower")


RANGE = f"""tr AS (
  SELECT symbol, idx, close, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr
  FROM bars)"""


@query("ind16_atr", f"""
WITH {HOURLY}, {RANGE}, {smooth("a", "tr", "tr", "(1.0::DOUBLE / 14)")}
SELECT symbol, idx, CASE WHEN idx >= 14 THEN round(y, 6) END AS atr FROM a""")
def _(t):
    return lines(vo.atr(t.hourly, 14), "atr")


@query("ind17_keltner", f"""
WITH {HOURLY}, {RANGE}, {smooth("a", "tr", "tr", "(1.0::DOUBLE / 10)")},
{smooth("m", "tr", "close", "(2.0::DOUBLE / 21)")}
SELECT symbol, idx, round(m.y, 6) AS kc_middle,
       CASE WHEN idx >= 10 THEN round(m.y + 2 * a.y, 6) END AS kc_upper,
       CASE WHEN idx >= 10 THEN round(m.y - 2 * a.y, 6) END AS kc_lower
FROM m JOIN a USING (symbol, idx)""")
def _(t):
    return lines(vo.keltner(t.hourly), "kc_middle", "kc_upper", "kc_lower")


@query("ind18_std", simple(f"CASE WHEN idx >= 19 THEN stddev_samp(close) {last(20)} END", "std"))
def _(t):
    return lines(vo.rolling_std(t.hourly, 20), "std")


@query("ind19_chaikin_volatility", f"""
WITH {HOURLY}, s AS (SELECT symbol, idx, high - low AS spread FROM bars),
{smooth("e", "s", "spread", "(2.0::DOUBLE / 11)")}
SELECT symbol, idx, round(100 * (y - {lag('y', 10)}) / nullif({lag('y', 10)}, 0), 4) AS chaikin_vol FROM e""")
def _(t):
    return lines(vo.chaikin_vol(t.hourly), "chaikin_vol", digits=4)


@query("ind20_historical_volatility", f"""
WITH {HOURLY}, r AS (SELECT symbol, idx, ln(close / {lag('close')}) AS r FROM bars)
SELECT symbol, idx, CASE WHEN idx >= 20 THEN round(stddev_samp(r) {last(20)} * sqrt(252.0::DOUBLE) * 100, 5) END AS hist_vol
FROM r""")
def _(t):
    return lines(vo.hist_vol(t.hourly, 20), "hist_vol", digits=5)


@query("ind21_safe_division", simple("(close - open) / nullif(high - low, 0)", "body_share"))
def _(t):
    df = fr.index_bars(t.hourly)
    share = av.safe_div(F.col("close") - F.col("open"), F.col("high") - F.col("low"))
    return lines(df.withColumn("body_share", share), "body_share")


@query("ind22_required_columns", f"""
WITH {HOURLY} SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 800 THEN 1 END AS long_enough,
       count(CASE WHEN idx >= 799 THEN 1 END) AS full_frames FROM bars GROUP BY symbol""")
def _(t):
    df = av.sma(t.hourly, 800)
    return fr.per_series(df, F.count("sma").alias("full_frames")).select(
        "symbol", "n", F.when(F.col("n") >= 800, 1).alias("long_enough"), "full_frames")


@query("rel12_last_bars", f"""
WITH {MINUTELY}, m AS (SELECT symbol, idx, n, avg(close) {last(20)} AS a, stddev_samp(close) {last(20)} AS s FROM bars)
SELECT symbol, idx, round(a, 6) AS sma, round(a + 2 * s, 6) AS bb_upper, round(a - 2 * s, 6) AS bb_lower
FROM m WHERE idx >= n - 20 AND idx >= 19""")
def _(t):
    # the frames of the last 20 rows reach 19 rows further back: the rest of a series is cut off before any frame is built
    recent = last_n(fr.index_bars(t.minutely), 39)
    df = last_n(vo.bollinger(av.sma(recent, 20), 20), 20).filter("idx >= 19")
    return lines(df, "sma", "bb_upper", "bb_lower")


@query("rel13_threshold_label", f"""
WITH {HOURLY}, w AS (SELECT symbol, idx, -100 * (max(high) {last(14)} - close)
   / nullif(max(high) {last(14)} - min(low) {last(14)}, 0) AS w FROM bars)
SELECT CASE WHEN idx < 13 OR w IS NULL THEN 'unknown' WHEN w > -20 THEN 'overbought' WHEN w < -80 THEN 'oversold' ELSE 'neutral' END AS label,
       count(*) AS bars FROM w GROUP BY 1""")
def _(t):
    df = mo.williams_r(t.hourly, 14)
    named = F.when(F.col("williams_r").isNull(), "unknown").otherwise(mo.label(F.col("williams_r"), -20, -80))
    return df.groupBy(named.alias("label")).agg(F.count(F.lit(1)).alias("bars"))
