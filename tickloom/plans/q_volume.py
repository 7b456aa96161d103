"""Volume indicators."""

from tickloom.operators import volume as vm
from tickloom.plans.catalog import lines, query, rounded
from tickloom.plans.sql import DAILY, HOURLY, SERIES, frame, lag, last, smooth

OBV = f"""
sg AS (SELECT *, CASE WHEN idx = 0 THEN volume ELSE sign(close - {lag('close')}) * volume END AS signed FROM bars),
o AS (SELECT *, sum(signed) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS obv FROM sg)"""


def divergence(line: str) -> str:
    w = frame(-10, -1)
    return f"""CASE WHEN idx >= 20 AND close > max(close) {w} AND {line} < max({line}) {w} THEN -1
      WHEN idx >= 20 AND close < min(close) {w} AND {line} > min({line}) {w} THEN 1 ELSE 0 END"""


@query("vol01_obv", f"""
WITH {HOURLY}, {OBV}, {smooth("e", "o", "obv", "(2.0::DOUBLE / 21)")}
SELECT o.symbol, o.idx, round(obv, 4) AS obv, round(e.y, 4) AS obv_line FROM o JOIN e USING (symbol, idx)""")
def _(t):
    return lines(vm.obv(t.hourly), "obv", "obv_line", digits=4)


@query("vol02_obv_divergence", f"""
WITH {HOURLY}, {OBV}, s AS (SELECT symbol, idx, {divergence("obv")} AS obv_signal FROM o)
SELECT symbol, idx, obv_signal FROM s WHERE obv_signal <> 0""")
def _(t):
    return vm.obv(t.hourly).filter("obv_signal <> 0").select("symbol", "idx", "obv_signal")


HALVES = """SELECT symbol, any_value(n) AS n, max(CASE WHEN idx = n - 1 THEN {x} END) AS last,
  avg(CASE WHEN n - idx <= 20 THEN {x} END) AS a, avg(CASE WHEN n - idx BETWEEN 21 AND 50 THEN {x} END) AS b,
  max(CASE WHEN idx = n - 20 AND n > 20 THEN {x} END) AS prior FROM {src} GROUP BY symbol"""


@query("vol03_obv_summary", f"""
WITH {HOURLY}, {OBV}, h AS ({HALVES.format(x="obv", src="o")})
SELECT symbol, n, round(last, 4) AS last_obv,
  CASE WHEN n >= 50 AND a > b * 1.05 THEN 'bullish' WHEN n >= 50 AND a < b * 0.95 THEN 'bearish' ELSE 'neutral' END AS trend,
  round(CASE WHEN n > 20 THEN 100 * (last - prior) / nullif(abs(prior), 0) ELSE 0 END, 4) AS change_pct FROM h""")
def _(t):
    return rounded(vm.obv_summary(vm.obv(t.hourly)), ["symbol", "n", "trend"], 4,
                   last_obv="last_obv", change_pct="change_pct")


VROC = f"""v AS (SELECT *, 100 * (volume - {lag('volume', 14)}) / nullif({lag('volume', 14)}, 0) AS vroc FROM bars)"""


@query("vol04_vroc", f"""
WITH {HOURLY}, {VROC}
SELECT symbol, idx, round(vroc, 4) AS vroc,
  round(CASE WHEN count(vroc) {last(3)} = 3 THEN avg(vroc) {last(3)} END, 4) AS vroc_smooth FROM v""")
def _(t):
    return lines(vm.vroc(t.hourly), "vroc", "vroc_smooth", digits=4)


@query("vol05_vroc_signals", f"""
WITH {HOURLY}, {VROC}, p AS (SELECT *, {lag('vroc')} AS was FROM v)
SELECT symbol, idx, CASE WHEN was <= 0 AND vroc > 0 THEN 1 WHEN was >= 0 AND vroc < 0 THEN -1 ELSE 0 END AS vroc_signal,
  CASE WHEN was IS NOT NULL AND vroc > 50 THEN 'overbought' WHEN was IS NOT NULL AND vroc < -50 THEN 'oversold' END AS vroc_extreme
FROM p""")
def _(t):
    return vm.vroc(t.hourly).select("symbol", "idx", "vroc_signal", "vroc_extreme")


@query("vol05_vroc_trend", f"""
WITH {HOURLY}, {VROC}, m AS (SELECT symbol, any_value(n) AS n, max(CASE WHEN idx = n - 1 THEN vroc END) AS cur,
  avg(CASE WHEN n - idx <= 5 THEN vroc END) AS a, count(CASE WHEN n - idx <= 5 THEN vroc END) AS c FROM v GROUP BY symbol)
SELECT symbol, n, round(cur, 4) AS current_vroc,
  CASE WHEN n >= 10 AND c = 5 AND a > 10 THEN 'increasing_volume' WHEN n >= 10 AND c = 5 AND a < -10 THEN 'decreasing_volume'
  ELSE 'neutral' END AS trend FROM m""")
def _(t):
    return rounded(vm.vroc_summary(vm.vroc(t.hourly)), ["symbol", "n", "trend"], 4, current_vroc="current_vroc")


def vwap_sql(anchor: str | None) -> str:
    part = f", date_trunc('{anchor}', ts)" if anchor else ""
    run = f"OVER (PARTITION BY symbol{part} ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    return f"""
tp AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
vw AS (SELECT *, sum(tp * volume) {run} / nullif(sum(volume) {run}, 0) AS vwap FROM tp),
vd AS (SELECT *, sqrt(sum(pow(tp - vwap, 2) * volume) OVER ({SERIES} ROWS UNBOUNDED PRECEDING)
  / nullif(sum(volume) OVER ({SERIES} ROWS UNBOUNDED PRECEDING), 0)) AS sd FROM vw)"""


@query("vol06_vwap_session", f"WITH {HOURLY}, {vwap_sql('day')} SELECT symbol, idx, round(vwap, 6) AS vwap FROM vd")
def _(t):
    return lines(vm.vwap(t.hourly), "vwap")


@query("vol06_vwap_week", f"WITH {HOURLY}, {vwap_sql('week')} SELECT symbol, idx, round(vwap, 6) AS vwap FROM vd")
def _(t):
    return lines(vm.vwap(t.hourly, "week"), "vwap")


@query("vol06_vwap_month", f"WITH {DAILY}, {vwap_sql('month')} SELECT symbol, idx, round(vwap, 4) AS vwap FROM vd")
def _(t):
    return lines(vm.vwap(t.daily, "month"), "vwap", digits=4)


@query("vol06_vwap_series", f"WITH {HOURLY}, {vwap_sql(None)} SELECT symbol, idx, round(vwap, 5) AS vwap FROM vd")
def _(t):
    return lines(vm.vwap(t.hourly, "series"), "vwap", digits=5)


@query("vol07_vwap_bands", f"""
WITH {HOURLY}, {vwap_sql('day')}
SELECT symbol, idx, round(vwap + sd, 5) AS vwap_upper_1, round(vwap - sd, 5) AS vwap_lower_1,
  round(vwap + 2 * sd, 5) AS vwap_upper_2, round(vwap - 2 * sd, 5) AS vwap_lower_2 FROM vd""")
def _(t):
    return lines(vm.vwap(t.hourly), "vwap_upper_1", "vwap_lower_1", "vwap_upper_2", "vwap_lower_2", digits=5)


VWAP_SIGNAL = f"""CASE WHEN idx = 0 OR vwap IS NULL OR sd IS NULL THEN 0
  WHEN {lag('close')} < {lag('vwap')} AND close > vwap THEN 1
  WHEN {lag('close')} > {lag('vwap')} AND close < vwap THEN -1
  WHEN close <= vwap - 2 * sd THEN 2 WHEN close >= vwap + 2 * sd THEN -2 ELSE 0 END"""


@query("vol08_vwap_signals", f"""
WITH {HOURLY}, {vwap_sql('week')} SELECT symbol, idx, {VWAP_SIGNAL} AS vwap_signal FROM vd""")
def _(t):
    return vm.vwap(t.hourly, "week").select("symbol", "idx", "vwap_signal")


@query("vol08_vwap_position", f"""
WITH {HOURLY}, {vwap_sql('day')}
SELECT symbol, n, round(vwap, 6) AS current_vwap, CASE WHEN close > vwap + sd THEN 'above_upper_band'
  WHEN close > vwap THEN 'above_vwap' WHEN close < vwap - sd THEN 'below_lower_band'
  WHEN close < vwap THEN 'below_vwap' ELSE 'at_vwap' END AS price_position FROM vd WHERE idx = n - 1""")
def _(t):
    return rounded(vm.vwap_position(vm.vwap(t.hourly)), ["symbol", "n", "price_position"], current_vwap="current_vwap")


AD = f"""
mf AS (SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS mf FROM bars),
ad AS (SELECT *, sum(mf) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS ad FROM mf),
{smooth("l", "ad", "ad", "0.5::DOUBLE")},
al AS (SELECT ad.*, l.y AS ad_line FROM ad JOIN l USING (symbol, idx))"""
AD_SIGNAL = f"""CASE WHEN ({divergence("ad")}) <> 0 THEN ({divergence("ad")})
  WHEN {lag('ad')} < {lag('ad_line')} AND ad > ad_line THEN 0.5
  WHEN {lag('ad')} > {lag('ad_line')} AND ad < ad_line THEN -0.5 ELSE 0 END"""


@query("vol09_ad_line", f"""
WITH {HOURLY}, {AD} SELECT symbol, idx, round(ad, 4) AS ad, round(ad_line, 4) AS ad_line FROM al""")
def _(t):
    return lines(vm.ad_line(t.hourly), "ad", "ad_line", digits=4)


@query("vol10_ad_signals", f"""
WITH {HOURLY}, {AD} SELECT symbol, idx, CAST({AD_SIGNAL} AS DOUBLE) AS ad_signal FROM al""")
def _(t):
    return vm.ad_line(t.hourly).select("symbol", "idx", "ad_signal")


@query("vol10_ad_trend", f"""
WITH {HOURLY}, {AD}, h AS ({HALVES.format(x="ad", src="al")})
SELECT symbol, n, round(last, 4) AS current_ad,
  CASE WHEN n >= 50 AND a > b * 1.05 THEN 'accumulation' WHEN n >= 50 AND a < b * 0.95 THEN 'distribution' ELSE 'neutral' END AS trend
FROM h""")
def _(t):
    return rounded(vm.ad_summary(vm.ad_line(t.hourly)), ["symbol", "n", "trend"], 4, current_ad="current_ad")


SPIKES = f"""
ma AS (SELECT *, avg(volume) {last(20)} AS ma, stddev_samp(volume) {last(20)} AS sd, {lag('close')} AS was FROM bars),
z AS (SELECT *, (volume - ma) / nullif(sd, 0) AS z FROM ma),
sp AS (SELECT *, volume / ma AS ratio, CASE WHEN idx >= 20 AND (volume > 2 * ma OR coalesce(abs(z), 0) > 2) THEN 1 ELSE 0 END AS hit FROM z)"""


@query("vol11_volume_spikes", f"""
WITH {HOURLY}, {SPIKES}
SELECT symbol, idx, round(ma, 6) AS volume_ma, round(ratio, 6) AS spike_ratio, round(z, 6) AS z_score FROM sp WHERE hit = 1""")
def _(t):
    return lines(vm.volume_spikes(t.hourly), "volume_ma", "spike_ratio", "z_score")


@query("vol12_spike_class", f"""
WITH {HOURLY}, {SPIKES}
SELECT symbol, idx, CASE WHEN ratio > 5 THEN 'extreme' WHEN ratio > 3 THEN 'high' WHEN ratio > 2 THEN 'moderate' ELSE 'mild' END AS magnitude,
  CASE WHEN (close - was) / was * 100 > 1 THEN 'bullish' WHEN (close - was) / was * 100 < -1 THEN 'bearish' ELSE 'neutral' END AS price_action
FROM sp WHERE hit = 1""")
def _(t):
    return vm.volume_spikes(t.hourly).select("symbol", "idx", "magnitude", "price_action")


@query("vol13_spike_summary", f"""
WITH {HOURLY}, {SPIKES}, h AS (SELECT *, lead(idx, 2) OVER ({SERIES}) - idx AS gap FROM sp WHERE hit = 1),
a AS (SELECT symbol, count(*) AS spikes, count(CASE WHEN n - idx <= 20 THEN 1 END) AS new,
  bool_or(coalesce(gap <= 5, false)) AS c, avg(ratio) AS avg_ratio, max(ratio) AS max_ratio FROM h GROUP BY symbol),
b AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)
SELECT symbol, n, coalesce(spikes, 0) AS spikes, CASE WHEN spikes IS NULL THEN 'no_spikes' WHEN c THEN 'clustered' ELSE 'none' END AS pattern,
  CASE WHEN coalesce(spikes, 0) < 2 THEN 'insufficient_data' WHEN new > spikes - new THEN 'increasing'
    WHEN new < spikes - new THEN 'decreasing' ELSE 'stable' END AS trend,
  round(100.0::DOUBLE * coalesce(spikes, 0) / n, 6) AS frequency, round(avg_ratio, 6) AS avg_ratio, round(max_ratio, 6) AS max_ratio
FROM b LEFT JOIN a USING (symbol)""")
def _(t):
    df = vm.spike_summary(t.hourly, vm.volume_spikes(t.hourly))
    return rounded(df, ["symbol", "n", "spikes", "pattern", "trend"], frequency="frequency",
                   avg_ratio="avg_ratio", max_ratio="max_ratio")


@query("vol14_volume_composite", f"""
WITH {HOURLY}, {OBV}, {VROC}, {vwap_sql('day')}, {AD}, {SPIKES},
s AS (
  SELECT symbol, n, idx, {divergence("obv")} AS s FROM o
  UNION ALL SELECT symbol, n, idx, CASE WHEN {lag('vroc')} <= 0 AND vroc > 0 THEN 1 WHEN {lag('vroc')} >= 0 AND vroc < 0 THEN -1 ELSE 0 END FROM v
  UNION ALL SELECT symbol, n, idx, {VWAP_SIGNAL} FROM vd
  UNION ALL SELECT symbol, n, idx, {AD_SIGNAL} FROM al
  UNION ALL SELECT symbol, n, idx, hit FROM sp),
m AS (SELECT symbol, any_value(n) AS n, coalesce(avg(CASE WHEN s <> 0 THEN CAST(s AS DOUBLE) END), 0) AS score FROM s WHERE idx = n - 1 GROUP BY symbol)
SELECT symbol, n, round(score, 6) AS score, CASE WHEN score > 0.5 THEN 'strong_buy' WHEN score > 0 THEN 'buy'
  WHEN score < -0.5 THEN 'strong_sell' WHEN score < 0 THEN 'sell' ELSE 'neutral' END AS signal FROM m""")
def _(t):
    return rounded(vm.volume_composite(t.hourly), ["symbol", "n", "signal"], score="score")
