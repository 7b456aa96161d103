"""Price against volume."""

from pyspark.sql import functions as F

from tickloom.operators import candles as ca
from tickloom.operators import volprice as vp
from tickloom.plans.catalog import lines, query, rounded
from tickloom.plans.sql import CALM, DAILY, HOURLY, frame, lag, last, lead


def clean(expr: str) -> str:
    """A correlation, null instead of NaN."""
    return f"CASE WHEN NOT isnan({expr}) THEN {expr} END"


CHANGES = f"""ch AS (SELECT *, (close - {lag('close')}) / nullif({lag('close')}, 0) AS dp,
  (volume - {lag('volume')}) / nullif({lag('volume')}, 0) AS dv FROM bars),
co AS (SELECT *, CASE WHEN count(dp) {last(20)} = 20 AND count(dv) {last(20)} = 20 THEN {clean(f"corr(dp, dv) {last(20)}")} END AS pv FROM ch)"""


@query("vpa01_price_volume_correlation", f"WITH {HOURLY}, {CHANGES} SELECT symbol, idx, round(pv, 6) AS pv_corr FROM co")
def _(t):
    return lines(vp.pv_corr(t.hourly), "pv_corr")


def extremum(op: str, fn: str, k: int = 5) -> str:
    return f"idx > 0 AND idx < n - 1 AND close {op} {fn}(close) {frame(-k, -1)} AND close {op} {fn}(close) {frame(1, k)}"


DIVERGE = f"""{CHANGES},
m AS (SELECT *, avg(volume) {frame(-5, 0)} AS v6, {extremum('>', 'max')} AS pk, {extremum('<', 'min')} AS tr,
  close > {lag('close')} AND close > {lead('close')} AS p3, close < {lag('close')} AND close < {lead('close')} AS t3 FROM co),
c AS (SELECT a.symbol, a.idx, a.pk, max(b.idx) AS prev FROM m a JOIN m b ON a.symbol = b.symbol AND b.idx BETWEEN a.idx - 40 AND a.idx - 6
  AND CASE WHEN a.pk THEN b.p3 ELSE b.t3 END WHERE (a.pk OR a.tr) AND a.n >= 40 AND a.idx >= 20 AND a.idx < a.n - 5 GROUP BY 1, 2, 3),
d AS (SELECT c.symbol, c.idx, c.pk, c.prev, (a.close - p.close) / p.close AS dp, (a.v6 - p.v6) / p.v6 AS dv,
  (SELECT avg(k.pv) FROM co k WHERE k.symbol = c.symbol AND k.idx >= c.prev AND k.idx < c.idx) AS corr
  FROM c JOIN m a ON a.symbol = c.symbol AND a.idx = c.idx JOIN m p ON p.symbol = c.symbol AND p.idx = c.prev)
SELECT symbol, CASE WHEN pk THEN 'bearish' ELSE 'bullish' END AS divergence_type, prev AS start_idx, idx AS end_idx,
  round(dp * 100, 5) AS price_change_pct, round(dv * 100, 5) AS volume_change_pct, round(least(1, abs(dv) / (abs(dp) + 0.001)), 5) AS strength,
  coalesce(corr < 0, false) AS confirmed, round(corr, 5) AS correlation FROM d"""
DIV_COLS = {c: c for c in ("price_change_pct", "volume_change_pct", "strength", "correlation")}


@query("vpa02_peak_divergence", f"WITH {HOURLY}, {DIVERGE} WHERE pk AND dp > 0 AND dv < -0.1")
def _(t):
    df = vp.pv_divergence(t.hourly).filter("divergence_type = 'bearish'")
    return rounded(df, ["symbol", "divergence_type", "start_idx", "end_idx", "confirmed"], 5, **DIV_COLS)


@query("vpa03_trough_divergence", f"WITH {HOURLY}, {DIVERGE} WHERE NOT pk AND dp < 0 AND dv > 0.1")
def _(t):
    df = vp.pv_divergence(t.hourly).filter("divergence_type = 'bullish'")
    return rounded(df, ["symbol", "divergence_type", "start_idx", "end_idx", "confirmed"], 5, **DIV_COLS)


@query("vpa04_continuous_divergence", f"""
WITH RECURSIVE {HOURLY},
g AS (SELECT *, CASE WHEN idx >= 19 THEN regr_slope(close, idx) {last(20)} / avg(close) {last(20)} END AS pt,
  CASE WHEN idx >= 19 THEN regr_slope(volume, idx) {last(20)} / avg(volume) {last(20)} END AS vt FROM bars),
st AS (SELECT *, CASE WHEN pt > 0 AND vt < 0 THEN 1 WHEN pt < 0 AND vt > 0 THEN 2 ELSE 0 END AS st,
  abs(pt) > 0.01 AND abs(vt) > 0.01 AND idx >= 20 AND idx < n - 20 AS strong FROM g),
e AS (SELECT a.symbol, a.idx, a.st, coalesce(min(b.idx), any_value(a.n) - 1) AS stop FROM st a LEFT JOIN st b
  ON a.symbol = b.symbol AND b.idx > a.idx AND b.st <> a.st WHERE a.strong AND a.st > 0 GROUP BY 1, 2, 3),
r AS (
  SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS rn FROM e) WHERE rn = 1
  UNION ALL
  SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.symbol ORDER BY e.idx) AS rn FROM r JOIN e ON e.symbol = r.symbol AND e.idx > r.stop) WHERE rn = 1)
SELECT r.symbol, CASE r.st WHEN 1 THEN 'bearish' ELSE 'bullish' END AS divergence_type, r.idx - 20 AS start_idx, r.stop AS end_idx,
  round(100 * (z.close - a.close) / a.close, 5) AS price_change_pct, round(100 * (z.volume - a.volume) / nullif(a.volume, 0), 5) AS volume_change_pct,
  round(least(1, abs(i.vt) / abs(i.pt)), 5) AS strength
FROM r JOIN st i ON i.symbol = r.symbol AND i.idx = r.idx JOIN st a ON a.symbol = r.symbol AND a.idx = r.idx - 20
JOIN st z ON z.symbol = r.symbol AND z.idx = r.stop""")
def _(t):
    df = vp.continuous_divergence(t.hourly)
    return rounded(df, ["symbol", "divergence_type", "start_idx", "end_idx"], 5,
                   **{c: c for c in ("price_change_pct", "volume_change_pct", "strength")})


UNUSUAL = f"""u AS (SELECT *, avg(volume) {last(20)} AS mean, stddev_samp(volume) {last(20)} AS sd, {lag('close')} AS was,
  max(close) {frame(-20, -1)} AS hi, min(close) {frame(-20, -1)} AS lo, stddev_samp(close) {frame(-5, 0)} / avg(close) {frame(-5, 0)} AS quiet,
  avg(close) {last(50)} AS m50, max(close) {frame(-50, -1)} AS top, avg(volume) {frame(-10, -1)} AS v10 FROM bars),
w AS (SELECT *, max(CASE WHEN close < was THEN volume END) {frame(-10, -1)} AS md, (volume - mean) / nullif(sd, 0) AS z, volume / nullif(mean, 0) AS ratio,
  (high - low) / close AS spread FROM u)"""


def unusual(select: str, where: str, base: str = HOURLY) -> str:
    return f"WITH {base}, {UNUSUAL} SELECT symbol, idx AS end_idx, {select} FROM w WHERE {where}"


def finding(df, *meta, conf=True):
    m = F.col("metadata")
    cols = [F.round("confidence", 5).alias("significance")] if conf else []
    return df.select("symbol", "end_idx", "pattern_name", *cols, *[F.round(m[k], 5).alias(k) for k in meta])


@query("vpa05_volume_climax", unusual(
    "CASE WHEN close > was THEN 'buying_climax' WHEN close < was THEN 'selling_climax' ELSE 'volume_climax' END AS pattern_name, "
    "round(z, 5) AS z_score, round(ratio, 5) AS volume_ratio, round(close - was, 5) AS price_change", "idx >= 20 AND z > 3"))
def _(t):
    return finding(vp.unusual_volume(t.hourly, groups=["climax"]), "z_score", "volume_ratio", "price_change", conf=False)


@query("vpa06_volume_dry_up", unusual(
    "'volume_dry_up' AS pattern_name, round(ratio, 5) AS significance, round(quiet, 5) AS price_volatility, "
    "CAST(CAST(quiet < 0.01 AS INTEGER) AS DOUBLE) AS potential_breakout", "idx >= 20 AND ratio < 0.5", CALM))
def _(t):
    return finding(vp.unusual_volume(t.calm, groups=["dry_up"]), "price_volatility", "potential_breakout")


@query("vpa07_volume_breakout", unusual(
    "CASE WHEN close > hi THEN 'volume_breakout_up' ELSE 'volume_breakout_down' END AS pattern_name, round(least(1, ratio / 2), 5) AS significance, "
    "round(CASE WHEN close > hi THEN hi ELSE lo END, 5) AS breakout_level, round(CASE WHEN close > hi THEN (close - hi) / hi ELSE (lo - close) / lo END, 5) AS price_move",
    "idx >= 20 AND ratio > 1.5 AND (close > hi OR close < lo)"))
def _(t):
    return finding(vp.unusual_volume(t.hourly, groups=["breakout"]), "breakout_level", "price_move")


@query("vpa08_churning", unusual(
    "'volume_churning' AS pattern_name, round(ratio * (1 - spread), 5) AS significance, round(spread, 5) AS daily_range, "
    "CAST(CAST(idx >= 50 AND close > m50 AS INTEGER) AS DOUBLE) AS potential_distribution", "idx >= 20 AND ratio > 1.5 AND spread < 0.01", CALM))
def _(t):
    return finding(vp.unusual_volume(t.calm, groups=["churning"]), "daily_range", "potential_distribution")


@query("vpa09_pocket_pivot", unusual(
    "'pocket_pivot' AS pattern_name, CAST(CASE WHEN close >= top * 0.95 THEN 0.8 ELSE 0.5 END AS DOUBLE) AS significance, round(md, 5) AS max_down_volume, "
    "round(volume / nullif(md, 0), 5) AS volume_ratio, round((close - was) / was, 5) AS price_change", "idx >= 10 AND close > was AND volume > md"))
def _(t):
    return finding(vp.unusual_volume(t.hourly, groups=["pocket_pivot"]), "max_down_volume", "volume_ratio", "price_change")


@query("vpa10_wyckoff", f"""
WITH {CALM}, w AS (SELECT *, max(high) {frame(-40, -1)} AS hi, min(low) {frame(-40, -1)} AS lo, avg(close) {frame(-40, -1)} AS m,
  avg(volume) {frame(-40, -21)} AS v1, avg(volume) {frame(-20, -1)} AS v2 FROM bars),
p AS (SELECT *, CASE WHEN v2 < v1 * 0.8 AND close > m THEN 'accumulation' WHEN v2 > v1 * 1.2 AND close < m THEN 'distribution' END AS phase
  FROM w WHERE idx >= 40 AND (hi - lo) / close < 0.15)
SELECT symbol, idx, phase, CASE WHEN phase = 'accumulation' AND close < lo * 1.02 THEN 'spring' WHEN phase = 'accumulation' THEN 'markup'
  WHEN close > hi * 0.98 THEN 'upthrust' ELSE 'markdown' END AS stage, round(hi, 5) AS range_high, round(lo, 5) AS range_low,
  CASE phase WHEN 'accumulation' THEN 'decreasing' ELSE 'increasing' END AS volume_pattern FROM p WHERE phase IS NOT NULL""")
def _(t):
    return rounded(vp.wyckoff(t.calm), ["symbol", "idx", "phase", "stage", "volume_pattern"], 5,
                   range_high="range_high", range_low="range_low")


BANDS = """e AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY 1),
b AS (SELECT symbol, CAST(floor((close - lo) / ((hi - lo) / 20)) AS BIGINT) AS bin, sum(volume) AS v FROM bars JOIN e USING (symbol) GROUP BY 1, 2),
p AS (SELECT symbol, g.bin, lo + g.bin * ((hi - lo) / 20) AS bin_low, lo + (g.bin + 1) * ((hi - lo) / 20) AS bin_high, coalesce(v, 0) AS v
  FROM e CROSS JOIN (SELECT unnest(range(20)) AS bin) g LEFT JOIN b USING (symbol, bin))"""


@query("vpa11_volume_by_price", f"""
WITH {HOURLY}, {BANDS} SELECT symbol, bin, round(bin_low, 5) AS bin_low, round(bin_high, 5) AS bin_high, round(v, 4) AS volume FROM p""")
def _(t):
    return rounded(vp.volume_by_price(t.hourly), ["symbol", "bin"], 5, bin_low="bin_low", bin_high="bin_high", volume=F.round("volume", 4))


@query("vpa11_value_area", f"""
WITH {HOURLY}, {BANDS}, c AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY bin) AS cum, sum(v) OVER (PARTITION BY symbol) AS total FROM p)
SELECT symbol, round(arg_max((bin_low + bin_high) / 2, (v, -bin)), 5) AS poc, round(min(CASE WHEN cum >= total * 0.85 THEN bin_high END), 5) AS value_area_high,
  round(min(CASE WHEN cum >= total * 0.15 THEN bin_low END), 5) AS value_area_low, round(sum(v), 4) AS total_volume FROM c GROUP BY 1""")
def _(t):
    df = vp.value_area_by_price(vp.volume_by_price(t.hourly))
    return rounded(df, ["symbol"], 5, poc="poc", value_area_high="value_area_high", value_area_low="value_area_low",
                   total_volume=F.round("total_volume", 4))


@query("vpa12_smart_money_flow", f"""
WITH {HOURLY}, f AS (SELECT *, CASE WHEN idx = 0 THEN 0 WHEN close > {lag('close')} THEN (high + low + close) / 3 * volume
  ELSE -(high + low + close) / 3 * volume END AS fl FROM bars)
SELECT symbol, idx, CASE WHEN idx >= 19 THEN round(sum(fl) {last(20)}, 4) END AS smart_money FROM f""")
def _(t):
    return lines(vp.smart_money_flow(t.hourly), "smart_money", digits=4)


def day(cond: str) -> str:
    return f"""WITH {DAILY}, d AS (SELECT *, {lag('close')} AS was, CASE WHEN idx >= 49 THEN avg(volume) {last(50)} END AS v50 FROM bars)
SELECT symbol, idx, round(close, 8) AS close FROM d WHERE {cond} AND volume > v50 * 1.1"""


@query("vpa13_accumulation_days", day("close > was * 1.002"))
def _(t):
    return lines(vp.accumulation_days(t.daily), "close", digits=8)


@query("vpa14_distribution_days", day("close < was * 0.998"))
def _(t):
    return lines(vp.distribution_days(t.daily), "close", digits=8)


def kinds(col: str = "pattern_name") -> str:
    return f"CASE WHEN {col} LIKE '%star' THEN 'reversal' WHEN {col} LIKE 'three%' THEN 'continuation' WHEN {col} LIKE '%engulfing' THEN 'breakout' ELSE 'candlestick' END"


@query("vpa15_volume_confirmation", f"""
WITH {HOURLY}, s AS (SELECT *, close - open AS mv, {lag('open')} AS o1, {lag('close')} AS c1, {lag('open', 2)} AS o2, {lag('close', 2)} AS c2 FROM bars),
p AS (SELECT symbol, 'morning_star' AS name, 'reversal' AS kind, idx - 2 AS s, idx AS e FROM s WHERE c2 < o2 AND abs(c1 - o1) < abs(c2 - o2) * 0.3 AND mv > 0 AND close > (o2 + c2) / 2
UNION ALL SELECT symbol, 'evening_star', 'reversal', idx - 2, idx FROM s WHERE c2 > o2 AND abs(c1 - o1) < abs(c2 - o2) * 0.3 AND mv < 0 AND close < (o2 + c2) / 2
UNION ALL SELECT symbol, 'bullish_engulfing', 'breakout', idx - 1, idx FROM s WHERE c1 < o1 AND mv > 0 AND open < c1 AND close > o1
UNION ALL SELECT symbol, 'bearish_engulfing', 'breakout', idx - 1, idx FROM s WHERE c1 > o1 AND mv < 0 AND open > c1 AND close < o1
UNION ALL SELECT symbol, 'three_white_soldiers', 'continuation', idx - 2, idx FROM s WHERE c2 > o2 AND c1 > o1 AND mv > 0 AND c1 > c2 AND close > c1 AND o1 > o2 AND open > o1
UNION ALL SELECT symbol, 'three_black_crows', 'continuation', idx - 2, idx FROM s WHERE c2 < o2 AND c1 < o1 AND mv < 0 AND c1 < c2 AND close < c1 AND o1 < o2 AND open < o1),
v AS (SELECT p.symbol, name, kind, s, e, avg(b.volume) FILTER (b.idx BETWEEN s AND e) AS pv, regr_slope(b.volume, b.idx) FILTER (b.idx BETWEEN s AND e) AS sl,
  coalesce(avg(b.volume) FILTER (b.idx < s), max(b.volume) FILTER (b.idx = 0)) AS base, max(b.volume) FILTER (b.idx = s) AS v1, max(b.volume) FILTER (b.idx = e) AS v2
  FROM p JOIN bars b ON b.symbol = p.symbol AND b.idx BETWEEN s - 20 AND e GROUP BY ALL),
r AS (SELECT *, CASE WHEN base > 0 THEN pv / base ELSE 0 END AS r FROM v)
SELECT symbol || ':' || name || ':' || e AS pattern_id, CASE kind WHEN 'breakout' THEN r >= 1.5 WHEN 'reversal' THEN r > 1.2 AND sl > 0 ELSE r > 0.8 END AS confirmed,
  round(least(1, CASE kind WHEN 'breakout' THEN r / 2 WHEN 'reversal' THEN r / 1.5 ELSE r END), 5) AS confidence, round(r, 5) AS volume_ratio,
  round(base, 4) AS baseline_volume, round(pv, 4) AS pattern_volume, CASE WHEN v2 > v1 THEN 'increasing' ELSE 'decreasing' END AS volume_trend FROM r""")
def _(t):
    found = ca.candlestick_patterns(t.hourly, groups=["morning_star", "evening_star", "engulfing", "soldiers"])
    named = found.withColumn("pattern_type", F.expr(kinds())).withColumn(
        "pattern_id", F.concat_ws(":", "symbol", "pattern_name", "end_idx"))
    df = vp.confirm_volume(named, t.hourly)
    return rounded(df, ["pattern_id", "confirmed", "volume_trend"], 5, confidence="confidence", volume_ratio="volume_ratio",
                   baseline_volume=F.round("baseline_volume", 4), pattern_volume=F.round("pattern_volume", 4))


PROFILE = """e AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY 1),
x AS (SELECT symbol, volume, CAST(ceil((low - lo) / ((hi - lo) / 30)) AS BIGINT) AS a, CAST(floor((high - lo) / ((hi - lo) / 30)) AS BIGINT) + 1 AS b FROM bars JOIN e USING (symbol)),
s AS (SELECT symbol, unnest(range(a, least(b, 30))) AS bin, volume / (b - a) AS share FROM x WHERE b > a),
pr AS (SELECT symbol, g.bin, any_value(lo) + g.bin * (any_value(hi - lo) / 30) AS bin_low, any_value(lo) + (g.bin + 1) * (any_value(hi - lo) / 30) AS bin_high,
  coalesce(sum(share), 0) AS v FROM e CROSS JOIN (SELECT unnest(range(30)) AS bin) g LEFT JOIN s USING (symbol, bin) GROUP BY 1, 2)"""
AREA = """ar AS (SELECT *, sum(v) OVER (PARTITION BY symbol) AS total,
  coalesce(sum(v) OVER (PARTITION BY symbol ORDER BY v DESC, bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr),
va AS (SELECT symbol, arg_max((bin_low + bin_high) / 2, (v, -bin)) AS poc, max(v) AS poc_volume, max(CASE WHEN before < total * 0.7 THEN bin_high END) AS vah,
  min(CASE WHEN before < total * 0.7 THEN bin_low END) AS val, sum(v) AS total, sum(CASE WHEN before < total * 0.7 THEN v END) AS area FROM ar GROUP BY 1)"""


@query("vpa16_volume_profile", f"""
WITH {HOURLY}, {PROFILE} SELECT symbol, bin, round(bin_low, 5) AS bin_low, round(bin_high, 5) AS bin_high, round(v, 4) AS volume FROM pr""")
def _(t):
    return rounded(vp.volume_profile(t.hourly), ["symbol", "bin"], 5, bin_low="bin_low", bin_high="bin_high", volume=F.round("volume", 4))


@query("vpa17_profile_value_area", f"""
WITH {HOURLY}, {PROFILE}, {AREA}
SELECT symbol, round(poc, 5) AS poc, round(vah, 5) AS value_area_high, round(val, 5) AS value_area_low, round(total, 4) AS total_volume,
  round(area, 4) AS value_area_volume, round(100 * area / total, 5) AS value_area_percentage FROM va""")
def _(t):
    df = vp.profile_value_area(vp.volume_profile(t.hourly))
    return rounded(df, ["symbol"], 5, poc="poc", value_area_high="value_area_high", value_area_low="value_area_low",
                   total_volume=F.round("total_volume", 4), value_area_volume=F.round("value_area_volume", 4),
                   value_area_percentage="value_area_percentage")


@query("vpa18_profile_levels", f"""
WITH {HOURLY}, {PROFILE}, {AREA}, q AS (SELECT symbol, quantile_cont(v, 0.7) AS hi, quantile_cont(v, 0.3) AS lo FROM pr GROUP BY 1),
l AS (SELECT symbol, CASE WHEN v > q.hi THEN 'hvn' ELSE 'lvn' END AS level_type, (bin_low + bin_high) / 2 AS price, v AS volume,
  CASE WHEN v > q.hi THEN v / total ELSE 1 - v / total END AS strength FROM pr JOIN q USING (symbol) JOIN va USING (symbol) WHERE v > q.hi OR (v < q.lo AND v > 0)
UNION ALL SELECT symbol, 'poc', poc, poc_volume, 1.0 FROM va UNION ALL SELECT symbol, 'value_area_high', vah, NULL, 0.8 FROM va
UNION ALL SELECT symbol, 'value_area_low', val, NULL, 0.8 FROM va)
SELECT symbol, level_type, round(price, 5) AS price, round(volume, 4) AS volume, round(CAST(strength AS DOUBLE), 5) AS strength FROM l""")
def _(t):
    df = vp.profile_levels(vp.volume_profile(t.hourly))
    return rounded(df, ["symbol", "level_type"], 5, price="price", volume=F.round("volume", 4), strength="strength")


@query("vpa19_volume_signal_strength", f"""
WITH {HOURLY}, {CHANGES},
m AS (SELECT *, avg(volume) {frame(-20, -1)} AS mean, stddev_samp(volume) {frame(-20, -1)} AS sd, regr_slope(volume, idx) {frame(-20, -1)} AS sl,
  avg(volume) {frame(-50, -1)} AS lg, {clean(f"corr(dp, dv) {frame(-19, -1)}")} AS cr, least(count(dp) {frame(-19, -1)}, count(dv) {frame(-19, -1)}) AS k FROM ch),
p AS (SELECT symbol, idx, least(1, volume / mean / 2) AS a, least(1, abs(sl / mean) * 10) AS b,
  CASE WHEN idx >= 50 THEN least(1, volume / lg) ELSE least(1, volume / mean / 2) END AS c, greatest(0, 1 - coalesce(sd / mean, 1)) AS d,
  CASE WHEN k > 2 THEN coalesce(abs(cr), 0) ELSE 0 END AS e FROM m),
s AS (SELECT *, CASE WHEN idx >= 2 THEN a * 0.3 + b * 0.2 + c * 0.2 + d * 0.15 + e * 0.15 ELSE 0 END AS strength FROM p)
SELECT symbol, idx, CASE WHEN idx >= 2 THEN round(a, 5) END AS volume_surge, CASE WHEN idx >= 2 THEN round(b, 5) END AS volume_trend, CASE WHEN idx >= 2 THEN round(c, 5) END AS relative_volume,
  CASE WHEN idx >= 2 THEN round(d, 5) END AS volume_consistency, CASE WHEN idx >= 2 THEN round(CAST(e AS DOUBLE), 5) END AS price_volume_correlation, round(strength, 5) AS strength,
  CASE WHEN strength >= 0.8 THEN 'excellent' WHEN strength >= 0.6 THEN 'good' WHEN strength >= 0.4 THEN 'moderate' WHEN strength >= 0.2 THEN 'weak' ELSE 'very_weak' END AS signal_quality FROM s""")
def _(t):
    df = vp.volume_signal_strength(t.hourly)
    return rounded(df, ["symbol", "idx", "signal_quality"], 5, strength="strength", **{k: k for k in vp.STRENGTH_WEIGHTS})

