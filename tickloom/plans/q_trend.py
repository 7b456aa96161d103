"""Trend decomposition, tests, reversals, levels and strength."""

from pyspark.sql import functions as F

from tickloom.operators import trend as tr
from tickloom.operators import trendlines as tl
from tickloom.plans.catalog import lines, query, rounded
from tickloom.plans.sql import CALM, CLIMBING, HOURLY, frame, lag, last, lead, normal_two_sided, t_two_sided


# The five-diagonal system solved by elimination, one bar after the other, and back; then noise around each bar.
HP = f"""hb AS MATERIALIZED (SELECT symbol, idx, n, close, CASE WHEN idx IN (0, n - 1) THEN 1 WHEN idx IN (1, n - 2) THEN 5 ELSE 6 END * 1600::DOUBLE + 1 AS m,
  CASE WHEN idx IN (0, n - 2) THEN -2 ELSE -4 END * 1600::DOUBLE AS o FROM bars),
hf(symbol, idx, n, close, d, e, f, z, d1, f1, z1) AS (
  SELECT symbol, idx, n, close, m, o / m, 1600 / m, close, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM hb WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, n, close, d, (o - e0 * f0 * d0) / d, 1600 / d, close - e0 * z0 - f1 * z1, d0, f0, z0
  FROM (SELECT b.*, h.e AS e0, h.f AS f0, h.d AS d0, h.z AS z0, h.f1, h.z1, b.m - h.e * h.e * h.d - h.f1 * h.f1 * h.d1 AS d FROM hf h JOIN hb b ON b.symbol = h.symbol AND b.idx = h.idx + 1)),
hm AS MATERIALIZED (SELECT * FROM hf),
hr(symbol, idx, tau, tau1) AS (
  SELECT symbol, idx, z / d, 0::DOUBLE FROM hm WHERE idx = n - 1
  UNION ALL SELECT h.symbol, h.idx, h.z / h.d - h.e * r.tau - h.f * r.tau1, r.tau FROM hr r JOIN hm h ON h.symbol = r.symbol AND h.idx = r.idx - 1),
hp AS (SELECT symbol, idx, n, close, tau AS trend, close - tau AS cycle FROM hm JOIN hr USING (symbol, idx)),
hs AS (SELECT symbol, any_value(n) AS n, greatest(0, least(1, 1 - sum(cycle * cycle) / (var_pop(close) * count(*)))) AS strength FROM hp GROUP BY 1),
hw AS (SELECT *, CASE WHEN count(*) {frame(-5, 4)} = 10 THEN stddev_samp(cycle) {frame(-5, 4)} END AS w FROM hp),
hn AS (SELECT *, coalesce(w, first_value(w IGNORE NULLS) {frame(0, 5)}, last_value(w IGNORE NULLS) {frame(-4, 0)}) AS noise FROM hw)"""


@query("trd01_hp_filter", f"WITH RECURSIVE {HOURLY}, {HP} SELECT symbol, idx, round(trend, 4) AS trend, round(cycle, 4) AS cycle FROM hp")
def _(t):
    return lines(tr.hp_filter(t.hourly), "trend", "cycle", digits=4)


@query("trd01_hp_strength", f"WITH RECURSIVE {HOURLY}, {HP} SELECT symbol, n, round(strength, 6) AS trend_strength FROM hs")
def _(t):
    return rounded(tr.hp_strength(tr.hp_filter(t.hourly)), ["symbol", "n"], trend_strength="trend_strength")


@query("trd02_noise", f"WITH RECURSIVE {HOURLY}, {HP} SELECT symbol, idx, round(noise, 4) AS noise FROM hn")
def _(t):
    return lines(tr.hp_filter(t.hourly), "noise", digits=4)


PAIRS = """pr AS (SELECT a.symbol, a.n, sign(b.close - a.close) AS sg, (b.close - a.close) / (b.idx - a.idx) AS sl
  FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.idx > a.idx)"""
KENDALL = f"""{PAIRS}, ks AS (SELECT symbol, any_value(n) AS n, CAST(sum(sg) AS BIGINT) AS s FROM pr GROUP BY 1),
kt AS (SELECT symbol, sum(c * (c - 1) * (2 * c + 5)) AS tt FROM (SELECT symbol, close, count(*) AS c FROM bars GROUP BY 1, 2) GROUP BY 1),
kd AS (SELECT *, sqrt((n * (n - 1) * (2 * n + 5) - tt) / 18.0::DOUBLE) AS sd FROM ks JOIN kt USING (symbol)),
kz AS (SELECT *, CASE WHEN s > 0 THEN (s - 1) / sd WHEN s < 0 THEN (s + 1) / sd ELSE 0 END AS z FROM kd),
kp AS (SELECT *, {normal_two_sided("z")} AS p FROM kz),
mk AS (SELECT symbol, n, s, z, p, s / (n * (n - 1) / 2.0::DOUBLE) AS tau, p < 0.05 AS significant, CASE WHEN p < 0.05 THEN 1 - p ELSE 0 END AS confidence,
  CASE WHEN p < 0.05 AND z > 0 THEN 'increasing' WHEN p < 0.05 THEN 'decreasing' ELSE 'no_trend' END AS trend FROM kp)"""


@query("trd03_mann_kendall", f"""WITH {HOURLY}, {KENDALL}
SELECT symbol, n, s AS s_statistic, trend, significant, round(z, 6) AS z_score, round(tau, 6) AS tau, round(p, 6) AS p_value, round(confidence, 6) AS confidence FROM mk""")
def _(t):
    return rounded(tr.mann_kendall(t.hourly, sen=False), ["symbol", "n", "s_statistic", "trend", "significant"], z_score="z_score", tau="tau", p_value="p_value", confidence="confidence")


@query("trd04_sen_slope", f"""
WITH {HOURLY}, {PAIRS} SELECT symbol, round(median(sl), 6) AS sen_slope FROM pr GROUP BY 1""")
def _(t):
    return rounded(tr.median_slope(t.hourly, "close"), ["symbol"], sen_slope="sen_slope")


def peak(op: str, fn: str, col: str, k: int) -> str:
    return f"idx > 0 AND idx < n - 1 AND {col} {op} {fn}({col}) {frame(-k, -1)} AND {col} {op} {fn}({col}) {frame(1, k)}"


@query("trd05_local_extrema", f"""
WITH {HOURLY}, e AS (SELECT symbol, idx, close, {peak('>', 'max', 'close', 5)} AS p, {peak('<', 'min', 'close', 5)} AS q FROM bars)
SELECT symbol, idx, CASE WHEN p THEN 'peak' ELSE 'trough' END AS kind, round(close, 6) AS value FROM e WHERE p OR q""")
def _(t):
    return rounded(tr.extrema(t.hourly), ["symbol", "idx", "kind"], value="value")


REVERSAL = f"""a AS (SELECT *, CASE WHEN idx >= 19 THEN avg(close) {last(20)} END AS sma FROM bars),
b AS (SELECT *, {peak('>', 'max', 'close', 10)} AS pk, {peak('<', 'min', 'close', 10)} AS tr,
  coalesce(close < sma, true) AS lo, coalesce(close > sma, true) AS hi, (close - {lag('close', 10)}) / {lag('close', 10)} AS m0,
  (last_value(close) {frame(1, 10)} - close) / close AS m1, ({lead('close', 10)} - close) / close AS m2 FROM a),
c AS (SELECT *, {" AND ".join(lead('lo', k) for k in (1, 2, 3))} AS below, {" AND ".join(lead('hi', k) for k in (1, 2, 3))} AS above FROM b),
pt AS (SELECT symbol, idx, 0 AS k, 'top_reversal' AS type, 'peak_reversal' AS pattern, close AS price,
    (below::INT + coalesce(m0 > 0 AND m1 < 0, false)::INT) / 2 AS confidence, NULL::DOUBLE AS neckline FROM c WHERE pk AND idx < n - 3
  UNION ALL SELECT symbol, idx, 1, 'bottom_reversal', 'trough_reversal', close,
    (above::INT + coalesce(m0 < 0 AND m2 > 0, false)::INT) / 2, NULL FROM c WHERE tr AND idx < n - 3),
w AS (SELECT t.symbol, t.idx AS i, k.idx, k.close FROM bars t JOIN bars k ON t.symbol = k.symbol AND k.idx BETWEEN t.idx - 20 AND t.idx + 19
  WHERE t.idx >= 20 AND t.idx < t.n - 20),
x AS (SELECT symbol, i, max(close) FILTER (idx < i) AS lv, max(close) FILTER (idx >= i) AS rv, min(close) FILTER (idx < i) AS lw, min(close) FILTER (idx >= i) AS rw,
  min(close) FILTER (idx BETWEEN i AND i + 2) AS nlo, max(close) FILTER (idx BETWEEN i AND i + 2) AS nhi FROM w GROUP BY 1, 2),
y AS (SELECT x.symbol, x.i, min(idx) FILTER (idx < x.i AND close = lv) AS la, min(idx) FILTER (idx >= x.i AND close = rv) AS ra,
  min(idx) FILTER (idx < x.i AND close = lw) AS lb, min(idx) FILTER (idx >= x.i AND close = rw) AS rb FROM x JOIN w ON x.symbol = w.symbol AND x.i = w.i GROUP BY 1, 2),
v AS (SELECT y.symbol, y.i, min(close) FILTER (idx BETWEEN la AND ra) AS valley, max(close) FILTER (idx BETWEEN lb AND rb) AS crest, any_value(ra - la) AS d1, any_value(rb - lb) AS d2
  FROM y JOIN w ON y.symbol = w.symbol AND y.i = w.i GROUP BY 1, 2),
dt AS (SELECT symbol, i AS idx, 2 AS k, 'top_reversal' AS type, 'double_top' AS pattern, rv AS price, 0.7::DOUBLE AS confidence, valley AS neckline
    FROM x JOIN v USING (symbol, i) WHERE abs(lv - rv) < lv * 0.02 AND d1 >= 2 AND nlo < valley
  UNION ALL SELECT symbol, i, 3, 'bottom_reversal', 'double_bottom', rw, 0.7, crest FROM x JOIN v USING (symbol, i) WHERE abs(lw - rw) < lw * 0.02 AND d2 >= 2 AND nhi > crest),
al AS (SELECT * FROM pt WHERE confidence > 0 UNION ALL SELECT * FROM dt)"""
SHOW = "symbol, idx, type, pattern, round(price, 6) AS price, round(confidence, 4) AS confidence, round(neckline, 6) AS neckline"


def shown(df):
    return rounded(df, ["symbol", "idx", "type", "pattern"], price="price", confidence=F.round("confidence", 4), neckline="neckline")


@query("trd06_peak_reversals", f"WITH {CALM}, {REVERSAL} SELECT {SHOW} FROM al WHERE k < 2")
def _(t):
    return shown(tr.reversals(t.calm, dedupe=False).filter("pattern like '%reversal'"))


@query("trd07_double_tops", f"WITH {CALM}, {REVERSAL} SELECT {SHOW} FROM al WHERE k >= 2")
def _(t):
    return shown(tr.reversals(t.calm, dedupe=False).filter("pattern like 'double%'"))


@query("trd08_reversals", f"""
WITH RECURSIVE {CALM}, {REVERSAL},
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx, k) AS rn FROM al),
f AS (
  SELECT symbol, rn, idx AS li, confidence AS lc, rn AS lr, false AS appended FROM o WHERE rn = 1
  UNION ALL
  SELECT o.symbol, o.rn, CASE WHEN o.idx - f.li > 3 OR o.confidence > f.lc THEN o.idx ELSE f.li END,
    CASE WHEN o.idx - f.li > 3 OR o.confidence > f.lc THEN o.confidence ELSE f.lc END,
    CASE WHEN o.idx - f.li > 3 OR o.confidence > f.lc THEN o.rn ELSE f.lr END, o.idx - f.li > 3
  FROM f JOIN o ON o.symbol = f.symbol AND o.rn = f.rn + 1),
e AS (SELECT *, coalesce(lead(appended) OVER (PARTITION BY symbol ORDER BY rn), true) AS final FROM f)
SELECT {SHOW.replace("symbol, idx", "o.symbol, o.idx")} FROM e JOIN o ON o.symbol = e.symbol AND o.rn = e.lr WHERE e.final""")
def _(t):
    return shown(tr.reversals(t.calm))


LEVELS = f"""x AS (SELECT symbol, ts, n, high, low, {peak('>', 'max', 'high', 5)} AS p, {peak('<', 'min', 'low', 5)} AS q FROM bars),
xs AS (SELECT symbol, ts, high AS level, 1 AS top FROM x WHERE p AND n >= 100 UNION ALL SELECT symbol, ts, low, 0 FROM x WHERE q AND n >= 100),
ex AS (SELECT symbol, level, CASE WHEN max(top) = 1 THEN 'resistance' ELSE 'support' END AS level_type, count(*) AS strength, min(ts) AS first_touch,
  max(ts) AS last_touch, least(1, count(*) / 10) AS confidence FROM xs GROUP BY 1, 2 HAVING count(*) >= 2),
rc AS (SELECT symbol, max(high) AS hi, min(low) AS lo, min(ts) AS f, max(ts) AS l FROM bars WHERE idx >= n - 100 AND n >= 100 GROUP BY 1),
fb AS (SELECT symbol, hi - (hi - lo) * r AS level, CASE WHEN r > 0.5 THEN 'support' ELSE 'resistance' END AS level_type, 1 AS strength, f AS first_touch, l AS last_touch, 0.5::DOUBLE AS confidence
  FROM rc CROSS JOIN (SELECT unnest([0.236, 0.382, 0.5, 0.618, 0.786]::DOUBLE[]) AS r)),
la AS (SELECT symbol, arg_max(close, idx) AS last FROM bars WHERE n >= 100 GROUP BY 1),
mg AS (SELECT symbol, last, pow(10.0::DOUBLE, length(CAST(CAST(floor(last) AS BIGINT) AS VARCHAR)) - 2) AS m FROM la),
rl AS (SELECT symbol, last, round_even(last / m, 0) * m + i * m AS level FROM mg CROSS JOIN (SELECT unnest(range(-5, 6)) AS i)),
ps AS (SELECT symbol, level, CASE WHEN level < last THEN 'support' ELSE 'resistance' END AS level_type, count(*) AS strength, min(ts) AS first_touch, max(ts) AS last_touch,
  least(1, count(*) / 20) AS confidence FROM rl JOIN bars USING (symbol) WHERE level > 0 AND abs(close - level) < level * 0.02 GROUP BY symbol, level, last HAVING count(*) >= 2),
lv AS (SELECT * FROM ex UNION ALL SELECT * FROM fb UNION ALL SELECT * FROM ps),
cn AS (SELECT *, CASE WHEN abs(level - lag(level) OVER o) < lag(level) OVER o * 0.02 THEN 0 ELSE 1 END AS new FROM lv WINDOW o AS (PARTITION BY symbol ORDER BY level, level_type, strength)),
ch AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY level, level_type, strength) AS chain FROM cn),
me AS (SELECT symbol, chain, avg(level) AS level, CASE WHEN count(CASE WHEN level_type = 'support' THEN 1 END) > count(*) / 2 THEN 'support' ELSE 'resistance' END AS level_type,
  CAST(sum(strength) AS BIGINT) AS strength, min(first_touch) AS first_touch, max(last_touch) AS last_touch, least(1, avg(confidence) * 1.2) AS confidence FROM ch GROUP BY 1, 2)"""


def level_sql(src: str, kind: str = "level_type", join: str = "") -> str:
    return f"""WITH {CALM}, {LEVELS} SELECT symbol, round(level, 5) AS level, {kind} AS level_type, CAST(strength AS BIGINT) AS strength,
  strftime(first_touch, '%Y-%m-%d %H') AS first_touch, strftime(last_touch, '%Y-%m-%d %H') AS last_touch, round(CAST(confidence AS DOUBLE), 5) AS confidence FROM {src} {join}"""


def levels(df):
    return df.select("symbol", F.round("level", 5).alias("level"), "level_type", "strength",
                     F.date_format("first_touch", "yyyy-MM-dd HH").alias("first_touch"),
                     F.date_format("last_touch", "yyyy-MM-dd HH").alias("last_touch"), F.round("confidence", 5).alias("confidence"))


@query("trd09_extrema_levels", level_sql("ex"))
def _(t):
    return levels(tr.extrema_levels(t.calm))


@query("trd10_fibonacci_levels", level_sql("fb"))
def _(t):
    return levels(tr.fibonacci_levels(t.calm))


@query("trd11_psychological_levels", level_sql("ps"))
def _(t):
    return levels(tr.psychological_levels(t.calm))


@query("trd12_consolidated_levels", level_sql("me"))
def _(t):
    b = t.calm
    found = tr.extrema_levels(b).unionByName(tr.fibonacci_levels(b)).unionByName(tr.psychological_levels(b))
    return levels(tr.consolidate(found))


@query("trd13_support_resistance", level_sql("me", "CASE WHEN level < last THEN 'support' ELSE 'resistance' END", "JOIN la USING (symbol)"))
def _(t):
    return levels(tr.sr_levels(t.calm))


# Fits of all runs of extrema, then a walk in their order with the list of lines kept. Critical t values at 5 % for 1 to 4 degrees of freedom.
TRENDLINES = f"""le AS (SELECT symbol, n, idx, close, {peak('>', 'max', 'close', 5)} AS p, {peak('<', 'min', 'close', 5)} AS q FROM bars),
lp AS (SELECT symbol, kind, x, v, row_number() OVER (PARTITION BY symbol, kind ORDER BY x) AS k FROM (
  SELECT symbol, 'resistance' AS kind, idx AS x, close AS v FROM le WHERE p AND n >= 6 UNION ALL SELECT symbol, 'support', idx, close FROM le WHERE q AND n >= 6)),
lf AS (SELECT a.symbol, a.kind, a.k AS i, b.k AS j, count(*) AS np, a.x AS s0, b.x AS s1, regr_slope(c.v, c.x) AS sl, regr_intercept(c.v, c.x) AS ic, corr(c.v, c.x) AS r
  FROM lp a JOIN lp b ON a.symbol = b.symbol AND a.kind = b.kind AND b.k >= a.k + 2 JOIN lp c ON c.symbol = a.symbol AND c.kind = a.kind AND c.k BETWEEN a.k AND b.k GROUP BY ALL),
lg AS (SELECT *, abs(r) * sqrt((np - 2) / (1 - r * r)) AS t FROM lf WHERE abs(r) > 0.8),
lh AS (SELECT * FROM lg WHERE np > 6 OR t > [12.706204736, 4.302652730, 3.182446305, 2.776445105][np - 2]),
lt AS (SELECT symbol, kind, i, j, count(CASE WHEN abs(close - (sl * idx + ic)) / (sl * idx + ic) < 0.05 THEN 1 END) AS touches FROM lh JOIN bars USING (symbol) GROUP BY ALL),
lc AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY i, j) AS rn FROM lh JOIN lt USING (symbol, kind, i, j) WHERE touches >= 3),
lw(symbol, kind, rn, kept) AS (
  SELECT symbol, kind, rn, [{{'rn': rn, 's': sl, 'b': ic, 'q': r * r}}] FROM lc WHERE rn = 1
  UNION ALL
  SELECT symbol, kind, rn, CASE WHEN twin IS NULL THEN list_append(kept, c) WHEN c.q > kept[twin].q THEN list_append(list_filter(kept, lambda e: e.rn <> kept[twin].rn), c) ELSE kept END
  FROM (SELECT w.symbol, w.kind, n.rn, w.kept, {{'rn': n.rn, 's': n.sl, 'b': n.ic, 'q': n.r * n.r}} AS c,
    list_position(list_transform(w.kept, lambda e: abs(n.sl - e.s) < abs(e.s) * 0.1 AND abs(n.ic - e.b) < abs(e.b) * 0.1), true) AS twin
    FROM lw w JOIN lc n ON n.symbol = w.symbol AND n.kind = w.kind AND n.rn = w.rn + 1)),
lk AS (SELECT symbol, kind, unnest(kept).rn AS rn FROM lw QUALIFY lw.rn = max(lw.rn) OVER (PARTITION BY symbol, kind)),
ln AS (SELECT c.* FROM lc c JOIN lk USING (symbol, kind, rn))"""


@query("trd14_trendlines", f"""WITH RECURSIVE {CALM}, {TRENDLINES}
SELECT symbol, kind AS line_type, touches, s0 AS start_idx, s1 AS end_idx, round(sl, 5) AS slope, round(ic, 5) AS intercept, round(r * r, 5) AS r_squared,
  round({t_two_sided('t', '(np - 2)')}, 5) AS p_value, round(degrees(atan(sl)), 5) AS angle_degrees, round(abs(r), 5) AS strength FROM ln""")
def _(t):
    df = tl.trendlines(t.calm)
    return rounded(df, ["symbol", "line_type", "touches", "start_idx", "end_idx"], 5, slope="slope", intercept="intercept",
                   r_squared="r_squared", p_value="p_value", angle_degrees="angle_degrees", strength="strength")


@query("trd15_trendline_counts", f"""WITH RECURSIVE {HOURLY}, {TRENDLINES}
SELECT symbol, kind AS line_type, count(*) AS distinct_lines, max(touches) AS most_touches FROM ln GROUP BY 1, 2""")
def _(t):
    return tl.trendlines(t.hourly).groupBy("symbol", "line_type").agg(F.count(F.lit(1)).alias("distinct_lines"), F.max("touches").alias("most_touches"))


@query("join07_channels", f"""WITH RECURSIVE {CLIMBING}, {TRENDLINES}
SELECT u.symbol, greatest(u.s0, w.s0) AS start_idx, least(u.s1, w.s1) AS end_idx, round(u.sl, 5) AS upper_slope, round(w.sl, 5) AS lower_slope, round(u.ic - w.ic, 4) AS width,
  round((abs(u.r) + abs(w.r)) / 2, 5) AS strength FROM ln u JOIN ln w ON u.symbol = w.symbol AND u.kind = 'resistance' AND w.kind = 'support'
WHERE abs(u.sl - w.sl) / ((abs(u.sl) + abs(w.sl)) / 2) < 0.2 AND u.ic > w.ic""")
def _(t):
    df = tl.channels(tl.trendlines(t.climbing))
    return rounded(df, ["symbol", "start_idx", "end_idx"], 5, **{c: c for c in ("upper_slope", "lower_slope", "strength")}, width=F.round("width", 4))


ADX = f"""d AS (SELECT *, coalesce(close - {lag('close')}, 0) AS d FROM bars),
u AS (SELECT *, CASE WHEN idx >= 19 THEN avg(greatest(d, 0)) {last(20)} END AS up, CASE WHEN idx >= 19 THEN avg(greatest(-d, 0)) {last(20)} END AS dn FROM d),
dx AS (SELECT *, coalesce(100 * abs(up - dn) / nullif(up + dn, 0), 0) AS dx FROM u),
ad AS (SELECT symbol, idx, n, CASE WHEN idx >= 19 THEN avg(dx) {last(20)} END AS adx FROM dx)"""


@query("trd16_adx", f"WITH {HOURLY}, {ADX} SELECT symbol, idx, round(adx, 5) AS adx FROM ad")
def _(t):
    return lines(tr.adx(t.hourly), "adx", digits=5)


@query("trd17_adx_label", f"""WITH {HOURLY}, {ADX} SELECT symbol, CASE WHEN adx < 25 THEN 'weak_trend' WHEN adx < 50 THEN 'strong_trend'
  WHEN adx < 75 THEN 'very_strong_trend' ELSE 'extremely_strong_trend' END AS label, count(*) AS bars FROM ad WHERE adx IS NOT NULL GROUP BY 1, 2""")
def _(t):
    df = tr.adx(t.hourly).filter("adx is not null")
    return df.groupBy("symbol", tr.adx_label(F.col("adx")).alias("label")).agg(F.count(F.lit(1)).alias("bars"))


REGRESSION = f"""rg AS (SELECT symbol, n, slope, r2, {t_two_sided('sqrt(r2 * (n - 2) / (1 - r2))', '(n - 2)')} AS p, CASE WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction
  FROM (SELECT symbol, count(*) AS n, regr_slope(close, idx) AS slope, regr_r2(close, idx) AS r2 FROM bars GROUP BY 1))"""


@query("trd18_regression_strength", f"WITH {HOURLY}, {REGRESSION} SELECT symbol, n, round(slope, 7) AS slope, round(r2, 7) AS r_squared, round(p, 7) AS p_value, direction AS trend_direction FROM rg")
def _(t):
    return rounded(tr.regression_strength(t.hourly), ["symbol", "n", "trend_direction"], 7, slope="slope", r_squared="r_squared", p_value="p_value")


ALIGNMENT = """al AS (SELECT symbol, any_value(n) AS n, max(CASE WHEN idx = n - 1 THEN close END) AS p, avg(CASE WHEN n - idx <= 10 THEN close END) AS a,
  avg(CASE WHEN n - idx <= 20 THEN close END) AS b, avg(CASE WHEN n - idx <= 50 THEN close END) AS c FROM bars GROUP BY 1),
ma AS (SELECT symbol, n, CASE WHEN p > a AND a > b AND b > c THEN 'perfect_uptrend' WHEN p < a AND a < b AND b < c THEN 'perfect_downtrend' ELSE 'mixed' END AS alignment_type,
  CASE WHEN p < a AND a < b AND b < c THEN 1 ELSE ((p > a)::INT + (a > b)::INT + (b > c)::INT) / 3 END AS alignment FROM al)"""


@query("trd19_ma_alignment", f"WITH {HOURLY}, {ALIGNMENT} SELECT symbol, n, alignment_type, round(alignment, 6) AS alignment FROM ma")
def _(t):
    return rounded(tr.ma_alignment(t.hourly), ["symbol", "n", "alignment_type"], alignment="alignment")


MOMENTUM = """ml AS (SELECT symbol, any_value(n) AS n, max(CASE WHEN idx = n - 1 THEN close END) AS a, max(CASE WHEN idx = n - 20 THEN close END) AS b,
  max(CASE WHEN idx = n - 40 THEN close END) AS c FROM bars GROUP BY 1),
mo AS (SELECT symbol, n, 100 * (a - b) / b AS roc, a - b AS move, a - b - (b - c) AS acceleration, least(1, abs(100 * (a - b) / b) / 10) AS strength FROM ml)"""


@query("trd20_momentum_strength", f"""WITH {HOURLY}, {MOMENTUM} SELECT symbol, n, round(roc, 5) AS rate_of_change, round(move, 5) AS momentum, round(acceleration, 5) AS acceleration,
  round(strength, 5) AS momentum_strength FROM mo""")
def _(t):
    df = tr.momentum_strength(t.hourly)
    return rounded(df, ["symbol", "n"], 5, **{c: c for c in ("rate_of_change", "momentum", "acceleration", "momentum_strength")})


REPORT = f"""{HP}, {KENDALL}, {REGRESSION}, {ALIGNMENT}, {MOMENTUM}, {ADX},
rp AS (SELECT mk.symbol, mk.n, coalesce(adx, 0) AS adx, slope, r2, rg.p AS slope_p, direction, mk.trend AS mk_trend, tau, hs.strength AS hp, alignment_type, mo.strength AS momentum,
  (least(coalesce(adx, 0), 100) + r2 * 100 + confidence * 100 + hs.strength * 100 + alignment * 100 + mo.strength * 100) / 6 AS overall
  FROM mk JOIN rg USING (symbol) JOIN ma USING (symbol) JOIN mo USING (symbol) JOIN hs USING (symbol) JOIN ad ON ad.symbol = mk.symbol AND ad.idx = ad.n - 1 WHERE mk.n >= 40),
rq AS (SELECT *, CASE WHEN overall < 20 THEN 'no_trend' WHEN overall < 40 THEN 'weak_trend' WHEN overall < 60 THEN 'moderate_trend' WHEN overall < 80 THEN 'strong_trend' ELSE 'very_strong_trend' END AS quality,
  CASE WHEN adx < 25 THEN 'weak_trend' WHEN adx < 50 THEN 'strong_trend' WHEN adx < 75 THEN 'very_strong_trend' ELSE 'extremely_strong_trend' END AS adx_label FROM rp)"""


@query("trd21_overall_strength", f"WITH RECURSIVE {HOURLY}, {REPORT} SELECT symbol, quality AS trend_quality, round(overall, 4) AS overall_strength FROM rq")
def _(t):
    return rounded(tr.trend_strength(t.hourly), ["symbol", "trend_quality"], 4, overall_strength="overall_strength")


@query("trd22_trend_report", f"""WITH RECURSIVE {CALM}, {REPORT} SELECT symbol, n, adx_label AS adx_interpretation, mk_trend, alignment_type, direction AS trend_direction, quality AS trend_quality, round(adx, 4) AS adx,
  round(slope, 4) AS slope, round(r2, 4) AS r_squared, round(slope_p, 4) AS slope_p_value, round(tau, 4) AS tau, round(hp, 4) AS hp_strength, round(momentum, 4) AS momentum_strength, round(overall, 4) AS overall_strength FROM rq""")
def _(t):
    df = tr.trend_strength(t.calm)
    return rounded(df, ["symbol", "n", "adx_interpretation", "mk_trend", "alignment_type", "trend_direction", "trend_quality"], 4,
                   **{c: c for c in ("adx", "slope", "r_squared", "slope_p_value", "tau", "hp_strength", "momentum_strength", "overall_strength")})
