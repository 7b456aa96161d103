"""Known answers."""

from functools import reduce

import numpy as np
import pandas as pd
import pytest
from market_helpers import bars
from pyspark.sql import functions as F

from tickloom.functions import hodrick, ranking
from tickloom.functions.stats import t_two_sided
from tickloom.operators import averages as av
from tickloom.operators import confidence as co
from tickloom.operators import momentum, trend, trendlines, volatility, volprice
from tickloom.operators import quality as qa
from tickloom.operators import store as st
from tickloom.operators import validation as va
from tickloom.schemas import risk_reward


def col(df, name):
    return [r[name] for r in df.orderBy("idx").collect()]


def test_sma_values(spark):
    out = col(av.sma(bars(spark, range(10, 101, 10)), 5), "sma")
    assert out[3] is None and out[4] == 30.0 and out[9] == 80.0


def test_short_series_is_null(spark):
    assert col(av.sma(bars(spark, [1, 2, 3]), 5), "sma") == [None, None, None]


@pytest.mark.parametrize("alpha", [1.0, 0.9, 0.3, 0.01])
def test_ema_equals_pandas(spark, alpha):
    x = np.random.default_rng(1).uniform(10, 20, 300)
    got = col(av.ema(bars(spark, x), 1, alpha=alpha), "ema")
    assert np.allclose(got, pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), rtol=1e-12)


def test_ema_carries_on_over_nulls(spark):
    x = np.random.default_rng(3).uniform(10, 20, 120)
    x[[5, 6, 40, 119]] = np.nan
    df = bars(spark, x).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = col(av.ema(df, 1, alpha=0.3), "ema")
    assert np.allclose(got, pd.Series(x).ewm(alpha=0.3, adjust=False, ignore_na=True).mean(), rtol=1e-9)
    flat = bars(spark, [100.0] * 8).withColumn("close", F.when(F.hour("ts") != 3, F.col("close")))
    assert np.allclose(col(av.ema(flat, 3), "ema")[2:], 100.0)


def test_very_different_speeds_still_work(spark):
    x = np.random.default_rng(2).uniform(10, 20, 400)
    df = momentum.macd(bars(spark, x), fast=2, slow=200, signal=3)
    s = pd.Series(x)
    want = s.ewm(span=2, adjust=False).mean() - s.ewm(span=200, adjust=False).mean()
    assert np.allclose(np.array(col(df, "macd")[199:], float), want[199:], rtol=1e-9)


def test_rsi_bounds(spark):
    assert col(momentum.rsi(bars(spark, range(1, 21))), "rsi")[-1] == 100.0
    assert col(momentum.rsi(bars(spark, range(20, 0, -1))), "rsi")[-1] == 0.0
    assert col(momentum.rsi(bars(spark, [5] * 20)), "rsi")[-1] is None
    assert col(momentum.rsi(bars(spark, range(1, 21))), "rsi")[:14] == [None] * 14


def test_macd_histogram(spark):
    rows = momentum.macd(bars(spark, np.linspace(10, 30, 40) + np.sin(range(40)))).orderBy("idx").collect()
    assert rows[24].macd is None and rows[25].signal == pytest.approx(rows[25].macd)
    assert all(r.histogram == pytest.approx(r.macd - r.signal) for r in rows[25:])


def test_bollinger_order(spark):
    rows = volatility.bollinger(bars(spark, np.linspace(20, 25, 20)), 10).collect()
    assert all(r.bb_upper > r.bb_middle > r.bb_lower for r in rows if r.bb_middle is not None)


def test_flat_prices(spark):
    b = bars(spark, [7] * 30, highs=[7] * 30, lows=[7] * 30)
    assert set(col(momentum.williams_r(b), "williams_r")) == {None}
    assert set(col(momentum.stochastic(b), "stoch_k")) == {None}


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        av.sma(bars(spark, [1]), 0)
    with pytest.raises(ValueError):
        av.kama(bars(spark, [1]), 10, 30, 2)
    with pytest.raises(ValueError):
        av.sma(bars(spark, [1]).drop("close"), 3)
    with pytest.raises(ValueError):
        av.moving_average(bars(spark, [1]), "nope")


def test_mann_kendall_with_ties(spark):
    r = trend.mann_kendall(bars(spark, [1, 2, 2, 3, 3, 3, 4, 5, 5])).collect()[0]
    assert r.trend == "increasing" and r.sen_slope > 0 and r.significant


PRICES = np.random.default_rng(3)
SHAPES = {
    "walk": np.cumsum(PRICES.normal(size=1200)), "ticks": np.round(np.cumsum(PRICES.normal(size=900)), 1), "flat": np.r_[np.zeros(700), PRICES.normal(size=500)],
    "heavy": PRICES.standard_cauchy(1000) * 1e6, "two": np.array([1.0, 3.0]), "ties": np.array([1, 2, 2, 3, 3, 3, 4, 5, 5.0]),
}


@pytest.mark.parametrize(("rows", "listed"), [(4096, 1 << 21), (64, 5000)])
def test_pairs_are_counted_and_their_median_slope_found(spark, small_blocks, monkeypatch, rows, listed):
    monkeypatch.setattr(ranking, "LISTED", listed)
    df = reduce(lambda a, b: a.unionByName(b), [bars(spark, y, symbol=k) for k, y in SHAPES.items()])
    counts = small_blocks(lambda: {r.symbol: (r.n, r.s, r.tie_term) for r in ranking.pair_balance(df, "close").collect()}, rows)
    slopes = small_blocks(lambda: {r.symbol: r.sen_slope for r in ranking.median_slope(df, "close").collect()}, rows)
    for k, y in SHAPES.items():
        i, j = np.triu_indices(len(y), 1)
        ties = np.unique(y, return_counts=True)[1].astype(float)
        assert counts[k] == (len(y), int(np.sign(y[j] - y[i]).sum()), float((ties * (ties - 1) * (2 * ties + 5)).sum())), k
        assert slopes[k] == pytest.approx(np.median((y[j] - y[i]) / (j - i)), rel=1e-9, abs=1e-9), k


def test_balance_of_arrays():
    for v in (np.empty(0), np.ones(5), PRICES.normal(size=1), PRICES.normal(size=33), PRICES.integers(0, 9, 500).astype(float)):
        assert ranking.balance(v) == sum(int(np.sign(v[i + 1 :] - v[i]).sum()) for i in range(len(v)))


@pytest.mark.parametrize("lam", [1.0, 1600.0, 129600.0])
@pytest.mark.parametrize("n", [3, 4, 5, 63, 64, 65, 66, 127, 129, 700])
def test_trend_solver_at_the_edges_of_tiles(n, lam):
    y = np.random.default_rng(n).normal(size=(n, 2)).cumsum(axis=0)
    d = np.diff(np.eye(n), 2, axis=0)
    want = np.linalg.solve(np.eye(n) + lam * d.T @ d, y)
    assert np.allclose(hodrick.solve(y, lam), want, atol=1e-7) and np.allclose(hodrick.solve(y[:, 0], lam), want[:, 0], atol=1e-7)


def test_hp_filter_equals_dense_solution(spark):
    y = np.cumsum(np.random.default_rng(4).normal(0, 1, 120)) + 50
    d = np.diff(np.eye(120), 2, axis=0)
    want = np.linalg.solve(np.eye(120) + 1600 * d.T @ d, y)
    rows = trend.hp_filter(bars(spark, y)).orderBy("idx").collect()
    assert np.allclose([r.trend for r in rows], want, atol=1e-8)
    noise = pd.Series(y - want).rolling(10, center=True).std().bfill().ffill()
    assert np.allclose([r.noise for r in rows], noise, atol=1e-8)


def test_top_reversal(spark):
    y = list(range(100, 130)) + list(range(130, 100, -1))
    rows = trend.reversals(bars(spark, y), 10, 3).collect()
    assert any(r.type == "top_reversal" and 25 <= r.idx <= 35 for r in rows)


def plain_lines(y, sign):
    """Trendlines of one side by their definition: every run, every bar, one list."""
    y = np.asarray(y, float)
    at = [i for i in range(1, len(y) - 1) if all(sign * y[i] > sign * y[k] for k in range(max(0, i - 5), min(len(y), i + 6)) if k != i)]
    kept = []
    for i in range(len(at)):
        for j in range(i + 2, len(at)):
            x = np.array(at[i : j + 1])
            slope, base = np.polyfit(x, y[x], 1)
            r = np.corrcoef(x, y[x])[0, 1]
            p = t_two_sided(r * np.sqrt((len(x) - 2) / (1 - r * r)), len(x) - 2)
            line = slope * np.arange(len(y)) + base
            touches = int((np.abs(y - line) / line < 0.05).sum())
            if abs(r) > 0.8 and p < 0.05 and touches >= 3:
                twin = next((k for k in kept if abs(slope - k[0]) < abs(k[0]) * 0.1 and abs(base - k[1]) < abs(k[1]) * 0.1), None)
                if twin is None or r * r > twin[2]:
                    kept = [k for k in kept if k is not twin] + [(slope, base, r * r, touches, at[i], at[j])]
    return kept


def test_trendlines_are_those_of_the_definition(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(trendlines, "STARTS", 3)
    monkeypatch.setattr(trendlines, "PACKED", 20)
    x, rng = np.arange(400), np.random.default_rng(8)
    prices = {"climb": 100 + 0.2 * x + 5 * np.sin(x / 4) + rng.normal(size=400), "walk": 50 + np.cumsum(rng.normal(size=400)), "low": 3 * np.sin(x / 5) + rng.normal(size=400), "short": np.arange(5.0)}
    df = reduce(lambda a, b: a.unionByName(b), [bars(spark, y, symbol=k) for k, y in prices.items()])
    got = small_blocks(lambda: trendlines.trendlines(df).collect(), 50)
    for k, y in prices.items():
        for kind, sign in (("resistance", 1), ("support", -1)):
            own = sorted((r.start_idx, r.end_idx, r.touches, r.slope, r.intercept) for r in got if r.symbol == k and r.line_type == kind)
            want = sorted((i, j, t, s, b) for s, b, _, t, i, j in plain_lines(y, sign))
            assert [o[:3] for o in own] == [w[:3] for w in want] and np.allclose([o[3:] for o in own], [w[3:] for w in want], rtol=1e-6, atol=1e-6)
    lines = trendlines.trendlines(df).collect()
    up, low = ([r for r in lines if r.line_type == t] for t in ("resistance", "support"))
    pairs = sorted((round(u.slope, 9), round(w.slope, 9)) for u in up for w in low if u.symbol == w.symbol and u.intercept > w.intercept and abs(u.slope - w.slope) / ((abs(u.slope) + abs(w.slope)) / 2) < 0.2)
    found = sorted((round(r.upper_slope, 9), round(r.lower_slope, 9)) for r in trendlines.channels(trendlines.trendlines(df)).collect())
    assert found == pairs and pairs


def test_volume_scenarios(spark):
    v = [1_000_000.0 + (i % 7) * 10_000 for i in range(100)]
    c = [100 + (i % 5) * 0.1 for i in range(100)]
    v[50], c[50] = 5_000_000, 110
    v[60:64] = [100_000] * 4
    v[70], c[70] = 3_000_000, 125
    names = {r.pattern_name for r in volprice.unusual_volume(bars(spark, c, volumes=v)).collect()}
    assert {"buying_climax", "volume_dry_up", "volume_breakout_up"} <= names


def test_risk_reward(spark):
    df = spark.createDataFrame([(150.0, 155.0, 148.0), (300.0, 280.0, 305.0), (1.0, 2.0, 1.0)], "e double, t double, s double")
    assert [r[0] for r in df.select(risk_reward(F.col("e"), F.col("t"), F.col("s"))).collect()] == [2.5, 4.0, None]


def test_symbols(spark):
    df = spark.createDataFrame([("  aapl  ",), ("BRK.A",), ("AAPL$",), ("",), (None,), ("^GSPC",)], "symbol string")
    got = [(r.cleaned_symbol, len(r.errors) == 0) for r in qa.validate_symbol(df).collect()]
    assert got == [("AAPL", True), ("BRK.A", True), ("AAPL$", False), ("", False), (None, False), ("^GSPC", False)]
    assert len(qa.validate_symbol(df, symbol_type="index").collect()[5].errors) == 0
    assert len(qa.validate_symbol(df, symbol_type="us_stock", strict=True).collect()[1].errors) == 1


def test_high_below_close_is_rejected(spark):
    raw = spark.createDataFrame([("AAPL", "2023-12-01", "150", "148", "149", "151", "1000")],
                                "symbol string, timestamp string, open_price string, high_price string, low_price string, close_price string, volume string")
    assert any("high below" in e for e in qa.validate_ohlc(raw).collect()[0].errors)


def test_performance_score(spark):
    df = spark.createDataFrame([(True, False, 0.08, None, 0.85, False)], "hit_target boolean, hit_stop_loss boolean, max_favorable_excursion double, max_adverse_excursion double, follow_through_rate double, false_breakout boolean")
    assert st.perf_score(df).collect()[0].performance_score == 1.0


def test_alert_priority(spark):
    df = spark.createDataFrame([(0.92,), (0.65,)], "confidence double")
    assert [r.priority for r in st.route_alerts(df).collect()] == ["critical", "low"]


def test_profit_factor_and_mcc(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", -0.1), ("c", 0.2), ("c", -0.1)], "k string, r double")
    got = {r.k: r.p for r in df.groupBy("k").agg(va.profit_factor(F.col("r")).alias("p")).collect()}
    assert got["a"] is None and got["b"] == 0.0 and got["c"] == pytest.approx(2.0)
    m = spark.createDataFrame([(60, 10, 20, 10)], "tp int, fp int, tn int, fn int")
    assert m.select(va.mcc(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])).collect()[0][0] == pytest.approx((1200 - 100) / np.sqrt(70 * 70 * 30 * 30))


def test_learning_is_one_pass_per_key(spark):
    rows = [(f"k{i % 2}", i, *[0.5 + 0.01 * ((i * j) % 40) for j in range(1, 6)], 0.6, i % 3 == 0) for i in range(250)]
    df = spark.createDataFrame(rows, "pattern_name string, observed_at int, " + ", ".join(f"{c} double" for c in co.WEIGHTS) + ", overall_score double, success boolean")
    got = {r.pattern_name: r for r in co.learn(df, order=("observed_at",)).collect()}
    for key in ("k0", "k1"):
        w, seen = np.array(list(co.WEIGHTS.values())), []
        for r in (r for r in rows if r[0] == key):
            s, ok = np.array(r[2:7]), r[8]
            w = w + (float(ok) - 0.6) * s * 0.01
            if abs(w.sum() - 1) > 0.01:
                w = w / w.sum()
            seen.append((s > 0.6) == ok)
            if len(seen) % 100 == 0:
                acc = np.mean(seen[-50:], axis=0)
                w = np.array([x * (1.05 if a > 0.7 else 0.95 if a < 0.5 else 1) for x, a in zip(w, acc)])
                if abs(w.sum() - 1) > 0.01:
                    w = w / w.sum()
        assert got[key].outcomes == 125
        assert np.allclose([got[key][c] for c in co.WEIGHTS], w)


def test_row_indexing_of_a_crowded_day(spark):
    """Many rows in a day without a grid: places are those of a sort, and no window partition holds a day's rows."""
    from tickloom.functions import frames as fr

    df = spark.range(20_000).selectExpr("'A' AS symbol", "'' AS timeframe", "timestamp_seconds(1700000000 + hash(id) % 3600) AS ts", "id AS pattern_id")
    out = fr.index_rows(df, ["ts", "pattern_id"])
    rows = out.select("idx", "n", "ts", "pattern_id").collect()
    assert [r.idx for r in sorted(rows, key=lambda r: (r.ts, r.pattern_id))] == list(range(20_000)) and rows[0].n == 20_000


def test_levels_are_chained_as_one_by_one(spark):
    rng = np.random.default_rng(12)
    t0 = pd.Timestamp("2024-01-01")
    prices = np.concatenate([rng.uniform(1, 3, 60), 100 * 1.02 ** np.arange(6), 100 * 1.0199 ** np.arange(40), rng.lognormal(4, 3, 200), [0.0, -1.0, -1.0, 5e5]])
    rows = [("A", "1h", float(p), "support" if i % 3 else "resistance", i % 5 + 1, (t0 + pd.Timedelta(hours=i)).to_pydatetime(), (t0 + pd.Timedelta(hours=2 * i)).to_pydatetime(), (i % 10) / 10) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, level double, level_type string, strength long, first_touch timestamp, last_touch timestamp, confidence double")
    chains = []
    for r in sorted(rows, key=lambda r: r[2]):
        if chains and abs(r[2] - chains[-1][-1][2]) < chains[-1][-1][2] * 0.02:
            chains[-1].append(r)
        else:
            chains.append([r])
    want = [(np.mean([r[2] for r in c]), "support" if sum(r[3] == "support" for r in c) > len(c) / 2 else "resistance", sum(r[4] for r in c), min(1, np.mean([r[7] for r in c]) * 1.2)) for c in chains]
    got = sorted((r.level, r.level_type, r.strength, r.confidence) for r in trend.consolidate(df).collect())
    assert len(got) == len(want) > 20
    for g, w in zip(got, sorted(want), strict=True):
        assert g[1:3] == w[1:3] and g[0] == pytest.approx(w[0], rel=1e-9, abs=1e-9) and g[3] == pytest.approx(w[3])
