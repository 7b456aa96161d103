"""Trend decomposition, tests, reversals, levels and strength."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions import hodrick
from tickloom.functions.ranking import median_slope, pair_balance
from tickloom.functions.stats import normal_two_sided, t_p_value
from tickloom.operators.averages import safe_div
from tickloom.schemas import SERIES, positive, require


def hp_filter(bars: DataFrame, lam: float = 1600.0) -> DataFrame:
    """Trend, cycle and local noise of close."""
    require(bars, "close")
    positive(lam=lam)
    edge = hodrick.reach(lam) + 10
    df = fr.framed(bars, back=edge, ahead=edge, block_rows=max(fr.block_rows_of(bars.sparkSession), 2 * edge))
    row = F.struct("idx", "ts", "close", "core")
    blocks = df.groupBy(*fr.BLOCK, "n").agg(F.array_sort(F.collect_list(row)).alias("e"))
    blocks = blocks.select(*SERIES, "n", F.col("e.ts").alias("ts"), F.col("e.idx").alias("idx"), F.col("e.close").alias("close"), F.col("e.core").alias("core"))

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            closes = [batch.column("close")[r].values.to_numpy(zero_copy_only=False).astype(float) for r in range(batch.num_rows)]
            length = np.array([len(c) for c in closes])
            trends: list[np.ndarray] = [np.empty(0)] * len(closes)
            for size in np.unique(length).tolist():  # blocks of one length share the factors
                same = np.flatnonzero(length == size)
                for r, t in zip(same.tolist(), hodrick.solve(np.stack([closes[r] for r in same], axis=1), lam).T, strict=True):
                    trends[r] = t
            for r, (y, trend) in enumerate(zip(closes, trends, strict=True)):
                own = np.flatnonzero(batch.column("core")[r].values.to_numpy(zero_copy_only=False))
                noise = hodrick.noise(y - trend, batch.column("n")[r].as_py())
                at = pa.array(own)
                key = [batch.column(c).take(pa.array([r] * len(own), pa.int32())) for c in (*SERIES, "n")]
                yield pa.RecordBatch.from_arrays(
                    [*key[:2], batch.column("ts")[r].values.take(at), batch.column("idx")[r].values.take(at), key[2], pa.array(y[own]), pa.array(trend[own]), pa.array((y - trend)[own]), pa.array(noise[own], mask=np.isnan(noise[own]))],
                    names=[*SERIES, "ts", "idx", "n", "close", "trend", "cycle", "noise"])

    return blocks.mapInArrow(decompose, "symbol string, timeframe string, ts timestamp, idx long, n long, close double, trend double, cycle double, noise double")


def hp_strength(decomposed: DataFrame) -> DataFrame:
    """R squared of the trend, clipped to [0, 1]."""
    total = F.var_pop("close") * F.count("close")
    ratio = 1 - safe_div(F.sum(F.pow("cycle", 2)), total)
    return fr.per_series(decomposed, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0)))).alias("trend_strength"))


def mann_kendall(bars: DataFrame, alpha: float = 0.05, sen: bool = True) -> DataFrame:
    """Trend test with tie correction; Sen's slope unless ``sen`` is false. Series under 4 rows drop out."""
    require(bars, "close")
    df = pair_balance(bars, "close").filter("n >= 4")
    n, s = F.col("n"), F.col("s")
    sd = F.sqrt((n * (n - 1) * (2 * n + 5) - F.col("tie_term")) / 18)
    z = F.when(s > 0, safe_div(s - 1, sd)).when(s < 0, safe_div(s + 1, sd)).otherwise(0.0)
    df = df.withColumn("z_score", z).withColumn("p_value", normal_two_sided(F.col("z_score")))
    sure = F.col("p_value") < alpha
    df = df.select(
        *SERIES, "n", F.col("s").alias("s_statistic"), "z_score", "p_value",
        F.when(sure & (F.col("z_score") > 0), "increasing").when(sure, "decreasing").otherwise("no_trend").alias("trend"),
        sure.alias("significant"), F.when(sure, 1 - F.col("p_value")).otherwise(0.0).alias("confidence"),
        (s / (n * (n - 1) / 2)).alias("tau"))
    return df.join(median_slope(bars, "close"), SERIES) if sen else df


def extrema(bars: DataFrame, col: str = "close", order: int = 5) -> DataFrame:
    """Strict local peaks and troughs of one column."""
    require(bars, col)
    df = fr.framed(bars, back=order, ahead=order)
    kind = F.when(fr.is_peak(col, order), "peak").when(fr.is_trough(col, order), "trough")
    return fr.done(fr.core(df.withColumn("kind", kind)).filter("kind is not null")).select(
        *SERIES, "ts", "idx", "kind", F.col(col).alias("value"))


def _candidates(df: DataFrame, look: int, confirm: int) -> DataFrame:
    """Column ``_found``: the reversals of a bar in the order peak, trough, double top, double bottom."""
    c, idx, n = F.col("close"), F.col("idx"), F.col("n")
    half, w = look // 2, fr.last_rows(look)
    df = df.withColumn("_sma", fr.full(look, F.avg("close").over(w)))
    df = df.withColumns({
        "_below": F.coalesce(c < F.col("_sma"), F.lit(True)).cast("int"), "_above": F.coalesce(c > F.col("_sma"), F.lit(True)).cast("int"),
        "_neg": -idx,
    })
    ahead = fr.rows(1, confirm)
    left, right = fr.rows(-look, -1), fr.rows(0, look - 1)
    before = safe_div(c - fr.lag("close", 10), fr.lag("close", 10))
    clipped = safe_div(F.last("close").over(fr.rows(1, 10)) - c, c)
    later = safe_div(fr.lead("close", 10) - c, c)
    hi, lo = F.struct("close", "_neg"), F.struct("close", "idx")
    df = df.withColumns({
        "_peak": fr.is_peak("close", half), "_trough": fr.is_trough("close", half),
        "_allbelow": F.min("_below").over(ahead) == 1, "_allabove": F.min("_above").over(ahead) == 1,
        "_flipdown": F.coalesce((before > 0) & (clipped < 0), F.lit(False)), "_flipup": F.coalesce((before < 0) & (later > 0), F.lit(False)),
        "_lt": F.max(hi).over(left), "_rt": F.max(hi).over(right), "_lb": F.min(lo).over(left), "_rb": F.min(lo).over(right),
        "_around": F.collect_list("close").over(fr.rows(-look, look - 1)),
        "_next_lo": F.min("close").over(fr.rows(0, 2)), "_next_hi": F.max("close").over(fr.rows(0, 2)),
    })
    open_end = idx < n - confirm
    enough = n >= 2 * look

    def hit(kind: str, pattern: str, when: Column, price: Column, conf: Column, neck: Column) -> Column:
        return F.when(enough & when, F.struct(
            F.lit(kind).alias("type"), F.lit(pattern).alias("pattern"), price.alias("price"),
            conf.cast("double").alias("confidence"), neck.cast("double").alias("neckline")))

    none = F.lit(None)
    top_score = F.col("_allbelow").cast("int") + F.col("_flipdown").cast("int")
    low_score = F.col("_allabove").cast("int") + F.col("_flipup").cast("int")
    inner = (idx >= look) & (idx < n - look)

    def between(a: Column, b: Column) -> Column:
        return F.slice("_around", (a - (idx - look) + 1).cast("int"), (b - a + 1).cast("int"))

    lt, rt, lb, rb = F.col("_lt"), F.col("_rt"), F.col("_lb"), F.col("_rb")
    lt_at, rt_at = -lt["_neg"], -rt["_neg"]
    valley = F.when(inner, F.array_min(between(lt_at, rt_at)))
    crest = F.when(inner, F.array_max(between(lb["idx"], rb["idx"])))
    tops = inner & (F.abs(lt["close"] - rt["close"]) < lt["close"] * 0.02) & (rt_at - lt_at >= 2) & (F.col("_next_lo") < valley)
    bottoms = (
        inner & (F.abs(lb["close"] - rb["close"]) < lb["close"] * 0.02) & (rb["idx"] - lb["idx"] >= 2)
        & (F.col("_next_hi") > crest)
    )
    found = F.array_compact(F.array(
        hit("top_reversal", "peak_reversal", F.col("_peak") & open_end & (top_score >= 1), c, top_score / 2, none),
        hit("bottom_reversal", "trough_reversal", F.col("_trough") & open_end & (low_score >= 1), c, low_score / 2, none),
        hit("top_reversal", "double_top", tops, rt["close"], F.lit(0.7), valley),
        hit("bottom_reversal", "double_bottom", bottoms, rb["close"], F.lit(0.7), crest),
    ))
    return df.withColumn("_found", found).select(*fr.BLOCK, "ts", "idx", "n", "pos", "core", "_found")


def reversals(bars: DataFrame, lookback: int = 20, confirm: int = 3, dedupe: bool = True) -> DataFrame:
    """Top and bottom reversals. Of findings within ``confirm`` bars only the best is kept.

    The thinning walks along the findings; a gap of more than ``confirm`` bars always restarts
    it, so each stretch of close findings is walked on its own.
    """
    require(bars, "close")
    positive(lookback=lookback, confirm=confirm)
    df = _candidates(fr.framed(bars, back=2 * lookback + confirm, ahead=lookback + 10), lookback, confirm)
    df = df.withColumn("_any", (F.size("_found") > 0).cast("int"))
    recent = F.coalesce(F.max("_any").over(fr.rows(-confirm, -1)), F.lit(0))
    df = df.withColumn("_start", ((F.col("_any") == 1) & (recent == 0)).cast("double"))
    df = fr.running_sums(df.filter("core"), {"_island": F.col("_start")}).filter("_any = 1")
    each = df.select(*SERIES, "idx", "ts", "_island", F.posexplode("_found").alias("_k", "r"))
    if not dedupe:
        return each.select(*SERIES, "idx", "ts", "r.*")
    entry = F.struct("idx", "_k", "ts", "r")
    listed = each.groupBy(*SERIES, "_island").agg(F.array_sort(F.collect_list(entry)).alias("_list"))

    def walk(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        fresh = F.coalesce(x["idx"] - last["idx"] > confirm, F.lit(True))
        better = x["r"]["confidence"] > last["r"]["confidence"]
        head = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(fresh, F.concat(kept, F.array(x))).when(better, F.concat(head, F.array(x))).otherwise(kept)

    empty = F.filter("_list", lambda x: F.lit(False))
    walked = F.aggregate("_list", empty, walk)
    kept = listed.select(*SERIES, F.explode(walked).alias("e"))
    return kept.select(*SERIES, F.col("e.idx").alias("idx"), F.col("e.ts").alias("ts"), "e.r.*")


# Retracement ratios.
FIBONACCI = [0.236, 0.382, 0.5, 0.618, 0.786]
_LEVEL = ["level", "level_type", "strength", "first_touch", "last_touch", "confidence"]


def extrema_levels(bars: DataFrame, lookback: int = 100, min_touches: int = 2) -> DataFrame:
    """Prices that several local highs or lows share."""
    k = max(3, lookback // 20)
    df = fr.framed(bars, back=k, ahead=k)
    spots = F.array_compact(F.array(
        F.when(fr.is_peak("high", k), F.struct(F.col("high").alias("level"), F.lit(1).alias("top"))),
        F.when(fr.is_trough("low", k), F.struct(F.col("low").alias("level"), F.lit(0).alias("top")))))
    df = fr.core(df.withColumn("_s", spots)).filter(F.col("n") >= lookback).select(*SERIES, "ts", F.explode("_s").alias("s"))
    return df.groupBy(*SERIES, F.col("s.level").alias("level")).agg(
        F.when(F.max("s.top") == 1, "resistance").otherwise("support").alias("level_type"),
        F.count(F.lit(1)).alias("strength"), F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"),
    ).filter(F.col("strength") >= min_touches).withColumn("confidence", F.least(F.lit(1.0), F.col("strength") / 10)).select(*SERIES, *_LEVEL)


def fibonacci_levels(bars: DataFrame, lookback: int = 100) -> DataFrame:
    df = fr.index_bars(bars).filter((F.col("n") >= lookback) & (F.col("idx") >= F.col("n") - lookback))
    stats = df.groupBy(*SERIES).agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"),
                                    F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"))
    ratio = F.col("_ratio")
    return stats.withColumn("_ratio", F.explode(F.array(*[F.lit(r) for r in FIBONACCI]))).select(
        *SERIES, (F.col("_hi") - (F.col("_hi") - F.col("_lo")) * ratio).alias("level"),
        F.when(ratio > 0.5, "support").otherwise("resistance").alias("level_type"), F.lit(1).cast("long").alias("strength"),
        "first_touch", "last_touch", F.lit(0.5).alias("confidence"))


def psychological_levels(bars: DataFrame, lookback: int = 100, min_touches: int = 2, tol: float = 0.02) -> DataFrame:
    """Eleven round numbers around the last close, with the closes that came near."""
    df = fr.framed(bars)
    stats = fr.per_series(df, F.max_by("close", "idx").alias("_last")).filter(F.col("n") >= lookback)
    digits = F.length(F.floor("_last").cast("string"))
    mag = F.pow(F.lit(10.0), digits - 2)
    stats = stats.withColumn("_levels", F.filter(F.transform(
        F.sequence(F.lit(-5), F.lit(5)), lambda i: F.rint(F.col("_last") / mag) * mag + i * mag), lambda x: x > 0))
    near = F.filter("_levels", lambda x: F.abs(F.col("close") - x) < x * tol)
    hits = fr.attach(df, stats).select(*SERIES, "ts", "_last", F.explode(near).alias("level"))
    return hits.groupBy(*SERIES, "level", "_last").agg(
        F.count(F.lit(1)).alias("strength"), F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"),
    ).filter(F.col("strength") >= min_touches).withColumns({
        "level_type": F.when(F.col("level") < F.col("_last"), "support").otherwise("resistance"),
        "confidence": F.least(F.lit(1.0), F.col("strength") / 20)}).select(*SERIES, *_LEVEL)


def consolidate(levels: DataFrame, tol: float = 0.02) -> DataFrame:
    """Chain levels that lie within ``tol`` of the one below and merge each chain.

    Levels fall into cells of a logarithmic scale as wide as the tolerance, so those of one cell are one chain and are summed up
    before anything is ordered. Chains run on where a cell's lowest level lies near the highest of the cell below: a window over the
    occupied cells of a series, of which a price range of one to a million has 700. A level of zero or less chains with none.
    """
    width = math.log1p(tol) * (1 - 1e-12)
    n, support = F.count(F.lit(1)), F.count_if(F.col("level_type") == "support")
    cells = levels.filter("level > 0").groupBy(*SERIES, F.floor(F.log("level") / width).alias("_cell")).agg(
        n.alias("_n"), support.alias("_s"), F.sum("level").alias("_sum"), F.min("level").alias("_lo"), F.max("level").alias("_hi"), F.sum("strength").alias("strength"),
        F.min("first_touch").alias("first_touch"), F.max("last_touch").alias("last_touch"), F.sum("confidence").alias("_c"))
    up = Window.partitionBy(*SERIES).orderBy("_cell")
    below = F.lag("_hi").over(up)
    cells = cells.withColumn("_new", F.when(F.col("_lo") - below < below * tol, 0).otherwise(1))
    chains = cells.withColumn("_chain", F.sum("_new").over(up)).groupBy(*SERIES, "_chain").agg(
        F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_sum").alias("_sum"), F.sum("strength").alias("strength"), F.min("first_touch").alias("first_touch"),
        F.max("last_touch").alias("last_touch"), F.sum("_c").alias("_c"))
    alone = levels.filter("level <= 0").select(
        *SERIES, F.lit(1).cast("long").alias("_n"), (F.col("level_type") == "support").cast("long").alias("_s"), F.col("level").alias("_sum"), "strength", "first_touch", "last_touch", F.col("confidence").alias("_c"))
    return chains.drop("_chain").unionByName(alone).select(
        *SERIES, (F.col("_sum") / F.col("_n")).alias("level"), F.when(F.col("_s") > F.col("_n") / 2, "support").otherwise("resistance").alias("level_type"),
        F.col("strength"), "first_touch", "last_touch", F.least(F.lit(1.0), F.col("_c") / F.col("_n") * 1.2).alias("confidence"))


def classify_levels(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """Below the last close is support."""
    last = bars.groupBy(*SERIES).agg(F.max_by("close", "ts").alias("_last"))
    kind = F.when(F.col("level") < F.col("_last"), "support").otherwise("resistance")
    return levels.join(last, SERIES).withColumn("level_type", kind).drop("_last")


def sr_levels(bars: DataFrame, lookback: int = 100, min_touches: int = 2, tol: float = 0.02) -> DataFrame:
    """Support and resistance from extrema, retracements and round numbers, merged and classified."""
    require(bars, "high", "low", "close")
    df = fr.index_bars(bars)
    found = extrema_levels(df, lookback, min_touches).unionByName(fibonacci_levels(df, lookback)).unionByName(
        psychological_levels(df, lookback, min_touches, tol))
    return classify_levels(consolidate(found, tol), bars)


def adx_label(adx: Column) -> Column:
    return F.when(adx < 25, "weak_trend").when(adx < 50, "strong_trend").when(adx < 75, "very_strong_trend").otherwise("extremely_strong_trend")


def adx(bars: DataFrame, period: int = 20) -> DataFrame:
    """Directional strength from closes alone, every bar; null before 2*period-1 rows."""
    require(bars, "close")
    w = fr.last_rows(period)
    df = fr.framed(bars, back=2 * period + 1).withColumn("_d", F.coalesce(F.col("close") - fr.lag("close"), F.lit(0.0)))
    df = df.withColumns({"_up": fr.full(period, F.avg(F.greatest("_d", F.lit(0.0))).over(w)),
                         "_dn": fr.full(period, F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w))})
    both = F.col("_up") + F.col("_dn")
    df = df.withColumn("_dx", F.coalesce(safe_div(100 * F.abs(F.col("_up") - F.col("_dn")), both), F.lit(0.0)))
    df = df.withColumn("adx", fr.full(period, F.avg("_dx").over(w)))
    return fr.done(fr.core(df.drop("_d", "_up", "_dn", "_dx")))


def regression_strength(bars: DataFrame) -> DataFrame:
    """Slope, R squared and p-value of close on position, from one combined aggregate per series."""
    df = fr.index_bars(bars)
    x = F.col("idx").cast("double")
    stats = fr.per_series(df, F.regr_slope("close", x).alias("slope"), F.regr_r2("close", x).alias("r_squared"))
    free = F.col("n") - 2
    t = F.sqrt(safe_div(F.col("r_squared") * free, 1 - F.col("r_squared")))
    stats = stats.withColumn("p_value", t_p_value(t, free))
    return stats.withColumn("trend_direction", F.when(F.col("slope") > 0, "up").otherwise("down"))


def ma_alignment(bars: DataFrame) -> DataFrame:
    """Last close against the 10, 20 and 50 bar means."""
    df = fr.index_bars(bars)
    back = F.col("n") - F.col("idx")
    means = {p: F.when(F.max("n") >= p, F.avg(F.when(back <= p, F.col("close")))).alias(f"ma{p}") for p in (10, 20, 50)}
    s = fr.per_series(df, F.max_by("close", "idx").alias("price"), *means.values())
    p, a, b, c = (F.col(x) for x in ("price", "ma10", "ma20", "ma50"))
    up, down = (p > a) & (a > b) & (b > c), (p < a) & (a < b) & (b < c)
    score = ((p > a).cast("int") + (a > b).cast("int") + (b > c).cast("int")) / 3
    kind = F.when(c.isNull(), "insufficient_data").when(up, "perfect_uptrend").when(down, "perfect_downtrend").otherwise("mixed")
    strength = F.when(c.isNull(), 0.0).when(up | down, 1.0).otherwise(score)
    return s.withColumns({"alignment_type": kind, "alignment": strength, "aligned": strength > 0.66})


def momentum_strength(bars: DataFrame, period: int = 20) -> DataFrame:
    df = fr.index_bars(bars)

    def nth(k: int) -> Column:
        return F.max(F.when(F.col("idx") == F.col("n") - k, F.col("close")))

    s = fr.per_series(df, nth(1).alias("_c"), nth(period).alias("_p"), nth(2 * period).alias("_pp")).filter(F.col("n") >= period)
    move = F.col("_c") - F.col("_p")
    roc = 100 * safe_div(move, F.col("_p"))
    return s.select(*SERIES, "n", roc.alias("rate_of_change"), move.alias("momentum"),
                    F.coalesce(move - (F.col("_p") - F.col("_pp")), F.lit(0.0)).alias("acceleration"),
                    F.least(F.abs(roc) / 10, F.lit(1.0)).alias("momentum_strength"))


def trend_quality(overall: Column) -> Column:
    return (F.when(overall < 20, "no_trend").when(overall < 40, "weak_trend").when(overall < 60, "moderate_trend")
            .when(overall < 80, "strong_trend").otherwise("very_strong_trend"))


def trend_strength(bars: DataFrame, period: int = 20) -> DataFrame:
    """Six strength measures of each series and their mean on a 0-100 scale; needs 2*period bars."""
    require(bars, "close")
    df = fr.index_bars(bars)
    last = adx(df, period).filter(F.col("idx") == F.col("n") - 1).select(*SERIES, "n", F.coalesce("adx", F.lit(0.0)).alias("adx"))
    parts = [
        regression_strength(df).select(*SERIES, "slope", "r_squared", F.col("p_value").alias("slope_p_value"), "trend_direction"),
        mann_kendall(df, sen=False).select(*SERIES, F.col("trend").alias("mk_trend"), F.col("confidence").alias("mk_confidence"), "tau"),
        hp_strength(hp_filter(df)).select(*SERIES, F.col("trend_strength").alias("hp_strength")),
        ma_alignment(df).select(*SERIES, "alignment_type", "alignment"),
        momentum_strength(df, period).drop("n"),
    ]
    out = last.filter(F.col("n") >= 2 * period)
    for p in parts:
        out = out.join(p, SERIES)
    scores = [F.least("adx", F.lit(100.0)), F.col("r_squared") * 100, F.col("mk_confidence") * 100,
              F.col("hp_strength") * 100, F.col("alignment") * 100, F.col("momentum_strength") * 100]
    overall = sum(scores[1:], scores[0]) / len(scores)
    out = out.withColumn("overall_strength", overall)
    return out.withColumns({"adx_interpretation": adx_label(F.col("adx")), "trend_quality": trend_quality(F.col("overall_strength"))})
