"""Price against volume: correlation, divergences, unusual volume, profiles, confirmation."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.rules import Rule, emit
from tickloom.functions.stats import normal_upper
from tickloom.operators.averages import correlation, safe_div
from tickloom.schemas import SERIES, require


def _change(col: str) -> Column:
    return safe_div(F.col(col) - fr.lag(col), fr.lag(col))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _with_corr(df: DataFrame, n: int) -> DataFrame:
    df = df.withColumns({"_dp": _change("close"), "_dv": _change("volume")})
    w = fr.last_rows(n)
    whole = (F.count("_dp").over(w) == n) & (F.count("_dv").over(w) == n)
    return df.withColumn("pv_corr", F.when(whole, finite(correlation("_dp", "_dv", w))))


def pv_corr(bars: DataFrame, n: int = 20) -> DataFrame:
    """Rolling correlation of price and volume changes."""
    require(bars, "close", "volume")
    return fr.done(fr.core(_with_corr(fr.framed(bars, back=n + 1), n).drop("_dp", "_dv")))


def pv_divergence(bars: DataFrame, n: int = 20, min_div: float = 0.1) -> DataFrame:
    """A new price extremum against the previous small one while volume went the other way.

    The mean correlation between the two comes from running sums kept at both ends.
    """
    require(bars, "close", "volume")
    df = _with_corr(fr.framed(bars, back=4 * n + 10, ahead=6), n)
    so_far = fr.rows(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "_v6": F.avg("volume").over(fr.rows(-5, 0)),
        "_cs": F.coalesce(F.sum("pv_corr").over(so_far), F.lit(0.0)),
        "_cn": F.count("pv_corr").over(so_far),
        "_pk": fr.is_peak("close", 5), "_tr": fr.is_trough("close", 5),
    })
    c, before, after = F.col("close"), fr.lag("close"), fr.lead("close")
    point = F.struct("idx", "ts", "close", F.col("_v6").alias("v"), F.col("_cs").alias("s"), F.col("_cn").alias("k"))
    past = fr.rows(-2 * n, -6)
    df = df.withColumns({
        "_p": F.last(F.when((c > before) & (c > after), point), ignorenulls=True).over(past),
        "_t": F.last(F.when((c < before) & (c < after), point), ignorenulls=True).over(past),
    })
    inner = (F.col("n") >= 2 * n) & (F.col("idx") >= n) & (F.col("idx") < F.col("n") - 5)
    df = fr.core(df).filter(inner & (F.col("_pk") | F.col("_tr")))
    df = df.withColumn("q", F.when(F.col("_pk"), F.col("_p")).otherwise(F.col("_t"))).filter("q is not null")
    dp = safe_div(c - F.col("q.close"), F.col("q.close"))
    dv = safe_div(F.col("_v6") - F.col("q.v"), F.col("q.v"))
    hit = F.when(F.col("_pk"), (dp > 0) & (dv < -min_div)).otherwise((dp < 0) & (dv > min_div))
    corr = F.try_divide(F.col("_cs") - F.col("q.s"), (F.col("_cn") - F.col("q.k")).cast("double"))
    return df.filter(hit).select(
        *SERIES, F.when(F.col("_pk"), "bearish").otherwise("bullish").alias("divergence_type"),
        F.col("q.idx").alias("start_idx"), F.col("idx").alias("end_idx"), F.col("q.ts").alias("start_ts"), F.col("ts").alias("end_ts"),
        (dp * 100).alias("price_change_pct"), (dv * 100).alias("volume_change_pct"),
        F.least(F.lit(1.0), F.abs(dv) / (F.abs(dp) + 0.001)).alias("strength"),
        F.coalesce(corr < 0, F.lit(False)).alias("confirmed"), corr.alias("correlation"),
    )


def continuous_divergence(bars: DataFrame, n: int = 20) -> DataFrame:
    """Stretches where the price and volume trends point apart.

    The rule is a scan: a stretch starts at a strong bar, lasts while the signs hold, and the
    scan goes on after the bar that ended it. Bars of equal sign pair form runs; each run gives
    at most one stretch, and a run only depends on the one right before it (whose end bar is
    this run's first bar). Where a run's only strong bar is that first bar, it counts exactly
    if the run before did not; such dependent runs form chains that alternate.
    """
    require(bars, "close", "volume")
    w, x = fr.last_rows(n), F.col("pos").cast("double")
    df = fr.framed(bars, back=2 * n + 1, ahead=1)
    df = df.withColumns({
        "_pt": fr.full(n, safe_div(F.regr_slope("close", x).over(w), F.avg("close").over(w))),
        "_vt": fr.full(n, safe_div(F.regr_slope("volume", x).over(w), F.avg("volume").over(w))),
        "_c0": fr.lag("close", n), "_v0": fr.lag("volume", n),
        "_c1": F.coalesce(fr.lead("close"), F.col("close")), "_v1": F.coalesce(fr.lead("volume"), F.col("volume")),
    })
    pt, vt = F.col("_pt"), F.col("_vt")
    state = F.when((pt > 0) & (vt < 0), "bearish").when((pt < 0) & (vt > 0), "bullish").otherwise("none")
    df = df.withColumn("_st", state)
    df = df.withColumn("_new", F.when(F.col("_st").eqNullSafe(fr.lag("_st")), 0).otherwise(1).cast("double"))
    df = fr.running_sums(df.filter("core"), {"_run": F.col("_new")})
    strong = (
        (F.abs(pt) > 0.01) & (F.abs(vt) > 0.01) & (F.col("idx") >= n) & (F.col("idx") < F.col("n") - n)
    )
    at = F.when(strong, F.struct("idx", pt.alias("pt"), vt.alias("vt"), F.col("_c0").alias("c0"), F.col("_v0").alias("v0")))
    runs = (
        df.filter("_st <> 'none'")
        .withColumn("_at", at)
        .groupBy(*SERIES, F.col("_run").cast("long").alias("run"), F.col("_st").alias("kind"))
        .agg(
            F.min("idx").alias("first"), F.max("idx").alias("last"), F.max("n").alias("n"),
            F.min("_at").alias("s1"), F.min(F.when(F.col("_new") == 0, F.col("_at"))).alias("s2"),
            F.max_by("_c1", "idx").alias("c1"), F.max_by("_v1", "idx").alias("v1"),
        )
    )
    prev = runs.select(*SERIES, (F.col("run") + 1).alias("run"), F.lit(True).alias("touching"))
    runs = runs.join(prev, [*SERIES, "run"], "left")
    sure = (
        F.when(F.col("s2").isNotNull(), 1).when(F.col("s1").isNull(), 0)
        .when(F.col("touching").isNull(), 1)
    )
    size = fr.block_rows_of(bars.sparkSession)
    runs = runs.withColumns({
        "sure": sure, "idx": F.col("run"), "blk": F.floor(F.col("run") / size),
        "pos": F.lit(0), "core": F.lit(True),
    })
    runs = fr.running_sums(runs, {"chain": F.when(F.col("sure").isNotNull(), 1.0).otherwise(0.0)})
    links = Window.partitionBy(*SERIES, "chain").orderBy("run")
    odd = (F.row_number().over(links) - 1) % 2 == 1
    head = F.first("sure").over(links)
    runs = runs.withColumn("hit", F.when(odd, 1 - head).otherwise(head))
    ended = runs.filter("hit = 1").select(*SERIES, (F.col("run") + 1).alias("run"), F.lit(True).alias("cut"))
    out = runs.filter("hit = 1").join(ended, [*SERIES, "run"], "left")
    out = out.withColumn("s", F.when(F.col("cut"), F.col("s2")).otherwise(F.col("s1")))
    ratio = safe_div(F.abs("s.vt"), F.abs("s.pt"))
    return out.select(
        *SERIES, F.col("kind").alias("divergence_type"), (F.col("s.idx") - n).alias("start_idx"),
        F.least(F.col("last") + 1, F.col("n") - 1).alias("end_idx"),
        (100 * safe_div(F.col("c1") - F.col("s.c0"), F.col("s.c0"))).alias("price_change_pct"),
        (100 * safe_div(F.col("v1") - F.col("s.v0"), F.col("s.v0"))).alias("volume_change_pct"),
        F.least(F.lit(1.0), ratio).alias("strength"), F.lit(True).alias("confirmed"),
    )


UNUSUAL = ("climax", "dry_up", "breakout", "churning", "pocket_pivot")


def unusual_volume(bars: DataFrame, n: int = 20, groups: Collection[str] = UNUSUAL) -> DataFrame:
    """Climax, dry-up, breakout, churning and pocket pivot from one frame.

    ``confidence`` is the significance of the finding.
    """
    require(bars, "high", "low", "close", "volume")
    w, past = fr.last_rows(n), fr.rows(-n, -1)
    c, v, idx = F.col("close"), F.col("volume"), F.col("idx")
    df = fr.framed(bars, back=51).withColumns({
        "_mean": F.avg("volume").over(w), "_sd": F.stddev_samp("volume").over(w), "_was": fr.lag("close"),
        "_hi": F.max("close").over(past), "_lo": F.min("close").over(past),
        "_quiet": safe_div(F.stddev_samp("close").over(fr.rows(-5, 0)), F.avg("close").over(fr.rows(-5, 0))),
        "_ma50": F.avg("close").over(fr.last_rows(50)), "_top": F.max("close").over(fr.rows(-50, -1)),
        "_v10": F.avg("volume").over(fr.rows(-10, -1)),
    })
    df = df.withColumn("_down", F.when(c < F.col("_was"), v))
    df = df.withColumns({"_maxdown": F.max("_down").over(fr.rows(-10, -1)), "_z": safe_div(v - F.col("_mean"), F.col("_sd")),
                         "_ratio": safe_div(v, F.col("_mean"))})
    z, ratio, was, mean = F.col("_z"), F.col("_ratio"), F.col("_was"), F.col("_mean")
    hi, lo, spread, quiet = F.col("_hi"), F.col("_lo"), safe_div(F.col("high") - F.col("low"), c), F.col("_quiet")
    ready, move = idx >= n, c - was
    base = {"avg_volume": mean, "pattern_volume": v, "volume_ratio": ratio}
    busy = ready & (ratio > 1.5)
    near = c >= F.col("_top") * 0.95
    rules = {
        "climax": [Rule(F.when(move > 0, "buying_climax").when(move < 0, "selling_climax").otherwise("volume_climax"),
                        ready & (z > 3), F.lit("neutral"), F.lit(None), meta=base | {"z_score": z, "price_change": move})],
        "dry_up": [Rule("volume_dry_up", ready & (ratio < 0.5), "neutral", ratio,
                        meta=base | {"price_volatility": quiet, "potential_breakout": (quiet < 0.01).cast("int")})],
        "breakout": [
            Rule("volume_breakout_up", busy & (c > hi), "bullish", F.least(F.lit(1.0), ratio / 2),
                 meta=base | {"breakout_level": hi, "price_move": safe_div(c - hi, hi)}),
            Rule("volume_breakout_down", busy & ~(c > hi) & (c < lo), "bearish", F.least(F.lit(1.0), ratio / 2),
                 meta=base | {"breakout_level": lo, "price_move": safe_div(lo - c, lo)}),
        ],
        "churning": [Rule("volume_churning", busy & (spread < 0.01), "neutral", ratio * (1 - spread),
                          meta=base | {"daily_range": spread,
                                       "potential_distribution": ((idx >= 50) & (c > F.col("_ma50"))).cast("int")})],
        "pocket_pivot": [Rule("pocket_pivot", (idx >= 10) & (c > was) & (v > F.col("_maxdown")), "bullish",
                              F.when(near, 0.8).otherwise(0.5),
                              meta={"avg_volume": F.col("_v10"), "pattern_volume": v,
                                    "volume_ratio": safe_div(v, F.col("_maxdown")), "max_down_volume": F.col("_maxdown"),
                                    "near_high": near.cast("int"), "price_change": safe_div(move, was)})],
    }
    out = emit(df, "volume", [r for g in UNUSUAL if g in groups for r in rules[g]])
    if "climax" not in groups:
        return out
    tail = normal_upper(F.col("metadata")["z_score"])
    return out.withColumn("confidence", F.when(F.col("pattern_name").endswith("climax"), tail).otherwise(F.col("confidence")))


def wyckoff(bars: DataFrame, period: int = 20) -> DataFrame:
    """Accumulation and distribution phases inside a narrow 2*period range."""
    require(bars, "high", "low", "close", "volume")
    w = fr.rows(-2 * period, -1)
    df = fr.framed(bars, back=2 * period).withColumns({
        "range_high": F.max("high").over(w), "range_low": F.min("low").over(w), "_mean": F.avg("close").over(w),
        "_v1": F.avg("volume").over(fr.rows(-2 * period, -period - 1)), "_v2": F.avg("volume").over(fr.rows(-period, -1)),
    })
    c, hi, lo = F.col("close"), F.col("range_high"), F.col("range_low")
    narrow = (F.col("idx") >= 2 * period) & (safe_div(hi - lo, c) < 0.15)
    acc = narrow & (F.col("_v2") < F.col("_v1") * 0.8) & (c > F.col("_mean"))
    dist = narrow & (F.col("_v2") > F.col("_v1") * 1.2) & (c < F.col("_mean"))
    stage = (
        F.when(acc & (c < lo * 1.02), "spring").when(acc, "markup")
        .when(c > hi * 0.98, "upthrust").otherwise("markdown")
    )
    return fr.done(fr.core(df).filter(acc | dist)).select(
        *SERIES, "ts", "idx", F.when(acc, "accumulation").otherwise("distribution").alias("phase"), stage.alias("stage"),
        "range_high", "range_low", F.when(acc, "decreasing").otherwise("increasing").alias("volume_pattern"))


def volume_by_price(bars: DataFrame, bins: int = 20) -> DataFrame:
    """Volume per equal-width band of close, every band listed. The top edge belongs to no band."""
    require(bars, "close", "volume")
    df = fr.framed(bars)
    edges = fr.per_series(df, F.min("close").alias("lo"), F.max("close").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    placed = fr.attach(df, edges).withColumn("bin", F.floor(safe_div(F.col("close") - F.col("lo"), step)))
    sums = placed.filter(F.col("bin") < bins).groupBy(*SERIES, "bin").agg(F.sum("volume").alias("volume"))
    return _all_bins(edges, sums, bins)


def _all_bins(edges: DataFrame, sums: DataFrame, bins: int) -> DataFrame:
    step = (F.col("hi") - F.col("lo")) / bins
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(sums, [*SERIES, "bin"], "left").select(
        *SERIES, "bin", (F.col("lo") + F.col("bin") * step).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_high"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def value_area_by_price(banded: DataFrame) -> DataFrame:
    """Point of control and the 15 % to 85 % volume band of :func:`volume_by_price`."""
    series = Window.partitionBy(*SERIES)
    df = banded.withColumns({"_cum": F.sum("volume").over(series.orderBy("bin")), "_total": F.sum("volume").over(series)})
    first = F.struct(F.col("volume"), -F.col("bin"))
    return df.groupBy(*SERIES).agg(
        F.max_by((F.col("bin_low") + F.col("bin_high")) / 2, first).alias("poc"),
        F.min(F.when(F.col("_cum") >= F.col("_total") * 0.85, F.col("bin_high"))).alias("value_area_high"),
        F.min(F.when(F.col("_cum") >= F.col("_total") * 0.15, F.col("bin_low"))).alias("value_area_low"),
        F.sum("volume").alias("total_volume"))


def smart_money_flow(bars: DataFrame, period: int = 20) -> DataFrame:
    require(bars, "high", "low", "close", "volume")
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    raw = price * F.col("volume")
    signed = F.when(F.col("idx") == 0, 0.0).when(F.col("close") > fr.lag("close"), raw).otherwise(-raw)
    df = fr.framed(bars, back=period).withColumn("_flow", signed)
    df = df.withColumn("smart_money", fr.full(period, F.sum("_flow").over(fr.last_rows(period))))
    return fr.done(fr.core(df.drop("_flow")))


def _days(bars: DataFrame, up: bool) -> DataFrame:
    require(bars, "close", "volume")
    df = fr.framed(bars, back=50).withColumns({"_was": fr.lag("close"), "_v50": fr.full(50, F.avg("volume").over(fr.last_rows(50)))})
    c, was = F.col("close"), F.col("_was")
    moved = c > was * 1.002 if up else c < was * 0.998
    df = fr.core(df).filter(moved & (F.col("volume") > F.col("_v50") * 1.1))
    return fr.done(df).select(*SERIES, "ts", "idx", "close", "volume")


def accumulation_days(bars: DataFrame) -> DataFrame:
    return _days(bars, True)


def distribution_days(bars: DataFrame) -> DataFrame:
    return _days(bars, False)


def confirm_volume(patterns: DataFrame, bars: DataFrame, min_increase: float = 1.5) -> DataFrame:
    """Mean volume of a pattern against the 20 bars before it, judged by pattern type.

    Range sums come from cumulative sums looked up at the ends of each range: one equi-join on
    (series, position) whatever the length of the pattern.
    """
    require(patterns, "pattern_id", "start_idx", "end_idx", "pattern_type")
    v, i = F.col("volume"), F.col("idx")
    sums = fr.running_sums(fr.framed(bars), {"_cv": v, "_civ": i * v}).select(*SERIES, "idx", "volume", "_cv", "_civ")
    s, e = F.col("start_idx"), F.col("end_idx")
    base = F.greatest(s - 21, F.lit(-1))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), k.cast("long").alias("idx"))
                      for r, k in (("end", e), ("before", s - 1), ("base", base), ("start", s), ("zero", F.lit(0)))])
    keyed = patterns.select("pattern_id", *SERIES, "pattern_type", "start_idx", "end_idx", F.explode(roles).alias("r"))
    at = keyed.select("*", "r.role", "r.idx").drop("r").join(sums, [*SERIES, "idx"])

    def pick(role: str, col: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col(col))), F.lit(0.0))

    g = at.groupBy("pattern_id", *SERIES, "pattern_type", "start_idx", "end_idx").agg(
        (pick("end", "_cv") - pick("before", "_cv")).alias("_sum"),
        (pick("end", "_civ") - pick("before", "_civ")).alias("_isum"),
        (pick("before", "_cv") - pick("base", "_cv")).alias("_bsum"),
        pick("zero", "volume").alias("_v0"), pick("start", "volume").alias("_first"), pick("end", "volume").alias("_last"))
    k = (e - s + 1).cast("double")
    centre = (s + e) / 2
    slope = safe_div(F.col("_isum") - centre * F.col("_sum"), k * (k * k - 1) / 12)
    baseline = F.when(s == 0, F.col("_v0")).otherwise(safe_div(F.col("_bsum"), F.least(s, F.lit(20)).cast("double")))
    g = g.withColumns({"baseline_volume": baseline, "pattern_volume": F.col("_sum") / k, "_slope": slope})
    g = g.withColumn("volume_ratio", F.coalesce(safe_div(F.col("pattern_volume"), F.when(baseline > 0, baseline)), F.lit(0.0)))
    r, kind, one = F.col("volume_ratio"), F.col("pattern_type"), F.lit(1.0)
    confirmed = (
        F.when(kind == "breakout", r >= min_increase)
        .when(kind == "reversal", (r > 1.2) & (F.coalesce(F.col("_slope"), F.lit(0.0)) > 0))
        .when(kind == "continuation", r > 0.8).otherwise(r >= 1.0)
    )
    confidence = F.when(kind == "breakout", F.least(one, r / 2)).when(kind == "reversal", F.least(one, r / 1.5)).otherwise(F.least(one, r))
    return g.select("pattern_id", *SERIES, "pattern_type", "start_idx", "end_idx", confirmed.alias("confirmed"),
                    confidence.alias("confidence"), "volume_ratio", "baseline_volume", "pattern_volume",
                    F.when(F.col("_last") > F.col("_first"), "increasing").otherwise("decreasing").alias("volume_trend"))


def volume_profile(bars: DataFrame, bins: int = 30, period: int | None = None) -> DataFrame:
    """Volume of each bar spread over the price bands between its low and high.

    A bar's volume is divided by the number of band edges it covers, counted before clipping.
    """
    require(bars, "high", "low", "close", "volume")
    df = fr.index_bars(bars)
    if period:
        df = df.filter(F.col("idx") >= F.col("n") - period)
    df = fr.framed(df)
    edges = fr.per_series(df, F.min("low").alias("lo"), F.max("high").alias("hi"))
    rows = fr.attach(df, edges)
    step = (F.col("hi") - F.col("lo")) / bins
    first = F.least(F.ceil(safe_div(F.col("low") - F.col("lo"), step)), F.lit(bins + 1))
    last = F.least(F.floor(safe_div(F.col("high") - F.col("lo"), step)) + 1, F.lit(bins + 1))
    rows = rows.withColumns({"_a": first, "_b": last}).filter((F.col("_b") > F.col("_a")) & (F.col("_a") < bins))
    share = F.col("volume") / (F.col("_b") - F.col("_a"))
    spread = rows.select(*SERIES, share.alias("_share"), F.explode(F.sequence("_a", F.least(F.col("_b"), F.lit(bins)) - 1)).alias("bin"))
    sums = spread.groupBy(*SERIES, "bin").agg(F.sum("_share").alias("volume"))
    return _all_bins(edges, sums, bins)


def profile_value_area(profile: DataFrame) -> DataFrame:
    """Point of control and the heaviest bands that together reach 70 % of the volume."""
    series = Window.partitionBy(*SERIES)
    heavy = series.orderBy(F.desc("volume"), F.desc("bin"))
    df = profile.withColumns({
        "_total": F.sum("volume").over(series),
        "_before": F.coalesce(F.sum("volume").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    }).withColumn("_in", F.col("_before") < F.col("_total") * 0.7)
    first = F.struct(F.col("volume"), -F.col("bin"))
    area = F.sum(F.when(F.col("_in"), F.col("volume")))
    return df.groupBy(*SERIES).agg(
        F.max_by((F.col("bin_low") + F.col("bin_high")) / 2, first).alias("poc"), F.max("volume").alias("poc_volume"),
        F.max(F.when(F.col("_in"), F.col("bin_high"))).alias("value_area_high"),
        F.min(F.when(F.col("_in"), F.col("bin_low"))).alias("value_area_low"),
        F.sum("volume").alias("total_volume"), area.alias("value_area_volume"),
        (100 * safe_div(area, F.sum("volume"))).alias("value_area_percentage"))


def profile_levels(profile: DataFrame) -> DataFrame:
    """High- and low-volume bands, point of control and value area as price levels."""
    area = profile_value_area(profile)
    cuts = profile.groupBy(*SERIES).agg(F.percentile("volume", F.lit(0.7)).alias("_p70"), F.percentile("volume", F.lit(0.3)).alias("_p30"))
    v = F.col("volume")
    bands = profile.join(cuts, SERIES).join(area.select(*SERIES, "total_volume"), SERIES)
    share = v / F.col("total_volume")
    nodes = bands.select(
        *SERIES, F.when(v > F.col("_p70"), "hvn").when((v < F.col("_p30")) & (v > 0), "lvn").alias("level_type"),
        ((F.col("bin_low") + F.col("bin_high")) / 2).alias("price"), v.alias("volume"),
        F.when(v > F.col("_p70"), share).otherwise(1 - share).alias("strength")).filter("level_type is not null")
    marks = area.select(*SERIES, F.explode(F.array(*[
        F.struct(F.lit(k).alias("level_type"), F.col(c).alias("price"), vol.cast("double").alias("volume"), F.lit(s).alias("strength"))
        for k, c, vol, s in (("poc", "poc", F.col("poc_volume"), 1.0), ("value_area_high", "value_area_high", F.lit(None), 0.8),
                             ("value_area_low", "value_area_low", F.lit(None), 0.8))])).alias("m")).select(*SERIES, "m.*")
    return nodes.unionByName(marks)


# Weights of the strength components.
STRENGTH_WEIGHTS = {
    "volume_surge": 0.3,
    "volume_trend": 0.2,
    "relative_volume": 0.2,
    "volume_consistency": 0.15,
    "price_volume_correlation": 0.15,
}


def volume_signal_strength(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Five volume components of each bar and their weighted sum; null for the first two bars."""
    require(bars, "close", "volume")
    w, v = fr.rows(-lookback, -1), F.col("volume")
    df = fr.framed(bars, back=max(51, lookback + 1)).withColumns({"_dp": _change("close"), "_dv": _change("volume")})
    inner = fr.rows(-lookback + 1, -1)
    df = df.withColumns({
        "_mean": F.avg("volume").over(w), "_sd": F.stddev_samp("volume").over(w),
        "_slope": F.regr_slope("volume", F.col("pos").cast("double")).over(w), "_long": F.avg("volume").over(fr.rows(-50, -1)),
        "_corr": finite(correlation("_dp", "_dv", inner)), "_k": F.least(F.count("_dp").over(inner), F.count("_dv").over(inner)),
    })
    one, zero, mean = F.lit(1.0), F.lit(0.0), F.when(F.col("_mean") > 0, F.col("_mean"))
    surge = F.coalesce(F.least(one, v / mean / 2), zero)
    parts = {
        "volume_surge": surge,
        "volume_trend": F.coalesce(F.least(one, F.abs(F.col("_slope") / mean) * 10), zero),
        "relative_volume": F.when(F.col("idx") >= 50, F.coalesce(F.least(one, safe_div(v, F.col("_long"))), zero)).otherwise(surge),
        "volume_consistency": F.greatest(zero, 1 - F.coalesce(F.col("_sd") / mean, one)),
        "price_volume_correlation": F.when(F.col("_k") > 2, F.coalesce(F.abs("_corr"), zero)).otherwise(zero),
    }
    df = fr.core(df).withColumns({k: F.when(F.col("idx") >= 2, c) for k, c in parts.items()})
    total = sum((F.col(k) * wt for k, wt in STRENGTH_WEIGHTS.items()), F.lit(0.0))
    s = F.col("strength")
    quality = (F.when(s >= 0.8, "excellent").when(s >= 0.6, "good").when(s >= 0.4, "moderate").when(s >= 0.2, "weak").otherwise("very_weak"))
    df = df.withColumn("strength", F.coalesce(total, zero)).withColumn("signal_quality", quality)
    return fr.done(df.drop("_dp", "_dv", "_mean", "_sd", "_slope", "_long", "_corr", "_k"))
