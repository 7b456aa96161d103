"""Breakouts from triangles, rectangles and wedges over the 20 bars before the current one."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import arrays, frames as fr
from tickloom.functions.rules import Rule, emit
from tickloom.operators.averages import safe_div
from tickloom.schemas import require

WINDOW = 20
GROUPS = ("ascending", "descending", "symmetrical", "rectangle", "wedge")


def breakout_patterns(
    bars: DataFrame, min_touches: int = 2, threshold: float = 0.02, groups: Collection[str] = GROUPS
) -> DataFrame:
    require(bars, "high", "low", "close", "volume")
    df = fr.framed(bars, back=WINDOW)
    w = fr.rows(-WINDOW, -1)
    ready = F.col("idx") >= WINDOW
    c = F.col("close")
    rules: dict[str, list[Rule]] = {g: [] for g in GROUPS}

    if {"ascending", "descending", "symmetrical"} & set(groups):
        df = df.withColumns({"_h": F.collect_list("high").over(w), "_l": F.collect_list("low").over(w)})
        df = df.withColumns({
            "_peaks": F.when(ready, arrays.extrema(F.col("_h"), WINDOW, 2, True)),
            "_troughs": F.when(ready, arrays.extrema(F.col("_l"), WINDOW, 2, False)),
        })
        peaks, troughs = F.col("_peaks"), F.col("_troughs")
        enough = (F.size(peaks) >= min_touches) & (F.size(troughs) >= min_touches)
        df = df.withColumn("_ok", F.coalesce(ready & enough, F.lit(False)))
        df = df.withColumns({
            "_pm": F.when(F.col("_ok"), arrays.mean(peaks)), "_tm": F.when(F.col("_ok"), arrays.mean(troughs)),
            "_ps": F.when(F.col("_ok"), arrays.slope(peaks)), "_ts": F.when(F.col("_ok"), arrays.slope(troughs)),
        })
        ok, pm, tm, ps, ts = (F.col(x) for x in ("_ok", "_pm", "_tm", "_ps", "_ts"))
        flat_top = safe_div(arrays.pop_std(peaks, pm), pm) < 0.02
        flat_floor = safe_div(arrays.pop_std(troughs, tm), tm) < 0.02
        highest = F.array_max(F.transform(peaks, lambda p: p["y"]))
        lowest = F.array_min(F.transform(troughs, lambda p: p["y"]))
        rules["ascending"].append(Rule(
            "ascending_triangle", ok & flat_top & (ts > 0) & (c > pm * (1 + threshold)), "bullish", 0.75,
            span=WINDOW, target=c + (pm - lowest), stop=pm * 0.98,
            meta={"resistance_level": pm, "support_slope": ts, "breakout_volume": F.col("volume")}))
        rules["descending"].append(Rule(
            "descending_triangle", ok & flat_floor & (ps < 0) & (c < tm * (1 - threshold)), "bearish", 0.75,
            span=WINDOW, target=c - (highest - tm), stop=tm * 1.02,
            meta={"support_level": tm, "resistance_slope": ps, "breakout_volume": F.col("volume")}))
        # Projection uses the absolute row minus the window-relative position of the last extremum. A window may have none.
        last_p, last_t = F.try_element_at(peaks, F.lit(-1)), F.try_element_at(troughs, F.lit(-1))
        top = last_p["y"] + ps * (F.col("idx") - last_p["x"])
        floor = last_t["y"] + ts * (F.col("idx") - last_t["x"])
        closing = ok & (ps < 0) & (ts > 0)
        up, down = c > top * (1 + threshold), c < floor * (1 - threshold)
        height = F.get(peaks, F.lit(0))["y"] - F.get(troughs, F.lit(0))["y"]
        rules["symmetrical"].append(Rule(
            "symmetrical_triangle", closing & (up | down), F.when(up, "bullish").otherwise("bearish"), 0.7,
            span=WINDOW, target=F.when(up, c + height).otherwise(c - height),
            stop=c * F.when(up, 0.98).otherwise(1.02),
            meta={"resistance_slope": ps, "support_slope": ts, "breakout_volume": F.col("volume")}))

    if "rectangle" in groups:
        df = df.withColumns({"_res": F.max("high").over(w), "_sup": F.min("low").over(w)})
        if "_h" not in df.columns:
            df = df.withColumns({"_h": F.collect_list("high").over(w), "_l": F.collect_list("low").over(w)})
        res, sup = F.col("_res"), F.col("_sup")
        hits = F.size(F.filter("_h", lambda x: F.abs(x - res) < res * 0.01)) >= min_touches
        floor_hits = F.size(F.filter("_l", lambda x: F.abs(x - sup) < sup * 0.01)) >= min_touches
        quiet = safe_div(F.stddev_samp("close").over(w), F.avg("close").over(w)) < 0.05
        up, down = c > res * (1 + threshold), c < sup * (1 - threshold)
        rules["rectangle"].append(Rule(
            "rectangle", ready & hits & floor_hits & quiet & (up | down),
            F.when(up, "bullish").otherwise("bearish"), 0.8, span=WINDOW,
            target=F.when(up, c + (res - sup)).otherwise(c - (res - sup)),
            stop=F.when(up, sup).otherwise(res),
            meta={"resistance": res, "support": sup, "range_size": res - sup, "consolidation_period": WINDOW}))

    if "wedge" in groups:
        x = F.col("pos").cast("double")
        df = df.withColumns({"_hs": F.regr_slope("high", x).over(w), "_ls": F.regr_slope("low", x).over(w),
                             "_ph": fr.lag("high"), "_pl": fr.lag("low")})
        hs, ls = F.col("_hs"), F.col("_ls")
        meta = {"upper_slope": hs, "lower_slope": ls}
        rules["wedge"] += [
            Rule("rising_wedge", ready & (hs > 0) & (ls > hs) & (c < F.col("_pl")), "bearish", 0.7, span=WINDOW,
                 target=c * 0.95, stop=F.col("_ph"), meta=meta),
            Rule("falling_wedge", ready & (hs < 0) & (ls < 0) & (hs < ls) & (c > F.col("_ph")), "bullish", 0.7,
                 span=WINDOW, target=c * 1.05, stop=F.col("_pl"), meta=meta),
        ]
    return emit(df, "breakout", [r for g in GROUPS if g in groups for r in rules[g]])
