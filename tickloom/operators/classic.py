"""Head and shoulders, flags and pennants."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import arrays, frames as fr
from tickloom.functions.rules import Rule, emit
from tickloom.operators.averages import safe_div
from tickloom.schemas import require

WINDOW = 30
GROUPS = ("head_and_shoulders", "flag", "pennant")


def _head_and_shoulders(df: DataFrame) -> tuple[DataFrame, list[Rule]]:
    w = fr.rows(-WINDOW, -1)
    c = F.col("close")
    ready = (F.col("idx") >= WINDOW) & (F.col("idx") < F.col("n") - 5)
    df = df.withColumns({"_hh": F.collect_list("high").over(w), "_ll": F.collect_list("low").over(w)})
    df = df.withColumn("_tops", F.when(ready, arrays.extrema(F.col("_hh"), WINDOW, 3, True)))

    def trough(a, b):
        return F.array_min(F.slice("_ll", a["x"] + 1, b["x"] - a["x"]))

    def triple(j):
        left, head, right = (F.get("_tops", j + k) for k in range(3))
        neck = (trough(left, head) + trough(head, right)) / 2
        return F.struct(left.alias("left"), head.alias("head"), right.alias("right"), neck.alias("neck"))

    def fits(t):
        left, head, right = t["left"]["y"], t["head"]["y"], t["right"]["y"]
        even = F.abs(left - right) < left * 0.03
        return (head > left) & (head > right) & even & (c < t["neck"])

    count = F.size("_tops")
    starts = F.when(count >= 3, F.sequence(F.lit(0), count - 3))
    df = df.withColumn("_hs", F.get(F.filter(F.transform(starts, triple), fits), F.lit(0)))
    t = F.col("_hs")
    return df, [Rule(
        "head_and_shoulders", t.isNotNull(), "bearish", 0.85,
        start_idx=F.col("idx") - WINDOW + t["left"]["x"], target=t["neck"] - (t["head"]["y"] - t["neck"]),
        stop=t["right"]["y"] * 1.02,
        meta={"left_shoulder": t["left"]["y"], "head": t["head"]["y"], "right_shoulder": t["right"]["y"],
              "neckline": t["neck"]})]


def classic_patterns(bars: DataFrame, groups: Collection[str] = GROUPS) -> DataFrame:
    require(bars, "high", "low", "close")
    df = fr.framed(bars, back=WINDOW)
    rules: list[Rule] = []
    if "head_and_shoulders" in groups:
        df, rules = _head_and_shoulders(df)
    if {"flag", "pennant"} & set(groups):
        w, c, x = fr.rows(-10, -1), F.col("close"), F.col("pos").cast("double")
        df = df.withColumns({
            "_start": fr.lag("close", 20), "_pole": fr.lag("close", 10) - fr.lag("close", 20),
            "_top": F.max("high").over(w), "_floor": F.min("low").over(w),
        })
        pole, top, floor = F.col("_pole"), F.col("_top"), F.col("_floor")
        ready = (F.col("idx") >= 20) & (F.col("idx") < F.col("n") - 10)
        strong = ready & (safe_div(F.abs(pole), F.col("_start")) > 0.05)
        up, down = (pole > 0) & (c > top), (pole < 0) & (c < floor)
        bull = {"direction": "bullish", "span": 20, "target": c + F.abs(pole), "stop": floor}
        bear = {"direction": "bearish", "span": 20, "target": c - F.abs(pole), "stop": top}
        if "flag" in groups:
            df = df.withColumns({
                "_slope": F.regr_slope("close", x).over(w),
                "_quiet": safe_div(F.stddev_samp("close").over(w), F.avg("close").over(w)) < 0.02,
            })
            meta = {"pole_height": F.abs(pole), "flag_slope": F.col("_slope")}
            quiet = strong & F.col("_quiet")
            rules += [
                Rule("bull_flag", quiet & (F.col("_slope") < 0) & up, confidence=0.75, meta=meta, **bull),
                Rule("bear_flag", quiet & (F.col("_slope") > 0) & down, confidence=0.75, meta=meta, **bear),
            ]
        if "pennant" in groups:
            df = df.withColumns({"_hs2": F.regr_slope("high", x).over(w), "_ls2": F.regr_slope("low", x).over(w)})
            meta = {"pole_height": F.abs(pole), "upper_slope": F.col("_hs2"), "lower_slope": F.col("_ls2")}
            narrow = strong & (F.col("_hs2") < 0) & (F.col("_ls2") > 0)
            rules += [
                Rule("bull_pennant", narrow & up, confidence=0.7, meta=meta, **bull),
                Rule("bear_pennant", narrow & down, confidence=0.7, meta=meta, **bear),
            ]
    return emit(df, "classic", rules)
