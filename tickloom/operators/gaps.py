"""Price gaps: detection, class, whether they fill, and target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.rules import Rule, emit
from tickloom.operators.averages import safe_div
from tickloom.schemas import require


def gaps(bars: DataFrame, min_gap: float = 0.002) -> DataFrame:
    require(bars, "open", "high", "low", "close")
    df = fr.framed(bars, back=11, ahead=10)
    five, ten, older = fr.rows(-5, -1), fr.rows(-10, -1), fr.rows(-10, -6)
    df = df.withColumns({
        "_prev": fr.lag("close"),
        "_m5": F.avg("close").over(five), "_m10": F.avg("close").over(ten), "_s10": F.stddev_samp("close").over(ten),
        "_older": F.avg("close").over(older), "_next": F.avg("close").over(fr.rows(0, 4)),
        "_low": F.min("low").over(fr.rows(0, 9)), "_high": F.max("high").over(fr.rows(0, 9)),
    })
    o, c, prev, idx, n = (F.col(x) for x in ("open", "close", "_prev", "idx", "n"))
    size = o - prev
    up = size > 0
    inner = (idx >= 5) & (idx < n - 5)
    strong = inner & F.when(up, c > F.col("_m5") * 1.02).otherwise(c < F.col("_m5") * 0.98)
    quiet = (idx < 10) | (safe_div(F.col("_s10"), F.col("_m10")) < 0.02)
    going = F.when(up, F.col("_m5") > F.col("_older")).otherwise(F.col("_m5") < F.col("_older"))
    tired = F.when(up, F.col("_next") < c).otherwise(F.col("_next") > c)
    kind = (
        F.when(strong & quiet, "breakaway_gap").when(strong & going, "runaway_gap")
        .when(strong & tired, "exhaustion_gap").otherwise("common_gap")
    )
    with_gap = F.when(up, "bullish").otherwise("bearish")
    against = F.when(up, "bearish").otherwise("bullish")
    df = df.withColumn("_kind", kind)
    k = F.col("_kind")
    direction = F.when(k.isin("breakaway_gap", "runaway_gap"), with_gap).when(k == "exhaustion_gap", against)
    step = (
        F.when(k == "breakaway_gap", 2.0).when(k == "runaway_gap", 1.0).when(k == "exhaustion_gap", -0.5).otherwise(0.0)
    )
    filled = (idx < n - 10) & F.when(up, F.col("_low") <= prev).otherwise(F.col("_high") >= prev)
    return emit(df, "gap", [Rule(
        k, safe_div(F.abs(size), prev) > min_gap, F.coalesce(direction, F.lit("neutral")), 0.9, span=1, entry=o,
        target=c + size * step, stop=F.when(up, prev).otherwise(o * 1.02),
        meta={"gap_size": size, "gap_percentage": safe_div(F.abs(size), prev) * 100,
              "filled": filled.cast("int"), "gap_up": up.cast("int")})])
