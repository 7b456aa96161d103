"""First-order recurrences along each series.

Exponential smoothing forgets: after ``memory(alpha)`` rows the start value weighs less than
exp(-44), under the rounding of a double. So a block that also sees that many rows before its
own computes the same values as the whole series, with no state passed between blocks. Inside
a block the recurrence is one running sum of rescaled inputs, y = sum(b * g) / g with
g = decay**-position; block length keeps g inside the double range.

A decay that changes by row can be too slow to forget within a block; :func:`scan` then passes
start values between blocks, one summary row per block.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.frames import BLOCK
from tickloom.schemas import SERIES

_FORGET = 44.0
_LOG_RANGE = 600.0


def memory(alpha: float) -> int:
    """Rows after which an earlier value no longer matters."""
    return 0 if alpha >= 1 else math.ceil(_FORGET / -math.log(1.0 - alpha))


@dataclass
class Calc:
    """A plain column step."""

    out: str
    value: Column

    def apply(self, df: DataFrame, back: int) -> DataFrame:
        return df.withColumn(self.out, self.value)


@dataclass
class Running:
    """Cumulative sums, restarting with the ``reset`` columns."""

    sums: Mapping[str, Column]
    reset: Sequence[str] = ()

    def apply(self, df: DataFrame, back: int) -> DataFrame:
        return fr.running_sums(df, self.sums, self.reset)


@dataclass
class Smooth:
    """out += alpha*(x - out), null before ``seed_idx``, started there with ``seed`` (default x).

    A null x adds nothing and lets nothing decay: the value is carried on. A series that begins with nulls starts from the mean
    of its first values by weight. A result that equals x but for rounding is x: on a
    constant stretch the line meets its input exactly, so comparisons of the two do not see noise.
    """

    out: str
    x: Column
    alpha: float
    seed_idx: int = 0
    seed: Column | None = None

    def apply(self, df: DataFrame, back: int) -> DataFrame:
        started = F.col("idx") >= self.seed_idx
        if self.alpha >= 1:
            return df.withColumn(self.out, F.when(started, self.x))
        first = self.x if self.seed is None else self.seed
        seeds = F.col("idx") == self.seed_idx
        value = F.when(seeds, first).otherwise(self.x)
        weight = F.when(started & value.isNotNull(), F.when(seeds, 1.0).otherwise(self.alpha)).otherwise(0.0)
        run = fr.rows(Window.unboundedPreceding, 0)
        df = df.withColumn("_gaps", F.count_if(started & value.isNull()).over(run))
        growth = (F.col("pos") + back - F.col("_gaps")) * F.lit(-math.log(1.0 - self.alpha))
        total = F.exp(-growth) * F.sum(F.coalesce(weight * value, F.lit(0.0)) * F.exp(growth)).over(run)
        weights = F.exp(-growth) * F.sum(weight * F.exp(growth)).over(run)
        y, x = F.col(self.out), self.x
        # without nulls the weights sum to one
        df = df.withColumn(self.out, F.when(started, F.when(F.abs(weights - 1) < 1e-9, total).otherwise(F.try_divide(total, weights))))
        return df.withColumn(self.out, F.when(F.abs(y - x) <= F.abs(x) * 1e-12, x).otherwise(y)).drop("_gaps")


def chain(bars: DataFrame, steps: Sequence[Calc | Running | Smooth], back: int = 0) -> DataFrame:
    """Run dependent steps in one frame; ``back`` is what the plain steps look back in all.

    Smoothings too far apart for one block length (one very fast, one very slow) get a
    frame each instead.
    """
    smooths = [s for s in steps if isinstance(s, Smooth)]
    reach = back + sum(memory(s.alpha) for s in smooths)
    speed = max([-math.log(1.0 - s.alpha) for s in smooths if s.alpha < 1], default=1e-9)
    room = int(_LOG_RANGE / speed) - reach
    if len(smooths) > 1 and room < 2 * reach:
        df = bars
        for s in steps:
            df = chain(df, [s], back)
        return df
    usual = fr.block_rows_of(bars.sparkSession)
    df = fr.framed(bars, back=reach, block_rows=max(1, min(room, max(usual, 2 * reach))))
    for s in steps:
        df = s.apply(df, reach)
    return fr.done(fr.core(df))


def scan_rows(fastest: float) -> int:
    """Longest block for :func:`scan` when no decay is below ``fastest``."""
    return max(1, int(_LOG_RANGE / 2 / -math.log(fastest)))


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("blk")
    start, y = [], 0.0
    for gain, add in zip(pdf["_gain"].to_numpy(), pdf["_add"].to_numpy()):
        start.append(y)
        y = gain * y + add
    return pdf[BLOCK].assign(_start=start)


def scan(df: DataFrame, out: str, a: Column, b: Column) -> DataFrame:
    """y = a*y + b for a decay ``a`` in (0, 1) that changes by row; core rows only."""
    run = fr.rows(Window.unboundedPreceding, 0)
    df = df.withColumn("_log", F.sum(F.ln(a)).over(run))
    df = df.withColumn("_sum", F.sum(b * F.exp(-F.col("_log"))).over(run))
    last = F.max_by("_log", "idx"), F.max_by("_sum", "idx")
    ends = df.groupBy(*BLOCK).agg(F.exp(last[0]).alias("_gain"), (F.exp(last[0]) * last[1]).alias("_add"))
    starts = ends.groupBy(*SERIES).applyInPandas(
        _carry, "symbol string, timeframe string, blk long, _start double"
    )
    y = F.exp("_log") * (F.col("_start") + F.col("_sum"))
    return df.join(starts, BLOCK).withColumn(out, y).drop("_log", "_sum", "_start")
