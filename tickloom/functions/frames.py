"""Ordered series cut into blocks.

A window partitioned by the instrument alone puts a whole instrument into one task.
Here every bar first gets its position ``idx`` in its series (and the length ``n``),
then the series is cut into blocks of ``block_rows`` positions. A row is copied into the
neighbouring blocks whose frames reach it (``back`` rows before, ``ahead`` rows after),
so frames of bounded length give the same values as on the uncut series, and the work
of one busy instrument spreads over as many tasks as it has blocks.

Positions need no global sort: rows fall into time buckets that hold at most
``block_rows`` bars of the series' width, buckets are counted, and the running total
over the (few) buckets is added to the position inside the bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.schemas import SERIES, timeframe_seconds

BLOCK_CONF = "spark.tickloom.blockRows"
DEFAULT_BLOCK_ROWS = 4096
BLOCK = [*SERIES, "blk"]


def block_rows_of(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_CONF, str(DEFAULT_BLOCK_ROWS)))


def index_bars(bars: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Add ``idx`` (0-based position by ts, then the rest of ``order``) and ``n`` (length of the series)."""
    if "idx" in bars.columns and "n" in bars.columns:
        return bars
    width = timeframe_seconds() * block_rows_of(bars.sparkSession)
    keys = [*SERIES, "_bucket"]
    rows = bars.withColumn("_bucket", F.floor(F.unix_seconds("ts") / width))
    series = Window.partitionBy(*SERIES)
    before = series.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            *keys,
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
            F.sum("_c").over(series).alias("n"),
        )
    )
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        rows.withColumn("_pos", pos)
        .join(offsets, keys)
        .withColumn("idx", F.col("_off") + F.col("_pos"))
        .drop("_bucket", "_pos", "_off")
    )


def index_rows(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``idx`` and ``n`` as :func:`index_bars`, for rows that follow no time grid: any number may fall in a day.

    Rows are counted per second; where a second begins in its series is the sum of the days before and of the seconds before
    in its day, and a row's place follows inside its second. The largest window partitions are a series' days, a day's
    seconds, and a second's rows.
    """
    second = [*SERIES, "_second"]
    at = rows.withColumn("_second", F.unix_seconds("ts"))
    counts = at.groupBy(*second).agg(F.count(F.lit(1)).alias("_c")).withColumn("_day", F.floor(F.col("_second") / 86_400))
    series, day = Window.partitionBy(*SERIES), Window.partitionBy(*SERIES, "_day")
    before = lambda w, by: F.coalesce(F.sum("_c").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = counts.groupBy(*SERIES, "_day").agg(F.sum("_c").alias("_c")).select(*SERIES, "_day", before(series, "_day").alias("_days"), F.sum("_c").over(series).alias("n"))
    starts = counts.withColumn("_seconds", before(day, "_second")).join(days, [*SERIES, "_day"]).select(*second, (F.col("_days") + F.col("_seconds")).alias("_start"), "n")
    inside = F.row_number().over(Window.partitionBy(*second).orderBy(*order)) - 1
    return at.withColumn("_inside", inside).join(starts, second).withColumn("idx", F.col("_start") + F.col("_inside")).drop("_second", "_inside", "_start")


def framed(
    bars: DataFrame, back: int = 0, ahead: int = 0, block_rows: int | None = None
) -> DataFrame:
    """Indexed bars with ``blk``, ``pos`` (place in the block) and ``core``.

    Rows near a cut appear in each block whose frames need them. Rows that are cut already
    (wide enough, by the caller) come back as they are, so several operators can share one cut.
    """
    if {"blk", "pos", "core"} <= set(bars.columns):
        return bars
    df = index_bars(bars)
    size = block_rows or block_rows_of(bars.sparkSession)
    home = F.floor(F.col("idx") / size)
    pos = (F.col("idx") - F.col("blk") * size).alias("pos")
    if not back and not ahead:
        return df.withColumn("blk", home).withColumns({"pos": pos, "core": F.lit(True)})
    first = F.greatest(F.floor((F.col("idx") - ahead) / size), F.lit(0))
    last = F.least(F.floor((F.col("idx") + back) / size), F.floor((F.col("n") - 1) / size))
    return df.withColumn("blk", F.explode(F.sequence(first, last))).withColumns(
        {"pos": pos, "core": F.col("blk") == home}
    )


def core(df: DataFrame) -> DataFrame:
    """Drop the copies made by :func:`framed`, keeping the block partitioning."""
    return df.filter("core").drop("core")


def done(df: DataFrame) -> DataFrame:
    """Drop the columns that only the cutting needs."""
    return df.drop("blk", "pos", "core")


def order() -> WindowSpec:
    return Window.partitionBy(*BLOCK).orderBy("idx")


def rows(start: int, end: int) -> WindowSpec:
    return order().rowsBetween(start, end)


def last_rows(n: int) -> WindowSpec:
    """The current row and the n-1 before it."""
    return rows(-(n - 1), 0)


def full(n: int, value: Column, start: int = 0) -> Column:
    """``value`` once n rows from position ``start`` on exist, else null."""
    return F.when(F.col("idx") >= start + n - 1, value)


def lag(col: Column | str, k: int = 1) -> Column:
    return F.lag(col, k).over(order())


def lead(col: Column | str, k: int = 1) -> Column:
    return F.lead(col, k).over(order())


def is_peak(col: str, k: int) -> Column:
    """Strictly above the k rows on each side that exist; never at either end of the series."""
    inner = (F.col("idx") > 0) & (F.col("idx") < F.col("n") - 1)
    c = F.col(col)
    return inner & (c > F.max(col).over(rows(-k, -1))) & (c > F.max(col).over(rows(1, k)))


def is_trough(col: str, k: int) -> Column:
    inner = (F.col("idx") > 0) & (F.col("idx") < F.col("n") - 1)
    c = F.col(col)
    return inner & (c < F.min(col).over(rows(-k, -1))) & (c < F.min(col).over(rows(1, k)))


def running_sums(df: DataFrame, sums: Mapping[str, Column], reset: Sequence[str] = ()) -> DataFrame:
    """Cumulative sums along each series (restarting when a ``reset`` column changes).

    Each block sums by itself; block totals are accumulated in a table with one row per
    block and added back, less what the copied rows before the block had contributed, so
    the copies carry the right sums too.
    """
    keys = [*BLOCK, *reset]
    run = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    before = (
        Window.partitionBy(*SERIES, *reset).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0.0)
    totals = df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("core"), c)).alias(f"_t_{k}") for k, c in sums.items()],
        *[F.sum(F.when(F.col("pos") < 0, c)).alias(f"_h_{k}") for k, c in sums.items()],
    )
    offsets = totals.select(
        *keys,
        *[
            (F.coalesce(F.sum(f"_t_{k}").over(before), zero) - F.coalesce(f"_h_{k}", zero)).alias(f"_o_{k}")
            for k in sums
        ],
    )
    out = df.withColumns({f"_r_{k}": F.sum(c).over(run) for k, c in sums.items()}).join(offsets, keys)
    out = out.withColumns({k: F.coalesce(F.col(f"_r_{k}"), zero) + F.col(f"_o_{k}") for k in sums})
    return out.drop(*[f"_r_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Join one-row-per-series ``stats`` (with ``n``) to blocked rows.

    The small table is spread to one row per block first, so the join runs on the
    block key and no instrument lands in a single task.
    """
    size = block_rows_of(df.sparkSession)
    spread = stats.withColumn(
        "blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size)))
    ).drop("n")
    return df.join(spread, BLOCK)


def per_series(df: DataFrame, *aggs: Column) -> DataFrame:
    """One row per series with ``n``; partial aggregation runs before the shuffle."""
    return df.groupBy(*SERIES).agg(F.max("n").alias("n"), *aggs)
