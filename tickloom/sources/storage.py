"""Writing and merging tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schemas import require


def with_partitions(df: DataFrame, data_type: str, granularity: str | None = None) -> DataFrame:
    """Add the partition columns of the store: data_type, granularity, date."""
    require(df, "symbol", "ts")
    grain = F.lit(granularity) if granularity else (F.col("timeframe") if "timeframe" in df.columns else F.lit("tick"))
    return df.withColumns({"data_type": F.lit(data_type), "granularity": grain, "date": F.to_date("ts")})


def _write(df: DataFrame, path: str, mode: str) -> None:
    parts = ["data_type", "granularity", "date"]
    # A date goes to few tasks and gets few files; adaptive execution splits what a busy symbol's day makes too large, and joins small parts.
    (df.hint("rebalance", "date", "symbol").sortWithinPartitions("date", "symbol", "ts")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def write_bars(bars: DataFrame, path: str, data_type: str = "market_data", mode: str = "append") -> None:
    _write(with_partitions(bars, data_type), path, mode)


def write_quotes(quotes: DataFrame, path: str, mode: str = "append") -> None:
    _write(with_partitions(quotes, "quotes", "tick"), path, mode)


def last_records(df: DataFrame, n: int, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest n rows of a sink."""
    return df.orderBy(F.desc(ts), *([F.desc(tie)] if tie else [])).limit(n)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Insert or replace by key; of several updates of a key the highest ``version`` wins.

    Only the keys of the updates meet the base, so a small update does not shuffle it.
    """
    new = updates
    if version:
        first = Window.partitionBy(*keys).orderBy(F.desc(version))
        new = updates.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    cols = base.columns
    kept = base.join(new.select(*keys), list(keys), "left_anti")
    return kept.select(*cols).unionByName(new.select(*cols))


def upsert_bars(base: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    return upsert(base, updates, ["symbol", "timeframe", "ts"], version)


def rewrite_dates(base_path: str, updates: DataFrame, keys: Sequence[str], version: str | None = None) -> None:
    """Merge updates into a stored table, reading and rewriting the touched dates only.

    The merged dates are written beside the table first: the table is never overwritten while
    it is still being read.
    """
    from tickloom.functions.lineage import cut_lineage

    spark = updates.sparkSession
    dates = updates.select("data_type", "granularity", "date").distinct()
    touched = spark.read.parquet(base_path).join(dates, ["data_type", "granularity", "date"], "left_semi")
    merged = cut_lineage(upsert(touched, updates, keys, version))
    _write(merged, base_path, "overwrite")


Writer = Callable[[DataFrame], None]


def fan_out(df: DataFrame, writers: Sequence[Writer], require_all: bool = True) -> list[bool]:
    """Write one batch to several sinks; fail when any (or, with ``require_all=False``, all) fail."""
    batch = df.persist()
    done, errors = [], []
    try:
        for w in writers:
            try:
                w(batch)
                done.append(True)
            except Exception as e:  # a sink's failure must not stop the others
                done.append(False)
                errors.append(e)
    finally:
        batch.unpersist()
    if errors and (require_all or not any(done)):
        raise errors[0]
    return done


def write_with_fallback(df: DataFrame, primary: Writer, backup: Writer, max_retries: int = 3, backoff: float = 1.0) -> str:
    """Try the primary sink with growing pauses, then the backup; returns which one took the batch."""
    for attempt in range(max_retries):
        try:
            primary(df)
            return "primary"
        except Exception:
            if attempt + 1 < max_retries:
                time.sleep(backoff * 2**attempt)
    backup(df)
    return "backup"
