"""The whole scan of a set of bars: detect, rank, save, correlate, route. Each step is a table, committed by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import joins
from tickloom.operators import store as st
from tickloom.plans.detectors import scan_patterns

#: Tables of a scan below its root, in the order in which they are written.
TABLES = ("patterns", "correlations", "alerts")


def saved(found: DataFrame, detected_at: Column | None = None) -> DataFrame:
    """Findings as stored patterns; one row for each id, which follows from what was found and when."""
    return st.to_store(found, F.current_timestamp() if detected_at is None else detected_at).dropDuplicates(["pattern_id"])


def correlations(patterns: DataFrame) -> DataFrame:
    """Pairs that start together, as new rows of the table of correlations."""
    return joins.co_occurrence(patterns).withColumn("co_occurrence_count", F.lit(1).cast("long"))


def alerts(patterns: DataFrame, subs: DataFrame | None = None) -> DataFrame:
    """One row per pattern and channel; with subscriptions, per subscriber too."""
    routed = st.route_alerts(patterns if subs is None else st.match_subscriptions(patterns, subs))
    who = [] if subs is None else ["subscriber"]
    return routed.select(*who, "pattern_id", "symbol", "timeframe", "pattern_name", "confidence", "priority", F.explode("channels").alias("channel"))


def scan(bars: DataFrame, root: str, batch_id: int = 0, subs: DataFrame | None = None, find: Callable[[DataFrame], DataFrame] = scan_patterns,
         keep: Callable[[DataFrame], DataFrame] | None = None, detected_at: Column | None = None) -> dict[str, DataFrame]:
    """Scan bars and commit every table's part of this batch below ``root``.

    Patterns are written once and read for the other steps. A batch that runs again overwrites its own parts and touches no
    other, so sinks that failed halfway are whole after it. ``keep`` chooses among the findings before they are saved.
    """
    spark = bars.sparkSession
    found = find(bars)
    part = lambda name: f"{root}/{name}/batch_id={batch_id}"
    saved(found if keep is None else keep(found), detected_at).write.mode("overwrite").parquet(part("patterns"))
    patterns = spark.read.parquet(part("patterns"))
    correlations(patterns).write.mode("overwrite").parquet(part("correlations"))
    alerts(patterns, subs).write.mode("overwrite").parquet(part("alerts"))
    return {name: spark.read.parquet(part(name)) for name in TABLES}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all batches. Patterns found by several batches appear once, as last saved; correlations add their counts up."""
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    if name == "patterns":
        newest = F.struct("batch_id", *[c for c in ("detected_at",) if c in rows.columns])
        own = [c for c in rows.columns if c not in ("pattern_id", "batch_id")]
        return rows.groupBy("pattern_id").agg(F.max_by(F.struct(*own), newest).alias("r")).select("pattern_id", "r.*")
    if name == "correlations":
        return rows.groupBy("pattern_id", "correlated_id").agg(
            F.max_by("correlation_strength", "batch_id").alias("correlation_strength"), F.min_by("temporal_relationship", "batch_id").alias("temporal_relationship"),
            F.sum("co_occurrence_count").alias("co_occurrence_count"))
    return rows.drop("batch_id").distinct()
