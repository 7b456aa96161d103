"""Joins of patterns with each other, with stored rows, bars and definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.schemas import SERIES, require, timeframe_seconds


def with_details(patterns: DataFrame, perf: DataFrame) -> DataFrame:
    """Patterns with their performance row, if any."""
    return patterns.join(perf, "pattern_id", "left")


def with_tags(patterns: DataFrame, tags: list[str]) -> DataFrame:
    """Patterns that carry any of the tags."""
    return patterns.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def co_occurrence(patterns: DataFrame, bars: int = 10) -> DataFrame:
    """Unordered pairs of one symbol, timeframe and direction that start within ``bars`` bars."""
    return _pairs(patterns, patterns, bars)


def co_occurrence_by_repeats(patterns: DataFrame, bars: int = 10) -> tuple[DataFrame, DataFrame]:
    """The rows of co_occurrence in two parts: pairs of ids that one pattern each has, and pairs with an id that repeats or is null.

    In the first part every pair has one row, so what is done per pair needs no grouping.
    """
    ids = patterns.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and pattern_id is not null").select("pattern_id")
    named = patterns.filter("pattern_id is not null")
    single = named.join(ids, "pattern_id", "left_anti")
    repeated = named.join(ids, "pattern_id", "left_semi").unionByName(patterns.filter("pattern_id is null"))
    return _pairs(single, single, bars), _pairs(repeated, patterns, bars).unionByName(_pairs(single, repeated, bars))


def _pairs(earlier: DataFrame, later: DataFrame, bars: int) -> DataFrame:
    """Pairs of an earlier pattern of the one and a later pattern of the other table.

    The time condition becomes an equality: starts are cut into buckets as wide as the limit,
    and the later pattern of a pair is looked up from its own and the previous bucket. So rows
    meet only near rows, and each pair is found once.

    The work grows with the pairs, not with the bytes shuffled, so the number of tasks is named
    here: AQE would merge these small partitions to little more than one task a core, and the
    last of them would run alone.
    """
    spark = earlier.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = [*SERIES, "direction", "bucket"]

    def near(patterns: DataFrame) -> DataFrame:
        require(patterns, "pattern_id", *SERIES, "direction", "start_ts", "confidence")
        limit = timeframe_seconds() * bars
        p = patterns.select("pattern_id", *SERIES, "direction", "confidence", F.unix_micros("start_ts").alias("t"), (limit * 1_000_000).alias("limit"))
        return p.withColumn("bucket", F.floor(F.col("t") / F.col("limit")))

    early = near(earlier).select(*keys, "limit", F.col("pattern_id").alias("id_a"), F.col("t").alias("t_a"), F.col("confidence").alias("c_a"))
    late = near(later).select(*SERIES, "direction", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"),
                              F.col("pattern_id").alias("id_b"), F.col("t").alias("t_b"), F.col("confidence").alias("c_b"))
    after = (F.col("t_b") > F.col("t_a")) | ((F.col("t_b") == F.col("t_a")) & (F.col("id_b") > F.col("id_a")))
    pairs = early.repartition(tasks, *keys).join(late.repartition(tasks, *keys), keys).filter(after & (F.col("t_b") - F.col("t_a") <= F.col("limit")))
    first = F.col("id_a") < F.col("id_b")
    pairs = pairs.select(
        F.least("id_a", "id_b").alias("pattern_id"), F.greatest("id_a", "id_b").alias("correlated_id"), *SERIES, "direction",
        F.when(first, F.col("t_a")).otherwise(F.col("t_b")).alias("t1"), F.when(first, F.col("t_b")).otherwise(F.col("t_a")).alias("t2"),
        (F.col("t_b") - F.col("t_a")).alias("gap"), F.abs(F.col("c_a") - F.col("c_b")).alias("confidence_gap"), F.col("limit"))
    return pairs.withColumns({
        "correlation_strength": correlation_strength(F.lit(True), F.col("confidence_gap"), F.col("gap"), F.col("limit")),
        "temporal_relationship": temporal_relationship(F.col("t1"), F.col("t2")),
        "lag_seconds": (F.col("gap") / 1_000_000).cast("long"),
    }).drop("t1", "t2", "gap", "limit", "confidence_gap")


def correlation_strength(same_direction: Column, confidence_gap: Column, dt: Column, limit: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1 - dt / limit)
    return F.least(F.lit(1.0), 0.5 + F.when(same_direction, 0.2).otherwise(0.0) + (1 - confidence_gap) * 0.2 + near * 0.1)


def temporal_relationship(t1: Column, t2: Column) -> Column:
    return F.when(t1 < t2, "p1_leads").when(t2 < t1, "p2_leads").otherwise("concurrent")


def merge_correlations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs seen again take the new strength and count one more; first values keep the rest."""
    cols = ["pattern_id", "correlated_id", "correlation_strength", "temporal_relationship", "co_occurrence_count"]
    a = old.select(*cols, F.lit(0).alias("_v"))
    b = new.select(*cols[:4], F.lit(1).cast("long").alias("co_occurrence_count"), F.lit(1).alias("_v"))
    return a.unionByName(b).groupBy("pattern_id", "correlated_id").agg(
        F.max_by("correlation_strength", "_v").alias("correlation_strength"), F.min_by("temporal_relationship", "_v").alias("temporal_relationship"),
        F.sum("co_occurrence_count").alias("co_occurrence_count"))


def merge_in_place(pairs: DataFrame) -> DataFrame:
    """merge_correlations of pairs that have one row each, with what is stored and what is new as structs `old` and `new`, either null."""
    old, new = F.col("old").isNotNull(), F.col("new").isNotNull()
    return pairs.filter(old | new).select(
        "pattern_id", "correlated_id", F.when(new, F.col("new.correlation_strength")).otherwise(F.col("old.correlation_strength")).alias("correlation_strength"),
        F.when(old, F.col("old.temporal_relationship")).otherwise(F.col("new.temporal_relationship")).alias("temporal_relationship"),
        F.when(new, F.coalesce("old.co_occurrence_count", F.lit(0)) + 1).otherwise(F.col("old.co_occurrence_count")).alias("co_occurrence_count"))


def correlated(corr: DataFrame, pattern_id: str, min_strength: float = 0.5) -> DataFrame:
    hit = (F.col("pattern_id") == pattern_id) & (F.col("correlation_strength") >= min_strength)
    return corr.filter(hit).orderBy(F.desc("correlation_strength"), "correlated_id")


def outcomes(patterns: DataFrame, bars: DataFrame, horizon: int = 20) -> DataFrame:
    """Return from the close at ``entry_idx`` to the close ``horizon`` bars on (or the last one).

    A bullish pattern succeeds on a rise; any other direction on a fall.
    """
    require(patterns, *SERIES, "entry_idx", "direction")
    df = fr.framed(bars, ahead=horizon)
    df = fr.core(df.withColumn("exit_price", F.last("close").over(fr.rows(0, horizon))))
    at = df.select(*SERIES, F.col("idx").alias("entry_idx"), F.col("close").alias("entry_close"), "exit_price")
    ret = F.try_divide(F.col("exit_price") - F.col("entry_close"), F.col("entry_close"))
    won = F.when(F.col("direction") == "bullish", F.col("ret") > 0).otherwise(F.col("ret") < 0)
    return patterns.join(at, [*SERIES, "entry_idx"]).withColumn("ret", ret).withColumn("success", won)


def match_saved(new: DataFrame, saved: DataFrame, tol_seconds: int = 60) -> DataFrame:
    """Nearest saved pattern of the same type, name, symbol and timeframe within the tolerance."""
    keys = ["pattern_type", "pattern_name", *SERIES]
    width = tol_seconds * 1_000_000
    n = new.select("new_id", *keys, F.unix_micros("start_ts").alias("t"))
    b = F.floor(F.col("t") / width)
    n = n.withColumn("b", F.explode(F.array(b - 1, b, b + 1)))
    s = saved.select(F.col("pattern_id").alias("saved_id"), *keys, F.unix_micros("detected_at").alias("d"))
    s = s.withColumn("b", F.floor(F.col("d") / width))
    gap = F.abs(F.col("t") - F.col("d"))
    near = n.join(s, [*keys, "b"]).filter(gap <= width)
    return near.groupBy("new_id").agg(F.min(F.struct(gap.alias("gap"), "saved_id")).alias("m")).select("new_id", "m.saved_id", (F.col("m.gap") / 1_000_000).alias("gap_seconds"))


def with_definition(detected: DataFrame, definitions: DataFrame) -> DataFrame:
    """Detected patterns with their definition by name."""
    return detected.join(definitions, "pattern_name", "left")
