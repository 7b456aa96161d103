"""Inputs that only larger tables hold: windows without extrema, dense pairs, repeated subscriptions."""

import math
from collections import Counter

import pytest
from market_helpers import bars
from pyspark.sql import functions as F

from tickloom.operators import breakouts as bo
from tickloom.operators import joins as jo
from tickloom.plans import catalog
from tickloom.plans import detectors as de

FLAT = [100.0] * 40


@pytest.mark.parametrize("groups", [["symmetrical"], list(bo.GROUPS)])
def test_windows_without_extrema_hold_no_triangle(spark, groups):
    found = bo.breakout_patterns(bars(spark, FLAT), groups=groups)
    assert found.filter("pattern_name like '%triangle'").count() == 0
    assert [r.pattern_name for r in found.select("pattern_name", "target_price", "stop_loss", "metadata").collect() if "triangle" in r.pattern_name] == []


def test_the_scan_takes_bars_without_extrema(spark):
    assert de.scan_patterns(bars(spark, FLAT)).filter("pattern_type = 'breakout'").collect() == []


def stored_patterns(spark, rows):
    """id, symbol, timeframe, start in seconds, confidence."""
    df = spark.createDataFrame(rows, "pattern_id string, symbol string, timeframe string, t long, confidence double")
    return df.select("pattern_id", "symbol", "timeframe", F.lit("bullish").alias("direction"), F.timestamp_seconds("t").alias("start_ts"), "confidence")


class PatternsOnly:
    def __init__(self, patterns):
        self.patterns = patterns


def test_strengths_are_rounded_by_arithmetic(spark):
    catalog.load()
    p = stored_patterns(spark, [("1", "A", "4h", 0, 0.5), ("2", "A", "4h", 7, 0.25)])
    for name in ("join03_correlation_strength", "join05_merge_correlations"):
        df = catalog.PLANS[name](PatternsOnly(p))
        assert "rint" in df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert [r.correlation_strength for r in df.collect()] == [round(0.7 + 0.75 * 0.2 + (1 - 7 / 144_000) * 0.1, 5)]


def test_correlations_of_single_ids_are_merged_where_they_are_found(spark):
    catalog.load()
    p = stored_patterns(spark, [(str(k), "A", ["1h", "4h", "1d"][k % 3], 900 * k, k % 7 / 10) for k in range(60)])
    once, again = jo.co_occurrence_by_repeats(p)
    assert again.count() == 0 and once.count() == jo.co_occurrence(p).count() > 500
    both = once.withColumns({"old": F.struct("correlation_strength", "temporal_relationship", F.lit(3).alias("co_occurrence_count")), "new": F.struct("correlation_strength", "temporal_relationship")})
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (once, jo.merge_in_place(both))]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")  # pairs are not shuffled
    # the whole query groups pairs by their ids only in the part with repeated ids, which is empty here
    df = catalog.PLANS["join05_merge_correlations"](PatternsOnly(p))
    df.collect()
    assert Counter(r.co_occurrence_count for r in df.collect()) == Counter({"1h": 1, "4h": 3, "1d": 4}[r.timeframe] for r in jo.co_occurrence(p).select("timeframe").collect())


def test_the_join_of_pairs_keeps_its_tasks(spark):
    """Few bytes make many pairs: AQE must not merge the tasks of the join by the bytes shuffled."""
    p = stored_patterns(spark, [(str(k), "A", ["1h", "4h", "1d"][k % 3], 900 * k, k % 7 / 10) for k in range(60)])
    p = p.withColumn("direction", F.when(F.col("confidence") < 2, "bullish"))  # a literal would be left out of the join's keys
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to be broadcast
    try:
        assert jo.co_occurrence(p).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lags_and_relations_hold_for_every_order_of_ids(spark):
    rows = [("1", "A", "4h", 0, 0.5), ("2", "A", "4h", 7, 0.25), ("0", "A", "4h", 7, None), (None, "A", "4h", 9, 0.5), ("9", "A", "4h", 144_009, 0.5), ("8", "A", "4h", 144_010, 0.5)]
    got = {(r.pattern_id, r.correlated_id): (r.lag_seconds, r.temporal_relationship) for r in jo.co_occurrence(stored_patterns(spark, rows)).collect()}
    want = {("1", "2"): (7, "p1_leads"), ("0", "1"): (7, "p2_leads"), ("0", "2"): (0, "concurrent"), ("1", "1"): (9, "p2_leads"), ("2", "2"): (2, "p2_leads"), ("0", "0"): (2, "p2_leads"),
            ("9", "9"): (144_000, "p2_leads"), ("8", "9"): (1, "p2_leads")}
    assert got == want


def test_rounding_of_many_rows_equals_round(spark):
    ties = [k / 100_000 + 0.000005 for k in range(0, 100_000, 7)]
    odd = [None, 0.0, -0.0, -0.7000049, 1e-9, 4.9999e-6, 5e-6, 5.0001e-6, 0.9999949999, 0.999995, 1.0, 12345.678905, 1e12 + 0.123456, float("nan"), float("inf"), float("-inf")]
    near = [y for x in ties[::20] for y in (math.nextafter(x, 0), math.nextafter(x, 1), x + 1e-12, x - 1e-12)]
    df = spark.createDataFrame([(x,) for x in ties + near + odd], "x double").select("x", F.round("x", 5).alias("a"), catalog.round_many("x", 5).alias("b"))
    assert df.filter("not (a <=> b)").collect() == []


def test_ids_that_repeat_are_merged_over_all_series(spark):
    """The ids 1 and 2 meet in two series, 3 repeats in one, 4 is alone, and two patterns have no id."""
    rows = [("1", "A", "1d", 0, 0.5), ("2", "A", "1d", 3600, 0.5), ("1", "B", "1d", 0, 0.1), ("2", "B", "1d", 7200, 0.1),
            ("3", "A", "4h", 0, 0.2), ("3", "A", "4h", 60, 0.2), ("4", "A", "4h", 120, 0.2), (None, "A", "4h", 30, 0.2), (None, "B", "1d", 40, 0.2), ("5", "A", "4h", 300, 0.3)]
    p = stored_patterns(spark, rows)
    once, again = jo.co_occurrence_by_repeats(p)
    bag = lambda df: Counter(tuple(r) for r in df.collect())
    assert bag(once) + bag(again) == bag(jo.co_occurrence(p))
    assert {(r.pattern_id, r.correlated_id) for r in once.collect()} == {("4", "5")}
    catalog.load()
    got = {(r.pattern_id, r.correlated_id): r.co_occurrence_count for r in catalog.PLANS["join05_merge_correlations"](PatternsOnly(p)).collect()}
    assert got["1", "2"] == 8 and got["3", "4"] == 6 and got["4", "5"] == 3
    assert sum(got.values()) == sum({"4h": 3, "1d": 4}[r.timeframe] for r in jo.co_occurrence(p).collect())


def test_what_is_merged_in_place_equals_the_grouped_merge(spark):
    row = "struct<correlation_strength:double,temporal_relationship:string,co_occurrence_count:long>"
    pairs = spark.createDataFrame(
        [("1", "2", (0.5, "p1_leads", 3), None), ("1", "3", None, (0.7, "p2_leads", None)), ("2", "3", (0.5, "p1_leads", 3), (0.7, "p2_leads", None)), ("2", "4", None, None)],
        f"pattern_id string, correlated_id string, old {row}, new {row}")
    old, new = (pairs.filter(f"{x} is not null").select("pattern_id", "correlated_id", f"{x}.*") for x in ("old", "new"))
    want = {tuple(r) for r in jo.merge_correlations(old, new).collect()}
    assert {tuple(r) for r in jo.merge_in_place(pairs).collect()} == want and len(want) == 3
