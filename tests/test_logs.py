"""Call log analytics: exact results where groups are large or odd, and sketches against exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import logs


def timed(spark, values, endpoint="/a"):
    return spark.createDataFrame([(endpoint, float(v)) for v in values], "endpoint string, response_time_ms double")


@pytest.mark.parametrize("kind", ["outlier", "equal", "heavy", "small"])
def test_percentiles_at_exact_places(spark, kind):
    rng = np.random.default_rng(1)
    v = {"outlier": np.append(rng.normal(100, 5, 3000), 1e12), "equal": np.full(50, 7.0), "heavy": np.round(rng.pareto(0.5, 2000), 1), "small": np.arange(9.0)}[kind]
    got = logs.latency_percentiles(timed(spark, v), ["endpoint"]).collect()
    if kind == "small":
        assert got == []
        return
    s = np.sort(v)
    assert [tuple(got[0][p] for p in ("n", "p50", "p90", "p95", "p99"))] == [(len(v), *(s[int(len(v) * q)] for q in (0.5, 0.9, 0.95, 0.99)))]


def test_one_outlier_does_not_fill_one_range(spark):
    v = np.append(np.random.default_rng(2).normal(100, 5, 5000), 1e12)
    counts = timed(spark, v).groupBy("response_time_ms").count()
    cuts = counts.agg(F.percentile_approx("response_time_ms", [k / 16 for k in range(1, 16)], 160).alias("c"))
    sizes = [r["count"] for r in counts.crossJoin(cuts).withColumn("b", F.size(F.filter("c", lambda x: x < F.col("response_time_ms")))).groupBy("b").count().collect()]
    assert max(sizes) < 2 * 5001 / 16


def test_leading_values_are_bounded(spark):
    rows = [("a", f"u{i:03}", c) for i, c in enumerate([5] * 20 + [9, 1])] + [("b", "u1", 1)]
    counts = spark.createDataFrame(rows, "k string, value string, count long")
    got = {r.k: r for r in logs.leading(counts, ["k"], "value", "top", 3).collect()}
    assert [(e["value"], e["count"]) for e in got["a"].top] == [("u020", 9), ("u000", 5), ("u001", 5)] and got["a"].top_total == 22
    assert got["b"].top_total == 1 and len(got["b"].top) == 1


def test_stored_sketches_answer_for_any_days(spark, tables, tmp_path):
    path = str(tmp_path / "sketches")
    logs.call_sketches(tables.calls).write.partitionBy("day").parquet(path)
    kept = spark.read.parquet(path)
    days = F.col("day").between("2024-01-03", "2024-01-12")
    merged = {r.endpoint: r for r in logs.merged_sketches(kept.filter(days), ["endpoint"]).collect()}
    calls = tables.calls.filter(F.to_date("ts").between("2024-01-03", "2024-01-12"))
    for r in calls.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"), F.collect_list("response_time_ms").alias("t")).collect():
        m, t = merged[r.endpoint], np.sort(r.t)
        assert m.calls == r.n and abs(m.unique_users - r.u) <= max(1, 0.03 * r.u)
        assert abs((t <= m.p95).mean() - 0.95) <= 0.02 and abs((t <= m.p50).mean() - 0.5) <= 0.02
        assert len(m.top_users) == 10
    assert logs.merged_sketches(kept.filter("day = '1999-01-01'"), ["endpoint"]).count() == 0
