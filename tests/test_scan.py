"""The whole scan: composition, sinks, and what a replayed batch does."""

import glob
import itertools
import os

import pytest
from pyspark.sql import functions as F

from tickloom.operators.candles import candlestick_patterns
from tickloom.plans import detectors as de
from tickloom.plans import scan
from tickloom.streaming import live


def found(bars):
    return de.filter_rank(de.detect(bars, ["candlestick"]))


@pytest.fixture
def subs(spark):
    rows = [("all", [], [], 0.0), ("one", ["view"], ["candlestick"], 0.7), ("none", ["nope"], [], 0.0)]
    return spark.createDataFrame(rows, "subscriber string, symbols array<string>, pattern_types array<string>, min_confidence double")


def test_scan_runs_and_ranks_all_detectors(spark, tables):
    rows = [r.asDict() for r in de.detect(tables.hourly).collect()]
    assert {"candlestick", "divergence"} <= {r["detector"] for r in rows}
    good = [r for r in rows if r["confidence"] is not None and r["confidence"] >= 0.6 and (not r["risk_reward"] or r["risk_reward"] >= 1.5)]
    best = lambda r: (-r["confidence"], -(r["strength"] or 0), -(r["quality_score"] or 0), r["start_ts"], r["end_idx"])
    day = lambda r: (r["pattern_type"], r["pattern_name"], r["symbol"], r["start_ts"].date())
    firsts = [min(g, key=best) for _, g in itertools.groupby(sorted(good, key=lambda r: (*day(r), *best(r))), key=day)]
    want = []
    for _, g in itertools.groupby(sorted(firsts, key=lambda r: (r["symbol"], *best(r), r["pattern_type"], r["pattern_name"])), key=lambda r: r["symbol"]):
        want += [(r["symbol"], r["pattern_name"], r["confidence"], k + 1) for k, r in enumerate(itertools.islice(g, 50))]
    got = [(r.symbol, r.pattern_name, r.confidence, r["rank"]) for r in de.scan_patterns(tables.hourly).collect()]
    assert sorted((a, c, d) for a, _, c, d in got) == sorted((a, c, d) for a, _, c, d in want)
    assert len(got) == len(want)


def test_divergences_are_those_of_their_operators(tables):
    from tickloom.operators import volprice

    got = de.divergences(tables.hourly)
    assert got.count() == volprice.pv_divergence(tables.hourly).count() + volprice.continuous_divergence(tables.hourly).count() > 0
    assert got.filter("start_ts >= end_ts or direction not in ('bullish', 'bearish') or confidence > 1").count() == 0


def rows(spark, root, name):
    df = scan.read(spark, root, name)
    drop = [c for c in ("detected_at", "expires_at", "batch_id") if c in df.columns]
    return sorted(map(str, df.drop(*drop).select(sorted(set(df.columns) - set(drop))).collect()))


def test_tables_of_a_batch(spark, tables, subs, tmp_path):
    root = str(tmp_path / "scan")
    out = scan.scan(tables.hourly, root, 3, subs, found)
    patterns = out["patterns"].collect()
    assert len({p.pattern_id for p in patterns}) == len(patterns) > 50
    starts = [(p.symbol, p.direction, p.start_ts.timestamp(), p.pattern_id) for p in patterns]
    near = {tuple(sorted((a[3], b[3]))) for a, b in itertools.combinations(starts, 2) if a[:2] == b[:2] and abs(a[2] - b[2]) <= 36_000}
    assert {(r.pattern_id, r.correlated_id) for r in out["correlations"].collect()} == near and near
    channels = lambda c: ["database"] + ["websocket"] * (c >= 0.8) + ["email"] * (c >= 0.9)
    want = {("all", p.pattern_id, c) for p in patterns for c in channels(p.confidence)}
    want |= {("one", p.pattern_id, c) for p in patterns if p.symbol == "view" and p.confidence >= 0.7 for c in channels(p.confidence)}
    assert {(r.subscriber, r.pattern_id, r.channel) for r in out["alerts"].collect()} == want
    before = {n: rows(spark, root, n) for n in scan.TABLES}
    scan.scan(tables.hourly, root, 3, subs, found)
    assert {n: rows(spark, root, n) for n in scan.TABLES} == before


def test_a_replayed_batch_leaves_all_sinks_as_they_were(spark, tables, subs, tmp_path):
    bars, path, root, marks = tables.hourly, str(tmp_path / "bars"), str(tmp_path / "scan"), str(tmp_path / "marks")
    for k in range(3):
        bars.filter(F.pmod(F.floor(F.unix_seconds("ts") / (10 * 86400)), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)
        live.scan_stream(stream, root, marks, lambda b: candlestick_patterns(b, groups=["engulfing", "doji"]), subs, every=None).awaitTermination()
        return {n: rows(spark, root, n) for n in scan.TABLES}

    first = run()
    commits = sorted((p for p in glob.glob(f"{marks}/commits/[0-9]*")), key=lambda p: int(os.path.basename(p)))
    assert len(commits) == 3 and all(first.values())
    os.remove(commits[-1])  # as if the driver was lost after the sinks and before the commit
    for crc in glob.glob(f"{marks}/commits/.{os.path.basename(commits[-1])}.crc"):
        os.remove(crc)
    assert run() == first
    ids = {r.pattern_id for r in scan.read(spark, root, "patterns").collect()}
    every = candlestick_patterns(bars, groups=["engulfing", "doji"])
    assert ids == {r.pattern_id for r in scan.saved(every).collect()}  # history comes from the state, whatever the cut


def test_ring_keeps_order_and_counts(spark, tmp_path):
    from market_helpers import bars

    whole = bars(spark, range(1, 31))
    path, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    late = whole.filter("close = 8").withColumn("close", F.lit(99.0))
    for part in (whole.filter("close <= 10 and close <> 5"), whole.filter("close between 11 and 20").unionByName(late), whole.filter("close > 20 or close = 5")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live.recent_bars(stream, 12).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    rows = [r for r in spark.read.parquet(out).collect()]
    second = sorted((r.idx, r.close, r.is_new) for r in rows if r.n == 19)
    assert [c for _, c, _ in second] == [1, 2, 3, 4, 6, 7, 99, 9, 10, *range(11, 21)] and [i for i, _, _ in second] == list(range(19))
    assert [c for _, c, new in second if new] == [99, *range(11, 21)]
    third = sorted((r.idx, r.close) for r in rows if r.n == 30)
    assert len(third) == 23 and third[-1] == (29, 30.0)
