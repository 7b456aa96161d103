"""Writers, merging, streaming decoders and the detector registry."""

import datetime

import numpy as np
import pytest
from market_helpers import bars
from pyspark.sql import functions as F

from tickloom.operators import quality as qa
from tickloom.plans import detectors as de
from tickloom.sources import messages, raw, storage, vendor
from tickloom.streaming import live, sinks


def test_partitioned_write_prunes(spark, tables, tmp_path):
    path = str(tmp_path / "bars")
    storage.write_bars(tables.hourly, path)
    df = spark.read.parquet(path).filter("date = '2024-01-05'")
    assert "PartitionFilters: [isnotnull(date" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == tables.hourly.filter("to_date(ts) = '2024-01-05'").count()


def test_rewrite_touches_only_updated_dates(spark, tables, tmp_path):
    path = str(tmp_path / "bars")
    storage.write_bars(tables.hourly, path)
    before = spark.read.parquet(path).count()
    late = storage.with_partitions(tables.hourly.filter("to_date(ts) = '2024-01-05'").withColumn("close", F.lit(1.0)), "market_data")
    storage.rewrite_dates(path, late, ["symbol", "timeframe", "ts"])
    after = spark.read.parquet(path)
    assert after.count() == before
    assert after.filter("close = 1.0 and date = '2024-01-05'").count() == late.count()


def test_fan_out_rules(spark):
    def bad(df):
        raise OSError("away")

    df = spark.range(3)
    assert storage.fan_out(df, [bad, lambda d: d.count()], require_all=False) == [False, True]
    with pytest.raises(OSError):
        storage.fan_out(df, [bad, lambda d: d.count()])
    assert storage.write_with_fallback(df, bad, lambda d: None, 2, 0.0) == "backup"


def test_stream_decoder_equals_batch(spark, tables, tmp_path):
    path = str(tmp_path / "in")
    msgs = raw.ticker_messages(tables.ticks)
    msgs.write.parquet(path)
    stream = vendor.decode_ticker_stream(spark.readStream.schema("value string").parquet(path))
    assert sinks.drained(stream).count() == vendor.decode_ticker_stream(msgs).count() > 0


def test_bus_with_checkpoint_and_restart(spark, tables, tmp_path):
    source, bus, marks, seen, out, log = (str(tmp_path / x) for x in ("source", "bus", "marks", "seen", "out", "log"))
    ticks = tables.ticks
    parts = [ticks.filter(F.pmod("tick_id", F.lit(3)) == k) for k in range(3)]

    def pump():
        """Send what is new, read what is new, and log it."""
        stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(source)
        messages.write_stream(stream, "ticks", marks, path=bus, once=True).awaitTermination()
        got = messages.read_stream(spark, "ticks", "symbol string, ts timestamp, price double, tick_id bigint", path=bus, max_files=1)
        q = got.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start()
        q.awaitTermination()
        return live.log_progress(q, log)

    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(source)
    both = parts[0].count() + parts[1].count()
    first = pump()
    assert first.filter("input_rows > 0").count() == 2 and first.agg(F.sum("input_rows")).first()[0] == both
    assert pump().agg(F.sum("input_rows")).first()[0] == both  # a restart sends and reads nothing twice
    parts[2].coalesce(1).write.mode("append").parquet(source)
    rows = pump().collect()
    assert len({(r.batch_id, r.source) for r in rows}) == len(rows) and all(r.end_offset for r in rows) and sum(r.input_rows for r in rows) == ticks.count()
    assert sorted((r.symbol, r.ts, r.price, r.tick_id) for r in spark.read.parquet(out).collect()) == sorted((r.symbol, r.ts, r.price, r.tick_id) for r in ticks.collect())
    assert messages.read_stream(spark, "other", "symbol string", path=bus).isStreaming


def test_batch_messages(spark, tables, tmp_path):
    path = str(tmp_path / "bus")
    messages.write_batch(tables.ticks.limit(5), "ticks", path=path)
    messages.write_batch(tables.ticks.limit(3), "other", path=path)
    got = sinks.drained(messages.read_stream(spark, "other", "symbol string, price double", path=path))
    assert got.count() == 3


def test_broken_messages_drop_out(spark):
    rows = spark.createDataFrame([('{"symbol": "A", "price": 1.5}',), ("{broken",), (None,)], "value string")
    assert [tuple(r) for r in messages.from_messages(rows, "symbol string, price double").filter("symbol is not null").collect()] == [("A", 1.5)]


def test_chunks_are_full_but_the_last(spark, tmp_path):
    df = spark.range(2357).repartition(7)
    sizes = sorted((r.chunk, r["count"]) for r in live.chunks(df, 500).groupBy("chunk").count().collect())
    assert sizes == [(0, 500), (1, 500), (2, 500), (3, 500), (4, 357)]
    assert live.chunks(df.limit(0), 500).count() == 0


def test_registered_detector_gets_plain_bars(spark):
    def last_bar(df):
        return df.filter(F.col("idx") == F.col("n") - 1).select(
            "symbol", "timeframe", F.lit("own").alias("pattern_type"), F.lit("last_bar").alias("pattern_name"), F.lit("neutral").alias("direction"), F.col("idx").alias("start_idx"),
            F.col("idx").alias("end_idx"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.lit(0.9).alias("confidence"), F.lit(None).cast("double").alias("risk_reward"))

    de.register_detector("own", last_bar, "low")
    try:
        rows = de.scan_patterns(bars(spark, range(1, 30)), ["own"]).collect()
        assert [(r.pattern_name, r.end_idx) for r in rows] == [("last_bar", 28)]
    finally:
        de.unregister_detector("own")


def arrivals(spark, n, keys=5, seed=4):
    """Records whose arrivals are steady, in bursts, and with long pauses."""
    rng = np.random.default_rng(seed)
    gaps = np.where(rng.random(n) < 0.02, rng.integers(300, 5000, n), rng.integers(0, 40, n))
    at = np.cumsum(gaps).tolist()
    rows = [(f"S{k}", "daily", datetime.datetime(2024, 1, 1), "x", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=int(t)), i) for i, (t, k) in enumerate(zip(at, rng.integers(0, keys, n).tolist()))]
    return spark.createDataFrame(rows, "symbol string, data_type string, ts timestamp, granularity string, arrived_at timestamp, id long"), rows


def walked(rows, seconds=300):
    last, kept = {}, []
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        if r[0] not in last or (r[4] - last[r[0]]).total_seconds() >= seconds:
            last[r[0]] = r[4]
            kept.append(r[5])
    return sorted(kept)


def test_dedupe_of_a_batch_and_of_its_stream(spark, tmp_path):
    df, rows = arrivals(spark, 1500)
    want = walked(rows)
    assert sorted(r.id for r in qa.dedupe(df).collect()) == want and 20 < len(want) < 700
    path = str(tmp_path / "in")
    for k in range(3):  # a key's window reaches over the batches
        df.filter(F.col("id").between(k * 500, k * 500 + 499)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted(r.id for r in sinks.drained(live.dedupe_stream(stream)).collect()) == want


def test_dedupe_of_nulls_and_repeats(spark):
    t = datetime.datetime(2024, 1, 1)
    at = [None, None, t, t, t + datetime.timedelta(seconds=299.999999), t + datetime.timedelta(seconds=300), t + datetime.timedelta(days=40)]
    df = spark.createDataFrame([("A", "daily", t, "x", a, i) for i, a in enumerate(at)], "symbol string, data_type string, ts timestamp, granularity string, arrived_at timestamp, id long")
    assert sorted(r.id for r in qa.dedupe(df).collect()) == [0, 2, 5, 6]
    assert qa.dedupe(df.limit(0)).count() == 0


def test_retention_and_dedupe_stream_state_is_bounded(spark, tables):
    df = tables.ticks.select("symbol", F.lit("daily").alias("data_type"), F.date_trunc("hour", "ts").alias("ts"), F.lit("x").alias("granularity"), F.col("ts").alias("arrived_at"))
    kept = {}
    for r in sorted(df.collect(), key=lambda r: r.arrived_at):
        times = kept.setdefault((r.symbol, r.ts), [])
        if not times or (r.arrived_at - times[-1]).total_seconds() >= 300:
            times.append(r.arrived_at)
    got = [(r.symbol, r.ts, r.arrived_at) for r in qa.dedupe(df).collect()]
    assert sorted(got) == sorted((s, t, a) for (s, t), times in kept.items() for a in times)


def test_late_bars_take_their_place(spark, tmp_path):
    """Bars shuffled over batches within the lateness give what bars in order give; later ones drop out."""
    rng = np.random.default_rng(6)
    prices = 100 + np.cumsum(rng.normal(size=120))
    df = bars(spark, prices)
    order = sorted(range(120), key=lambda i: i + rng.uniform(0, 4))  # late by at most four bars
    paths = {k: str(tmp_path / k) for k in ("plain", "late")}
    for name, places in (("plain", list(range(120))), ("late", order)):
        for k in range(0, 120, 30):
            df.join(spark.createDataFrame([(p,) for p in places[k : k + 30]], "p int"), F.unix_seconds("ts") == 1704067200 + F.col("p") * 3600).drop("p").coalesce(1).write.mode("append").parquet(paths[name])
    df.filter("close > 0").limit(1).withColumn("close", F.lit(1e9)).coalesce(1).write.mode("append").parquet(paths["late"])  # the first bar again, far behind the watermark

    def run(name):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(paths[name])
        return {r.ts: r for r in sinks.drained(live.ema_stream(stream, lateness="6 hours")).collect()}

    plain, late = run("plain"), run("late")
    assert len(plain) == 113 and plain == late  # those within six hours of the end are still held
