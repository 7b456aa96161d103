"""Continuous operators on Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.lineage import cut_lineage
from tickloom.operators import quality as qa
from tickloom.operators import store as st
from tickloom.plans.detectors import scan_patterns
from tickloom.plans.scan import scan
from tickloom.schemas import SERIES, require


def table_stream(spark: SparkSession, path: str, name: str, max_files: int | None = None) -> DataFrame:
    """A stored table as a stream; the schema comes from the files already there."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def ingest_stream(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Landed quote records, validated and typed; invalid ones drop out (their table is the quarantine query's)."""
    return qa.transform_quotes(qa.validate_quotes(raw, as_of))


def start(stream: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds"):
    """Write a stream to files in micro-batches, every interval or once over what is there."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def chunks(batch: DataFrame, size: int = 1000) -> DataFrame:
    """Rows with ``chunk``: consecutive numbers, each for ``size`` rows and the last for the rest.

    A row's place is its place in its partition plus the rows of the partitions before, a table with a row for each partition.
    """
    rows = cut_lineage(batch.withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_p", part).join(sizes.select("_p", before.alias("_off")), "_p").withColumn("chunk", F.floor((F.col("_off") + place) / size)).drop("_m", "_p", "_off")


def buffered(stream: DataFrame, path: str, checkpoint: str, size: int = 1000, every: str | None = "30 seconds"):
    """Flush a stream every interval in chunks of at most ``size`` rows; readers see batch_id and chunk.

    A batch that runs again overwrites its own part.
    """

    def flush(batch: DataFrame, n: int) -> None:
        chunks(batch, size).write.mode("overwrite").parquet(f"{path}/batch_id={n}")

    w = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def dedupe_stream(df: DataFrame, window: str = "5 minutes", arrival: str = "arrived_at") -> DataFrame:
    """First record of each key; keys are forgotten ``window`` behind the newest arrival."""
    return qa.dedupe(df, window, arrival)


def bars_stream(ticks: DataFrame, width: str = "1 minute", lateness: str = "10 minutes", timeframe: str = "1m") -> DataFrame:
    """Bars of a trade stream, each emitted once when the watermark passes its end.

    Trades later than ``lateness`` are dropped. The order key is one decimal, as in the batch bars.
    """
    require(ticks, "symbol", "ts", "price", "size", "tick_id")
    at = F.unix_micros("ts").cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("tick_id")
    g = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return g.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


_STATE = "rows long, ema double, gain double, loss double, fast double, slow double, signal double, last double, range double, done long, held binary"
_LIVE = "symbol string, timeframe string, us long, close double, ema double, rsi double, macd double, signal double, atr double"
_HELD = np.dtype([("us", "<i8"), ("high", "<f8"), ("low", "<f8"), ("close", "<f8")])


def ema_stream(bars: DataFrame, ema: int = 20, rsi: int = 14, fast: int = 12, slow: int = 26, signal: int = 9, atr: int = 14, lateness: str = "2 hours") -> DataFrame:
    """EMA, RSI, MACD and ATR of each closed bar from nine numbers of state per series.

    Bars may come late by up to ``lateness``, over batches too: state holds them (32 bytes each) until the watermark has passed, and a timer
    releases them in order. Of bars with one time the last that came counts. Bars behind the watermark drop out.
    """
    require(bars, "high", "low", "close")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, e, g, lo, f, s, sig, last, tr, done, raw = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -(1 << 62), b"")
        parts = [np.frombuffer(bytes(raw), _HELD)]
        for rows in batches if not state.hasTimedOut else ():
            new = np.empty(len(rows), _HELD)
            for c in _HELD.names:
                new[c] = rows[c].to_numpy()
            parts.append(new)
        held = np.concatenate(parts)
        held = held[np.argsort(held["us"], kind="stable")]
        held = held[np.append(held["us"][1:] != held["us"][:-1], True)] if len(held) else held
        mark = state.getCurrentWatermarkMs()
        ready, held = held[(held["us"] < mark * 1000) & (held["us"] > done)], held[held["us"] >= mark * 1000]
        out = []
        for us, high, low, close in ready.tolist():
            reach = high - low
            if n == 0:
                e, f, s, last, tr = close, close, close, close, reach
            else:
                tr += (max(reach, abs(high - last), abs(low - last)) - tr) / atr
            d = close - last
            e += (close - e) * 2 / (ema + 1)
            f += (close - f) * 2 / (fast + 1)
            s += (close - s) * 2 / (slow + 1)
            g = max(d, 0.0) if n == 0 else g + (max(d, 0.0) - g) / rsi
            lo = max(-d, 0.0) if n == 0 else lo + (max(-d, 0.0) - lo) / rsi
            m = f - s if n >= slow - 1 else None
            if m is not None:
                sig = m if n == slow - 1 else sig + (m - sig) * 2 / (signal + 1)
            strength = 100 * g / (g + lo) if n >= rsi and g + lo > 0 else None
            out.append((*key, us, close, e if n >= ema - 1 else None, strength, m, None if m is None else sig, tr if n >= atr else None))
            n, last, done = n + 1, close, us
        state.update((n, e, g, lo, f, s, sig, last, tr, done, held.tobytes()))
        if len(held):
            state.setTimeoutTimestamp(max(int(held["us"][0]) // 1000 + 1, mark + 1))
        yield pd.DataFrame(out, columns=["symbol", "timeframe", "us", "close", "ema", "rsi", "macd", "signal", "atr"])

    rows = bars.withWatermark("ts", lateness).select(*SERIES, "ts", F.unix_micros("ts").alias("us"), *[F.col(c).cast("double").alias(c) for c in _HELD.names[1:]])
    out = rows.groupBy(*SERIES).applyInPandasWithState(step, _LIVE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*SERIES, F.timestamp_micros("us").alias("ts"), "close", "ema", "rsi", "macd", "signal", "atr")


_BAR = np.dtype([("us", "<i8"), *[(c, "<f8") for c in ("open", "high", "low", "close", "volume")]])
_RING = "symbol string, timeframe string, us long, open double, high double, low double, close double, volume double, idx long, n long, is_new boolean"


def recent_bars(bars: DataFrame, keep: int = 300) -> DataFrame:
    """Of each series in a micro-batch, its new bars after the last ``keep`` ones, which keyed state holds (48 bytes a bar).

    ``idx`` and ``n`` count all bars of the series so far. A bar at a time that the ring holds replaces that one; one
    between them is put in its place.
    """
    require(bars, "open", "high", "low", "close", "volume")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ring = (state.get[0], np.frombuffer(bytes(state.get[1]), _BAR)) if state.exists else (0, np.empty(0, _BAR))
        rows = pd.concat(list(batches))
        new = np.empty(len(rows), _BAR)
        for c in _BAR.names:
            new[c] = rows[c].to_numpy()
        both = np.concatenate([ring, new])
        both = both[np.argsort(both["us"], kind="stable")]
        both = both[np.append(both["us"][1:] != both["us"][:-1], True)]  # the last of one time
        seen += len(both) - len(ring)
        out = pd.DataFrame({c: both[c] for c in _BAR.names})
        out.insert(0, "symbol", key[0])
        out.insert(1, "timeframe", key[1])
        out["idx"] = np.arange(seen - len(both), seen)
        out["n"] = seen
        out["is_new"] = np.isin(both["us"], new["us"])
        state.update((seen, both[-keep:].tobytes()))
        yield out

    numbers = [F.col(c).cast("double").alias(c) for c in _BAR.names[1:]]
    rows = bars.select(*SERIES, F.unix_micros("ts").alias("us"), *numbers)
    return rows.groupBy(*SERIES).applyInPandasWithState(step, _RING, "seen long, ring binary", "append", GroupStateTimeout.NoTimeout)


def scan_stream(bars: DataFrame, root: str, checkpoint: str, find: Callable[[DataFrame], DataFrame] = scan_patterns, subs: DataFrame | None = None,
                keep: int = 300, every: str | None = "60 seconds"):
    """Scan each micro-batch of bars with the bars before it, and commit patterns, correlations and alerts by batch id.

    Only findings that end on a new bar or later are saved. State and sinks belong to a batch id, so one that runs again reads the
    state from before it and overwrites its own parts.
    """

    def work(batch: DataFrame, n: int) -> None:
        recent = cut_lineage(batch.withColumn("ts", F.timestamp_micros("us")).drop("us"))
        since = recent.filter("is_new").groupBy(*SERIES).agg(F.min("ts").alias("_from"))

        def fresh(found: DataFrame) -> DataFrame:
            return found.join(since, SERIES).filter(F.col("end_ts") >= F.col("_from")).drop("_from")

        scan(recent.drop("is_new"), root, n, subs, find, fresh)

    w = recent_bars(bars, keep).writeStream.foreachBatch(work).outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def message_lag(messages: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Seconds between a message's time and now, per topic."""
    now = F.current_timestamp() if as_of is None else as_of
    lag = F.unix_millis(now) - F.unix_millis("ts")
    return messages.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), (F.max(lag) / 1000).alias("max_lag_seconds"), (F.avg(lag) / 1000).alias("avg_lag_seconds"), (F.min(lag) / 1000).alias("min_lag_seconds"))


def offset_lag(consumed: DataFrame, stored: DataFrame) -> DataFrame:
    """Position, high-water mark and lag of a reader after each of its batches, per topic.

    ``consumed`` has batch_id, topic and messages; ``stored`` has topic and messages, all that the topic holds.
    """
    topic = Window.partitionBy("topic").orderBy("batch_id")
    high = stored.groupBy("topic").agg(F.sum("messages").alias("high_water_mark"))
    sums = consumed.groupBy("topic", "batch_id").agg(F.sum("messages").alias("messages"))
    return sums.join(high, "topic").withColumn("position", F.sum("messages").over(topic)).withColumn("lag", F.col("high_water_mark") - F.col("position"))


_PROGRESS = "batch_id long, at timestamp, source string, start_offset string, end_offset string, latest_offset string, input_rows long, rows_per_second double"


def progress_table(query) -> DataFrame:
    """A row for each source of each recent batch of a query, as the engine reported it: offsets as JSON, rows and rate."""
    rows = []
    for p in query.recentProgress:
        at = datetime.fromisoformat(p["timestamp"])
        for s in p["sources"]:
            offsets = [None if s.get(k) is None else json.dumps(s.get(k)) for k in ("startOffset", "endOffset", "latestOffset")]
            rows.append((p["batchId"], at, s["description"], *offsets, s["numInputRows"], float(s.get("processedRowsPerSecond") or 0)))
    return SparkSession.active().createDataFrame(rows, _PROGRESS)


def log_progress(query, path: str) -> DataFrame:
    """Append the recent progress of a query to its log and return the log, one row for each batch and source."""
    progress_table(query).write.mode("append").parquet(path)
    rows = SparkSession.active().read.parquet(path)
    own = [c for c in rows.columns if c not in ("batch_id", "source")]
    return rows.groupBy("batch_id", "source").agg(F.max_by(F.struct(*own), F.struct("input_rows", "at")).alias("r")).select("batch_id", "source", "r.*")


def by_symbol(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """All rows of a symbol in one partition, as keyed messages arrive."""
    return df.repartition(partitions, "symbol") if partitions else df.repartition("symbol")


def alert_classes(subs: DataFrame) -> DataFrame:
    """Subscriptions with equal criteria as one row each, with the number of its ``members``: all of them get the same alerts."""
    names = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias(c)
    of = [names("symbols"), names("pattern_types"), F.coalesce("min_confidence", F.lit(0.0)).alias("min_confidence")]
    classes = subs.groupBy(*of).agg(F.count(F.lit(1)).alias("members"))
    return classes.withColumn("subscriber", F.sha2(F.to_json(F.struct("symbols", "pattern_types", "min_confidence")), 256))


def alert_stream(patterns: DataFrame, subs: DataFrame, salts: int = 16) -> DataFrame:
    """Patterns matched to subscriptions, one row per channel; works on a stream joined to a static table.

    Everything matches '*', so keys carry a salt: a pattern picks one, a subscription has all. A subscription names each of its symbols
    once, and one for all symbols has no other key, so a pattern meets it once. ``members`` of :func:`alert_classes` go along.
    """
    def listed(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) == 0

    along = [c for c in ("members",) if c in subs.columns]
    s = subs.select("subscriber", *along, F.col("pattern_types").alias("_t"), F.coalesce("min_confidence", F.lit(0.0)).alias("_m"),
                    F.explode(F.when(listed("symbols"), F.array(F.lit("*"))).otherwise(F.array_distinct("symbols"))).alias("_key"))
    s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    p = patterns.withColumns({"_salt": F.pmod(F.xxhash64("pattern_id"), F.lit(salts)).cast("int"), "_key": F.explode(F.array(F.col("symbol"), F.lit("*")))})
    hit = (F.col("confidence") >= F.col("_m")) & (listed("_t") | F.array_contains("_t", F.col("pattern_type")))
    return st.route_alerts(p.join(s, ["_key", "_salt"]).filter(hit)).withColumn("channel", F.explode("channels")).drop("_key", "_salt", "_t", "_m", "channels")
