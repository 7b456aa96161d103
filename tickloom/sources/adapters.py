"""Adapters from general tables (event log, order lines) to ticks and bars."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import ticks_to_bars


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Each event is a trade of the instrument named by its type."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.col("event_id").alias("tick_id"),
    )


def ticks_from_lines(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Each order line is a trade of its supplier's region at the unit price."""
    places = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )
    return lineitem.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("r_name").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tick_id"),
    )


def calls_from_events(events: DataFrame) -> DataFrame:
    """Each event is an API call; its ``k`` decides method, status and sizes."""
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(k % 20 == 0, 500).when(k % 10 == 3, 404).otherwise(200)
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
        F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), status.alias("status_code"), (F.col("value") * 50).alias("response_time_ms"),
        F.when(k != 9, F.col("user_id")).alias("user_id"), (F.col("user_id") % 40).alias("ip_address"), (k * 10).alias("request_size"), (k * 100).alias("response_size"))


def patterns_from_orders(orders: DataFrame) -> DataFrame:
    """Each order is a stored pattern; its key decides name, scores and outcome."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(i, *names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))

    kind = pick(F.left("o_orderpriority", F.lit(1)).cast("int") - 1, "candlestick", "chart", "volume", "breakout", "price")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "active").otherwise(
        pick(k % 4, "failed", "expired", "detected", "confirmed"))
    done = status.isin("completed", "failed")
    detected = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))
    entry = F.col("o_totalprice") / 1000
    sign = F.when(c % 3 == 1, -1.0).otherwise(1.0)
    return orders.select(
        k.cast("string").alias("pattern_id"), F.concat(F.lit("SYM"), (c % 20).cast("string")).alias("symbol"), pick(k % 3, "1h", "4h", "1d").alias("timeframe"),
        kind.alias("pattern_type"), F.concat(kind, F.lit("_"), (k % 4).cast("string")).alias("pattern_name"), pick(c % 3, "bullish", "bearish", "neutral").alias("direction"),
        k.alias("start_idx"), (k + k % 5).alias("end_idx"), (detected - F.make_dt_interval(hours=(k % 5 * 2).cast("int"))).alias("start_ts"), detected.alias("end_ts"),
        (0.3 + k * 7 % 70 / 100).alias("confidence"), F.when(k % 17 != 0, k * 13 % 100 / 100).alias("strength"), (k * 3 % 10 / 10).alias("quality_score"),
        entry.alias("entry_price"), (entry * (1 + sign * (k % 7) / 50)).alias("target_price"), (entry * (1 - sign * (k % 5 + 1) / 100)).alias("stop_loss"),
        ((k % 7) / 50 / ((k % 5 + 1) / 100)).alias("risk_reward"), status.alias("status"), detected.alias("detected_at"),
        F.when(done & (status == "completed") & (k % 5 != 0), "success").when(done, "failure").alias("actual_outcome"),
        F.when(done, (k * 31 % 2000 - 800) / 10000).alias("actual_return"), (k % 5 * 7200).alias("duration_seconds"),
        F.when(k % 3 == 0, F.array(F.lit("momentum"))).when(k % 3 == 1, F.array(F.lit("reversal"), F.lit("volume"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.create_map(F.lit("volume_ratio"), (k % 30).cast("double") / 10).alias("metadata"))


class Tables:
    """The given parquet tables and the series derived from them, read lazily."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        return ticks_from_events(self.read("events"))

    @cached_property
    def hourly(self) -> DataFrame:
        return ticks_to_bars(self.ticks, "1h")

    @cached_property
    def minutely(self) -> DataFrame:
        return ticks_to_bars(self.ticks, "1m")

    @cached_property
    def calm_ticks(self) -> DataFrame:
        """The same trades on a price with small relative moves."""
        return self.ticks.withColumn("price", 500 + F.col("price") * 0.1)

    @cached_property
    def calm(self) -> DataFrame:
        return ticks_to_bars(self.calm_ticks, "1h")

    @cached_property
    def calm_minutes(self) -> DataFrame:
        return ticks_to_bars(self.calm_ticks, "1m")

    @cached_property
    def climbing(self) -> DataFrame:
        """The same trades on a price that climbs by the day, with little noise."""
        days = (F.unix_micros("ts") / 1e6 - 1704067200) / 86400
        return ticks_to_bars(self.ticks.withColumn("price", 100 + 2 * days + F.col("price") * 0.1), "1h")

    @cached_property
    def surges(self) -> DataFrame:
        """Minute bars whose volume follows the price, so moves come with volume."""
        return ticks_to_bars(self.ticks.withColumn("size", F.col("price")), "1m")

    @cached_property
    def calls(self) -> DataFrame:
        return calls_from_events(self.read("events"))

    @cached_property
    def patterns(self) -> DataFrame:
        return patterns_from_orders(self.read("orders"))

    @cached_property
    def line_ticks(self) -> DataFrame:
        return ticks_from_lines(*[self.read(t) for t in ("lineitem", "supplier", "nation", "region")])

    @cached_property
    def daily(self) -> DataFrame:
        return ticks_to_bars(self.line_ticks, "1d")
