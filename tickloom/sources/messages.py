"""Message-bus source and sink: keyed JSON values, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import require


def to_messages(df: DataFrame, topic: str, key: str = "symbol") -> DataFrame:
    """topic, key and a JSON value with a send time and an id, times to the microsecond. The key keeps a symbol in order."""
    require(df, key)
    body = F.struct(*[F.col(c) for c in df.columns], F.current_timestamp().alias("timestamp"), F.uuid().alias("message_id"))
    return df.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(body, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def from_messages(messages: DataFrame, schema: str) -> DataFrame:
    """Columns of the JSON values; broken messages drop out."""
    require(messages, "value")
    m = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).filter("m is not null")
    return m.select("m.*")


def read_stream(spark: SparkSession, topic: str, schema: str, servers: str | None = None, path: str | None = None,
                max_offsets: int = 1000, max_files: int | None = None, starting: str = "latest") -> DataFrame:
    """Stream of a topic, from the bus (at most ``max_offsets`` messages a batch, new ones unless ``starting`` says earliest) or from a
    folder of JSON lines with topic, key and value (at most ``max_files`` files a batch)."""
    if servers:
        src = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
               .option("startingOffsets", starting).option("maxOffsetsPerTrigger", max_offsets).load())
    else:
        reader = spark.readStream.schema("topic string, key string, value string")
        src = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path).filter(F.col("topic") == topic)
    return from_messages(src, schema)


def write_stream(df: DataFrame, topic: str, checkpoint: str, key: str = "symbol", servers: str | None = None, path: str | None = None, once: bool = False):
    """Start a query that sends a stream to the bus or a folder; ``once`` ends it when all that is there is sent.

    A restart from the same checkpoint goes on behind the last batch sent. The folder's own log hides parts of batches that failed.
    """
    writer = to_messages(df, topic, key).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    if servers:
        return writer.format("kafka").option("kafka.bootstrap.servers", servers).start()
    return writer.format("json").option("path", path).start()


def write_batch(df: DataFrame, topic: str, key: str = "symbol", servers: str | None = None, path: str | None = None) -> None:
    """Send a table; a folder that a stream writes to shows its readers only what the stream wrote, so use another."""
    out = to_messages(df, topic, key)
    if servers:
        out.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    else:
        out.write.mode("append").json(path)
