"""Streaming record sources that deliver JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from netwarden.sources.messages import read_messages


def parse_records(lines: DataFrame, fields: Sequence[str], column: str = "value") -> DataFrame:
    """JSON objects to all-text records; blank and malformed lines are dropped."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    parsed = lines.select(F.from_json(F.trim(F.col(column).cast("string")), schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col("r.__bad").isNull()).select(*[F.col(f"r.`{f}`").alias(f) for f in fields])


def message_records(spark: SparkSession, path: str, fields: Sequence[str], **options) -> DataFrame:
    """JSON payloads of a message log, by offset; a stopped query goes on behind the last message it took."""
    return parse_records(read_messages(spark, path, **options), fields)


def socket_records(spark: SparkSession, host: str, port: int, fields: Sequence[str]) -> DataFrame:
    """Line-delimited JSON from a TCP server (development use: the socket source cannot replay)."""
    return parse_records(spark.readStream.format("socket").option("host", host).option("port", port).load(), fields)


def topic_records(spark: SparkSession, servers: str, topic: str, fields: Sequence[str], per_batch: int = 1_000_000) -> DataFrame:
    """JSON payloads of a topic; needs the Kafka connector on the classpath."""
    stream = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_batch).load()
    )
    return parse_records(stream, fields)
