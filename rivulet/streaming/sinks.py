"""Sinks of streams: Kafka topics and files. Delivery is at least once; readers replace what comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def as_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """Every row as one JSON text with its nulls, and the key of a topic record if one is named."""
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None) -> DataStreamWriter:
    writer = as_json(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("kafka.compression.type", "lz4").option("kafka.linger.ms", "50").option("checkpointLocation", checkpoint)


def kafka_batch(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    """The rows of a micro-batch to a topic; one that comes again sends them again."""
    out = as_json(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    out.option("kafka.compression.type", "lz4").option("kafka.linger.ms", "50").save()


def to_files(df: DataFrame, folder: str, checkpoint: str, kind: str = "json") -> DataStreamWriter:
    writer = df.writeStream.format(kind).option("path", folder).option("checkpointLocation", checkpoint)
    return writer.option("ignoreNullFields", "false") if kind == "json" else writer


def put_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """Write a micro-batch under its number; a repeated micro-batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
