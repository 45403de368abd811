"""Topics as streams or tables: Kafka where its connector is installed, folders of files otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", group: str | None = None) -> DataFrame:
    """The values of a topic as text, with the arrival as ingest_ts. starting is earliest, latest or offsets as JSON."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    if group:
        reader = reader.option("kafka.group.id", group)
    return _values(reader.load())


def kafka_table(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The whole topic as it is now, to rebuild a view from its beginning."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return _values(reader.option("startingOffsets", "earliest").option("endingOffsets", "latest").load())


def _values(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts"),
        F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"),
    )


def lines_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """New text files of a folder, line by line; at most so many files in a micro-batch."""
    reader = spark.readStream.format("text")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(folder).withColumn("ingest_ts", F.current_timestamp())


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """The parquet files of a table as a stream."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    only = spark.read.schema(schema).parquet(path).inputFiles()
    if [f.rstrip("/").rpartition("/")[2] for f in only] == [path.rstrip("/").rpartition("/")[2]]:
        path = f"{path[:-1]}[{path[-1]}]"  # a table of one file; the source takes folders and patterns
    return reader.parquet(path)


def corpus(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines as rows; blank lines and lines that are no JSON object go."""
    text = spark.read.text(path).where(F.trim("value") != "")
    ok = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT"))
    return text.where(ok).select(F.from_json("value", schema).alias("r")).select("r.*")


def synthetic(spark: SparkSession, rows_per_second: int, keywords: list[str], seed: int = 1) -> DataFrame:
    """Made-up sentiment windows, without end, for demonstrations."""
    return synthetic_windows(spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load(), keywords, seed)


def synthetic_windows(ticks: DataFrame, keywords: list[str], seed: int = 1) -> DataFrame:
    """A window of a minute for each row of ticks (timestamp, value), which can be a stream."""
    names = F.array(*map(F.lit, keywords))
    h = F.xxhash64(F.lit(seed), "value")
    return ticks.select(
        F.element_at(names, (F.pmod(h, F.lit(len(keywords))) + 1).cast("int")).alias("keyword"),
        (F.unix_timestamp("timestamp") - 60).alias("window_start"),
        F.unix_timestamp("timestamp").alias("window_end"),
        (F.pmod(F.xxhash64(h), F.lit(10_000)) / 10_000).alias("positive_ratio"),
        (F.pmod(F.xxhash64(h, F.lit(2)), F.lit(50)) + 1).alias("comment_count"),
    )
