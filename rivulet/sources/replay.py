"""Replaying a dump of JSON comments: reading, ordering, slicing and restamping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.session import cut

#: The first and the last second of a replay (fixed values).
DATE_START, DATE_END = 1554076800, 1555472130


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files, compressed ones (zst, gz, ...) included; a compressed file is one task."""
    return spark.read.text(path).withColumn("file", F.input_file_name())


#: Records of a made-up dump: id, seconds after DATE_START, body. The b ones are to be filtered out.
SAMPLE = [
    ("a1", 0, "This phone is 🔥"), ("a2", 0, "Party 🎉 tonight"), ("a3", 60, "Perfect score 💯"), ("a4", 120, "A plain comment"),
    ("b1", -86_400, "Before the range"), ("b2", 30, "[deleted]"), ("b3", 40, "[removed]"), ("b4", DATE_END - DATE_START + 86_400, "Behind the range"),
]


def sample_lines(spark: SparkSession) -> DataFrame:
    """Eight records as JSON lines, four of which lie in the dates and have a body."""
    rows = [(i, "tester", DATE_START + t, body, 1, "technology", 0) for i, t, body in SAMPLE]
    df = spark.createDataFrame(rows, "id string, author string, created_utc bigint, body string, score bigint, subreddit string, controversiality bigint")
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def numbered(df: DataFrame) -> DataFrame:
    """df with line, a number that grows along each file and from file to file."""
    return df.withColumn("line", F.monotonically_increasing_id())


def runs(df: DataFrame, partition: Sequence[str], order: Sequence[str], seconds: str) -> DataFrame:
    """Runs of consecutive records with one time, within each partition; a time that comes again later is another run.

    Columns: partition, run (from 1), the time, n, first (the order value of its first record). Records are ranged over
    tasks by (partition, order): each piece numbers its own runs, and a run that goes on in the next piece is counted once.
    """
    ranged = cut(df.select(*partition, *order, seconds).repartitionByRange(*partition, *order).withColumn("_piece", F.spark_partition_id()))
    w = W.partitionBy(*partition, "_piece").orderBy(*order)
    again = F.lag(seconds).over(w).eqNullSafe(F.col(seconds)) & F.lag(F.lit(True)).over(w).isNotNull()
    marked = ranged.withColumn("_new", F.when(again, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = F.struct(*order)
    pieces = marked.groupBy(*partition, "_piece").agg(F.max("_run").alias("_n"), F.min_by(seconds, at).alias("_head"), F.max_by(seconds, at).alias("_tail"))
    along = W.partitionBy(*partition).orderBy("_piece")  # one row for each task
    goes_on = F.col("_head").eqNullSafe(F.lag("_tail").over(along)) & F.lag(F.lit(True)).over(along).isNotNull()
    pieces = pieces.withColumn("_on", F.when(goes_on, 1).otherwise(0))
    own = F.col("_n") - F.col("_on")
    pieces = pieces.withColumn("_before", F.sum(own).over(along.rowsBetween(W.unboundedPreceding, 0)) - own - F.col("_on"))
    a, b = marked.alias("a"), pieces.alias("b")
    same = F.col("a._piece") == F.col("b._piece")
    for c in partition:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    numbered_runs = a.join(b, same).select("a.*", (F.col("_run") + F.col("_before")).alias("run"))
    return numbered_runs.groupBy(*partition, "run", seconds).agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"))


def slice_of(df: DataFrame, order: Sequence[str], skip: int, limit: int | None) -> DataFrame:
    """Records skip to skip + limit in the given order; only as many rows as the end of the slice leave their partitions."""
    if skip < 0 or (limit is not None and limit < 0):
        raise ValueError("skip and limit cannot be negative")
    ordered = df.orderBy(*order)
    if skip:
        ordered = ordered.offset(skip)
    return ordered if limit is None else ordered.limit(limit)


def schedule(df: DataFrame, speed: float, seconds: str = "created_utc", unit: str = "due_s") -> DataFrame:
    """df with due_s, the seconds after the start of a replay at which a record is sent: its distance from the first one over speed."""
    if speed <= 0:
        raise ValueError("speed must be positive")
    first = df.agg(F.min(seconds).alias("t"))
    return df.withColumn(unit, (F.col(seconds) - first.scalar()) / F.lit(float(speed)))


def restamp(df: DataFrame, seconds: str = "created_utc") -> DataFrame:
    """df as if it were created now, with the distances between records kept."""
    top = df.agg(F.max(seconds).alias("t"))
    return df.withColumn(seconds, F.col(seconds) - top.scalar() + F.unix_timestamp())


def messages(df: DataFrame) -> DataFrame:
    """Topic records: key (the id), value (JSON), timestamp (the creation time)."""
    from rivulet.schemas import RAW

    return df.select(
        F.col("id").alias("key"),
        F.to_json(F.struct(*RAW.names), {"ignoreNullFields": "false"}).alias("value"),
        F.timestamp_seconds("created_utc").alias("timestamp"),
    )
