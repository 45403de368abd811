"""Per-key results when a few keys hold most rows.

Value-frequency compression: rows are grouped by (key, value) before they are grouped by key. The first grouping spreads
a hot key over all its values and combines on the map side; what reaches the second is one weighted row for each value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.session import cut


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): how often each value occurs under each key. Null keys and null values are kept."""
    return df.groupBy(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")).agg(
        F.count(F.lit(1)).alias("weight")
    )


def key_summary(weighted: DataFrame) -> DataFrame:
    """(key, n_rows, n_values, mode, mode_count) from compressed rows.

    n_rows counts all rows, n_values the distinct non-null values. The mode is the most frequent non-null value, the
    smallest one of several; it is null if the key has no value. An empty table gives no rows.
    """
    known = F.col("value").isNotNull()
    totals = weighted.groupBy("key").agg(
        F.sum("weight").alias("n_rows"),
        F.count("value").alias("n_values"),
        F.min(F.when(known, F.struct((-F.col("weight")).alias("down"), "value"))).alias("best"),
    )
    return totals.select("key", "n_rows", "n_values", F.col("best.value").alias("mode"), (-F.col("best.down")).alias("mode_count"))


def weighted_percentiles(weighted: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(key, n, q0, q1, ...): exact discrete percentiles of the non-null values, one column for each of probs.

    The percentile p of n values is the value of rank ceil(p n) (1 at least). Values are ranged over partitions by
    (key, value), so a key with more values than fit a task is spread over several; each piece adds up its own weights
    and starts from the sum of the pieces before it.
    """
    ranged = cut(
        weighted.where(F.col("value").isNotNull())
        .repartitionByRange("key", "value")  # without a number, so that small partitions are put together
        .withColumn("piece", F.spark_partition_id())
    )
    pieces = ranged.groupBy("piece", "key").agg(F.sum("weight").alias("sum"))
    before = W.partitionBy("key").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col("piece").alias("p"),
        F.col("key").alias("k"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"),
        F.sum("sum").over(W.partitionBy("key")).alias("n"),
    )
    running = W.partitionBy("piece", "key").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.withColumn("inside", F.sum("weight").over(running)).join(
        pieces, (F.col("piece") == F.col("p")) & F.col("key").eqNullSafe(F.col("k"))
    )
    upto = F.col("start") + F.col("inside")
    rank = [F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))) for p in probs]
    hit = [(upto >= r) & (upto - F.col("weight") < r) for r in rank]
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    return (
        placed.where(any_hit)
        .groupBy("key")
        .agg(F.max("n").alias("n"), *[F.max(F.when(h, F.col("value"))).alias(f"q{i}") for i, h in enumerate(hit)])
    )


def heavy_keys(weighted: DataFrame, share: float, no_keys: Sequence[str] = ("",)) -> DataFrame:
    """(key, n_rows, share) of the keys with at least that share of all rows; null and no_keys count as rows, not as keys."""
    by_key = cut(weighted.groupBy("key").agg(F.sum("weight").alias("n_rows")))  # one row a key, read twice
    total = by_key.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"))
    return (
        by_key.where(F.col("key").isNotNull() & ~F.col("key").isin(*no_keys))
        .where(F.col("n_rows") >= F.lit(share) * total.scalar())
        .select("key", "n_rows", (F.col("n_rows") / total.scalar()).alias("share"))
    )
