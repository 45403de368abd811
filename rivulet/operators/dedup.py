"""Exactly one copy of every message that was delivered more than once.

Only the identifier, the delivery order and the file-row position of a row are shuffled. The winners of the repeated
identifiers are selected from them with a map-side combined minimum, the positions of the losers become one deletion
bitmap for each 32,768 rows of a file, and the wide rows are then read once and filtered in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import children, cut, scratch

NO_IDS = ("", "None")
#: A side is broadcast only if its rows stay below the bound.
BROADCAST_BYTES = 64 << 20
_ROW_BYTES = 96  # of a row beside its identifier, in a hash table
_VECTOR_BYTES = 4096 + 64
#: An identifier on so many rows is hot: there are at most 1,000 of them in 10^9 rows.
HOT_ROWS = 1_000_000
#: Rows of a file that one vector covers (the size of the built-in bitmaps).
ROWS = 32_768


@dataclass(frozen=True)
class DedupPlan:
    """repeated: (id, n, winner), one row for each identifier on more than one row; vectors: (file_key, bucket, bits)."""

    repeated: DataFrame
    path: str
    spark: SparkSession
    id_col: str
    order: tuple[str, ...]
    no_ids: tuple[str, ...]

    def duplicated_ids(self) -> DataFrame:
        return self.repeated.select(F.col("_id").alias(self.id_col), F.col("_n").alias("copies"))

    def vectors(self) -> DataFrame:
        """The deletion vectors: bit i of (file_key, bucket) is set if that row of the file is a losing copy."""
        narrow = _positions(self.spark.read.parquet(self.path), self.id_col, self.order, self.no_ids).select(
            "_id", "_file", "_row"
        )
        winners = self.repeated.select("_id", "_n", F.col("_w._file").alias("_wf"), F.col("_w._row").alias("_wr"))
        size = winners.agg(F.sum(F.octet_length(F.col("_id").cast("string")) + _ROW_BYTES)).first()[0] or 0
        if size <= BROADCAST_BYTES:
            pairs = narrow.join(F.broadcast(winners), "_id")
        else:
            # identifiers on HOT_ROWS rows or more are as few as that says, and their rows never meet in one task
            marked = narrow.join(F.broadcast(winners.where(F.col("_n") >= HOT_ROWS)), "_id", "left")
            cold = marked.where(F.col("_wf").isNull()).select("_id", "_file", "_row").join(winners.where(F.col("_n") < HOT_ROWS), "_id")
            pairs = marked.where(F.col("_wf").isNotNull()).unionByName(cold)
        losers = pairs.where(~((F.col("_file") == F.col("_wf")) & (F.col("_row") == F.col("_wr"))))
        at = F.col("_row") + 1
        return losers.groupBy("_file", F.bitmap_bucket_number(at).alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")
        )

    def apply(self, columns: list[str] | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
        """The whole table without the losing copies. The wide columns are read once and never shuffled.

        The vectors are broadcast while they stay within the bound. Beyond it they are written to the shared folder, one
        part for each file, and every task loads those of the file that it reads; nothing of them passes the driver.
        """
        whole = self.spark.read.parquet(self.path)
        keep = columns or whole.columns
        vectors = cut(self.vectors())
        total = vectors.count()
        if total == 0:
            return whole.select(*keep)
        return _without(whole, vectors, keep) if total * _VECTOR_BYTES <= bound else _without_written(whole, vectors, keep)


def _file_key(path: Column) -> Column:
    return F.xxhash64(path)


def _file_key_of(path: str) -> int:
    """The same key on the driver: 64-bit xxHash of the path with Spark's seed, as a signed number."""
    h = xxhash.xxh64_intdigest(path.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _is_id(c: Column, no_ids: tuple[str, ...]) -> Column:
    return c.isNotNull() & ~c.isin(*no_ids) if no_ids else c.isNotNull()


def _positions(df: DataFrame, id_col: str, order: tuple[str, ...], no_ids: tuple[str, ...]) -> DataFrame:
    return df.where(_is_id(F.col(f"`{id_col}`"), no_ids)).select(
        F.col(f"`{id_col}`").alias("_id"),
        *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)],
        _file_key(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )


def _without(df: DataFrame, vectors: DataFrame, keep: list[str]) -> DataFrame:
    at = F.col("_metadata.row_index") + 1
    wide = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_wide"),
        _file_key(F.col("_metadata.file_path")).alias("_file"),
        F.bitmap_bucket_number(at).alias("_bucket"),
        F.bitmap_bit_position(at).alias("_bit"),
    )
    joined = wide.join(F.broadcast(vectors), ["_file", "_bucket"], "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    gone = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return joined.where(F.col("_bits").isNull() | ~gone).select("_wide.*")


def _without_written(df: DataFrame, vectors: DataFrame, keep: list[str]) -> DataFrame:
    """As _without, with the vectors of each file in a folder of its own under the shared folder."""
    spark = df.sparkSession
    folder = scratch(spark, "vectors")
    vectors.repartition("_file").write.partitionBy("_file").parquet(folder)
    sent = spark.sparkContext.broadcast(sorted(int(n.partition("=")[2]) for n in children(spark, folder) if n.startswith("_file=")))  # a number for each file

    @F.pandas_udf("boolean")
    def stays(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, loaded = set(sent.value), {}
        for files, rows in batches:
            out = np.ones(len(rows), bool)
            for f in files.unique():
                if f not in known:
                    continue
                if f not in loaded:
                    loaded.clear()  # a task reads one file after the other
                    loaded[f] = _load(f"{folder}/_file={f}")
                at = np.flatnonzero((files == f).to_numpy())
                out[at] = ~_deleted(loaded[f], rows.to_numpy()[at])
            yield pd.Series(out)

    wide = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_wide"),
        _file_key(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    return wide.where(stays("_file", "_row")).select("_wide.*")


def _load(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the vectors in a folder, sorted, and their bits, one row of 4,096 bytes each."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    source, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    t = ds.dataset(path, filesystem=source, format="parquet").to_table(columns=["_bucket", "_bits"])
    bucket = t.column("_bucket").to_numpy()
    bits = np.frombuffer(b"".join(t.column("_bits").to_pylist()), np.uint8).reshape(len(bucket), -1)
    order = np.argsort(bucket)
    return bucket[order], bits[order]


def _deleted(vectors: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    bucket, bits = vectors
    number, bit = rows // ROWS + 1, rows % ROWS
    at = np.minimum(np.searchsorted(bucket, number), len(bucket) - 1)
    return (bucket[at] == number) & ((bits[at, bit // 8] >> (bit % 8)) & 1 == 1)


def dedup_plan(
    spark: SparkSession,
    path: str,
    id_col: str = "id",
    order: tuple[str, ...] = ("ingest_ts", "kafka_partition", "kafka_offset"),
    no_ids: tuple[str, ...] = NO_IDS,
) -> DedupPlan:
    """Select the winner of each identifier that stands on more than one row of the parquet table at path.

    The winner is the row that comes first by the order columns (nulls first), then by file and row. Identifiers are
    compared exactly. Rows whose id is null or one of no_ids are no copies of each other and all stay. An empty table
    gives an empty plan; repeated equal rows are copies like any other; a hot identifier is combined before the shuffle.
    """
    files = spark.read.parquet(path).inputFiles()
    if len({_file_key_of(f) for f in files}) != len(set(files)):
        raise ValueError("two files share a key; rename one of them")
    narrow = _positions(spark.read.parquet(path), id_col, order, no_ids)
    inner = [f"_o{i}" for i in range(len(order))]
    repeated = (
        narrow.groupBy("_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*inner, "_file", "_row")).alias("_w"))
        .where("_n > 1")
    )
    return DedupPlan(cut(repeated), path, spark, id_col, order, no_ids)
