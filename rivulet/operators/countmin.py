"""Count-Min sketches as tables of cells: map-side combined, merged by sums, asked by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.sketches import CMS_DEPTH, CMS_WIDTH
from rivulet.functions.text import hash64


def _cells(df: DataFrame, value: str, width: int, depth: int) -> DataFrame:
    if width < 1 or depth < 1:
        raise ValueError("a sketch needs one cell in one row at least")
    cell = lambda d: F.struct(F.lit(d).alias("row"), F.pmod(hash64(F.col(value), d), F.lit(width)).cast("int").alias("cell"))
    return df.where(F.col(value).isNotNull()).withColumn("_c", F.explode(F.array(*map(cell, range(depth))))).withColumns({"row": F.col("_c.row"), "cell": F.col("_c.cell")}).drop("_c")


def build(df: DataFrame, keys: Sequence[str], value: str, width: int = CMS_WIDTH, depth: int = CMS_DEPTH) -> DataFrame:
    """(keys, row, cell, count): the sketch of the values of each group; cells that are zero are left out, null values too."""
    return _cells(df.select(*keys, value), value, width, depth).groupBy(*keys, "row", "cell").agg(F.count(F.lit(1)).alias("count"))


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch for each group from several of the same size, or for coarser groups."""
    return parts.groupBy(*keys, "row", "cell").agg(F.sum("count").alias("count"))


def estimate(sketch: DataFrame, asked: DataFrame, keys: Sequence[str], value: str, width: int = CMS_WIDTH, depth: int = CMS_DEPTH) -> DataFrame:
    """(keys, value, estimate) of the asked values: the least of their cells. Never too low; too high by e / width of the total rarely."""
    at = _cells(asked.select(*keys, value).distinct(), value, width, depth)
    hit = at.join(sketch, [*keys, "row", "cell"], "left")
    return hit.groupBy(*keys, value).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))
