"""Built-in sketches: Count-Min for frequencies, HyperLogLog for distinct counts, and approximate top values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Count-Min and HyperLogLog sizes (fixed values).
CMS_WIDTH, CMS_DEPTH, HLL_P = 2048, 4, 12


def hll_std_error(p: int = HLL_P) -> float:
    if not 4 <= p <= 18:
        raise ValueError("precision must be from 4 to 18")
    return 1.04 / 2 ** (p / 2)


def count_min(c: Column, eps: float = 2.718281828 / CMS_WIDTH, confidence: float = 0.982, seed: int = 7) -> Column:
    """A serialised Count-Min sketch of a column; it never counts too low, and too high by more than eps of the total only rarely."""
    return F.count_min_sketch(c, F.lit(eps), F.lit(confidence), F.lit(seed))


def hll(c: Column, p: int = HLL_P) -> Column:
    """A mergeable sketch of the distinct values; estimate it with hll_count, merge sketches with hll_merge."""
    return F.hll_sketch_agg(c, F.lit(p))


def hll_merge(sketch: Column) -> Column:
    return F.hll_union_agg(sketch)


def hll_count(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def top_values(c: Column, k: int, capacity: int | None = None) -> Column:
    """About the k most frequent values, as array<struct<item, count>>, keeping max(8 k, 128) candidates."""
    return F.call_function("approx_top_k", c, F.lit(k), F.lit(capacity or max(8 * k, 128)))
