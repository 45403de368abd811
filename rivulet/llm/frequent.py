"""The most frequent values of a column in bounded memory.

A majority-vote sketch: each of depth x width cells keeps the total weight of the values hashed to it, one candidate and
the surplus of votes for it. Cells merge by vote cancellation. For any value the cells give an upper bound of its count,
for a candidate a lower bound as well. Values are known by a 64-bit hash in the sketch, so a cell has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, DEPTH = 4096, 4
#: Odd multipliers, one for each row of the sketch (fixed values).
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def hashes(values: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.asarray(values, dtype=object), categorize=False)


def cells_of(h: np.ndarray, depth: int, width: int) -> np.ndarray:
    """The cell of each hash in each row: depth x len(h)."""
    with np.errstate(over="ignore"):
        mixed = (h[None, :] ^ (h[None, :] >> np.uint64(29))) * _ODD[:depth, None]
    return ((mixed >> np.uint64(32)) % np.uint64(width)).astype(np.int64)


class Sketch:
    def __init__(self, depth: int = DEPTH, width: int = WIDTH):
        if not 1 <= depth <= len(_ODD) or width < 1:
            raise ValueError("depth or width is out of range")
        self.total = np.zeros((depth, width), np.int64)
        self.votes = np.zeros((depth, width), np.int64)
        self.candidate = np.zeros((depth, width), np.uint64)

    def add(self, h: np.ndarray, weight: np.ndarray) -> None:
        """Add distinct values with their weights: a batch becomes a sketch of its own, which is merged."""
        depth, width = self.total.shape
        at = cells_of(h, depth, width)
        order = np.argsort(weight, kind="stable")
        for d in range(depth):
            c = at[d]
            total = np.bincount(c, weight, width).astype(np.int64)
            top, who = np.zeros(width, np.int64), np.zeros(width, np.uint64)
            top[c[order]] = weight[order]  # the last assignment, the heaviest value, stays
            who[c[order]] = h[order]
            self._merge_row(d, total, who, np.maximum(2 * top - total, 0))

    def merge(self, other: Sketch) -> None:
        if other.total.shape != self.total.shape:
            raise ValueError("sketches of different shape cannot be merged")
        for d in range(len(self.total)):
            self._merge_row(d, other.total[d], other.candidate[d], other.votes[d])

    def _merge_row(self, d: int, total: np.ndarray, who: np.ndarray, votes: np.ndarray) -> None:
        same, mine = self.candidate[d] == who, self.votes[d]
        takes = ~same & (votes > mine)
        self.candidate[d] = np.where(takes, who, self.candidate[d])
        self.votes[d] = np.where(same, mine + votes, np.abs(mine - votes))
        self.total[d] += total

    def bounds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the weight of each value."""
        depth, width = self.total.shape
        rows = np.arange(depth)[:, None]
        at = cells_of(h, depth, width)
        total, votes = self.total[rows, at], self.votes[rows, at]
        own = self.candidate[rows, at] == h[None, :]
        upper = np.where(own, (total + votes) // 2, (total - votes) // 2).min(axis=0)
        return np.where(own, votes, 0).max(axis=0), upper


@dataclass(frozen=True)
class Frequent:
    """items: (item, count, lower, upper), exact count with the bounds that the sketch gave; total: the weight of all items."""

    items: DataFrame
    total: int


def _batch(values: pa.Array, weights: pa.Array | None) -> tuple[list[str], np.ndarray]:
    """Distinct lower-cased, non-blank values of a list column with their weights."""
    values = pc.utf8_lower(values)
    keep = pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(values)), 0)
    if weights is None:
        counted = pc.value_counts(pc.filter(values, keep))
        return counted.field("values").to_pylist(), counted.field("counts").to_numpy(zero_copy_only=False).astype(np.int64)
    t = pa.table({"v": pc.filter(values, keep), "w": pc.filter(pc.fill_null(weights, 0), keep)})
    g = t.group_by("v").aggregate([("w", "sum")])
    return g.column("v").to_pylist(), g.column("w_sum").to_numpy().astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1_500_000) -> Iterator[tuple[list[str], np.ndarray]]:
    """Batches are put together up to some values, so that repeated ones are counted before they are hashed."""

    def flush(kept: list[pa.RecordBatch]):
        v = pa.concat_arrays([b.column(0) for b in kept]).flatten()
        w = pa.concat_arrays([b.column(1) for b in kept]).flatten() if kept[0].num_columns > 1 else None
        return _batch(v, w)

    kept, n = [], 0
    for b in batches:
        kept.append(b)
        n += len(b.column(0).flatten()) + 1
        if n >= most:
            yield flush(kept)
            kept, n = [], 0
    if n:
        yield flush(kept)


def sketch(lists: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> Sketch:
    """The sketch of all values. lists has one column of string arrays, and optionally one of equally long integer arrays of weights.

    Every task emits its cells as plain numbers, which are merged by sums: of the cells with one candidate the votes add
    up, and the heaviest candidate keeps what exceeds the votes of all others. Both steps combine on the map side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketch(depth, width)
        for values, weights in _batches(batches):
            if values:
                s.add(hashes(values), weights)
        at = np.flatnonzero(s.total.ravel())
        columns = [at, s.candidate.ravel()[at].view(np.int64), s.total.ravel()[at], s.votes.ravel()[at]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cell", "candidate", "total", "votes"])

    parts = lists.mapInArrow(run, "cell bigint, candidate bigint, total bigint, votes bigint")
    merged = (
        parts.groupBy("cell", "candidate")
        .agg(F.sum("total").alias("total"), F.sum("votes").alias("votes"))
        .groupBy("cell")
        .agg(F.sum("total").alias("total"), F.sum("votes").alias("all"), F.max(F.struct("votes", "candidate")).alias("top"))
        .select("cell", "total", F.greatest(F.lit(0), 2 * F.col("top.votes") - F.col("all")).alias("votes"), F.col("top.candidate").alias("candidate"))
    )
    s = Sketch(depth, width)
    found = merged.toPandas()  # depth x width rows of four numbers at most
    at = found["cell"].to_numpy()
    s.total.ravel()[at], s.votes.ravel()[at] = found["total"], found["votes"]
    s.candidate.ravel()[at] = found["candidate"].to_numpy().view(np.uint64)
    return s


def frequent(lists: DataFrame, share: float, depth: int = DEPTH, width: int = WIDTH) -> Frequent:
    """All lower-cased, non-blank values with at least that share of the total weight, none missed and none too many.

    The first pass builds the sketch. Every value whose upper bound reaches the threshold, and no other, is counted
    exactly in a second pass; their number is bounded by the sketch, not by the distinct values. Null lists, null and
    blank elements count for nothing, null weights as 0. An empty table gives no items.
    """
    s = sketch(lists, depth, width)
    total = int(s.total[0].sum())
    least = max(1, int(np.ceil(share * total - 1e-9)))
    sent = lists.sparkSession.sparkContext.broadcast((s.total, s.votes, s.candidate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Sketch(depth, width)
        mine.total, mine.votes, mine.candidate = sent.value
        for values, weights in _batches(batches):
            if not values:
                continue
            low, high = mine.bounds(hashes(values))
            at = np.flatnonzero(high >= least)
            yield pa.RecordBatch.from_arrays(
                [pa.array([values[i] for i in at], pa.string()), *[pa.array(x[at], pa.int64()) for x in (weights, low, high)]],
                names=["item", "count", "lower", "upper"],
            )

    exact = (
        lists.mapInArrow(run, "item string, count bigint, lower bigint, upper bigint")
        .groupBy("item")
        .agg(F.sum("count").alias("count"), F.max("lower").alias("lower"), F.max("upper").alias("upper"))
        .where(F.col("count") >= least)
    )
    return Frequent(exact, total)
