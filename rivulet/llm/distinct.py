"""Distinct counts over huge identifier sets, for groups and combinations of groups.

A register keeps the largest rank of its identifiers and two indicator bits, whether the two ranks below occurred too.
Registers merge without loss, and the count is their maximum-likelihood estimate. With 2**p registers of one byte its
standard error is 0.761 / sqrt(2**p); one-byte registers without the bits need a third more memory for the same error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

P = 12
#: Standard error times the square root of the number of registers (a fixed value of the estimator).
SPREAD = 0.761


def std_error(p: int = P) -> float:
    return SPREAD / 2 ** (p / 2)


def rank_bit(value: Column, p: int) -> tuple[Column, Column]:
    """The register of a value and a number with bit (rank - 1) set. Ranks run from 1 to 64 - p + 1 and halve in frequency."""
    h = F.xxhash64(value)
    rest = F.shiftrightunsigned(h, p)
    lowest = rest.bitwiseAND(-rest)
    return h.bitwiseAND(F.lit((1 << p) - 1)).cast("int"), F.when(rest == 0, F.lit(1 << (64 - p))).otherwise(lowest)


def pack(bits: Column) -> Column:
    """A register from the set of all ranks: four times the largest rank, plus 2 and 1 for the two ranks below."""
    top = F.length(F.bin(bits)) - 1
    one_below = F.when(top >= 1, F.call_function("getbit", bits, F.greatest(top - 1, F.lit(0))).cast("int")).otherwise(0)
    two_below = F.when(top >= 2, F.call_function("getbit", bits, F.greatest(top - 2, F.lit(0))).cast("int")).otherwise(0)
    return ((top + 1) * 4 + one_below * 2 + two_below).cast("smallint")


def unpack(register: Column) -> Column:
    """The set of ranks that a register stands for; sets of several registers are merged by bit_or and packed again."""
    r = register.cast("int")
    shifted = lambda by: F.call_function("shiftleft", F.lit(1).cast("bigint"), by)
    top = F.floor(r / 4).cast("int") - 1
    return (
        shifted(top)
        .bitwiseOR(F.when(r.bitwiseAND(F.lit(2)) > 0, shifted(F.greatest(top - 1, F.lit(0)))).otherwise(F.lit(0).cast("bigint")))
        .bitwiseOR(F.when(r.bitwiseAND(F.lit(1)) > 0, shifted(F.greatest(top - 2, F.lit(0)))).otherwise(F.lit(0).cast("bigint")))
    )


def registers(df: DataFrame, keys: Sequence[str], value: str, p: int = P) -> DataFrame:
    """Partial results: (keys, idx, register), one row for each register that is not empty. Null values count for nothing."""
    idx, bit = rank_bit(F.col("_v"), p)
    return (
        df.select(*keys, F.col(f"`{value}`").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, idx.alias("idx"))
        .agg(F.bit_or(bit).alias("bits"))
        .select(*keys, "idx", pack(F.col("bits")).alias("register"))
    )


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Registers of coarser groups, or of several partial results, without loss."""
    return (
        parts.groupBy(*keys, "idx")
        .agg(F.bit_or(unpack(F.col("register"))).alias("bits"))
        .select(*keys, "idx", pack(F.col("bits")).alias("register"))
    )


def combine(parts: DataFrame, keys: Sequence[str], known: dict[str, Column] | None = None) -> DataFrame:
    """Registers of every combination of keys, from the finest ones. level names the keys that a row is grouped by.

    Keys outside a combination are null. known: rows to which a key applies; others are left out of its combinations.
    """
    sets = [c for n in range(len(keys) + 1) for c in combinations(keys, n)]
    known = known or {}
    entries = []
    for s in sets:
        fits = F.lit(True)
        for k in s:
            if k in known:
                fits = fits & known[k]
        row = F.struct(F.lit("+".join(s) or "all").alias("level"), *[(F.col(k) if k in s else F.lit(None).cast(parts.schema[k].dataType)).alias(k) for k in keys])
        entries.append(F.when(fits, row))
    spread = parts.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("g"), "idx", "register")
    return merge(spread.select("g.*", "idx", "register"), ["level", *keys])


#: A packed register: its number times 256, plus its value. A group travels in so many parts at most.
PARTS = 4
#: Rows that a task holds before it combines them.
HELD = 500_000


def _pack(bits: np.ndarray) -> np.ndarray:
    """pack() for arrays."""
    high, low = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    top = np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1] - 1)
    below = lambda k: np.where(top >= k, bits >> np.maximum(top - k, 0).astype(np.uint64) & np.uint64(1), 0).astype(np.int64)
    return (top + 1) * 4 + below(1) * 2 + below(2)


def _unpack(register: np.ndarray) -> np.ndarray:
    top = (register // 4 - 1).astype(np.uint64)
    one = np.uint64(1)
    bits = one << top
    for k, flag in ((1, 2), (2, 1)):
        there = (register & flag > 0) & (top >= k)
        bits |= np.where(there, one << np.where(there, top - np.uint64(k), 0).astype(np.uint64), 0).astype(np.uint64)
    return bits


def _merged(group: np.ndarray, idx: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted groups and registers, each pair once with the union of its bits, and where each pair first stood."""
    order = np.lexsort((idx, group))
    g, i = group[order], idx[order]
    starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])) if len(g) else np.empty(0, np.int64)
    union = np.bitwise_or.reduceat(bits[order], starts) if len(starts) else bits
    return order[starts], i[starts], union


def cube(df: DataFrame, keys: Sequence[str], value: str, known: dict[str, Column] | None = None, p: int = P, sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(level, keys, sketch): the packed registers of every combination of keys (or of the given sets), straight from the rows.

    level names the keys that a row is grouped by, the others are null. known: rows to which a key applies; others are
    left out of its combinations. Null values count for nothing, null keys are groups. Every task combines its rows for
    all combinations at once, so that what is shuffled is one row of four bytes a register for each of its groups, known
    by a 64-bit number; a group of all rows reaches a task in PARTS parts. sketch is a mergeable result: see merge_packed.
    """
    sets = [tuple(c) for c in sets] if sets is not None else [c for n in range(len(keys) + 1) for c in combinations(keys, n)]
    known = known or {}
    idx, bit = rank_bit(F.col("_v"), p)
    rows = df.select(*keys, F.col(f"`{value}`").alias("_v")).where(F.col("_v").isNotNull())
    gids = []
    for n, s in enumerate(sets):
        fits = F.lit(True)
        for k in s:
            fits = fits & known.get(k, F.lit(True))
        gids.append(F.when(fits, F.xxhash64(F.lit(n), *[x for k in s for x in (F.col(k).isNull(), F.col(k))])).alias(f"_g{n}"))
    schema = T.StructType([T.StructField("_gid", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_set", T.IntegerType()), *[df.schema[k] for k in keys], T.StructField("_r", T.ArrayType(T.IntegerType(), False))])
    arrow = to_arrow_schema(schema)
    per_part = -(-(1 << p) // PARTS)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD:
                yield from flush(held)
                held = []
        yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        of, number, member = [], [], []
        for n in range(len(sets)):
            c = t.column(f"_g{n}")
            there = np.flatnonzero(c.is_valid().to_numpy())
            of.append(c.fill_null(0).to_numpy()[there])
            number.append(np.full(len(there), n, np.int32))
            member.append(there)
        group, which, row = map(np.concatenate, (of, number, member))
        i, bits = t.column("_i").to_numpy()[row].astype(np.int64), t.column("_b").to_numpy()[row].view(np.uint64)
        first, i, bits = _merged(group, i, bits)
        g, part = group[first], (i // per_part).astype(np.int32)
        heads = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])])) if len(g) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(g)).astype(np.int32)), pa.array((i * 256 + _pack(bits)).astype(np.int32)))
        at = pa.array(row[first[heads]])
        names = [t.column(k).take(at).combine_chunks().cast(arrow.field(k).type) for k in keys]
        columns = [pa.array(g[heads]), pa.array(part[heads]), pa.array(which[first[heads]]), *[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in names], lists.cast(arrow.field("_r").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    parts = rows.select(*keys, *gids, idx.alias("_i"), bit.alias("_b")).mapInArrow(combine, schema)
    names = [F.first(c).alias(c) for c in ("_set", *keys)]
    whole = (
        parts.groupBy("_gid", "_part")
        .agg(*names, F.flatten(F.collect_list("_r")).alias("_r"))
        .withColumn("_r", merge_packed(F.col("_r")))
        .groupBy("_gid")
        .agg(*names, F.flatten(F.collect_list("_r")).alias("sketch"))
    )
    level = F.element_at(F.array(*[F.lit("+".join(s) or "all") for s in sets]), F.col("_set") + 1)
    return whole.select(level.alias("level"), *[F.when(F.col("_set").isin(*[n for n, s in enumerate(sets) if k in s]), F.col(k)).alias(k) for k in keys], "sketch")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def merge_packed(sketches: pd.Series) -> pd.Series:
    """Concatenated packed registers, each register once. The concatenation of two sketches of one size is merged without loss."""
    flat = np.concatenate([*sketches, np.empty(0, np.int32)]).astype(np.int64)
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    group = np.repeat(np.arange(len(sketches)), sizes)
    first, idx, bits = _merged(group, flat // 256, _unpack(flat % 256))
    packed = (idx * 256 + _pack(bits)).astype(np.int32)
    return pd.Series(np.split(packed, np.searchsorted(group[first], np.arange(1, len(sketches)))) if len(sketches) else [], dtype=object)


def estimate_packed(sketches: DataFrame, keys: Sequence[str], p: int = P, sigmas: float = 3.0) -> DataFrame:
    """estimate() for rows (keys, sketch) with the packed registers of a group each."""

    @F.pandas_udf("double")
    def likely(values: pd.Series) -> pd.Series:
        flat = np.concatenate([*values, np.empty(0, np.int32)]).astype(np.int64) % 256
        group = np.repeat(np.arange(len(values)), np.fromiter(map(len, values), np.int64, len(values)))
        alpha, beta = likelihood_terms(flat, np.ones(len(flat)), group, len(values), p)
        return pd.Series(solve(alpha, beta, p))

    return _bounded(sketches.select(*keys, likely("sketch").alias("raw")), keys, p, sigmas)


def solve(alpha: np.ndarray, beta: np.ndarray, p: int) -> np.ndarray:
    """The most likely counts. alpha: summed probability of ranks known not to have occurred; beta[:, k - 1]: registers in which rank k did.

    The log-likelihood of x identifiers a register is sum beta_k log(1 - exp(-x w_k)) - alpha x, with w_k the frequency
    of rank k; its slope falls in x and is brought to zero by bisection in log x.
    """
    ranks = np.arange(1, beta.shape[1] + 1)
    w = 2.0 ** -np.minimum(ranks, 64 - p)
    lo, hi = np.full(len(alpha), -30.0), np.full(len(alpha), 45.0)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for _ in range(56):
            mid = (lo + hi) / 2
            slope = (beta * w / np.expm1(np.exp(mid)[:, None] * w)).sum(axis=1) - alpha
            up = slope > 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    m = 2.0**p
    return np.where(beta.sum(axis=1) == 0, 0.0, np.exp((lo + hi) / 2) * m / (1 + 0.48 / m))


def likelihood_terms(register: np.ndarray, count: np.ndarray, group: np.ndarray, groups: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """alpha and beta of solve() for each group, from how often each register value occurs in it."""
    kmax = 64 - p + 1
    w = 2.0 ** -np.minimum(np.arange(1, kmax + 1), 64 - p)
    above = np.concatenate([np.cumsum(w[::-1])[::-1][1:], [0.0]])  # probability of all ranks above each
    beta = np.zeros((groups, kmax))
    used = np.bincount(group, count, groups)
    alpha = 2.0**p - used  # an empty register rules out every rank
    top = register // 4
    np.add.at(beta, (group, top - 1), count)
    alpha += np.bincount(group, count * above[top - 1], groups)
    for below, flag in ((1, 2), (2, 1)):
        k = top - below
        there = k >= 1
        seen = there & (register & flag > 0)
        np.add.at(beta, (group[seen], k[seen] - 1), count[seen])
        absent = there & ~seen
        alpha += np.bincount(group[absent], count[absent] * w[k[absent] - 1], groups)
    return alpha, beta


def estimate(parts: DataFrame, keys: Sequence[str], p: int = P, sigmas: float = 3.0) -> DataFrame:
    """(keys, estimate, low, high): the most likely count of each group, and the bounds at so many standard errors.

    What reaches a group's row is how often each of at most 256 register values occurs, whatever the number of registers.
    """

    @F.pandas_udf("double")
    def likely(values: pd.Series) -> pd.Series:
        sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
        flat = [r for v in values for r in v]
        reg = np.fromiter((r["register"] for r in flat), np.int64, len(flat))
        cnt = np.fromiter((r["n"] for r in flat), np.float64, len(flat))
        alpha, beta = likelihood_terms(reg, cnt, np.repeat(np.arange(len(values)), sizes), len(values), p)
        return pd.Series(solve(alpha, beta, p))

    counted = (
        parts.groupBy(*keys, "register")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("register", "n")).alias("v"))
    )
    return _bounded(counted.select(*keys, likely("v").alias("raw")), keys, p, sigmas)


def _bounded(raw: DataFrame, keys: Sequence[str], p: int, sigmas: float) -> DataFrame:
    e = sigmas * std_error(p)
    return raw.select(
        *keys,
        F.round("raw").cast("bigint").alias("estimate"),
        F.floor(F.col("raw") / (1 + e)).cast("bigint").alias("low"),
        F.ceil(F.col("raw") / (1 - e)).cast("bigint").alias("high"),
    )
