"""Aggregates by event time over late and unordered rows, by stream slicing.

Rows are aggregated into panes that do not overlap: a pane lies between two neighbouring window boundaries, so every
window (tumbling or sliding) is a run of whole panes. A late row changes one pane, and only the windows that cover it are
recomposed. A row that arrives later than the end of its pane plus the cut-off changes nothing and is counted apart;
window_panes and recompose_windows take the cut-off from the end of each window instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ON_TIME, LATE, PAST = "on_time", "late", "past_cutoff"


def pane_size(size: int, slide: int) -> int:
    if size <= 0 or slide <= 0:
        raise ValueError("window size and slide must be positive")
    return gcd(size, slide)


def judge(
    df: DataFrame, event_s: Column, arrival: Column, pane_s: int, cutoff_s: int, ends: bool = False
) -> DataFrame:
    """df with pane_start, pane_end (unix seconds) and status: on_time, late, past_cutoff, or null without an event time.

    event_s is the event time in unix seconds, or with ends=True the end of the row's pane itself. arrival is a
    timestamp. A row is on time if it arrived by the end of its pane, late until the cut-off, and past it after that;
    arriving exactly at the cut-off still counts. Rows without arrival count as on time.
    """
    event_s = event_s.cast("bigint")
    end = event_s if ends else event_s - F.pmod(event_s, F.lit(pane_s).cast("bigint")) + pane_s
    late = F.unix_micros(arrival) - end * 1_000_000
    return df.withColumns(
        {
            "pane_start": (end - pane_s).cast("bigint"),
            "pane_end": end.cast("bigint"),
            "status": F.when(end.isNull(), F.lit(None))
            .when(late > cutoff_s * 1_000_000, PAST)
            .when(late > 0, LATE)
            .otherwise(ON_TIME),
        }
    )


def first_deliveries(df: DataFrame, keys: Sequence[Column], has_key: Column, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Of the rows of one message only the first to arrive, by the order columns; rows without a key all stay.

    Only keep and order travel, and a hot key is combined before the shuffle. Null parts of a key are equal.
    """
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *keep)
    one = (
        df.where(has_key)
        .groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(F.min(row).alias("_r"))
        .select(*[F.col(f"_r.{c}") for c in keep])
    )
    return one.unionByName(df.where(~F.coalesce(has_key, F.lit(False))).select(*keep))


def panes(judged: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One row for each key and pane: n, n_late and the sum of each of values over rows within the cut-off, n_past beyond it."""
    within = F.col("status").isin(ON_TIME, LATE)
    return (
        judged.where(F.col("status").isNotNull())
        .groupBy(*keys, "pane_start", "pane_end")
        .agg(
            F.count(F.when(within, 1)).alias("n"),
            F.count(F.when(F.col("status") == LATE, 1)).alias("n_late"),
            F.count(F.when(F.col("status") == PAST, 1)).alias("n_past"),
            *[F.coalesce(F.sum(F.when(within, c)), F.lit(0)).alias(name) for name, c in values.items()],
        )
    )


def past_panes(judged: DataFrame, keys: Sequence[str], part: Sequence[Column], row: Sequence[str]) -> DataFrame:
    """Panes in parts, each with what it counted and what it turned away: (keys, pane_start, pane_end, part, n, n_late, n_past, past).

    past lists the columns of row of the rows past the cut-off. part numbers the parts of a pane; it has to bound the rows
    that one of them can hold. Parts are combined before the shuffle, in which rows within the cut-off are only numbers.
    """
    within, past = F.col("status").isin(ON_TIME, LATE), F.col("status") == PAST
    return (
        judged.where(F.col("status").isNotNull())
        .groupBy(*keys, "pane_start", "pane_end", F.struct(*part).alias("part"))
        .agg(
            F.count(F.when(within, 1)).alias("n"),
            F.count(F.when(F.col("status") == LATE, 1)).alias("n_late"),
            F.count(F.when(past, 1)).alias("n_past"),
            F.collect_list(F.when(past, F.struct(*row))).alias("past"),
        )
    )


def covering_windows(pane_start: Column, pane_end: Column, size: int, slide: int) -> Column:
    """The starts of all windows that cover the pane."""
    last = F.floor(pane_start / slide) * slide
    first = F.ceil((pane_end - size) / slide) * slide
    return F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(slide).cast("bigint"))


def recompose(panes_df: DataFrame, keys: Sequence[str], sums: Sequence[str], size: int, slide: int) -> DataFrame:
    """Windows from panes: one row for each key and window with the sums over the panes that it covers."""
    return (
        panes_df.withColumn(
            "window_start", F.explode(covering_windows(F.col("pane_start"), F.col("pane_end"), size, slide))
        )
        .groupBy(*keys, "window_start")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .withColumn("window_end", F.col("window_start") + size)
    )


def window_panes(
    df: DataFrame, keys: Sequence[str], event_s: Column, arrival: Column, values: dict[str, Column], size: int, slide: int, cutoff_s: int
) -> DataFrame:
    """Panes for recompose_windows, which judges rows against each window instead of their pane.

    One row for each key, pane and arrival class: n_rows and the sum of each of values. The class of a row is the first
    window end by which it arrived (due_from) and the first one whose cut-off it met (kept_from); both lie among the ends
    of the windows that cover the pane or right behind them, so a pane has few classes. Edges as in judge.
    """
    step = pane_size(size, slide)
    event_s = event_s.cast("bigint")
    start = (event_s - F.pmod(event_s, F.lit(step).cast("bigint"))).cast("bigint")
    starts = covering_windows(F.col("pane_start"), F.col("pane_end"), size, slide)

    def first_end(late_s: int) -> Column:
        at, every = F.unix_micros(arrival) - F.lit((size + late_s) * 1_000_000).cast("bigint"), F.lit(slide * 1_000_000).cast("bigint")
        end = ((at + F.pmod(-at, every)) / 1_000_000).cast("bigint") + size
        return F.greatest(F.array_min("_starts") + size, F.least(end, F.array_max("_starts") + size + slide)).cast("bigint")

    return (
        df.where(event_s.isNotNull())
        .withColumns({"pane_start": start, "pane_end": start + step})
        .withColumn("_starts", starts)
        .withColumns(
            {
                "due_from": F.when(arrival.isNull(), F.array_min("_starts") + size).otherwise(first_end(0)),
                "kept_from": F.when(arrival.isNull(), F.array_min("_starts") + size).otherwise(first_end(cutoff_s)),
            }
        )
        .groupBy(*keys, "pane_start", "pane_end", "due_from", "kept_from")
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in values.items()])
    )


def recompose_windows(panes_df: DataFrame, keys: Sequence[str], values: Sequence[str], size: int, slide: int) -> DataFrame:
    """Windows from window_panes: n, n_late and values over rows within the cut-off of the window, n_past beyond it."""
    kept, late = F.col("window_end") >= F.col("kept_from"), F.col("window_end") < F.col("due_from")
    total = lambda c, of: F.coalesce(F.sum(F.when(c, F.col(of))), F.lit(0))
    return (
        panes_df.withColumn(
            "window_start", F.explode(covering_windows(F.col("pane_start"), F.col("pane_end"), size, slide))
        )
        .withColumn("window_end", F.col("window_start") + size)
        .groupBy(*keys, "window_start", "window_end")
        .agg(
            total(kept, "n_rows").alias("n"),
            total(kept & late, "n_rows").alias("n_late"),
            total(~kept, "n_rows").alias("n_past"),
            *[total(kept, v).alias(v) for v in values],
        )
    )


def revisions(
    judged: DataFrame, keys: Sequence[str], arrival: Column, size: int, slide: int, every_s: int
) -> DataFrame:
    """The emissions of every window: one when it closes and one for each later period of every_s in which a pane it covers changed.

    Columns: keys, window_start, window_end, revision (0 is the first emission), emitted_s, n (rows so far). A window
    whose rows were all late is first emitted with the first of them.
    """
    within = judged.where(F.col("status").isin(ON_TIME, LATE))
    at = F.ceil(F.unix_micros(arrival) / 1_000_000 / every_s) * every_s
    deltas = within.groupBy(*keys, "pane_start", "pane_end", at.cast("bigint").alias("at")).agg(
        F.count(F.lit(1)).alias("delta")
    )
    by_window = (
        deltas.withColumn("window_start", F.explode(covering_windows(F.col("pane_start"), F.col("pane_end"), size, slide)))
        .withColumn("window_end", F.col("window_start") + size)
        .groupBy(*keys, "window_start", "window_end", F.greatest("window_end", F.coalesce("at", "window_end")).alias("emitted_s"))
        .agg(F.sum("delta").alias("delta"))
    )
    w = W.partitionBy(*keys, "window_start").orderBy("emitted_s")
    return by_window.select(
        *keys,
        "window_start",
        "window_end",
        (F.row_number().over(w) - 1).cast("bigint").alias("revision"),
        "emitted_s",
        F.sum("delta").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("n"),
    )
