"""Counting records that come too late for their window, by pipeline and period of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.operators import trending, windows


def watermarks(df: DataFrame, delay_s: int, period_s: int, seconds: str = "created_utc", arrival: str = "ingest_ts") -> DataFrame:
    """(period, watermark): the largest event time of all earlier periods of arrival less the delay. One row for each period."""
    p = (F.floor(F.unix_micros(arrival) / 1_000_000 / period_s) * period_s).cast("bigint")
    top = df.groupBy(p.alias("period")).agg(F.max(seconds).alias("top"))
    before = W.orderBy("period").rowsBetween(W.unboundedPreceding, -1)  # one row for each period, no more
    return top.select("period", (F.max("top").over(before) - delay_s).alias("watermark"))


def mark_late(df: DataFrame, size: int, delay_s: int = 5, period_s: int = 10) -> DataFrame:
    """df with period and late: whether the watermark of the earlier periods had closed the window of the row."""
    marks = watermarks(df, delay_s, period_s)
    p = (F.floor(F.unix_micros("ingest_ts") / 1_000_000 / period_s) * period_s).cast("bigint")
    end = windows.bucket(F.col("created_utc"), size) + size
    return df.withColumn("period", p).join(marks, "period", "left").withColumn("late", F.coalesce(end <= F.col("watermark"), F.lit(False)))


def late_drops(df: DataFrame, size: int, delay_s: int = 5, period_s: int = 10, stopwords: Sequence[str] = trending.STOPWORDS) -> DataFrame:
    """(type, pipeline, count, emitted_at) for each pipeline and period with late elements.

    The unit is the element that a pipeline would have counted: one for each keyword of a scored comment, one for each
    keyword of a comment with an author, one for each keyword and term.
    """
    late = mark_late(df, size, delay_s, period_s).where("late")
    rows = (
        windows.keyword_rows(late, "period").select("period", F.lit("sentiment").alias("pipeline"))
        .unionByName(windows.author_rows(late, "period").select("period", F.lit("reach").alias("pipeline")))
        .unionByName(trending.term_rows(late, stopwords, "period").select("period", F.lit("trending").alias("pipeline")))
    )
    return rows.groupBy("pipeline", "period").agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("late_drop").alias("type"), "pipeline", "count", (F.col("period") + period_s).alias("emitted_at")
    )
