"""Tumbling event-time windows: positive ratio, reach, breakdowns. The same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import sketches

NO_AUTHORS = ("", "[deleted]")


def bucket(seconds: Column, size: int) -> Column:
    if size <= 0:
        raise ValueError("a window must be longer than 0 seconds")
    seconds = seconds.cast("bigint")
    return seconds - F.pmod(seconds, F.lit(size).cast("bigint"))


def event_time(df: DataFrame, seconds: str = "created_utc", fallback: Column | None = None) -> DataFrame:
    """df with et, the event time as a timestamp; the arrival stands in where there is none."""
    et = F.timestamp_seconds(F.col(seconds))
    return df.withColumn("et", F.coalesce(et, fallback) if fallback is not None else et)


def keyword_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each matched keyword of a scored comment: keyword (or keyword:sense), base_keyword, sentiment_label."""
    scored = df.where(F.coalesce(F.col("sentiment_label"), F.lit("")) != "")
    rows = scored.select(*keep, "sentiment_label", "keyword_senses", F.explode("matched_keywords").alias("base_keyword"))
    sense = F.try_element_at("keyword_senses", F.col("base_keyword"))
    keyword = F.when(F.coalesce(sense, F.lit("")) != "", F.concat_ws(":", "base_keyword", sense)).otherwise(F.col("base_keyword"))
    return rows.select(*keep, keyword.alias("keyword"), "base_keyword", "sentiment_label")


def author_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each matched keyword of a comment with a known author."""
    known = df.where(F.col("author").isNotNull() & ~F.col("author").isin(*NO_AUTHORS))
    return known.select(*keep, F.explode("matched_keywords").alias("keyword"), "author")


def ratio(label: Column, places: int = 4) -> Column:
    """The share of positive labels among those that are not empty, half-even rounded; 0 if there are none."""
    known = label.isNotNull() & (label != "")
    share = F.avg(F.when(known, (label == "positive").cast("double")))
    return F.coalesce(F.bround(share, places), F.lit(0.0))


def sentiment(df: DataFrame, size: int, *more: str) -> DataFrame:
    """Positive ratio and scored comments of each keyword (or keyword:sense) and window."""
    rows = keyword_rows(df, "created_utc", *more)
    return (
        rows.groupBy("keyword", bucket(F.col("created_utc"), size).alias("window_start"))
        .agg(ratio(F.col("sentiment_label")).alias("positive_ratio"), F.count(F.lit(1)).alias("comment_count"))
        .select("keyword", "window_start", (F.col("window_start") + size).alias("window_end"), "positive_ratio", "comment_count")
    )


def reach(df: DataFrame, size: int, p: int = sketches.HLL_P) -> DataFrame:
    """Distinct authors (by sketch) and comments of each keyword and window, scored or not, repeated bodies included."""
    rows = author_rows(df, "created_utc")
    return (
        rows.groupBy("keyword", bucket(F.col("created_utc"), size).alias("window_start"))
        .agg(sketches.hll_count(sketches.hll("author", p)).alias("unique_authors"), F.count(F.lit(1)).alias("comment_count"))
        .select(
            F.lit("reach").alias("type"), "keyword", "window_start", (F.col("window_start") + size).alias("window_end"),
            "unique_authors", "comment_count",
            F.struct(F.lit("hyperloglog").alias("kind"), F.lit(p).cast("bigint").alias("precision"), F.lit(round(sketches.hll_std_error(p), 4)).alias("std_error")).alias("sketch"),
        )
    )


def reach_sketches(df: DataFrame, size: int, p: int = sketches.HLL_P) -> DataFrame:
    """Mergeable partial results: one sketch for each keyword and window."""
    rows = author_rows(df, "created_utc")
    return rows.groupBy("keyword", bucket(F.col("created_utc"), size).alias("window_start")).agg(
        sketches.hll("author", p).alias("authors"), F.count(F.lit(1)).alias("comment_count")
    )


def merge_reach(parts: DataFrame, size: int) -> DataFrame:
    """Coarser windows from the sketches of finer ones."""
    return parts.groupBy("keyword", bucket(F.col("window_start"), size).alias("window_start")).agg(
        sketches.hll_count(sketches.hll_merge("authors")).alias("unique_authors"), F.sum("comment_count").alias("comment_count")
    )


def by_language(df: DataFrame) -> DataFrame:
    """Positive ratio and labelled comments of each language; a missing one is unknown."""
    return (
        df.where(F.coalesce(F.col("sentiment_label"), F.lit("")) != "")
        .groupBy(F.coalesce("language", F.lit("unknown")).alias("language"))
        .agg(ratio(F.col("sentiment_label")).alias("positive_ratio"), F.count(F.lit(1)).alias("comment_count"))
    )


def label_counts(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
