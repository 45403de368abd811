"""Queries of the general problems: repeated deliveries, hot keys, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import dedup, panes, skew
from rivulet.session import table, table_path

CUTOFF_S = 7200
HOUR = 3600
_RAW_ORDER = ("ingest_ts", "kafka_offset", "kafka_partition")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers on more than one row, from the winners that the deduplication selects."""
    out = [
        dedup.dedup_plan(spark, table_path(d, t)).duplicated_ids().select(F.lit(t).alias("topic"), "id")
        for t in ("reddit_comments", "reddit_comments_cleaned")
    ]
    return out[0].unionByName(out[1])


def p2_comments(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_plan(spark, table_path(d, "reddit_comments")).apply()


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the deduplicated table; lists and maps are given as text, so that SQL can state them."""
    out = dedup.dedup_plan(spark, table_path(d, "reddit_comments_cleaned")).apply()
    senses = F.transform(F.array_sort(F.map_entries("keyword_senses")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    as_text = {c: F.array_join(F.col(c), "|", "<null>") for c in ("tokens", "matched_keywords")}
    return out.withColumns({**as_text, "keyword_senses": F.array_join(senses, "|")})


def p2_cleaned_whole(spark: SparkSession, d: str) -> DataFrame:
    """p2_cleaned with lists and maps as they are."""
    return dedup.dedup_plan(spark, table_path(d, "reddit_comments_cleaned")).apply()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least 5 % of all rows, from rows compressed by (key, value)."""
    out = []
    for t, key, value in (("reddit_comments", "subreddit", "score"), ("sentiment_results", "keyword", "comment_count")):
        heavy = skew.heavy_keys(skew.compress(table(spark, d, t), key, value), 0.05)
        out.append(heavy.select(F.lit(key).alias("field"), "key"))
    return out[0].unionByName(out[1])


def p3_subreddits(spark: SparkSession, d: str) -> DataFrame:
    """Per subreddit: rows, distinct authors, most frequent author, exact score percentiles."""
    df = table(spark, d, "reddit_comments")
    who = skew.key_summary(skew.compress(df, "subreddit", "author"))
    q = skew.weighted_percentiles(skew.compress(df, "subreddit", "score"), (0.5, 0.9, 0.99))
    return who.alias("a").join(q.alias("q"), F.col("a.key").eqNullSafe(F.col("q.key")), "left").select(
        F.col("a.key").alias("subreddit"),
        "n_rows",
        F.col("n_values").alias("n_authors"),
        F.col("mode").alias("top_author"),
        F.col("mode_count").alias("top_author_rows"),
        F.col("q0").alias("score_p50"),
        F.col("q1").alias("score_p90"),
        F.col("q2").alias("score_p99"),
    )


def p3_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Per series: windows, distinct and most frequent comment counts, exact percentiles of the ratio."""
    df = table(spark, d, "sentiment_results")
    counts = skew.key_summary(skew.compress(df, "keyword", "comment_count"))
    q = skew.weighted_percentiles(skew.compress(df, "keyword", "positive_ratio"), (0.25, 0.5, 0.75))
    return counts.alias("a").join(q.alias("q"), F.col("a.key").eqNullSafe(F.col("q.key")), "left").select(
        F.col("a.key").alias("keyword"),
        "n_rows",
        F.col("n_values").alias("n_counts"),
        F.col("mode").alias("usual_count"),
        F.col("mode_count").alias("usual_count_rows"),
        F.col("q0").alias("ratio_p25"),
        F.col("q1").alias("ratio_p50"),
        F.col("q2").alias("ratio_p75"),
    )


def first_comments(spark: SparkSession, d: str, *more: str) -> DataFrame:
    df = table(spark, d, "reddit_comments")
    keep = ["kafka_partition", "kafka_offset", "ingest_ts", "created_utc", *more]
    has_id = F.col("id").isNotNull() & (F.col("id") != "")
    return panes.first_deliveries(df, [F.col("id")], has_id, _RAW_ORDER, keep)


def judged_comments(spark: SparkSession, d: str, *more: str, pane_s: int = HOUR) -> DataFrame:
    event = F.when(F.col("created_utc") > 0, F.col("created_utc"))
    return panes.judge(first_comments(spark, d, *more), event, F.col("ingest_ts"), pane_s, CUTOFF_S)


def judged_windows(spark: SparkSession, d: str, *more: str) -> DataFrame:
    df = table(spark, d, "analytics_results").where(F.col("window_end").isNotNull())
    keep = ["kafka_partition", "kafka_offset", "ingest_ts", "window_end", *more]
    keys = [F.col("type"), F.col("keyword"), F.col("window_end")]
    first = panes.first_deliveries(df, keys, F.lit(True), _RAW_ORDER, keep)
    return panes.judge(first, F.col("window_end"), F.col("ingest_ts"), 300, CUTOFF_S, ends=True)


def _past(judged: DataFrame, topic: str) -> DataFrame:
    """The rows that panes turned away. A part of a pane spans 65,536 offsets of a partition."""
    part = [F.col("kafka_partition"), F.floor(F.col("kafka_offset") / 65_536)]
    parts = panes.past_panes(judged, [], part, ["kafka_partition", "kafka_offset"])
    return parts.where("n_past > 0").select(F.lit(topic).alias("topic"), F.inline("past"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows past the cut-off, as their panes turned them away."""
    return _past(judged_comments(spark, d), "reddit_comments").unionByName(_past(judged_windows(spark, d), "analytics_results"))


def p4_hours(spark: SparkSession, d: str) -> DataFrame:
    """Comments per clock hour: rows within the cut-off, late ones among them, rows past it counted apart."""
    p = panes.panes(judged_comments(spark, d, "score"), [], {"score": F.col("score")})
    return panes.recompose(p, [], ["n", "n_late", "n_past", "score"], HOUR, HOUR)


def p4_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Comments per subreddit in windows of six hours that start every two hours, from panes of two hours."""
    size, slide = 6 * HOUR, 2 * HOUR
    judged = judged_comments(spark, d, "subreddit", pane_s=panes.pane_size(size, slide))
    return panes.recompose(panes.panes(judged, ["subreddit"], {}), ["subreddit"], ["n", "n_late", "n_past"], size, slide)


def p4_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of p4_sliding with every row judged against each window that it falls into, not against its pane."""
    size, slide = 6 * HOUR, 2 * HOUR
    event = F.when(F.col("created_utc") > 0, F.col("created_utc"))
    p = panes.window_panes(first_comments(spark, d, "subreddit"), ["subreddit"], event, F.col("ingest_ts"), {}, size, slide, CUTOFF_S)
    return panes.recompose_windows(p, ["subreddit"], [], size, slide)


def p4_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Every emission of every clock hour: the first at its end, then one for each ten minutes that corrected it."""
    return panes.revisions(judged_comments(spark, d), [], F.col("ingest_ts"), HOUR, HOUR, 600)


def p4_published(spark: SparkSession, d: str) -> DataFrame:
    """Published analytics windows by type and clock hour of their end, with late ones and ones past the cut-off."""
    judged = judged_windows(spark, d, "type").withColumn("hour_start", F.floor((F.col("window_end") - 1) / HOUR) * HOUR)
    return judged.groupBy("type", F.col("hour_start").cast("bigint").alias("hour_start")).agg(
        F.count(F.when(F.col("status") != panes.PAST, 1)).alias("n"),
        F.count(F.when(F.col("status") == panes.LATE, 1)).alias("n_late"),
        F.count(F.when(F.col("status") == panes.PAST, 1)).alias("n_past"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_comments, p2_cleaned, p2_cleaned_whole, p3_found, p3_subreddits, p3_keywords,
        p4_found, p4_hours, p4_sliding, p4_windows, p4_revisions, p4_published,
    )
}

_FIRST_COMMENTS = """
first AS (SELECT * FROM reddit_comments QUALIFY id IS NULL OR id = '' OR
  row_number() OVER (PARTITION BY id ORDER BY ingest_ts NULLS FIRST, kafka_offset, kafka_partition) = 1),
judged AS (SELECT *, (created_utc // 3600) * 3600 + 3600 AS pane_end, epoch_us(ingest_ts) AS a FROM first WHERE created_utc > 0)
"""
_FIRST_WINDOWS = """
first AS (SELECT * FROM analytics_results WHERE window_end IS NOT NULL QUALIFY row_number() OVER
  (PARTITION BY type, keyword, window_end ORDER BY ingest_ts NULLS FIRST, kafka_offset, kafka_partition) = 1)
"""


def _dedup_sql(t: str, cols: str) -> str:
    return f"""SELECT {cols} FROM {t} QUALIFY id IS NULL OR id IN ('', 'None') OR
    row_number() OVER (PARTITION BY id ORDER BY ingest_ts NULLS FIRST, kafka_partition, kafka_offset) = 1"""


def _stats_sql(t: str, key: str, mode: str, q: str, names: list[str], probs: list[float]) -> str:
    qs = ", ".join(f"min(CASE WHEN r >= greatest(1, ceil({p} * n)) THEN v END) AS {c}" for p, c in zip(probs, names[4:], strict=True))
    return f"""WITH m AS (SELECT {key} AS key, {mode} AS v, count(*) AS c FROM {t} WHERE {mode} IS NOT NULL GROUP BY {key}, {mode}
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {mode}) = 1),
    a AS (SELECT {key} AS key, count(*) AS n_rows, count(DISTINCT {mode}) AS d FROM {t} GROUP BY ALL),
    r AS (SELECT {key} AS key, {q} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {q}) AS r,
      count(*) OVER (PARTITION BY {key}) AS n FROM {t} WHERE {q} IS NOT NULL),
    q AS (SELECT key, {qs} FROM r GROUP BY key)
    SELECT a.key AS {names[0]}, n_rows, d AS {names[1]}, m.v AS {names[2]}, m.c AS {names[3]}, {", ".join(names[4:])}
    FROM a LEFT JOIN m ON a.key IS NOT DISTINCT FROM m.key LEFT JOIN q ON a.key IS NOT DISTINCT FROM q.key"""


_LATE = "a > pane_end * 1000000"
_PAST = "a > (pane_end + 7200) * 1000000"

SQL = {
    "p2_found": " UNION ALL ".join(
        f"SELECT '{t}' AS topic, id FROM {t} WHERE id NOT IN ('', 'None') GROUP BY id HAVING count(*) > 1"
        for t in ("reddit_comments", "reddit_comments_cleaned")
    ),
    "p2_comments": _dedup_sql("reddit_comments", "*"),
    "p2_cleaned": _dedup_sql("reddit_comments_cleaned", """* REPLACE (
      array_to_string(list_transform(tokens, lambda x: coalesce(x, '<null>')), '|') AS tokens,
      array_to_string(list_transform(matched_keywords, lambda x: coalesce(x, '<null>')), '|') AS matched_keywords,
      array_to_string(list_transform(list_sort(map_entries(keyword_senses)), lambda e: e.key || '=' || e.value), '|') AS keyword_senses)"""),
    "p3_found": " UNION ALL ".join(
        f"SELECT '{k}' AS field, {k} AS key FROM {t} WHERE {k} <> '' GROUP BY {k} HAVING count(*) >= 0.05 * (SELECT count(*) FROM {t})"
        for t, k in (("reddit_comments", "subreddit"), ("sentiment_results", "keyword"))
    ),
    "p3_subreddits": _stats_sql(
        "reddit_comments", "subreddit", "author", "score",
        ["subreddit", "n_authors", "top_author", "top_author_rows", "score_p50", "score_p90", "score_p99"], [0.5, 0.9, 0.99],
    ),
    "p3_keywords": _stats_sql(
        "sentiment_results", "keyword", "comment_count", "positive_ratio",
        ["keyword", "n_counts", "usual_count", "usual_count_rows", "ratio_p25", "ratio_p50", "ratio_p75"], [0.25, 0.5, 0.75],
    ),
    "p4_found": f"""WITH {_FIRST_COMMENTS}, w AS (WITH {_FIRST_WINDOWS} SELECT * FROM first)
    SELECT 'reddit_comments' AS topic, kafka_partition, kafka_offset FROM judged WHERE {_PAST}
    UNION ALL SELECT 'analytics_results', kafka_partition, kafka_offset FROM w
    WHERE epoch_us(ingest_ts) > (window_end + 7200) * 1000000""",
    "p4_hours": f"""WITH {_FIRST_COMMENTS} SELECT pane_end - 3600 AS window_start, pane_end AS window_end,
    count(*) FILTER (NOT ({_PAST})) AS n, count(*) FILTER ({_LATE} AND NOT ({_PAST})) AS n_late, count(*) FILTER ({_PAST}) AS n_past,
    CAST(coalesce(sum(score) FILTER (NOT ({_PAST})), 0) AS BIGINT) AS score FROM judged GROUP BY pane_end""",
    "p4_sliding": f"""WITH {_FIRST_COMMENTS}, s AS (SELECT *, created_utc // 7200 * 7200 AS p, unnest([0, 1, 2]) AS k FROM judged)
    SELECT subreddit, p - k * 7200 AS window_start, p - k * 7200 + 21600 AS window_end,
    count(*) FILTER (a <= (p + 14400) * 1000000) AS n,
    count(*) FILTER (a > (p + 7200) * 1000000 AND a <= (p + 14400) * 1000000) AS n_late,
    count(*) FILTER (a > (p + 14400) * 1000000) AS n_past FROM s GROUP BY ALL""",
    "p4_windows": f"""WITH {_FIRST_COMMENTS}, s AS (SELECT *, created_utc // 7200 * 7200 + unnest([7200, 14400, 21600]) AS e FROM judged)
    SELECT subreddit, e - 21600 AS window_start, e AS window_end,
    count(*) FILTER (a IS NULL OR a <= (e + 7200) * 1000000) AS n,
    count(*) FILTER (a > e * 1000000 AND a <= (e + 7200) * 1000000) AS n_late,
    count(*) FILTER (a > (e + 7200) * 1000000) AS n_past FROM s GROUP BY ALL""",
    "p4_revisions": f"""WITH {_FIRST_COMMENTS}, e AS (SELECT pane_end AS window_end,
      greatest(pane_end, CAST(ceil(a / 1000000 / 600) * 600 AS BIGINT)) AS emitted_s, count(*) AS c
      FROM judged WHERE NOT ({_PAST}) GROUP BY ALL)
    SELECT window_end - 3600 AS window_start, window_end, emitted_s,
    row_number() OVER (PARTITION BY window_end ORDER BY emitted_s) - 1 AS revision,
    CAST(sum(c) OVER (PARTITION BY window_end ORDER BY emitted_s) AS BIGINT) AS n FROM e""",
    "p4_published": f"""WITH {_FIRST_WINDOWS} SELECT type, (window_end - 1) // 3600 * 3600 AS hour_start,
    count(*) FILTER (epoch_us(ingest_ts) <= (window_end + 7200) * 1000000) AS n,
    count(*) FILTER (epoch_us(ingest_ts) > window_end * 1000000 AND epoch_us(ingest_ts) <= (window_end + 7200) * 1000000) AS n_late,
    count(*) FILTER (epoch_us(ingest_ts) > (window_end + 7200) * 1000000) AS n_past FROM first GROUP BY ALL""",
}
