"""Queries of the serving side, over the published windows and the scored comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import trending, views
from rivulet.plans.pipeline import _first_sql, _terms_sql
from rivulet.plans.stated import quoted
from rivulet.session import table

ARRIVAL = ["ingest_ts", "kafka_partition", "kafka_offset"]
A, B = "espresso", "mercury"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return views.valid_windows(table(spark, d, "sentiment_results"))


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return views.valid_comments(table(spark, d, "reddit_comments_cleaned"))


def _analytics(spark: SparkSession, d: str) -> DataFrame:
    return views.valid_analytics(table(spark, d, "analytics_results"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return views.trending_windows(_analytics(spark, d), ARRIVAL, table(spark, d, "tracked_keywords"))


_POINT = ["keyword", "window_end", "positive_ratio", "comment_count"]


def latest_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return views.latest_sentiment(_windows(spark, d), ARRIVAL).select(*_POINT, "base_keyword")


def stored_windows(spark: SparkSession, d: str) -> DataFrame:
    """The last 500 windows of each series."""
    return views.last_per_key(_windows(spark, d), ["keyword"], ARRIVAL, views.MAX_WINDOWS).select(*_POINT)


def timeseries(spark: SparkSession, d: str) -> DataFrame:
    return views.timeseries(_windows(spark, d), B).select(*_POINT, "base_keyword", "sense")


def compare(spark: SparkSession, d: str) -> DataFrame:
    return views.timeseries(_windows(spark, d), [A, B]).select(*_POINT, "base_keyword")


def rebucket(spark: SparkSession, d: str) -> DataFrame:
    return views.rebucket(_windows(spark, d), 3600)


def merged_senses(spark: SparkSession, d: str) -> DataFrame:
    return views.merge_senses(_windows(spark, d))


def headline(spark: SparkSession, d: str) -> DataFrame:
    return views.headline(_windows(spark, d), 3600)


def label_buckets(spark: SparkSession, d: str) -> DataFrame:
    return views.label_buckets(_comments(spark, d), 3600)


def chart(spark: SparkSession, d: str) -> DataFrame:
    return views.chart(_comments(spark, d), _windows(spark, d), A, B, 3600)


def scatter(spark: SparkSession, d: str) -> DataFrame:
    return views.scatter(table(spark, d, "reddit_comments_cleaned"), A)


def known_keywords(spark: SparkSession, d: str) -> DataFrame:
    return views.known_keywords(_windows(spark, d))


def recent_comments(spark: SparkSession, d: str) -> DataFrame:
    return views.recent_comments(_comments(spark, d), ARRIVAL).select("keyword", "id", "kafka_partition", "kafka_offset")


def matching_comments(spark: SparkSession, d: str) -> DataFrame:
    found = views.matching_comments(_comments(spark, d), A, "little in common", ARRIVAL, 20)
    return found.select("id", "kafka_partition", "kafka_offset", "snippet")


def comments_of_senses(spark: SparkSession, d: str) -> DataFrame:
    found = views.comments_of_senses(_comments(spark, d), [A, B], {B: "planet"})
    return found.select("kafka_partition", "kafka_offset", "id")


def series_of_sense(spark: SparkSession, d: str) -> DataFrame:
    return views.series_of_sense(_windows(spark, d), "planet").select(*_POINT)


def trending_stored(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select("keyword", "window_end", "rank", F.size("items").cast("bigint").alias("n_items"), F.col("sketch.stream_total").alias("stream_total"))


def trending_overview(spark: SparkSession, d: str) -> DataFrame:
    out = views.trending_overview(_stored(spark, d))
    return out.withColumn("keywords", F.array_join("keywords", "|"))


def trending_all(spark: SparkSession, d: str) -> DataFrame:
    """Every term of the latest windows with its momentum."""
    out = views.trending_overview(_stored(spark, d), None)
    return out.withColumn("keywords", F.array_join("keywords", "|"))


def trending_history(spark: SparkSession, d: str) -> DataFrame:
    return views.trending_history(_stored(spark, d))


def trending_examples(spark: SparkSession, d: str) -> DataFrame:
    """Comments behind the three best terms of the latest day of every keyword, two for each."""
    days = trending.trending(table(spark, d, "reddit_comments_cleaned"), 86400)
    overview = views.trending_overview(views.trending_windows(days, ["window_start"]))
    found = views.trending_examples(overview, _comments(spark, d), ARRIVAL, 3, 2)
    return found.select("rank", "token", "position", "id", "author", "sentiment_label", "created_utc")


def delivered(spark: SparkSession, d: str) -> DataFrame:
    """What a client on some keywords is sent of comments and windows, at no more than the allowed rate for each keyword."""
    names = [A, B, "ferry", "glimmerdrop"]
    comments = views.delivered_comments(_comments(spark, d), names, ["created_utc", "kafka_partition", "kafka_offset"])
    windows = views.delivered_windows(_windows(spark, d), names, ["window_end", "kafka_partition", "kafka_offset"])
    cols = [F.col("key"), F.col("kafka_partition"), F.col("kafka_offset")]
    return comments.select(F.lit("comment").alias("kind"), *cols).unionByName(windows.select(F.lit("window").alias("kind"), *cols))


def health(spark: SparkSession, d: str) -> DataFrame:
    """State of the pipeline by stage, from what each stage has written last."""
    stages = {"raw": table(spark, d, "reddit_comments"), "cleaned": table(spark, d, "reddit_comments_cleaned"), "sentiment": table(spark, d, "sentiment_results"),
              "analytics": table(spark, d, "analytics_results"), "nothing": table(spark, d, "sentiment_results").where("false")}
    return views.health(stages, stale_s=86400)


def reach_series(spark: SparkSession, d: str) -> DataFrame:
    return views.reach_series(_analytics(spark, d), ARRIVAL)


def reach_latest(spark: SparkSession, d: str) -> DataFrame:
    return views.reach_latest(_analytics(spark, d), ARRIVAL, table(spark, d, "tracked_keywords"))


def late_status(spark: SparkSession, d: str) -> DataFrame:
    return views.late_status(_analytics(spark, d))


def live_points(spark: SparkSession, d: str) -> DataFrame:
    return views.live_points(_windows(spark, d), ARRIVAL).select(*_POINT, "kafka_partition", "kafka_offset")


def live_feed(spark: SparkSession, d: str) -> DataFrame:
    return views.live_feed(_comments(spark, d).select("id", "author", *ARRIVAL), ARRIVAL).select("id", "author", "kafka_partition", "kafka_offset")


QUERIES = {
    f.__name__: f
    for f in (
        latest_sentiment, stored_windows, timeseries, compare, rebucket, merged_senses, headline, label_buckets, chart,
        scatter, known_keywords, recent_comments, matching_comments, comments_of_senses, series_of_sense, trending_stored,
        trending_overview, trending_all, trending_history, trending_examples, reach_series, reach_latest, late_status,
        live_points, live_feed, delivered, health,
    )
}

_ORDER = "ingest_ts, kafka_partition, kafka_offset"
_DESC = "ingest_ts DESC, kafka_partition DESC, kafka_offset DESC"
_W = """w AS (SELECT keyword, lower(split_part(keyword, ':', 1)) AS base_keyword, window_end, coalesce(positive_ratio, 0.0) AS positive_ratio,
  coalesce(comment_count, 0) AS comment_count, ingest_ts, kafka_partition, kafka_offset FROM sentiment_results WHERE keyword <> '')"""
_C = """c AS (SELECT * FROM reddit_comments_cleaned WHERE len(matched_keywords) > 0 AND sentiment_label <> '')"""
_RB = """rb AS (SELECT keyword, window_end // 3600 * 3600 AS window_end, sum(positive_ratio * greatest(comment_count, 1)) / sum(greatest(comment_count, 1)) AS positive_ratio,
  CAST(sum(comment_count) AS BIGINT) AS comment_count FROM w GROUP BY 1, 2)"""
_LB = """lb AS (SELECT keyword, window_end, count(*) FILTER (l = 'positive') AS positive, count(*) FILTER (l = 'negative') AS negative,
  count(*) FILTER (l NOT IN ('positive', 'negative')) AS neutral FROM (SELECT unnest(list_distinct(list_transform(matched_keywords, lambda x: lower(x)))) AS keyword,
  created_utc // 3600 * 3600 AS window_end, sentiment_label AS l FROM c) GROUP BY 1, 2)"""
_T = f"""t0 AS (SELECT lower(keyword) AS keyword, window_end, items, sketch, ingest_ts, kafka_partition, kafka_offset FROM analytics_results
  WHERE type = 'trending' AND keyword <> '' AND lower(keyword) IN (SELECT lower(keyword) FROM tracked_keywords)),
  t1 AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY keyword, window_end ORDER BY {_DESC}) = 1),
  t AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY window_end DESC) AS rank FROM t1 QUALIFY rank <= 8)"""
_O = """i AS (SELECT keyword, rank, unnest(items) AS x FROM t WHERE rank <= 2),
  p AS (SELECT keyword, x.token AS token, max(x.count) AS before FROM i WHERE rank = 2 GROUP BY 1, 2),
  h AS (SELECT DISTINCT keyword, true AS has FROM t WHERE rank = 2),
  j AS (SELECT i.keyword, i.x.token AS token, i.x.count AS n, coalesce(i.x.score, i.x.count) AS score, coalesce(has, false) AS has, coalesce(before, 0) AS before
    FROM i LEFT JOIN h USING (keyword) LEFT JOIN p ON i.keyword = p.keyword AND i.x.token = p.token WHERE i.rank = 1),
  g AS (SELECT token, CAST(sum(n) AS BIGINT) AS count, CAST(round(sum(CAST(score AS DECIMAL(18, 3))), 2) AS DOUBLE) AS score, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords,
    bool_or(has) AS known, coalesce(sum(before) FILTER (has), 0) AS before, coalesce(sum(n) FILTER (has), 0) AS now FROM j GROUP BY token),
  o AS (SELECT token, count, score, keywords, CASE WHEN NOT known THEN 'flat' WHEN before <= 0 THEN 'new' WHEN (now - before) / before > 0.1 THEN 'up'
    WHEN (now - before) / before < -0.1 THEN 'down' ELSE 'flat' END AS momentum,
    CASE WHEN known AND before > 0 THEN round_even(CAST((now - before) / before AS DOUBLE), 3) END AS change FROM g)"""
_R = f"""r0 AS (SELECT lower(keyword) AS keyword, window_end, unique_authors, comment_count, {_ORDER} FROM analytics_results WHERE type = 'reach' AND keyword <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(keyword), window_end ORDER BY {_DESC}) = 1),
  r AS (SELECT keyword, window_end, unique_authors, comment_count FROM r0 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY window_end DESC) <= 200)"""

SQL = {
    "latest_sentiment": f"WITH {_W} SELECT keyword, window_end, positive_ratio, comment_count, base_keyword FROM w QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY {_DESC}) = 1",
    "stored_windows": f"WITH {_W} SELECT keyword, window_end, positive_ratio, comment_count FROM w QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY {_DESC}) <= 500",
    "timeseries": f"""WITH {_W} SELECT keyword, window_end, positive_ratio, comment_count, base_keyword,
    CASE WHEN contains(keyword, ':') THEN split_part(keyword, ':', 2) END AS sense FROM w WHERE base_keyword = '{B}'""",
    "compare": f"WITH {_W} SELECT keyword, window_end, positive_ratio, comment_count, base_keyword FROM w WHERE base_keyword IN ('{A}', '{B}')",
    "rebucket": f"WITH {_W}, {_RB} SELECT * FROM rb",
    "merged_senses": f"""WITH {_W} SELECT base_keyword AS keyword, window_end, CAST(sum(comment_count) AS BIGINT) AS comment_count,
    CASE WHEN sum(comment_count) > 0 THEN sum(positive_ratio * comment_count) / sum(comment_count) ELSE 0.0 END AS positive_ratio FROM w GROUP BY 1, 2""",
    "headline": f"""WITH {_W}, {_RB}, d AS (SELECT *, positive_ratio - lag(positive_ratio) OVER (PARTITION BY keyword ORDER BY window_end) AS delta FROM rb)
    SELECT keyword, CAST(floor(positive_ratio * 100 + 0.5) AS BIGINT) AS pct, comment_count AS count, CAST(floor(delta * 100 + 0.5) AS BIGINT) AS delta_pct
    FROM d QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY window_end DESC) = 1""",
    "label_buckets": f"WITH {_C}, {_LB} SELECT * FROM lb",
    "chart": f"""WITH {_W}, {_RB}, {_C}, {_LB}, f AS (SELECT keyword, window_end AS t, CAST(floor(positive_ratio * 100 + 0.5) AS BIGINT) AS pct,
      coalesce(positive + negative + neutral, 0) = 0 AND coalesce(comment_count, 0) > 0 AS fill,
      CAST(floor(positive_ratio * comment_count + 0.5) AS BIGINT) AS est, positive, negative, neutral, comment_count
      FROM lb FULL JOIN rb USING (keyword, window_end) WHERE keyword IN ('{A}', '{B}')),
    v AS (SELECT keyword, t, pct, CASE WHEN fill THEN est ELSE coalesce(positive, 0) END AS positive,
      CASE WHEN fill THEN greatest(comment_count - est, 0) ELSE coalesce(negative, 0) END AS negative, coalesce(neutral, 0) AS neutral FROM f)
    SELECT t, {", ".join(f"coalesce(max({c}) FILTER (keyword = '{k}'), 0) AS {s}_{c}" for s, k in (("a", A), ("b", B)) for c in ("positive", "negative", "neutral"))},
    max(pct) FILTER (keyword = '{A}') AS a_pct, max(pct) FILTER (keyword = '{B}') AS b_pct FROM v GROUP BY t""",
    "scatter": f"""SELECT created_utc AS t, CASE sentiment_label WHEN 'negative' THEN -abs(sentiment_score) WHEN 'positive' THEN abs(sentiment_score) ELSE 0.0 END AS score,
    sentiment_label AS label, author, original_body AS body FROM reddit_comments_cleaned
    WHERE list_contains(list_transform(matched_keywords, lambda x: lower(x)), '{A}') AND sentiment_score IS NOT NULL""",
    "known_keywords": f"WITH {_W} SELECT DISTINCT keyword FROM w",
    "recent_comments": f"""WITH {_C}, k AS (SELECT *, unnest(list_distinct(list_transform(matched_keywords, lambda x: lower(x)))) AS keyword FROM c)
    SELECT keyword, id, kafka_partition, kafka_offset FROM k QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY {_DESC}) <= 100""",
    "matching_comments": f"""WITH {_C}, m AS (SELECT *, regexp_extract(original_body, {quoted(r"(?i)(?:^|[^\p{L}\p{N}_])(little[^\p{L}\p{N}_]+in[^\p{L}\p{N}_]+common)(?:$|[^\p{L}\p{N}_])")}, 1) AS hit FROM c
      WHERE list_contains(list_transform(matched_keywords, lambda x: lower(x)), '{A}')), n AS (SELECT *, instr(original_body, hit) - 1 AS a FROM m WHERE hit <> ''
      ORDER BY {_DESC} LIMIT 20), b AS (SELECT *, greatest(a - 140, 0) AS lo, least(a + length(hit) + 140, length(original_body)) AS hi FROM n)
    SELECT id, kafka_partition, kafka_offset, CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(substr(original_body, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)), E' \\n\\t\\r')
    || CASE WHEN hi < length(original_body) THEN '…' ELSE '' END AS snippet FROM b""",
    "comments_of_senses": f"""WITH {_C} SELECT kafka_partition, kafka_offset, id FROM c WHERE len(list_filter(matched_keywords, lambda x: lower(x) IN ('{A}', '{B}')
      AND (lower(x) <> '{B}' OR coalesce(keyword_senses[lower(x)], '') = 'planet'))) > 0""",
    "series_of_sense": f"WITH {_W} SELECT keyword, window_end, positive_ratio, comment_count FROM w WHERE contains(keyword, ':') AND split_part(keyword, ':', 2) = 'planet'",
    "trending_stored": f"WITH {_T} SELECT keyword, window_end, rank, len(items) AS n_items, sketch.stream_total AS stream_total FROM t",
    "trending_overview": f"WITH {_T}, {_O} SELECT * FROM o ORDER BY score DESC, token LIMIT 20",
    "trending_all": f"WITH {_T}, {_O} SELECT * FROM o",
    "trending_history": f"""WITH {_T}, i AS (SELECT window_end, unnest(items) AS x FROM t), r AS (SELECT window_end, x.token AS token, CAST(sum(x.count) AS BIGINT) AS count,
      sum(coalesce(x.score, x.count)) AS score FROM i GROUP BY 1, 2),
    top AS (SELECT token FROM r WHERE window_end = (SELECT max(window_end) FROM t) ORDER BY score DESC, token LIMIT 5)
    SELECT e.window_end, top.token, r.count FROM (SELECT DISTINCT window_end FROM t) e CROSS JOIN top LEFT JOIN r ON r.window_end = e.window_end AND r.token = top.token""",
    "trending_examples": f"""WITH {_first_sql(86400)}, {_terms_sql("f")},
    n AS (SELECT keyword, created_utc // 86400 AS day, term, count(*) AS n FROM s GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY keyword, day ORDER BY n DESC, term) AS rank, sum(n) OVER (PARTITION BY keyword, day) AS total FROM n),
    last AS (SELECT keyword, max(day) AS day FROM r WHERE total >= 30 GROUP BY keyword),
    o AS (SELECT term AS token, sum(n) AS score, list_sort(list(DISTINCT keyword)) AS names FROM r JOIN last USING (keyword, day) WHERE rank <= 20 AND n >= 2
      GROUP BY term ORDER BY score DESC, token LIMIT 3),
    p AS (SELECT rank, token, unnest(names) AS keyword, generate_subscripts(names, 1) AS place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, token) - 1 AS rank FROM o)),
    {_C}, st AS (SELECT * FROM (SELECT *, unnest(list_distinct(list_transform(matched_keywords, lambda x: lower(x)))) AS keyword FROM c)
      QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY {_DESC}) <= 100),
    hit AS (SELECT p.rank, token, place, row_number() OVER (PARTITION BY p.rank, place ORDER BY {_DESC}) AS i, id, author, sentiment_label, created_utc FROM st JOIN p USING (keyword)
      WHERE regexp_matches(original_body, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || replace(token, ' ', '[^\\p{{L}}\\p{{N}}_]+') || '($|[^\\p{{L}}\\p{{N}}_])') QUALIFY i <= 6),
    e0 AS (SELECT * FROM (SELECT * FROM hit WHERE rank = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, i) = 1) ORDER BY place, i LIMIT 2),
    e1 AS (SELECT * FROM (SELECT * FROM hit WHERE rank = 1 AND id NOT IN (SELECT id FROM e0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, i) = 1) ORDER BY place, i LIMIT 2),
    e2 AS (SELECT * FROM (SELECT * FROM hit WHERE rank = 2 AND id NOT IN (SELECT id FROM e0 UNION ALL SELECT id FROM e1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, i) = 1)
      ORDER BY place, i LIMIT 2)
    SELECT rank, token, row_number() OVER (PARTITION BY rank ORDER BY place, i) AS position, id, author, sentiment_label, created_utc
    FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2)""",
    "delivered": f"""WITH RECURSIVE {_C}, {_W},
    m AS (SELECT 'comment' AS kind, k.key, created_utc AS t, kafka_partition, kafka_offset, 5::DOUBLE AS rate, 3::DOUBLE AS burst FROM
      (SELECT *, list_min(list_filter(list_transform(matched_keywords, lambda x: lower(x)), lambda x: x IN ('espresso', 'mercury', 'ferry', 'glimmerdrop'))) AS key FROM c) k WHERE k.key IS NOT NULL
      UNION ALL SELECT 'window', base_keyword, window_end, kafka_partition, kafka_offset, 20, 10 FROM w WHERE base_keyword IN ('espresso', 'mercury', 'ferry', 'glimmerdrop')),
    o AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY t, kafka_partition, kafka_offset) AS i FROM m),
    b AS (SELECT kind, key, i, t, rate, burst, kafka_partition, kafka_offset, true AS sent, burst - 1 AS left_ FROM o WHERE i = 1
      UNION ALL SELECT o.kind, o.key, o.i, o.t, o.rate, o.burst, o.kafka_partition, o.kafka_offset, least(b.burst, left_ + (o.t - b.t) * b.rate) >= 1,
        least(b.burst, left_ + (o.t - b.t) * b.rate) - CASE WHEN least(b.burst, left_ + (o.t - b.t) * b.rate) >= 1 THEN 1 ELSE 0 END
      FROM b JOIN o ON o.kind = b.kind AND o.key = b.key AND o.i = b.i + 1)
    SELECT kind, key, kafka_partition, kafka_offset FROM b WHERE sent""",
    "health": """WITH s AS (SELECT 'raw' AS stage, ingest_ts FROM reddit_comments UNION ALL SELECT 'cleaned', ingest_ts FROM reddit_comments_cleaned
      UNION ALL SELECT 'sentiment', ingest_ts FROM sentiment_results UNION ALL SELECT 'analytics', ingest_ts FROM analytics_results),
    a AS (SELECT stage, count(*) AS n, max(CAST(floor(epoch_us(ingest_ts) / 1000000) AS BIGINT)) AS last_s FROM s GROUP BY stage)
    SELECT stage, n, (SELECT max(last_s) FROM a) - last_s AS behind_s, CASE WHEN (SELECT max(last_s) FROM a) - last_s > 86400 THEN 'stale' ELSE 'ok' END AS status FROM a
    UNION ALL SELECT 'nothing', 0, NULL, 'empty'""",
    "reach_series": f"WITH {_R} SELECT * FROM r",
    "reach_latest": f"""WITH {_R} SELECT * FROM r WHERE keyword IN (SELECT lower(keyword) FROM tracked_keywords)
    QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY window_end DESC) = 1""",
    "late_status": """SELECT pipeline, CAST(sum(count) AS BIGINT) AS total, max(emitted_at) AS last_at FROM analytics_results
    WHERE type = 'late_drop' AND pipeline IS NOT NULL GROUP BY ROLLUP (pipeline)""",
    "live_points": f"""WITH {_W}, l AS (SELECT lower(keyword) AS keyword, * EXCLUDE (keyword), lead(window_end) OVER o AS nxt, lead(true) OVER o AS more FROM w
      WINDOW o AS (PARTITION BY lower(keyword) ORDER BY {_ORDER})), s AS (SELECT * FROM l WHERE NOT (coalesce(more, false) AND nxt IS NOT DISTINCT FROM window_end))
    SELECT keyword, window_end, positive_ratio, comment_count, kafka_partition, kafka_offset FROM s QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY {_DESC}) <= 120""",
    "live_feed": f"""WITH {_C}, f AS (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) = 1)
    SELECT id, author, kafka_partition, kafka_offset FROM f ORDER BY {_DESC} LIMIT 60""",
}
