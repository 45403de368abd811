"""Queries of sources and sinks: dumps, corpora, topics as JSON lines, replay, and checks of what a topic holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import parse, views
from rivulet.plans.pipeline import POS, raw_json
from rivulet.plans.stated import quoted
from rivulet.schemas import CLEANED, RAW, SENTIMENT_WINDOW
from rivulet.session import scratch, table
from rivulet.sources import replay, topics
from rivulet.streaming import sinks


def dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """The raw comments written as a dump of JSON lines, in compressed parts, and read back through the dump reader."""
    folder = scratch(spark, "dump")
    raw_json(spark, d).select("value").write.option("compression", "gzip").text(folder)
    found = parse.decode_dump(replay.read_lines(spark, folder).select("value"))
    return found.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.max(F.length("body")).alias("longest"))


def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    """The rejected records as a corpus of JSON lines: those that are no JSON object are skipped."""
    folder = scratch(spark, "corpus")
    table(spark, d, "reddit_comments_malformed").select(F.translate("raw", "\r\n", "  ").alias("value")).write.text(folder)
    return topics.corpus(spark, folder, RAW).select("id", "author", "subreddit")


def replay_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When each comment of the replay window is sent, at twenty times the speed, under which key and time."""
    df = table(spark, d, "reddit_comments").where(F.col("created_utc").between(replay.DATE_START, replay.DATE_END))
    return replay.schedule(df, 20).select(*POS, F.col("id").alias("key"), F.round("due_s", 6).alias("due_s"), (F.col("created_utc") * 1000).alias("timestamp_ms"))


def replayed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Topic records of all comments: the key, the fields that their JSON holds, and the time."""
    sent = replay.messages(table(spark, d, "reddit_comments").where(F.col("created_utc") > 0))
    back = F.from_json("value", RAW)
    return sent.select("key", F.unix_timestamp("timestamp").alias("time"), back["author"].alias("author"), back["body"].alias("body"), F.size(F.json_object_keys("value")).cast("bigint").alias("fields"))


def encoded_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sentiment windows as the JSON text of a topic record, nulls included."""
    df = table(spark, d, "sentiment_results")
    lines = sinks.as_json(df.select("keyword", "window_start", "window_end", "comment_count"), "keyword")
    return lines.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def rebuilt_views(spark: SparkSession, d: str) -> DataFrame:
    """The views of sentiment windows rebuilt from a topic: written by the file sink, read from the beginning, validated."""
    folder = scratch(spark, "topic")
    df = table(spark, d, "sentiment_results").select(*SENTIMENT_WINDOW.names, *POS)
    lines = sinks.as_json(df)
    lines.write.text(f"{folder}/results")
    stream = topics.lines_stream(spark, f"{folder}/results", 1)
    again = sinks.to_files(stream.select("value"), f"{folder}/copy", f"{folder}/checkpoint", "text").trigger(availableNow=True).start()
    again.awaitTermination()
    schema = "keyword string, window_start bigint, window_end bigint, positive_ratio double, comment_count bigint, kafka_partition int, kafka_offset bigint"
    got = spark.read.text(f"{folder}/copy").select(F.from_json("value", schema).alias("r")).select("r.*")
    return views.rebucket(views.valid_windows(got), 86400)


def topic_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records of the raw and the cleaned topic that break a rule: fields, dates, deleted bodies, tokens, texts that lost an emoji."""
    raw = raw_json(spark, d)
    cleaned = table(spark, d, "reddit_comments_cleaned").select(F.to_json(F.struct(*CLEANED.names), {"ignoreNullFields": "false"}).alias("value"))
    return views.raw_checks(raw).unionByName(views.cleaned_checks(cleaned))


def dump_sample(spark: SparkSession, d: str) -> DataFrame:
    """The made-up dump of eight records: what passes the decoder in its date range."""
    lines = replay.sample_lines(spark)
    return parse.decode_dump(lines, start=replay.DATE_START, end=replay.DATE_END).select("id", "created_utc")


def mock_windows(spark: SparkSession, d: str) -> DataFrame:
    """One batch of the made-up stream of windows, checked: keywords, lengths, ranges."""
    folder = scratch(spark, "mock")
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 200).option("startTimestamp", 1_554_076_800_000).load()
    got = []
    query = topics.synthetic_windows(rate, ["apple", "tesla"]).writeStream.foreachBatch(lambda df, n: sinks.put_batch(df, f"{folder}/out", n)).option("checkpointLocation", f"{folder}/checkpoint").trigger(once=True)
    got.append(query.start())
    got[0].awaitTermination()
    df = spark.read.parquet(f"{folder}/out")
    ok = (F.col("window_end") - F.col("window_start") == 60) & F.col("positive_ratio").between(0, 1) & F.col("comment_count").between(1, 50)
    return df.groupBy(F.col("keyword").isin("apple", "tesla").alias("known")).agg((F.count(F.lit(1)) % 200).alias("odd"), F.count(F.when(~ok, 1)).alias("n_wrong"))


QUERIES = {
    f.__name__: f
    for f in (dump_lines, corpus_lines, replay_schedule, replayed_messages, encoded_windows, rebuilt_views, topic_checks, dump_sample, mock_windows)
}

_RAW_BAD = "trim(coalesce(body, '')) = '' OR body IN ('[deleted]', '[removed]')"
SQL = {
    "dump_lines": f"""SELECT coalesce(subreddit, '') AS subreddit, count(*) AS n, CAST(sum(coalesce(score, 0)) AS BIGINT) AS score, max(length(body)) AS longest
    FROM reddit_comments WHERE created_utc IS NOT NULL AND NOT ({_RAW_BAD}) GROUP BY 1""",
    "corpus_lines": """WITH m AS (SELECT CASE WHEN json_valid(raw) THEN raw END AS j FROM reddit_comments_malformed)
    SELECT j ->> '$.id' AS id, j ->> '$.author' AS author, j ->> '$.subreddit' AS subreddit FROM m WHERE json_type(j) = 'OBJECT'""",
    "replay_schedule": """WITH w AS (SELECT *, min(created_utc) OVER () AS first FROM reddit_comments WHERE created_utc BETWEEN 1554076800 AND 1555472130)
    SELECT kafka_partition, kafka_offset, id AS key, round((created_utc - first) / 20.0, 6)::DOUBLE AS due_s, created_utc * 1000 AS timestamp_ms FROM w""",
    "replayed_messages": "SELECT id AS key, created_utc AS time, author, body, 7 AS fields FROM reddit_comments WHERE created_utc > 0",
    "encoded_windows": """SELECT keyword AS key, to_json({'keyword': keyword, 'window_start': window_start, 'window_end': window_end,
    'comment_count': comment_count})::VARCHAR AS value, count(*) AS n FROM sentiment_results GROUP BY 1, 2""",
    "rebuilt_views": """SELECT keyword, window_end // 86400 * 86400 AS window_end, CAST(sum(coalesce(comment_count, 0)) AS BIGINT) AS comment_count,
    sum(coalesce(positive_ratio, 0) * greatest(coalesce(comment_count, 0), 1)) / sum(greatest(coalesce(comment_count, 0), 1)) AS positive_ratio
    FROM sentiment_results WHERE keyword <> '' GROUP BY 1, 2""",
    "topic_checks": f"""SELECT 'raw' AS topic, count(*) AS n, 0 AS n_missing,
      count(*) FILTER (created_utc IS NULL OR created_utc NOT BETWEEN 1554076800 AND 1555472130) AS n_dates,
      count(*) FILTER (body IS NULL OR body IN ('', '[deleted]', '[removed]')) AS n_bodies, 0 AS n_tokens, 0 AS n_lost FROM reddit_comments
    UNION ALL SELECT 'cleaned', count(*), 0, count(*) FILTER (created_utc IS NULL), count(*) FILTER (original_body IS NULL OR original_body = ''),
      count(*) FILTER (tokens IS NULL), count(*) FILTER (regexp_matches(original_body, {quoted(r"[\x{1F300}-\x{1FAFF}]")})
      AND NOT regexp_matches(cleaned_body, {quoted(r"[\x{1F300}-\x{1FAFF}]")})) FROM reddit_comments_cleaned""",
    "dump_sample": "SELECT * FROM (VALUES ('a1', 1554076800), ('a2', 1554076800), ('a3', 1554076860), ('a4', 1554076920)) AS t(id, created_utc)",
    "mock_windows": "SELECT true AS known, 0 AS odd, 0 AS n_wrong",
}
