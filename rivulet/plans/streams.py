"""Streaming queries, run over what is there now until it is used up. Their results equal those of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.config import Settings
from rivulet.ml import model
from rivulet.operators import keywords
from rivulet.plans import general, models, pipeline
from rivulet.session import scratch, table, table_path
from rivulet.sources import topics
from rivulet.sources.topics import table_stream
from rivulet.streaming import job, sinks
from rivulet.streaming.panes import PaneStream

#: Longer than the rows are spread, so that nothing is late and the results can be compared.
PATIENT = Settings(watermark_s=60 * 86400, window_s=3600, analytics_window_s=300)


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "streams")


def _comments(spark: SparkSession, d: str) -> DataFrame:
    path = table_path(d, "reddit_comments_cleaned")
    return table_stream(spark, path, spark.read.parquet(path).schema)


def _last(spark: SparkSession, df: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream in update mode and give the last value of each key."""
    root, values = _folder(spark), [c for c in df.columns if c not in keys]
    put = lambda out, n: sinks.put_batch(out, f"{root}/out", n)
    q = df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


def stream_sentiment(spark: SparkSession, d: str) -> DataFrame:
    df = job.with_watermark(_comments(spark, d), PATIENT)
    return _last(spark, job.sentiment(df, PATIENT.window_s), ["keyword", "window_start", "window_end"])


def stream_reach(spark: SparkSession, d: str) -> DataFrame:
    df = job.with_watermark(_comments(spark, d), PATIENT)
    out = job.reach(df, PATIENT.analytics_window_s).drop("type", "sketch")
    return _last(spark, out, ["keyword", "window_start", "window_end"])


#: A day of arrivals is one micro-batch of the streams below, so that lateness can be stated in SQL.
PERIOD = 86_400
PROMPT = Settings(watermark_s=5, window_s=3600, analytics_window_s=86_400)


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned comments as a stream in the order of arrival, one micro-batch for each period."""
    folder = f"{_folder(spark)}/in"
    df = table(spark, d, "reddit_comments_cleaned").withColumn("_p", F.floor(F.unix_micros("ingest_ts") / 1_000_000 / PERIOD))
    periods = sorted(r["_p"] for r in df.select("_p").distinct().collect())  # as many as the micro-batches to be run
    for i, p in enumerate(periods):
        df.where(F.col("_p") == p).drop("_p").coalesce(1).write.parquet(f"{folder}/{i:06d}")
    return spark.readStream.schema(df.drop("_p").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _run(spark: SparkSession, df: DataFrame, put) -> None:
    query = df.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{_folder(spark)}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _closed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """What a stream in append mode has written when its input is used up: the windows that the watermark has closed."""
    root = _folder(spark)
    _run(spark, df, lambda out, n: sinks.put_batch(out, f"{root}/out", n))
    return spark.read.parquet(f"{root}/out").drop("batch")


def stream_closed_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Positive ratios of the windows that a watermark of five seconds closed; what came behind it is left out."""
    return _closed(spark, job.sentiment(job.with_watermark(_arriving(spark, d), PROMPT), PROMPT.window_s))


def stream_closed_reach(spark: SparkSession, d: str) -> DataFrame:
    return _closed(spark, job.reach(job.with_watermark(_arriving(spark, d), PROMPT), PROMPT.window_s).drop("type", "sketch"))


def stream_trending(spark: SparkSession, d: str) -> DataFrame:
    """Trending windows of a day, each published in the micro-batch that closed it. Repeated bodies count each time here."""
    root = _folder(spark)
    put = lambda out, n: sinks.put_batch(out, f"{root}/out", n)
    counts = job.term_counts(job.with_watermark(_arriving(spark, d), PROMPT), PROMPT.analytics_window_s, dedup=False)
    _run(spark, counts, job.publish_trending(PROMPT.analytics_window_s, PROMPT, put))
    items = F.transform("items", lambda i: F.concat_ws(":", i["token"], i["count"]))
    return spark.read.parquet(f"{root}/out").select("keyword", "window_start", "window_end", F.array_join(items, "|").alias("items"), F.col("sketch.stream_total").alias("stream_total"))


def stream_late_drops(spark: SparkSession, d: str) -> DataFrame:
    """Elements behind the watermark by pipeline and micro-batch, counted beside the windows."""
    counter = job.LateCounter(spark, _folder(spark), PROMPT.window_s, PROMPT.watermark_s)
    _run(spark, _arriving(spark, d), counter)
    return spark.read.parquet(f"{counter.folder}/late").select("pipeline", F.col("batch").cast("bigint").alias("batch"), "count")


def stream_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """The job's first stage over raw lines: cleaned and tagged comments without a model, and the rejected ones by error."""
    root = _folder(spark)
    pipeline.raw_json(spark, d).select("value").write.text(f"{root}/in")
    words = keywords.tracked(table(spark, d, "tracked_keywords"))
    settings = Settings(keywords=tuple(words), subkeywords=words)
    run = job.Job(spark, settings, f"{root}/out", detector=pipeline.detector(spark, d))
    run.start_cleaning(topics.lines_stream(spark, f"{root}/in", 2), availableNow=True).awaitTermination()
    good = spark.read.parquet(f"{run.root}/cleaned").groupBy(F.col("sentiment_status").alias("outcome"))
    bad = spark.read.parquet(f"{run.root}/malformed").groupBy(F.col("error").alias("outcome"))
    n = [F.count(F.lit(1)).alias("n")]
    return good.agg(*n, F.sum(F.size("matched_keywords")).alias("n_keywords")).unionByName(bad.agg(*n, F.lit(0).cast("bigint").alias("n_keywords")))


def stream_scored(spark: SparkSession, d: str) -> DataFrame:
    """The first stage with a stored model: by status, the comments and those with a label."""
    root = _folder(spark)
    pipeline.raw_json(spark, d).select("value").write.text(f"{root}/in")
    store = model.Store(spark, f"{root}/models")
    labelled = table(spark, d, "reddit_comments_cleaned").select("tokens", F.col("sentiment_label").alias("label"))
    store.save(model.fit(model.dataset(labelled), max_iter=3), version="v1")
    run = job.Job(spark, Settings(), f"{root}/out", store=store, detector=pipeline.detector(spark, d))
    run.start_cleaning(topics.lines_stream(spark, f"{root}/in"), availableNow=True).awaitTermination()
    out = spark.read.parquet(f"{run.root}/cleaned").groupBy("sentiment_status", "sentiment_model")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("sentiment_label").alias("n_labels"))


def stream_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Sentiment windows of a stream that was stopped after half of its input and started again from its checkpoint.

    Comments of time 0 are left out: after the restart they lie behind any watermark.
    """
    df = table(spark, d, "reddit_comments_cleaned").where(F.col("created_utc") > 0)
    root, schema = _folder(spark), df.schema
    put = lambda out, n: sinks.put_batch(out, f"{root}/out", n)
    for part in (0, 1):
        df.where(F.pmod(F.xxhash64(*pipeline.POS), F.lit(2)) == part).write.mode("append").parquet(f"{root}/in")
        rows = job.sentiment(job.with_watermark(table_stream(spark, f"{root}/in", schema, 2), PATIENT), PATIENT.window_s)
        query = rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    values = F.struct("positive_ratio", "comment_count")
    keys = ["keyword", "window_start", "window_end"]
    return spark.read.parquet(f"{root}/out").groupBy(*keys).agg(F.max_by(values, "batch").alias("r")).select(*keys, "r.*")


def stream_labelling(spark: SparkSession, d: str) -> DataFrame:
    """Labels by the word list appended to a corpus as comments arrive, and the models that were trained on the way."""
    root = _folder(spark)
    keeper = model.Retrainer(model.Store(spark, f"{root}/models"), every=1, max_iter=3)
    labels = job.Labelling(spark, root, keeper, report=lambda text: None)
    _run(spark, table_stream(spark, table_path(d, "reddit_comments_cleaned"), table(spark, d, "reddit_comments_cleaned").schema), labels)
    out = labels.corpus().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("trained", F.lit(len(keeper.store.versions()) > 0))


def replay_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limits of replay controls, and when a replay from before what was sent warns."""
    asked = [("speed", 0.0), ("speed", 5e3), ("limit", 5.0), ("limit", 9e6), ("skip", -1.0), ("skip", 6e7), ("parallelism", 9.0), ("window", 1.0), ("window", 60.0)]
    rows = [(f"{n} {v:g}", float(job.clamp(n, v))) for n, v in asked]
    rows += [(f"replay {a} of {b}", float(job.replay_warning(a, b) is not None)) for a, b in ((0, 10), (10, 10), (11, 10))]
    return spark.createDataFrame(rows, "asked string, given double")


def _panes(spark: SparkSession, d: str, by_window: bool) -> DataFrame:
    path, root = table_path(d, "reddit_comments"), _folder(spark)
    size, slide = 6 * 3600, 2 * 3600
    state = PaneStream(spark, root, size, slide, general.CUTOFF_S, ["subreddit"], by_window=by_window)
    df = table_stream(spark, path, table(spark, d, "reddit_comments").schema, files=4)
    df.writeStream.foreachBatch(state).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.current().select("subreddit", "window_start", "window_end", "n", "n_late", "n_past")


def stream_panes(spark: SparkSession, d: str) -> DataFrame:
    """Windows of six hours every two, per subreddit, corrected pane by pane as rows arrive; every delivery counts."""
    return _panes(spark, d, by_window=False)


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of stream_panes with every row judged against each window that it falls into, not against its pane."""
    return _panes(spark, d, by_window=True)


QUERIES = {
    f.__name__: f
    for f in (
        stream_sentiment, stream_reach, stream_closed_sentiment, stream_closed_reach, stream_trending, stream_late_drops, stream_cleaning,
        stream_scored, stream_resumed, stream_labelling, replay_limits,
        stream_panes, stream_windows,
    )
}
_ALL = "judged AS (SELECT *, epoch_us(ingest_ts) AS a FROM reddit_comments WHERE created_utc > 0)"
_EMPTY = "trim(regexp_replace(body, '[\\s\\x{85}\\x{1c}-\\x{1f}\\p{Z}]+', ' ', 'g')) = ''"


def _kept(size: int) -> str:
    """b: comments with their micro-batch and the watermark of those before it; late: behind it; kept: what the engine takes, in windows closed at the end.

    The engine drops rows behind the watermark that the micro-batch before worked with, which is that of two before.
    """
    return f"""b AS (SELECT *, CAST(epoch_us(ingest_ts) // 86400000000 AS BIGINT) AS p FROM reddit_comments_cleaned WHERE created_utc IS NOT NULL),
  tops AS (SELECT p, max(created_utc) AS top FROM b GROUP BY p),
  marks AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS batch, max(top) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5 AS mark,
    max(top) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 5 AS engine_mark FROM tops),
  seen AS (SELECT b.*, batch, mark, engine_mark, created_utc // {size} * {size} + {size} AS wend FROM b JOIN marks USING (p)),
  kept AS (SELECT * FROM seen WHERE (engine_mark IS NULL OR wend > engine_mark) AND wend <= (SELECT max(top) - 5 FROM tops)),
  late AS (SELECT * FROM seen WHERE wend <= mark)"""


SQL = {
    "stream_closed_sentiment": f"""WITH {_kept(3600)}, f AS (SELECT wend, sentiment_label, CASE WHEN coalesce(keyword_senses[k], '') <> '' THEN k || ':' || keyword_senses[k] ELSE k END AS keyword
      FROM (SELECT *, unnest(matched_keywords) AS k FROM kept WHERE sentiment_label <> ''))
    SELECT keyword, wend - 3600 AS window_start, wend AS window_end, round_even(avg(CASE WHEN sentiment_label = 'positive' THEN 1.0::DOUBLE ELSE 0 END), 4) AS positive_ratio,
    count(*) AS comment_count FROM f GROUP BY 1, 2, 3""",
    "stream_closed_reach": f"""WITH {_kept(3600)}, f AS (SELECT wend, author, unnest(matched_keywords) AS keyword FROM kept WHERE author NOT IN ('', '[deleted]'))
    SELECT keyword, wend - 3600 AS window_start, wend AS window_end, count(DISTINCT author) AS unique_authors, count(*) AS comment_count FROM f GROUP BY 1, 2, 3""",
    "stream_trending": f"""WITH {_kept(86400)}, {pipeline._terms_sql("kept")},
    c AS (SELECT keyword, wend AS we, term, count(*) AS n FROM s GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY keyword, we ORDER BY n DESC, term) AS rank, sum(n) OVER (PARTITION BY keyword, we) AS total FROM c)
    SELECT keyword, we - 86400 AS window_start, we AS window_end, CAST(any_value(total) AS BIGINT) AS stream_total,
    coalesce(string_agg(term || ':' || n, '|' ORDER BY rank) FILTER (rank <= 20 AND n >= 2), '') AS items FROM r WHERE total >= 30 GROUP BY keyword, we""",
    "stream_late_drops": f"""WITH {_kept(3600)}, {pipeline._terms_sql("late")}, e AS (
      SELECT 'sentiment' AS pipeline, batch FROM (SELECT batch, unnest(matched_keywords) FROM late WHERE sentiment_label <> '')
      UNION ALL SELECT 'reach', batch FROM (SELECT batch, unnest(matched_keywords) FROM late WHERE author NOT IN ('', '[deleted]'))
      UNION ALL SELECT 'trending', batch FROM s) SELECT pipeline, batch, count(*) AS count FROM e GROUP BY pipeline, batch""",
    "stream_cleaning": f"""WITH cl AS ({pipeline.SQL["cleaned_comments"]}), tk AS (SELECT lower(trim(keyword)) AS keyword FROM tracked_keywords),
    cw AS (SELECT DISTINCT kafka_partition, kafka_offset, unnest(string_split_regex(lower(cleaned_body), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM cl),
    hits AS (SELECT count(*) AS n FROM cw JOIN tk ON word = keyword WHERE regexp_full_match(keyword, '[a-z0-9]+')),
    signs AS (SELECT count(*) AS n FROM cl, (SELECT keyword FROM tk WHERE NOT regexp_full_match(keyword, '[a-z0-9]+')) WHERE contains(lower(cleaned_body), keyword)
      AND regexp_matches(cleaned_body, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || keyword || '($|[^\\p{{L}}\\p{{N}}_])'))
    SELECT 'no_model_available' AS outcome, count(*) AS n, (SELECT n FROM hits) + (SELECT n FROM signs) AS n_keywords FROM cl
    UNION ALL SELECT error, count(*), 0 FROM (SELECT CASE WHEN body IS NULL OR {_EMPTY} THEN 'empty_body' WHEN body IN ('[deleted]', '[removed]') THEN 'deleted_body'
      WHEN coalesce(created_utc, -1) < 0 THEN 'invalid_created_utc' END AS error FROM reddit_comments) WHERE error IS NOT NULL GROUP BY error""",
    "stream_sentiment": pipeline.SQL["sentiment_windows"],
    "stream_scored": f"""WITH cl AS ({pipeline.SQL["cleaned_comments"]}), st AS (SELECT CASE WHEN len(string_split(tokens, '|')) >= 2 THEN 'scored'
      ELSE 'skipped_too_short' END AS sentiment_status FROM cl)
    SELECT sentiment_status, CASE WHEN sentiment_status = 'scored' THEN 'v1' END AS sentiment_model, count(*) AS n,
    count(*) FILTER (sentiment_status = 'scored') AS n_labels FROM st GROUP BY sentiment_status""",
    "stream_resumed": f"SELECT * FROM ({pipeline.SQL['sentiment_windows']}) WHERE window_start > 0",
    "stream_labelling": f"""WITH {models._LEXICON} SELECT label, count(*) AS n, true AS trained FROM z JOIN reddit_comments_cleaned USING (kafka_partition, kafka_offset)
    WHERE label <> 'neutral' AND len(tokens) > 0 GROUP BY label""",
    "replay_limits": """SELECT * FROM (VALUES ('speed 0', 0.1::DOUBLE), ('speed 5000', 1000), ('limit 5', 1000), ('limit 9e+06', 5000000), ('skip -1', 0), ('skip 6e+07', 50000000),
    ('parallelism 9', 4), ('window 1', 5), ('window 60', 60), ('replay 0 of 10', 1), ('replay 10 of 10', 0), ('replay 11 of 10', 0)) AS t(asked, given)""",
    "stream_reach": pipeline.SQL["reach_windows"],
    "stream_panes": general.SQL["p4_sliding"].replace(general._FIRST_COMMENTS, _ALL),
    "stream_windows": general.SQL["p4_windows"].replace(general._FIRST_COMMENTS, _ALL),
}
