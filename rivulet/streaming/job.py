"""The streaming job: raw JSON to cleaned, tagged and scored comments, their three window aggregates and late counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.config import Settings
from rivulet.functions import sketches
from rivulet.functions import text as X
from rivulet.ml import lexicon
from rivulet.ml.model import Retrainer, Store, score
from rivulet.operators import keywords, parse, trending, windows
from rivulet.operators.language import Detector
from rivulet.schemas import LIVE_CORPUS
from rivulet.session import exists, remove
from rivulet.streaming import sinks

LATE_PIPELINES = ("sentiment", "trending", "reach")


def scored(comments: DataFrame, settings: Settings, words: Mapping[str, Sequence[str]], model=None, version: str | None = None, detector: Detector | None = None) -> DataFrame:
    """Valid raw comments to scored ones. The same plan serves a table and a stream."""
    stop = X.STOPWORDS if settings.remove_stopwords else ()
    cleaned = parse.cleaned(comments, detector, stop, settings.stem)
    return score(keywords.tag(cleaned, words), model, version, settings.min_tokens)


def with_watermark(df: DataFrame, settings: Settings) -> DataFrame:
    """df with the event time et, and the watermark that closes windows."""
    return windows.event_time(df).withWatermark("et", f"{settings.watermark_s} seconds")


def _bounds(size: int) -> list:
    start = F.unix_timestamp("window.start")
    return [start.alias("window_start"), (start + size).alias("window_end")]


def sentiment(df: DataFrame, size: int) -> DataFrame:
    """Positive ratio by keyword and window of a stream with a watermark; the state is two counters for each."""
    rows = windows.keyword_rows(df, "et")
    out = rows.groupBy(F.window("et", f"{size} seconds"), "keyword").agg(
        windows.ratio(F.col("sentiment_label")).alias("positive_ratio"), F.count(F.lit(1)).alias("comment_count")
    )
    return out.select("keyword", *_bounds(size), "positive_ratio", "comment_count")


def reach(df: DataFrame, size: int) -> DataFrame:
    """Distinct authors by keyword and window; the state is one sketch for each."""
    rows = windows.author_rows(df, "et")
    out = rows.groupBy(F.window("et", f"{size} seconds"), "keyword").agg(
        sketches.hll_count(sketches.hll("author")).alias("unique_authors"), F.count(F.lit(1)).alias("comment_count")
    )
    info = F.struct(F.lit("hyperloglog").alias("kind"), F.lit(sketches.HLL_P).cast("bigint").alias("precision"), F.lit(round(sketches.hll_std_error(), 4)).alias("std_error"))
    return out.select(F.lit("reach").alias("type"), "keyword", *_bounds(size), "unique_authors", "comment_count", info.alias("sketch"))


def term_counts(df: DataFrame, size: int, stopwords: Sequence[str] = trending.STOPWORDS, dedup: bool = True) -> DataFrame:
    """Term counts by keyword and window. A body that comes again within the watermark is skipped."""
    if dedup:
        df = df.withColumn("_h", X.hash64(F.coalesce("original_body", F.lit("")))).dropDuplicatesWithinWatermark(["_h"])
    rows = trending.term_rows(df, stopwords, "et")
    out = rows.groupBy(F.window("et", f"{size} seconds"), "keyword", "term").agg(F.count(F.lit(1)).alias("count"))
    return out.select("keyword", F.unix_timestamp("window.start").alias("window_start"), "term", "count")


def publish_trending(size: int, settings: Settings, put: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch behind term_counts in append mode: a window closes in one micro-batch, so its best terms are picked there."""

    def run(counts: DataFrame, batch_id: int) -> None:
        put(trending.publish(counts, size, settings.trending_k, settings.trending_min_terms, settings.trending_min_count), batch_id)

    return run


@dataclass
class LateCounter:
    """Counts elements behind the watermark in foreachBatch, with the watermark of the batches before.

    The largest event time is kept in a folder by batch, so a repeated micro-batch sees the same watermark and
    replaces its own counts. The built-in metric counts aggregated rows; this counts the elements themselves.
    """

    spark: SparkSession
    folder: str
    size: int
    delay_s: int = 5
    stopwords: Sequence[str] = tuple(trending.STOPWORDS)

    def watermark(self, batch_id: int) -> int | None:
        if not exists(self.spark, f"{self.folder}/seen"):  # any other failure makes the micro-batch fail, and come again
            return None
        seen = self.spark.read.parquet(f"{self.folder}/seen")
        top = seen.where(F.col("batch") < batch_id).agg(F.max("top").alias("t")).first()["t"]
        return None if top is None else top - self.delay_s

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        mark = self.watermark(batch_id)
        end = windows.bucket(F.col("created_utc"), self.size) + self.size
        late = df.where(end <= F.lit(mark)) if mark is not None else df.where(F.lit(False))
        rows = (
            windows.keyword_rows(late).select(F.lit("sentiment").alias("pipeline"))
            .unionByName(windows.author_rows(late).select(F.lit("reach").alias("pipeline")))
            .unionByName(trending.term_rows(late, self.stopwords).select(F.lit("trending").alias("pipeline")))
        )
        counts = rows.groupBy("pipeline").agg(F.count(F.lit(1)).alias("count"))
        sinks.put_batch(counts.select(F.lit("late_drop").alias("type"), "pipeline", "count", F.unix_timestamp().alias("emitted_at")), f"{self.folder}/late", batch_id)
        top = df.agg(F.max("created_utc").alias("top"))
        sinks.put_batch(top.where(F.col("top").isNotNull()), f"{self.folder}/seen", batch_id)


@dataclass
class Job:
    """All queries of the job over one stream of JSON comments, with files under root as sinks, and topics beside them if settings say so.

    Each micro-batch reads the tracked keywords and the latest model again, and keeps the last good ones where that fails.
    """

    spark: SparkSession
    settings: Settings
    root: str
    registry: keywords.Registry | None = None
    store: Store | None = None
    detector: Detector | None = None
    report: Callable[[str], None] = print
    _model: object = None
    _version: str | None = None

    def words(self) -> dict[str, list[str]]:
        found = self.registry.load() if self.registry else {}
        return found or {k: self.settings.subkeywords.get(k, []) for k in self.settings.keywords}

    def model(self):
        """The latest model; the last good one where there is no pointer to one, or the one pointed to cannot be loaded."""
        try:
            latest = self.store.latest() if self.store else None
            if latest is not None and latest != self._version:
                self._model, self._version = self.store.load(latest)
        except Exception as e:  # noqa: BLE001 - whatever hinders it, scoring goes on
            self.report(f"model not loaded: {e}")
        return self._model, self._version

    def _put(self, df: DataFrame, name: str, topic: str, batch_id: int, key: str | None = None) -> None:
        if self.settings.output == "kafka":
            sinks.kafka_batch(df, self.settings.bootstrap, topic, key)
        sinks.put_batch(df, f"{self.root}/{name}", batch_id)

    def _batch(self, df: DataFrame, batch_id: int) -> None:
        parsed, s = parse.parse(df), self.settings
        self._put(parse.malformed(parsed, F.unix_millis("ingest_ts")), "malformed", s.malformed_topic, batch_id)
        self._put(scored(parse.valid(parsed), s, self.words(), *self.model(), self.detector), "cleaned", s.cleaned_topic, batch_id, "id")

    def start_cleaning(self, lines: DataFrame, **trigger):
        """Raw lines to the cleaned and the malformed table."""
        return lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.root}/_checkpoints/cleaning").trigger(**trigger).start()

    def cleaned_stream(self, files: int | None = None) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.root}/cleaned").schema
        reader = self.spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{self.root}/cleaned")

    def start_windows(self, cleaned: DataFrame, **trigger) -> list:
        """The three window aggregates and the late counter; windows are written when they close."""
        s, root = self.settings, self.root
        df = with_watermark(cleaned.where(F.col("created_utc").isNotNull()), s)
        stop = trending.load_stopwords(s.trending_stopwords)
        point = lambda name: f"{root}/_checkpoints/{name}"
        put = lambda name: lambda out, n: self._put(out, name, s.results_topic if name == "sentiment" else s.analytics_topic, n, "keyword")
        jobs = [
            sentiment(df, s.window_s).writeStream.outputMode("append").foreachBatch(put("sentiment")).option("checkpointLocation", point("sentiment")),
            reach(df, s.analytics_window_s).writeStream.outputMode("append").foreachBatch(put("reach")).option("checkpointLocation", point("reach")),
            term_counts(df, s.analytics_window_s, stop).writeStream.outputMode("append")
            .foreachBatch(publish_trending(s.analytics_window_s, s, put("trending"))).option("checkpointLocation", point("trending")),
            cleaned.writeStream.foreachBatch(LateCounter(self.spark, f"{root}/lateness", s.window_s, s.watermark_s, stop)).option("checkpointLocation", point("late")),
        ]
        return [j.trigger(**trigger).start() for j in jobs]

    def reset(self) -> None:
        """Forget everything that was written, checkpoints included, to replay from the beginning."""
        remove(self.spark, self.root)
        self._model, self._version = None, None


@dataclass
class Labelling:
    """For foreachBatch over cleaned comments: lexicon labels, appended to a corpus, and a new model every so many.

    Neutral comments and comments without tokens go. A failed retraining is reported and the stream goes on; a repeated
    micro-batch replaces its own part of the corpus.
    """

    spark: SparkSession
    folder: str
    retrainer: Retrainer
    report: Callable[[str], None] = print

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        labelled = lexicon.label_corpus(df).select("tokens", "label").where(F.size("tokens") > 0)
        sinks.put_batch(labelled, f"{self.folder}/corpus", batch_id)
        n = self.spark.read.schema(LIVE_CORPUS).parquet(f"{self.folder}/corpus/batch={batch_id}").count()
        if self.retrainer.add(n):
            try:
                version = self.retrainer.cycle(self.corpus())
                self.report(f"model {version} is ready")
            except Exception as e:  # noqa: BLE001 - the stream goes on with the model it has
                self.report(f"retraining failed: {e}")

    def corpus(self) -> DataFrame:
        return self.spark.read.schema(LIVE_CORPUS).parquet(f"{self.folder}/corpus").select("tokens", "label")


def replay_warning(skip: int, high_water: int) -> str | None:
    """A replay from before what was already sent arrives behind the watermark."""
    return f"records before {high_water} were sent already; reset the pipeline to replay them" if skip < high_water else None


def clamp(name: str, value: float) -> float:
    """Replay controls within their limits (fixed values)."""
    lo, hi = {"speed": (0.1, 1000), "limit": (1000, 5_000_000), "skip": (0, 50_000_000), "parallelism": (1, 4), "window": (5, 3600)}[name]
    return min(max(value, lo), hi)
