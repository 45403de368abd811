"""Feature extraction, training, scoring and versions of the sentiment classifier, with Spark ML."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IDFModel, IndexToString, Normalizer, StringIndexer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions import text as X


def dataset(df: DataFrame, min_tokens: int = 1) -> DataFrame:
    """(tokens, label) of rows with a label and enough tokens that are not blank."""
    tokens = F.filter("tokens", lambda t: F.trim(t) != "")
    return (
        df.where(F.coalesce(F.col("label"), F.lit("")) != "")
        .select(*[c for c in df.columns if c not in ("tokens", "label")], tokens.alias("tokens"), "label")
        .where(F.size("tokens") >= min_tokens)
    )


def tfidf_stages(max_features: int = 20_000, min_df: int = 2) -> list:
    """tf (ln((1 + n) / (1 + df)) + 1), scaled to length 1. Case is kept, unseen tokens are ignored.

    The built-in idf lacks the "+ 1", which with_one adds to the fitted model.
    """
    return [
        CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=max_features, minDF=min_df),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features"),
    ]


def with_one(idf: IDFModel) -> ElementwiseProduct:
    """The fitted weights plus one, as a product with the term counts."""
    return ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=Vectors.dense([x + 1 for x in idf.idf]))


def word2vec_stages(size: int = 100, window: int = 5, min_count: int = 2, epochs: int = 5, seed: int = 42, partitions: int = 1) -> list:
    return [Word2Vec(inputCol="tokens", outputCol="features", vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=partitions)]


def fit_features(df: DataFrame, stages: list) -> PipelineModel:
    fitted, at = [], df
    for s in stages:
        m = s.fit(at) if hasattr(s, "fit") else s
        m = with_one(m) if isinstance(m, IDFModel) else m
        fitted.append(m)
        at = m.transform(at)
    return PipelineModel(stages=fitted)


def split(df: DataFrame, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, the same share of each label, by a hash of the row; repeated rows stay together."""
    h = F.xxhash64(F.lit(seed), F.array_join("tokens", "\u0001"), "label").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    marked = df.withColumn("_h", h)
    cut = marked.groupBy("label").agg(F.percentile_approx("_h", F.lit(1 - test), F.lit(10_000)).alias("_cut"))
    placed = marked.join(F.broadcast(cut), "label")  # one row for each label
    train, rest = placed.where(F.col("_h") <= F.col("_cut")), placed.where(F.col("_h") > F.col("_cut"))
    return train.drop("_h", "_cut"), rest.drop("_h", "_cut")


def balanced(df: DataFrame) -> DataFrame:
    """df with weight, n / (labels * n of the label)."""
    sizes = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    w = F.create_map(*[x for a, n in sizes.items() for x in (F.lit(a), F.lit(total / (len(sizes) * n)))])
    return df.withColumn("weight", F.element_at(w, F.col("label")))


def fit(train: DataFrame, features: str = "tfidf", max_iter: int = 100, **how) -> PipelineModel:
    """A pipeline from tokens to predicted label and probabilities, fitted on (tokens, label)."""
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if total < 4 or len(sizes) < 2:
        raise ValueError("training needs four rows and two labels at least")
    if features not in ("tfidf", "word2vec"):
        raise ValueError(f"unknown features: {features}")
    stages = tfidf_stages(**how) if features == "tfidf" else word2vec_stages(**how)
    indexer = StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc", handleInvalid="error").fit(train)
    lr = LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", maxIter=max_iter, regParam=1 / total, standardization=False, family="multinomial" if len(sizes) > 2 else "auto")
    weighted = indexer.transform(balanced(train))
    features_model = fit_features(weighted, stages)
    body = PipelineModel(stages=[*features_model.stages, lr.fit(features_model.transform(weighted))])
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return PipelineModel(stages=[*body.stages, names])


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def score(df: DataFrame, model: PipelineModel | None, version: str | None = None, min_tokens: int = 2) -> DataFrame:
    """df with sentiment_label, sentiment_score (the probability of positive, else of the last label), _model and _status.

    Without a model the status is no_model_available, with fewer than min_tokens tokens that are not blank
    skipped_too_short; the other three columns are null then.
    """
    none = {"sentiment_label": F.lit(None).cast("string"), "sentiment_score": F.lit(None).cast("double"), "sentiment_model": F.lit(None).cast("string")}
    if model is None:
        return df.withColumns({**none, "sentiment_status": F.lit("no_model_available")})
    kept, original = F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.trim(t) != ""), df.columns
    labels = labels_of(model)
    at = labels.index("positive") if "positive" in labels else len(labels) - 1
    got = model.transform(df.withColumn("_all", F.col("tokens")).withColumn("tokens", kept))
    long = F.size("tokens") >= min_tokens
    return got.select(
        *[F.col("_all").alias("tokens") if c == "tokens" else F.col(c) for c in original],
        F.when(long, F.col("predicted")).alias("sentiment_label"),
        F.when(long, vector_to_array("probability")[at]).alias("sentiment_score"),
        F.when(long, F.lit(version)).alias("sentiment_model"),
        F.when(long, "scored").otherwise("skipped_too_short").alias("sentiment_status"),
    )


def null_score(df: DataFrame) -> DataFrame:
    return score(df, None).withColumn("sentiment_status", F.lit("pending_ml_integration"))


def confusion(df: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(truth).alias("label"), F.col(guess).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def evaluation(df: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each label, rounded to 4 places; 0 where nothing was predicted or is there."""
    pairs = confusion(df, truth, guess)
    by_label = pairs.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    by_guess = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    m = by_label.join(by_guess, "label", "full").na.fill(0, ["support", "hit", "guessed"])
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    m = m.withColumns({"p": safe(F.col("hit"), F.col("guessed")), "r": safe(F.col("hit"), F.col("support"))})
    return m.select(
        "label",
        F.bround("p", 4).alias("precision"),
        F.bround("r", 4).alias("recall"),
        F.bround(safe(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 4).alias("f1"),
        "support",
    )


def macro(per_label: DataFrame) -> DataFrame:
    total = per_label.agg(F.sum("support").alias("n"))
    return per_label.agg(
        F.bround(F.sum(F.col("recall") * F.col("support")) / total.scalar(), 4).alias("accuracy"),
        *[F.bround(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")],
    )


class Store:
    """Versions of models in a shared folder, with a pointer to the latest one that is written last."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _write(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def save(self, model: PipelineModel, metadata: dict | None = None, version: str | None = None) -> str:
        version = version or datetime.now(timezone.utc).strftime("v%Y%m%d-%H%M%S")
        model.write().overwrite().save(f"{self.root}/{version}/model")
        self._write(f"{self.root}/{version}/metadata.json", json.dumps({"version": version, "labels": labels_of(model), **(metadata or {})}))
        self._write(f"{self.root}/LATEST", version)
        return version

    def latest(self) -> str | None:
        try:
            return self._read(f"{self.root}/LATEST").strip() or None
        except FileNotFoundError:
            return None

    def versions(self) -> list[str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())

    def metadata(self, version: str) -> dict:
        return json.loads(self._read(f"{self.root}/{version}/metadata.json"))

    def load(self, version: str | None = None) -> tuple[PipelineModel, str]:
        version = version or self.latest()
        if version is None:
            raise FileNotFoundError(f"no model in {self.root}")
        self.metadata(version)
        return PipelineModel.load(f"{self.root}/{version}/model"), version


class Retrainer:
    """Counts labelled records and retrains after every so many; 0 never does."""

    def __init__(self, store: Store, every: int = 5000, features: str = "tfidf", min_tokens: int = 1, **how):
        self.store, self.every, self.features, self.min_tokens, self.how, self.seen = store, every, features, min_tokens, how, 0

    def add(self, n: int) -> bool:
        self.seen += n
        if self.every <= 0 or self.seen < self.every:
            return False
        self.seen = 0
        return True

    def cycle(self, corpus: DataFrame) -> str:
        """Load, train, evaluate on the held-out part, save. The version is returned."""
        train, rest = split(dataset(corpus, self.min_tokens))
        model = fit(train, self.features, **self.how)
        scores = macro(evaluation(model.transform(rest))).first()
        return self.store.save(model, {"features": self.features, **scores.asDict()})


def text_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", X.cache_key(F.col("tokens")))
