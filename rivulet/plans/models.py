"""Queries of the model side: labels, features, training on the scored comments, evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.functions.stem import stem_tokens
from rivulet.ml import lexicon, model, vectors
from rivulet.plans.stated import BLANK, strip
from rivulet.schemas import LABELLED
from rivulet.session import scratch, table
from rivulet.sources import topics
from rivulet.streaming import sinks


def _scored(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "reddit_comments_cleaned").where(F.col("tokens").isNotNull())
    return model.dataset(df.withColumnRenamed("sentiment_label", "label"), 2)


def corpus_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and tokens by label of what a model can be trained on."""
    return _scored(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("tokens"))


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    """The fitted TF-IDF features: for each token of the vocabulary its weight and the sum of its parts in all comments."""
    df = _scored(spark, d).select("tokens")
    fitted = model.fit_features(df, model.tfidf_stages())
    total = fitted.transform(df).agg(Summarizer.sum(F.col("features")).alias("s")).first()["s"]
    rows = list(zip(fitted.stages[0].vocabulary, map(float, fitted.stages[1].getScalingVec()), map(float, total), strict=True))
    weights = spark.createDataFrame(rows, "token string, idf double, weight double")  # a vocabulary, bounded by its parameter
    return weights.select("token", F.round("idf", 6).alias("idf"), F.round("weight", 4).alias("weight"))


def _half(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return model.split(_scored(spark, d).select("tokens", "label"))


def model_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 on held-out comments of a model trained on the others."""
    train, rest = _half(spark, d)
    return model.evaluation(model.fit(train, max_iter=30).transform(rest))


def model_floor(spark: SparkSession, d: str) -> DataFrame:
    """Whether a model trained on four fifths of the comments guesses the others better than their most frequent label does."""
    train, rest = _half(spark, d)
    found = model.macro(model.evaluation(model.fit(train, max_iter=30).transform(rest)))
    usual = rest.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))
    return found.select((F.col("accuracy") > usual.scalar()).alias("better"))


def stored_model(spark: SparkSession, d: str) -> DataFrame:
    """All comments scored by a model that was retrained, stored and loaded again: by status, the labels and scores that fit each other."""
    store = model.Store(spark, scratch(spark, "models"))
    labelled = _scored(spark, d).select("tokens", "label")
    keeper = model.Retrainer(store, every=100, max_iter=5)
    if keeper.add(labelled.count()):
        keeper.cycle(labelled)
    fitted, version = store.load()
    got = model.score(table(spark, d, "reddit_comments_cleaned").select("tokens"), fitted, version)
    fits = (F.col("sentiment_score") >= 0.5) == (F.col("sentiment_label") == "positive")
    return got.groupBy("sentiment_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("sentiment_label").alias("n_labels"),
        F.count(F.when(F.col("sentiment_score").between(0, 1) & fits & (F.col("sentiment_model") == version), 1)).alias("n_fit"),
    )


def null_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores where there is no model, and of the scorer that never has one."""
    df = table(spark, d, "reddit_comments_cleaned").select("tokens")
    both = model.score(df, None).unionByName(model.null_score(df))
    return both.groupBy("sentiment_status").agg(F.count(F.lit(1)).alias("n"), F.count("sentiment_label").alias("n_labels"))


def word_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of word vectors trained on all comments, and whether each has a vector and a neighbour."""
    fitted = vectors.train(table(spark, d, "reddit_comments_cleaned"), size=8, epochs=1, partitions=1)
    length = F.aggregate(F.transform(vector_to_array("vector"), lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    near = vectors.probe(fitted, ["the", "zzqzz"], 3)
    has = F.lit(len(near["the"] or []) == 3 and near["zzqzz"] is None)
    return fitted.getVectors().select(F.col("word").alias("token"), ((length > 0) & has).alias("known"))


def lexicon_scores(spark: SparkSession, d: str) -> DataFrame:
    """The compound of every comment by the word list, and its label."""
    df = lexicon.label_corpus(table(spark, d, "reddit_comments_cleaned"), keep_neutral=True)
    return df.select("kafka_partition", "kafka_offset", F.round("vader_compound", 3).alias("compound"), "label")


def lexicon_labels(spark: SparkSession, d: str) -> DataFrame:
    """How the labels of the word list stand against the published ones."""
    df = lexicon.label_corpus(table(spark, d, "reddit_comments_cleaned"), keep_neutral=True)
    return df.groupBy("sentiment_label", "label").agg(F.count(F.lit(1)).alias("n"))


def labelled_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The labelled corpus written as JSON lines without neutral records, and read as training data."""
    folder = scratch(spark, "labelled")
    df = lexicon.label_corpus(table(spark, d, "reddit_comments_cleaned"))
    sinks.as_json(lexicon.labelled_records(df)).write.text(folder)
    back = topics.corpus(spark, folder, LABELLED)
    read = model.dataset(back, 1)
    return read.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("tokens"), F.count("language").alias("n_languages"))


def stems(spark: SparkSession, d: str) -> DataFrame:
    """The stem of every token."""
    tokens = table(spark, d, "reddit_comments_cleaned").select(F.explode("tokens").alias("token")).where("token IS NOT NULL").distinct()
    return tokens.select("token", stem_tokens(F.array("token"))[0].alias("stem"))


def first_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that is labelled: the first of the bodies that is not blank, else the tokens."""
    text = X.first_text(F.col("original_body"), F.col("cleaned_body"), tokens=F.col("tokens"))
    tokens_only = X.first_text(F.lit(None).cast("string"), F.lit("  "), tokens=F.col("tokens"))
    return table(spark, d, "reddit_comments_cleaned").select("kafka_partition", "kafka_offset", text.alias("text"), tokens_only.alias("from_tokens"))


def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Published labels against the side of their score, as precision, recall and F1."""
    df = table(spark, d, "reddit_comments_cleaned").where(F.col("sentiment_label").isNotNull() & F.col("sentiment_score").isNotNull())
    guess = F.when(F.col("sentiment_score") >= 0.5, "positive").otherwise("negative")
    return model.evaluation(df.select(F.col("sentiment_label").alias("label"), guess.alias("predicted")))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "reddit_comments_cleaned").where(F.col("tokens").isNotNull())
    return df.select("kafka_partition", "kafka_offset", X.cache_key(F.col("tokens")).alias("key"))


def embedding_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with the mean of its label."""
    df = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    mean = df.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.col("c.m").alias("centre"))
    return df.join(F.broadcast(centre), "label").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_sizes, tfidf_weights, model_evaluation, model_floor, stored_model, null_scores, word_vectors, lexicon_scores, lexicon_labels,
        labelled_corpus, stems, first_texts, label_confusion, cache_keys, embedding_similarity,
    )
}

_D = """d AS (SELECT sentiment_label AS label, list_filter(tokens, lambda x: trim(x) <> '') AS tokens FROM reddit_comments_cleaned
  WHERE sentiment_label <> '' AND tokens IS NOT NULL AND len(list_filter(tokens, lambda x: trim(x) <> '')) >= 2)"""


def _boosted(k: int, left: float) -> str:
    """The value after the k-th word before: strengthened or weakened, more so in capitals."""
    x = f"x{k - 1}"
    more = f"(CASE WHEN {x} < 0 THEN -b{k} ELSE b{k} END + CASE WHEN c{k} AND loud THEN CASE WHEN {x} > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END)"
    return f"CASE WHEN t{k} AND b{k} <> 0 THEN {x} + {more} * {left} ELSE {x} END"


def _valence(words: str, v: float) -> str:
    return ", ".join(f"('{w}', {v})" for w in words.split())


#: z: (kafka_partition, kafka_offset, compound, label) of every cleaned comment. Words, their values and the rules are stated here.
_LEXICON = rf"""lx(word, v) AS (VALUES {_valence("amazing awesome brilliant excellent fantastic flawless love loved perfect superb wonderful", 3.1)},
    {_valence("beautiful best charming delightful enjoy glad good great happy impressive lovely nice pleased thanks", 2.2)},
    {_valence("better cool fine fun helpful interesting like liked okay reliable solid useful works", 1.5)},
    {_valence("awful disaster disgusting dreadful hate hated horrible miserable terrible worst", -3.0)},
    {_valence("angry bad broken disappointing failed garbage painful poor ridiculous sad stupid useless", -2.2)},
    {_valence("annoying complaint delay issue lost problem regret slow stopped wrong", -1.5)}),
  q AS (SELECT kafka_partition, kafka_offset, CASE WHEN {strip("original_body")} <> '' THEN original_body WHEN {strip("cleaned_body")} <> '' THEN cleaned_body
    ELSE coalesce(array_to_string(tokens, ' '), '') END AS text FROM reddit_comments_cleaned),
  qw AS (SELECT *, CASE WHEN length(bare) > 2 THEN bare ELSE raw END AS w FROM
    (SELECT kafka_partition, kafka_offset, text, raw, i, regexp_replace(raw, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS bare FROM
      (SELECT kafka_partition, kafka_offset, text, unnest(w) AS raw, generate_subscripts(w, 1) AS i FROM
        (SELECT *, list_filter(string_split_regex(text, '[{BLANK}]+'), lambda x: x <> '') AS w FROM q)))),
  qa AS (SELECT qw.*, lower(w) AS low, v, v IS NOT NULL AS known, upper(w) = w AND lower(w) <> w AS caps,
    CASE WHEN lower(w) IN ('absolutely', 'amazingly', 'awfully', 'completely', 'considerably', 'decidedly', 'deeply', 'enormously', 'entirely', 'especially',
      'exceptionally', 'extremely', 'fabulously', 'fully', 'greatly', 'highly', 'hugely', 'incredibly', 'intensely', 'majorly', 'more', 'most', 'particularly',
      'purely', 'quite', 'really', 'remarkably', 'so', 'substantially', 'thoroughly', 'totally', 'tremendously', 'unbelievably', 'unusually', 'utterly', 'very')
      THEN 0.293 WHEN lower(w) IN ('almost', 'barely', 'hardly', 'kinda', 'less', 'little', 'marginally', 'occasionally', 'partly', 'scarcely', 'slightly',
      'somewhat', 'sorta') THEN -0.293 ELSE 0.0 END AS b,
    contains(lower(w), 'n''t') OR lower(w) IN ('aint', 'arent', 'cannot', 'cant', 'couldnt', 'darent', 'didnt', 'doesnt', 'dont', 'hadnt', 'hasnt', 'havent', 'isnt',
      'mightnt', 'mustnt', 'neednt', 'neither', 'never', 'none', 'nope', 'nor', 'not', 'nothing', 'nowhere', 'oughtnt', 'shant', 'shouldnt', 'uhuh', 'wasnt', 'werent',
      'without', 'wont', 'wouldnt', 'rarely', 'seldom', 'despite') AS neg FROM qw LEFT JOIN lx ON lower(w) = word),
  qb AS (SELECT *, count(*) FILTER (caps) OVER d > 0 AND count(*) FILTER (caps) OVER d < count(*) OVER d AS loud, min(i) FILTER (low = 'but') OVER d AS but,
    {", ".join(f"lag(low, {k}) OVER o AS l{k}, coalesce(NOT lag(known, {k}) OVER o, false) AS t{k}, lag(b, {k}) OVER o AS b{k}, lag(neg, {k}) OVER o AS n{k}, lag(caps, {k}) OVER o AS c{k}" for k in (1, 2, 3))}
    FROM qa WINDOW d AS (PARTITION BY kafka_partition, kafka_offset), o AS (PARTITION BY kafka_partition, kafka_offset ORDER BY i)),
  v0 AS (SELECT *, v + CASE WHEN caps AND loud THEN sign(v) * 0.733 ELSE 0 END AS x0 FROM qb WHERE known AND b = 0),
  v1 AS (SELECT *, CASE WHEN t1 AND n1 THEN y * -0.74 ELSE y END AS x1 FROM (SELECT *, {_boosted(1, 1.0)} AS y FROM v0)),
  v2 AS (SELECT *, CASE WHEN t2 AND l2 = 'never' AND l1 IN ('so', 'this') THEN y2 * 1.25 WHEN t2 AND l2 = 'without' AND l1 = 'doubt' THEN y2
    WHEN t2 AND n2 THEN y2 * -0.74 ELSE y2 END AS x2 FROM (SELECT *, {_boosted(2, 0.95)} AS y2 FROM v1)),
  v3 AS (SELECT *, CASE WHEN t3 AND l3 = 'never' AND (l2 IN ('so', 'this') OR l1 IN ('so', 'this')) THEN y3 * 1.25
    WHEN t3 AND l3 = 'without' AND (l2 = 'doubt' OR l1 = 'doubt') THEN y3 WHEN t3 AND n3 THEN y3 * -0.74 ELSE y3 END AS x3 FROM (SELECT *, {_boosted(3, 0.9)} AS y3 FROM v2)),
  v4 AS (SELECT *, CASE WHEN l1 = 'least' AND t1 AND coalesce(l2, '') NOT IN ('at', 'very') THEN x3 * -0.74 ELSE x3 END AS x4 FROM v3),
  u AS (SELECT kafka_partition, kafka_offset, sum(x4 * CASE WHEN but IS NULL THEN 1.0 WHEN i < but THEN 0.5 ELSE 1.5 END) AS s FROM v4 GROUP BY ALL),
  e AS (SELECT kafka_partition, kafka_offset, coalesce(s, 0.0) AS s, least(length(text) - length(replace(text, '!', '')), 4) * 0.292
    + CASE WHEN questions < 2 THEN 0 WHEN questions <= 3 THEN questions * 0.18 ELSE 0.96 END AS m
    FROM (SELECT *, length(text) - length(replace(text, '?', '')) AS questions FROM q) LEFT JOIN u USING (kafka_partition, kafka_offset)),
  f AS (SELECT *, s + sign(s) * m AS x FROM e),
  z AS (SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM
    (SELECT kafka_partition, kafka_offset, round(x / sqrt(x * x + 15), 4) AS compound FROM f))"""
SQL = {
    "corpus_sizes": f"WITH {_D} SELECT label, count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM d GROUP BY label",
    "tfidf_weights": f"""WITH {_D}, r AS (SELECT row_number() OVER () AS i, tokens FROM d), t AS (SELECT i, unnest(tokens) AS token FROM r),
    tf AS (SELECT i, token, count(*) AS n FROM t GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token HAVING count(*) >= 2),
    w AS (SELECT token, ln((1.0 + (SELECT count(*) FROM d)) / (1 + df)) + 1 AS idf FROM df),
    x AS (SELECT i, token, idf, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY i)) AS part FROM tf JOIN w USING (token))
    SELECT token, round(any_value(idf), 6) AS idf, round(sum(part), 4) AS weight FROM x GROUP BY token""",
    "model_floor": "SELECT true AS better",
    "stored_model": """WITH s AS (SELECT CASE WHEN len(list_filter(coalesce(tokens, []), lambda x: trim(x) <> '')) >= 2 THEN 'scored' ELSE 'skipped_too_short' END
      AS sentiment_status FROM reddit_comments_cleaned)
    SELECT sentiment_status, count(*) AS n, count(*) FILTER (sentiment_status = 'scored') AS n_labels, count(*) FILTER (sentiment_status = 'scored') AS n_fit
    FROM s GROUP BY 1""",
    "null_scores": """SELECT unnest(['no_model_available', 'pending_ml_integration']) AS sentiment_status, count(*) AS n, 0 AS n_labels FROM reddit_comments_cleaned""",
    "word_vectors": """SELECT lower(trim(t)) AS token, true AS known FROM (SELECT unnest(tokens) AS t FROM reddit_comments_cleaned)
    WHERE trim(t) <> '' GROUP BY 1 HAVING count(*) >= 5""",
    "lexicon_scores": f"WITH {_LEXICON} SELECT kafka_partition, kafka_offset, round(compound, 3) AS compound, label FROM z",
    "lexicon_labels": f"WITH {_LEXICON} SELECT sentiment_label, label, count(*) AS n FROM z JOIN reddit_comments_cleaned USING (kafka_partition, kafka_offset) GROUP BY 1, 2",
    "labelled_corpus": f"""WITH {_LEXICON}, r AS (SELECT label, language, list_filter(tokens, lambda x: trim(x) <> '') AS tokens
      FROM z JOIN reddit_comments_cleaned USING (kafka_partition, kafka_offset) WHERE label <> 'neutral')
    SELECT label, count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS tokens, count(language) AS n_languages FROM r WHERE len(tokens) >= 1 GROUP BY label""",
    "first_texts": f"""SELECT kafka_partition, kafka_offset, CASE WHEN {strip("original_body")} <> '' THEN original_body WHEN {strip("cleaned_body")} <> '' THEN cleaned_body
    ELSE coalesce(array_to_string(tokens, ' '), '') END AS text, coalesce(array_to_string(tokens, ' '), '') AS from_tokens FROM reddit_comments_cleaned""",
    "label_confusion": """WITH p AS (SELECT sentiment_label AS label, CASE WHEN sentiment_score >= 0.5 THEN 'positive' ELSE 'negative' END AS g
      FROM reddit_comments_cleaned WHERE sentiment_label IS NOT NULL AND sentiment_score IS NOT NULL),
    l AS (SELECT label FROM p UNION SELECT g FROM p), m AS (SELECT l.label, (SELECT count(*) FROM p WHERE p.label = l.label) AS support,
      (SELECT count(*) FROM p WHERE p.g = l.label) AS guessed, (SELECT count(*) FROM p WHERE p.g = l.label AND p.label = l.label) AS hit FROM l),
    r AS (SELECT *, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS r FROM m)
    SELECT label, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, support FROM r""",
    "cache_keys": "SELECT kafka_partition, kafka_offset, sha1(coalesce(array_to_string(tokens, ' '), '')) AS key FROM reddit_comments_cleaned WHERE tokens IS NOT NULL",
    "embedding_similarity": """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2)
    SELECT vec_id, round(sum(CAST(x AS DOUBLE) * m) / (sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * sqrt(sum(m * m))), 6) AS similarity
    FROM e JOIN c USING (label, i) GROUP BY vec_id""",
}
