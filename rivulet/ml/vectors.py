"""Word vectors for the senses of keywords: training on token lists, the vector table, neighbours."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many comments are used, a bound of the training and no filter of the data (a fixed value).
MAX_ROWS = 2_000_000


def train(comments: DataFrame, max_rows: int = MAX_ROWS, size: int = 100, min_count: int = 5, epochs: int = 5, partitions: int = 4, seed: int = 42) -> Word2VecModel:
    """Vectors of the lower-cased tokens of about max_rows comments at most, chosen by a hash."""
    tokens = F.filter(F.transform("tokens", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    df = comments.select(tokens.alias("tokens")).where(F.size("tokens") > 0)
    n = df.count()
    if n > max_rows:  # a sample spread over the whole table, by a hash of the row
        h = F.xxhash64(F.lit(seed), "tokens").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
        df = df.where(h < max_rows / n)
    return Word2Vec(inputCol="tokens", outputCol="v", vectorSize=size, minCount=min_count, maxIter=epochs, numPartitions=partitions, seed=seed).fit(df)


def lookup(model: Word2VecModel, words: Iterable[str] | None = None) -> dict[str, list[float]]:
    """The vectors of the given words, or of the whole vocabulary, which min_count bounds."""
    df = model.getVectors()
    if words is not None:
        df = df.where(F.col("word").isin(*{w.lower() for w in words}))
    return {r["word"]: [float(x) for x in r["vector"]] for r in df.collect()}


def probe(model: Word2VecModel, words: Iterable[str], n: int = 5) -> dict[str, list[str] | None]:
    """The nearest words of each word; None for one without a vector."""
    known = lookup(model, list(words))
    return {w: [r["word"] for r in model.findSynonyms(w, n).collect()] if w in known else None for w in words}
