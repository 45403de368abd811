"""The English gate of the cleaning stage: a naive Bayes classifier over letter trigrams, trained on labelled texts.

Its table of trigrams is counted in Spark and has a fixed size; texts are classified by array operations over whole
Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.functions import text as X

#: Shorter texts pass the gate unseen (a fixed value).
SHORTEST = 20
#: At most so many trigrams of each language are kept, the most frequent ones; a language has fewer that matter.
MAX_GRAMS = 50_000
#: Characters that are worked on at once.
PIECE = 1 << 20
#: What is added to each count.
SMOOTH = 0.5


@dataclass(frozen=True)
class Detector:
    """grams: the sorted codes of the known trigrams; log: their log-probability in each language."""

    languages: tuple[str, ...]
    grams: np.ndarray
    log: np.ndarray

    def detect(self, texts: list[str]) -> list[str | None]:
        """The likeliest language of each text (the first one of several); None for a text without a known trigram."""
        score, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        held, rows, size = [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, max(len(t) - 2, 0), PIECE):  # a long text counts piece by piece
                held.append(t[at : at + PIECE + 2])
                rows.append(i)
                size += len(held[-1])
                if size >= PIECE:
                    self._add(held, rows, score, seen)
                    held, rows, size = [], [], 0
        self._add(held, rows, score, seen)
        return [self.languages[j] if s else None for j, s in zip(score.argmax(axis=1).tolist(), seen.tolist(), strict=True)]

    def _add(self, pieces: list[str], rows: list[int], score: np.ndarray, seen: np.ndarray) -> None:
        """Add the log-probabilities of pieces without line ends to the scores of the texts that they belong to."""
        if not pieces or not len(self.grams):
            return
        c = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        piece, codes = np.cumsum(c == 10), _codes(c)
        inside = (c[:-2] != 10) & (c[1:-1] != 10) & (c[2:] != 10)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        known = np.flatnonzero(inside & (self.grams[at] == codes))
        of = piece[known]
        if len(of):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            row = np.array(rows)[of[starts]]
            np.add.at(score, row, np.add.reduceat(self.log[at[known]], starts, axis=0))
            seen[row] = True


def _codes(c: np.ndarray) -> np.ndarray:
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def letters(text: Column) -> Column:
    """The words of a text in lower case, with one space before, between and behind them."""
    return F.concat(F.lit(" "), X.strip(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))), F.lit(" "))


def trigrams(text: Column) -> Column:
    t = letters(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))


def train(samples: DataFrame, max_grams: int = MAX_GRAMS) -> Detector:
    """A detector from samples (lang, text). Rows without a language or a letter are left out; no sample at all is an error."""
    known = samples.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.select("lang", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= max_grams)
    rows = kept.select("lang", "gram", "n").toPandas()
    if rows.empty:
        raise ValueError("labelled texts are needed")
    languages = tuple(sorted(rows["lang"].unique()))
    names = sorted(rows["gram"].unique())
    text = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3)
    codes = (text[:, 0] << 42) | (text[:, 1] << 21) | text[:, 2]
    n = np.zeros((len(names), len(languages)))
    n[pd.Index(names).get_indexer(rows["gram"]), pd.Index(languages).get_indexer(rows["lang"])] = rows["n"]
    order = np.argsort(codes)
    log = np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * len(names)))
    return Detector(languages, codes[order], log[order])


def detect(spark: SparkSession, text: Column, detector: Detector) -> Column:
    """The language of a text; null for texts without a letter, or none of whose trigrams is known."""
    sent = spark.sparkContext.broadcast(detector)  # a table of bounded size, see MAX_GRAMS

    @F.pandas_udf("string")
    def language(column: pd.Series) -> pd.Series:
        return pd.Series(sent.value.detect(column.tolist()), dtype=object)

    return language(letters(F.coalesce(text, F.lit(""))))


def is_english(spark: SparkSession, text: Column, detector: Detector | None) -> Column:
    """Blank texts and texts of fewer than 20 characters pass, others if they are in English.

    Without a detector, and where it knows nothing of a text, everything passes.
    """
    if detector is None:
        return F.lit(True)
    short = F.length(X.strip(F.coalesce(text, F.lit("")))) < SHORTEST
    return short | (F.coalesce(detect(spark, text, detector), F.lit("en")) == "en")
