"""Sentiment of a text from a table of word valences, by the published rules of valence-aware lexicon scoring.

The rules: words before a valued word that strengthen, weaken or negate it, capitals, "but", "least", exclamation and
question marks; the sum is brought into (-1, 1). The table of valences is an input: a small one is built in, a full one is
read from a file. Texts are scored by array operations over all words of an Arrow batch.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import text as X

#: Valence of some words from -4 to 4, an example of the table.
VALENCE = {
    **dict.fromkeys("amazing awesome brilliant excellent fantastic flawless love loved perfect superb wonderful".split(), 3.1),
    **dict.fromkeys("beautiful best charming delightful enjoy glad good great happy impressive lovely nice pleased thanks".split(), 2.2),
    **dict.fromkeys("better cool fine fun helpful interesting like liked okay reliable solid useful works".split(), 1.5),
    **dict.fromkeys("awful disaster disgusting dreadful hate hated horrible miserable terrible worst".split(), -3.0),
    **dict.fromkeys("angry bad broken disappointing failed garbage painful poor ridiculous sad stupid useless".split(), -2.2),
    **dict.fromkeys("annoying complaint delay issue lost problem regret slow stopped wrong".split(), -1.5),
}
#: Words that negate, strengthen and weaken (fixed values).
NEGATIONS = frozenset(
    """aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither never none
    nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent without wont wouldnt rarely seldom despite""".split()
)
STRONGER = frozenset(
    """absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely
    fabulously fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so
    substantially thoroughly totally tremendously unbelievably unusually utterly very""".split()
)
WEAKER = frozenset("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split())
#: How much a word strengthens, capitals add, a negation turns; what a distance of two or three words leaves (fixed values).
BOOST, CAPITALS, NEGATE, DISTANCE = 0.293, 0.733, -0.74, (1.0, 0.95, 0.9)
#: Characters that are worked on at once.
SLICE = 4 << 20


def read_valences(path: str) -> dict[str, float]:
    """Words and valences from a text file, separated by a tab; further columns are ignored."""
    with open(path, encoding="utf-8") as f:
        parts = [line.rstrip("\n").split("\t") for line in f if line.strip()]
    return {p[0]: float(p[1]) for p in parts}


def _words(text: str) -> list[str]:
    out = []
    for w in text.split():
        bare = w.strip(string.punctuation)
        out.append(bare if len(bare) > 2 else w)
    return out


def compounds(texts: list[str | None], valence: Mapping[str, float] = VALENCE) -> np.ndarray:
    """From -1 to 1 for each text, rounded to four places; 0 for null and blank texts and those without a valued word."""
    lists = [_words(t) if t else [] for t in texts]
    n, flat = len(texts), [w for ws in lists for w in ws]
    size = np.fromiter(map(len, lists), np.int64, n)
    owner, begin = np.repeat(np.arange(n), size), np.cumsum(size) - size
    low = [w.lower() for w in flat]
    value = np.array([valence.get(w, 0.0) for w in low], np.float64)
    valued = np.array([w in valence for w in low], bool)
    boost = np.array([BOOST if w in STRONGER else -BOOST if w in WEAKER else 0.0 for w in low], np.float64)
    negates = np.array([w in NEGATIONS or "n't" in w for w in low], bool)
    upper = np.array([w.isupper() for w in flat], bool)
    shout = np.bincount(owner[upper], minlength=n)
    mixed = (shout > 0) & (shout < size)
    word = np.array(low, dtype=object)
    at = np.flatnonzero(valued & (boost == 0))
    v, doc = value[at], owner[at]
    loud = mixed[doc]
    v = v + np.where(upper[at] & loud, np.sign(v) * CAPITALS, 0.0)
    before = lambda k: np.maximum(at - k, 0)
    is_word = lambda k, *names: np.isin(word[before(k)], names) & (at - k >= begin[doc]) if len(at) else np.zeros(0, bool)
    for k in (1, 2, 3):
        p = before(k)
        there = (at - k >= begin[doc]) & ~valued[p]
        more = boost[p] * np.where(v < 0, -1, 1)
        more = np.where((boost[p] != 0) & upper[p] & loud, more + np.where(v > 0, CAPITALS, -CAPITALS), more) * DISTANCE[k - 1]
        v = np.where(there, v + more, v)
        turned = np.where(negates[p], v * NEGATE, v)
        if k > 1:
            near = [is_word(j, "so", "this") for j in range(1, k)]
            sure = [is_word(j, "doubt") for j in range(1, k)]
            turned = np.where((word[p] == "without") & np.logical_or.reduce(sure), v, turned)
            turned = np.where((word[p] == "never") & np.logical_or.reduce(near), v * 1.25, turned)
        v = np.where(there, turned, v)
    least = is_word(1, "least") & ~valued[before(1)] & ~is_word(2, "at", "very")
    v = np.where(least, v * NEGATE, v)
    buts = np.flatnonzero(word == "but") if len(word) else np.empty(0, np.int64)
    first_but = np.full(n, np.iinfo(np.int64).max)
    first_but[owner[buts][::-1]] = buts[::-1]
    v = v * np.where(first_but[doc] == np.iinfo(np.int64).max, 1.0, np.where(at < first_but[doc], 0.5, 1.5))
    total = np.bincount(doc, v, n)
    marks = np.array([min(t.count("!"), 4) * 0.292 + (0 if (q := t.count("?")) < 2 else q * 0.18 if q <= 3 else 0.96) if t else 0.0 for t in texts])
    total = total + np.sign(total) * marks
    return np.round(total / np.sqrt(total * total + 15), 4)


def compound(text: str | None, valence: Mapping[str, float] = VALENCE) -> float:
    return float(compounds([text], valence)[0])


def score(spark: SparkSession, text: Column, valence: Mapping[str, float] = VALENCE) -> Column:
    sent = spark.sparkContext.broadcast(dict(valence))  # a word list, some thousand entries

    @F.pandas_udf("double")
    def scores(column: pd.Series) -> pd.Series:
        texts = column.tolist()
        parts = [compounds(texts[part], sent.value) for part in X.slices([len(t or "") for t in texts], SLICE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scores(text)


def label_corpus(df: DataFrame, band: float = 0.05, keep_neutral: bool = False, valence: Mapping[str, float] = VALENCE) -> DataFrame:
    """df with the compound of its text and the label; neutral records go unless they are to be kept.

    The text is the first of original_body, cleaned_body and the joined tokens that is not blank.
    """
    text = X.first_text(F.col("original_body"), F.col("cleaned_body"), tokens=F.col("tokens"))
    out = df.withColumn("vader_compound", score(df.sparkSession, text, valence)).withColumn("label", X.label_of(F.col("vader_compound"), band))
    return out if keep_neutral else out.where(F.col("label") != "neutral")


def labelled_records(labelled: DataFrame) -> DataFrame:
    """The record of a labelled corpus, as its JSON lines hold it."""
    return labelled.select("id", "tokens", "cleaned_body", "language", "matched_keywords", "label", "vader_compound")
