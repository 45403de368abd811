"""Tracked keywords: their registry, tagging of comments, and senses of ambiguous keywords."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.config import normalise_keywords
from rivulet.functions import text as X

AMBIGUOUS = "ambiguous"
#: What a keyword may consist of (a fixed value).
KEYWORD = r"^[a-z0-9 .+#-]{1,40}$"
#: Words that tell the senses of built-in ambiguous keywords (fixed values).
SENSES: dict[str, dict[str, list[str]]] = {
    "apple": {
        "company": ["iphone", "ios", "mac", "macbook", "ipad", "stock", "shares", "tim cook", "app store", "airpods"],
        "fruit": ["eat", "ate", "eating", "tree", "juice", "pie", "fruit", "orchard", "picking", "cider"],
    },
}


def valid_keyword(c: Column) -> Column:
    return F.coalesce(F.lower(X.strip(c)).rlike(KEYWORD), F.lit(False))


def clean_list(words: Column) -> Column:
    """Trimmed, lower-cased words of an array in their order, each once; null if one of them is no valid keyword."""
    w = F.array_distinct(F.transform(words, lambda x: F.lower(X.strip(x))))
    return F.when(F.forall(w, lambda x: F.coalesce(x.rlike(KEYWORD), F.lit(False))), w)


#: More tracked keywords than this are no configuration any more.
MAX_KEYWORDS = 100_000


def tracked(table: DataFrame) -> dict[str, list[str]]:
    """The control table (keyword, subkeywords) as {keyword: subkeywords}, all in normal form, each keyword once.

    It is configuration, which people write; more than MAX_KEYWORDS rows are an error, none is ever left out. Rows of one
    keyword add up. Invalid keywords and invalid sub-keywords go.
    """
    rows = table.where(valid_keyword(F.col("keyword"))).select("keyword", "subkeywords").take(MAX_KEYWORDS + 1)
    if len(rows) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} tracked keywords")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["keyword"], r["subkeywords"] or [])):
        subs = [w.strip().lower() for w in r["subkeywords"] or [] if w]
        listed = out.setdefault(r["keyword"].strip().lower(), [])
        listed += [w for w in dict.fromkeys(subs) if re.match(KEYWORD, w) and w not in listed]
    return dict(sorted(out.items()))


class Registry:
    """Tracked keywords in a control table of parquet files that streams re-read: add, remove, list, sub-keywords.

    A read that fails or finds nothing leaves the last good set in use.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path, self.last = spark, path, {}

    def load(self) -> dict[str, list[str]]:
        try:
            found = tracked(self.spark.read.schema("keyword string, subkeywords array<string>").parquet(self.path))
        except Exception:  # noqa: BLE001 - whatever hinders the read, the last good set stays in use
            found = {}
        self.last = found or self.last
        return self.last

    def _save(self, words: Mapping[str, Sequence[str]]) -> None:
        rows = [(k, list(v) or None) for k, v in sorted(words.items())]
        df = self.spark.createDataFrame(rows, "keyword string, subkeywords array<string>")
        df.coalesce(1).write.mode("overwrite").parquet(self.path)
        self.last = {k: list(v) for k, v in words.items()}

    def add(self, keyword: str) -> list[str]:
        k = keyword.strip().lower()
        if not re.match(KEYWORD, k):
            raise ValueError("a keyword has 1 to 40 letters, digits, spaces or . + # -")
        self._save({**self.load(), k: self.last.get(k, [])})
        return sorted(self.last)

    def remove(self, keyword: str) -> list[str]:
        """Without the keyword and its sub-keywords."""
        k = keyword.strip().lower()
        self._save({x: v for x, v in self.load().items() if x != k})
        return sorted(self.last)

    def set_subkeywords(self, keyword: str, words: Sequence[str]) -> list[str]:
        """Replace the sub-keywords; an empty list clears them."""
        listed = list(dict.fromkeys(w.strip().lower() for w in words))
        if any(not re.match(KEYWORD, w) for w in listed):
            raise ValueError("a sub-keyword has 1 to 40 letters, digits, spaces or . + # -")
        k = keyword.strip().lower()
        self._save({**self.load(), k: listed})
        return listed


def _form(keyword: str) -> str:
    """The words of a keyword, without what stands between them."""
    return " ".join(re.findall(r"\w+", keyword))


def _runs(words: Column, n: int) -> Column:
    """Every n neighbouring words, joined by spaces."""
    if n == 1:
        return words
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def matched(text: Column, keywords: Sequence[str]) -> Column:
    """The tracked keywords that occur as whole words in a text, in any case, sorted.

    The text is cut into words once; words and runs of words are looked up in one hash set of all keywords, so the size
    of the plan does not depend on how many there are. Only a keyword whose words are there in their order, and that has
    signs or several words, is then searched as it is written.
    """
    words = normalise_keywords(keywords)
    forms: dict[str, list[str]] = {}
    for w in words:
        forms.setdefault(_form(w), []).append(w)
    none = F.array().cast("array<string>")
    bare = forms.pop("", [])  # of signs only
    exact = [w for w in words if re.fullmatch(r"\w+", w)]
    rest = {f: [w for w in ws if w != f or " " in w] for f, ws in forms.items()}
    rest = {f: ws for f, ws in rest.items() if ws}

    def find(split: Column) -> Column:
        found = F.array_distinct(F.filter(split, lambda w: w.isin(*exact))) if exact else none
        candidates = []
        for n in sorted({f.count(" ") + 1 for f in rest}):
            of_n = [f for f in rest if f.count(" ") + 1 == n]
            candidates.append(F.array_distinct(F.filter(_runs(split, n), lambda r: r.isin(*of_n))))  # noqa: B023
        if not candidates:
            return found
        of = F.create_map(*[x for f, ws in rest.items() for x in (F.lit(f), F.array(*map(F.lit, ws)))])
        hit = lambda k: F.contains(F.lower(text), k) & F.regexp_like(text, F.concat(F.lit("(?iu)"), *_edges(k)))
        named = F.flatten(F.transform(F.concat(*candidates), lambda c: of[c]))
        return F.concat(found, F.filter(named, hit))

    found = X.let(F.filter(F.split(F.lower(text), rf"[^{X.W}]+"), lambda w: w != ""), find)
    others = [F.when(text.rlike(X.whole_word(w)), F.lit(w)) for w in bare]
    return F.array_sort(F.concat(found, F.array_compact(F.array(*others)))) if others else F.array_sort(found)


def _edges(keyword: Column) -> list[Column]:
    """The parts of a pattern for a keyword: as whole_word() of text functions, for a column."""
    word = rf"[{X.W}]"
    left = F.when(keyword.rlike(rf"^{word}"), F.lit(rf"(?<!{word})")).otherwise(F.lit(rf"(?<={word})"))
    right = F.when(keyword.rlike(rf"{word}$"), F.lit(rf"(?!{word})")).otherwise(F.lit(rf"(?={word})"))
    return [left, F.regexp_replace(keyword, r"([.+#-])", r"\\$1"), right]


def context_sense(text: Column, senses: Mapping[str, Sequence[str]]) -> Column:
    """The sense of which most context words occur in the text; ambiguous without any or with a tie."""
    counts = {s: sum((text.rlike(X.whole_word(w)).cast("int") for w in ws), F.lit(0)) for s, ws in senses.items()}
    if len(counts) < 2:
        only = next(iter(counts))
        return F.when(counts[only] > 0, only).otherwise(AMBIGUOUS)
    best = F.greatest(*counts.values())
    ties = sum(((c == best).cast("int") for c in counts.values()), F.lit(0))
    pick = F.when((best == 0) | (ties > 1), AMBIGUOUS)
    for s, c in counts.items():
        pick = pick.when(c == best, s)
    return pick


def _sense_in(senses: Mapping[str, Sequence[str]]):
    return lambda text: context_sense(text, senses)


def embedding_sense(
    tokens: list[str] | None, subs: Sequence[str], vectors: Mapping[str, list[float]], least: float = 0.20, margin: float = 0.05
) -> str:
    """The sub-keyword nearest to the mean of the known tokens' vectors.

    A sub-keyword without a vector scores 1 if it is itself a token. ambiguous if nothing scores, the best stays below
    least, or it leads the second by less than margin.
    """
    tokens = [t.lower() for t in tokens or [] if t]
    known = [np.asarray(vectors[t], float) for t in tokens if t in vectors]
    mean = np.mean(known, axis=0) if known else None
    scores = {}
    for s in subs:
        if s in vectors and mean is not None:
            v = np.asarray(vectors[s], float)
            n = np.linalg.norm(v) * np.linalg.norm(mean)
            scores[s] = float(v @ mean / n) if n else 0.0
        elif s not in vectors and s in tokens:
            scores[s] = 1.0
    ranked = sorted(scores.items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] < least or (len(ranked) > 1 and ranked[0][1] - ranked[1][1] < margin):
        return AMBIGUOUS
    return ranked[0][0]


#: Word vectors are sent to every executor; larger tables are to be cut to the words that matter.
MAX_VECTOR_BYTES = 512 << 20


def embedding_senses(
    spark, tokens: Column, words: Mapping[str, Sequence[str]], vectors: Mapping[str, list[float]], least: float = 0.20, margin: float = 0.05
) -> Column:
    """Map of the sense of each given keyword, by the rule of embedding_sense, for whole batches of token lists at once.

    The vectors are broadcast as one matrix; a vocabulary of more than MAX_VECTOR_BYTES is an error.
    """
    names = sorted(vectors)
    matrix = np.array([vectors[w] for w in names], np.float64).reshape(len(names), -1)
    if matrix.nbytes > MAX_VECTOR_BYTES:
        raise ValueError(f"word vectors of {matrix.nbytes} bytes are too many to broadcast")
    sent = spark.sparkContext.broadcast((names, matrix, {k: list(s) for k, s in words.items()}))

    @F.pandas_udf("map<string,string>")
    def senses(column: pd.Series) -> pd.Series:
        vocabulary, rows, subs = sent.value
        index, out = pd.Index(vocabulary), []
        for part in X.slices([0 if ts is None else len(ts) for ts in column], 500_000):
            lists = [[t.lower() for t in ts if t] if ts is not None else [] for ts in column.iloc[part]]
            picks = _sense_batch(lists, index, rows, subs, least, margin)
            out += [dict(zip(subs, p, strict=True)) for p in zip(*picks.values(), strict=True)]
        return pd.Series(out, dtype=object)

    return senses(tokens)


def _sense_batch(lists: list[list[str]], vocabulary: pd.Index, rows: np.ndarray, subs: Mapping[str, list[str]], least: float, margin: float) -> dict[str, np.ndarray]:
    """For each keyword the sense of every token list."""
    n, flat = len(lists), [t for ts in lists for t in ts]
    owner = np.repeat(np.arange(n), [len(ts) for ts in lists])
    at = vocabulary.get_indexer(flat) if flat else np.empty(0, np.int64)
    known = at >= 0
    count = np.bincount(owner[known], minlength=n)
    mean = np.zeros((n, rows.shape[1]))
    np.add.at(mean, owner[known], rows[at[known]])
    mean /= np.maximum(count, 1)[:, None]
    norm = np.linalg.norm(mean, axis=1)
    flat_array = np.array(flat, dtype=object)
    out = {}
    for k, listed in subs.items():
        score = np.full((len(listed), n), -np.inf)
        for j, s in enumerate(listed):
            i = vocabulary.get_indexer([s])[0]
            if i >= 0:
                length = norm * np.linalg.norm(rows[i])
                cosine = np.divide(mean @ rows[i], length, out=np.zeros(n), where=length > 0)
                score[j] = np.where(count > 0, cosine, -np.inf)
            else:
                score[j, owner[flat_array == s]] = 1.0
        best = score.argmax(axis=0)
        top = score[best, np.arange(n)]
        score[best, np.arange(n)] = -np.inf
        second = score.max(axis=0) if len(listed) > 1 else np.full(n, -np.inf)
        sure = (top >= least) & ((second == -np.inf) | (top - np.where(second == -np.inf, 0, second) >= margin))
        out[k] = np.where(sure, np.array(listed, dtype=object)[best], AMBIGUOUS)
    return out


def tag(
    df: DataFrame,
    words: Mapping[str, Sequence[str]],
    senses: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
    vectors: Mapping[str, list[float]] | None = None,
) -> DataFrame:
    """df with matched_keywords and keyword_senses. Comments without a keyword stay, with an empty list.

    words: tracked keywords with their sub-keywords. A keyword with sub-keywords gets its sense from the vectors if
    there are any, else from its context words if it has some, else it is ambiguous. A keyword without sub-keywords gets
    one only if it has context words. Texts without a cleaned body are searched in their tokens.
    """
    senses = SENSES if senses is None else senses
    text = F.coalesce(F.when(F.col("cleaned_body") != "", F.col("cleaned_body")), F.array_join("tokens", " "), F.lit(""))
    df = df.withColumn("matched_keywords", X.let(text, lambda t: matched(t, list(words))))
    by_vector = {k: s for k, s in words.items() if s and vectors}
    near = embedding_senses(df.sparkSession, F.col("tokens"), by_vector, vectors) if by_vector else None
    entries = []
    plain = {k for k, s in words.items() if s and k not in by_vector and k not in senses}
    for k in normalise_keywords(set(words) - plain):
        if near is not None and k in by_vector:
            sense = near[k]
        elif k in senses:
            sense = X.let(text, _sense_in(senses[k]))
        else:
            continue
        entries.append(F.when(F.array_contains("matched_keywords", k), F.struct(F.lit(k).alias("key"), sense.alias("value"))))
    found = F.array_compact(F.array(*entries)) if entries else F.array().cast("array<struct<key:string,value:string>>")
    if plain:  # with sub-keywords and nothing to tell them by
        unclear = F.filter("matched_keywords", lambda k: k.isin(*sorted(plain)))
        found = F.array_sort(F.concat(found, F.transform(unclear, lambda k: F.struct(k.alias("key"), F.lit(AMBIGUOUS).alias("value")))))
    return df.withColumn("keyword_senses", F.map_from_entries(found))
