"""Trending terms: words and two-word phrases of the comments around a keyword, counted once per comment."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rivulet.functions import text as X
from rivulet.functions.sketches import CMS_DEPTH, CMS_WIDTH
from rivulet.operators import countmin
from rivulet.operators.windows import bucket

#: Without a list of their own, trending terms leave out the stop words of the tokenizer.
STOPWORDS = X.STOPWORDS


def load_stopwords(path: str | None) -> Sequence[str]:
    """Stop words from a text file, one on each line (a list for trending terms, a language or a community); the default ones without a path."""
    if not path:
        return STOPWORDS
    with open(path, encoding="utf-8") as f:
        return sorted({w.strip().lower() for w in f if w.strip()})


def zipf_table(comments: DataFrame, least: int = 1) -> DataFrame:
    """(word, n, zipf) of the lower-cased tokens of letters: zipf is the decimal logarithm of their frequency in a billion tokens.

    Words met fewer than least times are left out of the table, not of the total.
    """
    words = comments.select(F.explode("tokens").alias("t")).select(F.lower("t").alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.where(F.col("n") >= least).select("word", "n", F.log10(F.col("n") / total.scalar() * 1e9).alias("zipf"))


def common_words(zipf: DataFrame, share: float = 0.01) -> list[str]:
    """The words that hold at least that share of all tokens, as stop words made by rule; there are 1 / share of them at most."""
    if not 0.001 <= share <= 1:
        raise ValueError("share must be from 0.001 to 1")
    return sorted(r["word"] for r in zipf.where(F.col("zipf") >= math.log10(share) + 9).select("word").collect())


def terms(tokens: Column, keyword: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The distinct terms of one comment for one keyword: countable words, and pairs of neighbouring ones.

    A word that does not count breaks a phrase. The keyword alone is no term but can be part of a phrase, however short
    it is; a phrase that is the keyword itself, or the keyword twice, is none.
    """
    kw = F.lower(keyword)

    def found(kept: Column) -> Column:
        singles = F.filter(kept, lambda t: t.isNotNull() & (t != kw))
        after = F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))
        twice = lambda a, b: (a == kw) & (b == kw)
        pairs = F.zip_with(kept, after, lambda a, b: F.when(a.isNotNull() & b.isNotNull() & ~twice(a, b), F.concat_ws(" ", a, b)))
        phrases = F.filter(pairs, lambda p: p.isNotNull() & (p != kw))
        return F.array_distinct(F.concat(singles, phrases))

    low = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.lower(t))
    return X.let(F.transform(low, lambda t: F.when(X.countable(t, stopwords) | (t == kw), t)), found)


def first_of_body(df: DataFrame, size: int) -> DataFrame:
    """Of comments with the same body in one window only the first, by time and id; a repeated body counts once.

    Bodies are compared by a 64-bit hash, and copies are combined before the shuffle, so one body may hold most rows.
    """
    row = F.struct("created_utc", "id", "tokens", "matched_keywords")
    one = df.groupBy(X.hash64(F.coalesce("original_body", F.lit(""))).alias("_h"), bucket(F.col("created_utc"), size).alias("_w")).agg(F.min(row).alias("r"))
    return one.select("r.*")


def term_rows(df: DataFrame, stopwords: Sequence[str] = STOPWORDS, *keep: str) -> DataFrame:
    """One row for each keyword and term of each comment."""
    rows = df.select(*keep, "tokens", F.explode(F.transform("matched_keywords", lambda k: F.lower(k))).alias("keyword"))
    return rows.select(*keep, "keyword", F.explode(terms(F.col("tokens"), F.col("keyword"), stopwords)).alias("term"))


def term_counts(df: DataFrame, size: int, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    rows = term_rows(df, stopwords, "created_utc")
    return rows.groupBy("keyword", bucket(F.col("created_utc"), size).alias("window_start"), "term").agg(F.count(F.lit(1)).alias("count"))


def weigh(counts: DataFrame, zipf: DataFrame | None) -> DataFrame:
    """counts (term, count, ...) with score: count times the informativeness of the rarest word of the term."""
    if zipf is None:
        return counts.withColumn("score", F.col("count").cast("double"))
    words = counts.select("term").distinct().withColumn("word", F.explode(F.split("term", " ")))
    least = words.join(zipf.select("word", "zipf"), "word", "left").groupBy("term").agg(F.min(X.known_zipf(F.col("zipf"))).alias("low"))
    return counts.join(least, "term").withColumn("score", F.col("count") * X.informativeness(F.col("low"))).drop("low")


def publish(
    counts: DataFrame, size: int, k: int = 20, min_terms: int = 30, min_count: int = 2, zipf: DataFrame | None = None
) -> DataFrame:
    """The trending record of each keyword and window with at least min_terms occurrences.

    Of the k best terms by score (count times informativeness) those with fewer than min_count are dropped afterwards, so
    a quiet window is published with no items. zipf: (word, zipf) frequencies; without them every term weighs 1. Only the
    best k of a window are ever put in one row.
    """
    weighted = weigh(counts, zipf)
    key = ["keyword", "window_start"]
    totals = counts.groupBy(*key).agg(F.sum("count").alias("stream_total")).where(F.col("stream_total") >= min_terms)
    best = weighted.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "term"))).where(F.col("rank") <= k)
    item = F.struct(F.col("term").alias("token"), "count", F.round("score", 3).alias("score"))
    listed = (
        best.where(F.col("count") >= min_count)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("r"))
        .select(*key, F.transform("r", lambda x: x["item"]).alias("items"))
    )
    none = F.array().cast("array<struct<token:string,count:bigint,score:double>>")
    return totals.join(listed, key, "left").select(
        F.lit("trending").alias("type"),
        "keyword",
        "window_start",
        (F.col("window_start") + size).alias("window_end"),
        F.coalesce("items", none).alias("items"),
        F.struct(
            F.lit("count_min").alias("kind"), F.lit(CMS_WIDTH).cast("bigint").alias("width"),
            F.lit(CMS_DEPTH).cast("bigint").alias("depth"), "stream_total",
        ).alias("sketch"),
    )


def trending(df: DataFrame, size: int, stopwords: Sequence[str] = STOPWORDS, **how) -> DataFrame:
    return publish(term_counts(first_of_body(df, size), size, stopwords), size, **how)


#: Occurrences that a task holds before it picks its candidates.
HELD = 1_000_000


def _leading(counted: DataFrame, keys: Sequence[str], capacity: int) -> DataFrame:
    """(keys, term, n): of every group the capacity terms with the largest n."""
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "term")
    return counted.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= capacity).select(*keys, "term", "n")


@dataclass(frozen=True)
class Counters:
    """A trending counter of bounded size for each group: the cells of a Count-Min sketch, and its candidates.

    The candidates (keys, term, n) are max(8 k, 128) terms; n is what was seen of them where they were among the leading
    ones, and only says which to keep. What they are ranked by is their estimate in the merged cells times their weight,
    so a telling term of modest count can still rank.
    """

    keys: tuple[str, ...]
    k: int
    cells: DataFrame
    candidates: DataFrame

    @staticmethod
    def build(rows: DataFrame, keys: Sequence[str], k: int = 20) -> Counters:
        """rows: keys and term, one row for each occurrence. A task keeps the leading terms of each group that it has seen."""
        capacity = max(8 * k, 128)
        schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
        arrow = to_arrow_schema(schema)

        def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                held.append(b)
                if sum(x.num_rows for x in held) >= HELD:
                    yield from picked(held)
                    held = []
            yield from picked(held)

        def picked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            counted = pa.Table.from_batches(held).group_by([*keys, "term"]).aggregate([([], "count_all")]).rename_columns([*keys, "term", "n"])
            counted = counted.sort_by([*[(c, "ascending") for c in keys], ("n", "descending"), ("term", "ascending")])
            names = counted.select(list(keys)).to_pandas()
            place = names.groupby(list(keys), dropna=False).cumcount().to_numpy()
            kept = counted.filter(pa.array(place < capacity))
            yield from kept.select(schema.names).cast(arrow).combine_chunks().to_batches()

        parts = rows.select(*keys, "term").mapInArrow(lead, schema)
        found = _leading(parts.groupBy(*keys, "term").agg(F.sum("n").alias("n")), keys, capacity)
        return Counters(tuple(keys), k, countmin.build(rows, keys, "term"), found)

    def merge(self, keys: Sequence[str]) -> Counters:
        """The counters of coarser groups: cells are added, candidates joined, the leading ones kept."""
        joined = self.candidates.groupBy(*keys, "term").agg(F.sum("n").alias("n"))
        return Counters(tuple(keys), self.k, countmin.merge(self.cells, keys), _leading(joined, keys, max(8 * self.k, 128)))

    def totals(self) -> DataFrame:
        """(keys, total): all occurrences of each group."""
        return self.cells.where("row = 0").groupBy(*self.keys).agg(F.sum("count").alias("total"))

    def estimates(self) -> DataFrame:
        """(keys, term, count) of the candidates of every group."""
        return countmin.estimate(self.cells, self.candidates.select(*self.keys, "term"), self.keys, "term").withColumnRenamed("estimate", "count")

    def top(self, zipf: DataFrame | None = None) -> DataFrame:
        """(keys, term, count, score, rank) of the k best terms of every group, by score, then by term."""
        scored = weigh(self.estimates(), zipf).withColumn("score", F.round("score", 2))
        w = W.partitionBy(*self.keys).orderBy(F.desc("score"), "term")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)
