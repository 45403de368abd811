"""Queries of the corpus problems, and the SQL that checks those which SQL can state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.llm import abuse, distinct, frequent, language, mix, split, tokens
from rivulet.session import cut, table

TOKENS_SHARE, ITEMS_SHARE = 0.0031, 0.01
NO_AUTHORS = ("", "None", "[deleted]")


def _token_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reddit_comments_cleaned").where(F.col("tokens").isNotNull()).select("tokens")


def _item_lists(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "analytics_results").where(F.col("items").isNotNull())
    return items.select(F.col("items.token").alias("tokens"), F.col("items.count").alias("weights"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms with at least the given share of all occurrences, through the sketch and an exact second pass."""
    a = frequent.frequent(_token_lists(spark, d), TOKENS_SHARE).items.select(F.lit("tokens").alias("field"), "item")
    b = frequent.frequent(_item_lists(spark, d), ITEMS_SHARE).items.select(F.lit("items").alias("field"), "item")
    return a.unionByName(b)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same terms with their counts."""
    a = frequent.frequent(_token_lists(spark, d), TOKENS_SHARE).items.select(F.lit("tokens").alias("field"), "item", "count")
    b = frequent.frequent(_item_lists(spark, d), ITEMS_SHARE).items.select(F.lit("items").alias("field"), "item", "count")
    return a.unionByName(b)


def _author_rows(spark: SparkSession, d: str) -> DataFrame:
    """Authors by day, subreddit and keyword; rows without a keyword stand under a null one."""
    df = table(spark, d, "reddit_comments_cleaned").where(~F.col("author").isin(*NO_AUTHORS))
    return df.select(
        F.to_date(F.timestamp_seconds("created_utc")).alias("day"),
        "subreddit",
        F.explode_outer("matched_keywords").alias("keyword"),
        "author",
    )


#: A segment counts as written in its language from this confidence and so many words on.
SURE, MIN_WORDS = 0.55, 4
#: A segment of fewer words counts from this confidence on.
SHORT_SURE = 0.9


def _stands(s: Column) -> Column:
    """Whether a segment counts as written in its language."""
    sure = F.when(s["words"] >= MIN_WORDS, s["confidence"] >= SURE).otherwise(s["confidence"] >= SHORT_SURE)
    return (s["language"] != language.UND) & sure


def _network(spark: SparkSession, d: str) -> language.Network:
    comments = table(spark, d, "reddit_comments_cleaned")
    claimed = comments.select(language.stated(F.col("language")).alias("lang"), F.col("original_body").alias("text"))
    return language.fit(table(spark, d, "language_samples"), claimed)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages in which a comment is written and which its label does not state."""
    df = table(spark, d, "reddit_comments_cleaned").where(F.col("id").isNotNull() & ~F.col("id").isin("", "None"))
    df = df.withColumn("stated", language.stated(F.col("language")))
    found = language.segments(df, _network(spark, d), ["id", "stated"], "original_body", with_text=False)
    return (
        found.where(F.col("n_words") >= MIN_WORDS)
        .select("id", "stated", F.explode("segments").alias("s"))
        .where(_stands(F.col("s")))
        .where(~F.col("stated").eqNullSafe(F.col("s.language")))
        .select("id", F.col("s.language").alias("language"))
        .distinct()
    )


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every cleaned comment with its language and confidence, beside the label."""
    df = table(spark, d, "reddit_comments_cleaned").withColumn("stated", language.stated(F.col("language")))
    keys = ["kafka_partition", "kafka_offset", "id", "stated"]
    found = language.segments(df, _network(spark, d), keys, "original_body")
    return found.select(*keys, F.posexplode("segments").alias("segment", "s")).select(*keys, "segment", "s.*")


def p5_comments(spark: SparkSession, d: str) -> DataFrame:
    """The main language of every raw comment, by words, with its confidence and the number of languages."""
    keys = ["kafka_partition", "kafka_offset", "id"]
    found = language.segments(table(spark, d, "reddit_comments"), _network(spark, d), keys, "body", with_text=False)
    by_words = lambda x, y: (y["words"] - x["words"]).cast("int")
    main = F.element_at(F.array_sort("segments", by_words), 1)
    return found.select(
        *keys,
        F.when(F.size("segments") > 0, main["language"]).alias("language"),
        F.when(F.size("segments") > 0, main["confidence"]).alias("confidence"),
        F.size(F.array_distinct("segments.language")).alias("n_languages"),
    )


_KEYS = ["day", "subreddit", "keyword"]


def p6_authors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors of each day, subreddit and keyword and of every combination of these, with three-sigma bounds."""
    whole = distinct.cube(_author_rows(spark, d), _KEYS, "author", {"keyword": F.col("keyword").isNotNull()})
    return distinct.estimate_packed(whole, ["level", *_KEYS])


def p6_published(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors by keyword and day beside the published reach: its windows, their sum and their largest value."""
    rows = _author_rows(spark, d).where(F.col("keyword").isNotNull())
    mine = distinct.estimate_packed(distinct.cube(rows, ["day", "keyword"], "author", sets=[["day", "keyword"]]), ["day", "keyword"])
    published = (
        table(spark, d, "analytics_results")
        .where((F.col("type") == "reach") & F.col("keyword").isNotNull())
        .groupBy(F.to_date(F.timestamp_seconds("window_start")).alias("day"), "keyword")
        .agg(
            F.count("unique_authors").alias("windows"),
            F.sum("unique_authors").alias("sum_of_windows"),
            F.max("unique_authors").alias("largest_window"),
        )
    )
    return mine.join(published, ["day", "keyword"], "full")


def p6_published_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The published columns of p6_published, and whether the exact count lies within the bounds or two of the estimate."""
    rows = _author_rows(spark, d).where(F.col("keyword").isNotNull())
    exact = rows.groupBy("day", "keyword").agg(F.count_distinct("author").alias("exact"))
    got = p6_published(spark, d).join(exact, ["day", "keyword"], "left")
    ok = F.coalesce(F.col("exact").between(F.col("low") - 2, F.col("high") + 2), F.col("estimate").isNull() & F.col("exact").isNull())
    return got.select("day", "keyword", "windows", "sum_of_windows", "largest_window", ok.alias("within"))


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    """By level, how many groups there are and how many have their exact count within the three-sigma bounds or two of the estimate."""
    got = p6_authors(spark, d)
    rows = _author_rows(spark, d)
    kw = F.col("keyword").isNotNull()
    exact = None
    for level, keys, fits in (("day", ["day"], None), ("subreddit", ["subreddit"], None), ("keyword", ["keyword"], kw), ("day+subreddit", ["day", "subreddit"], None), ("day+keyword", ["day", "keyword"], kw), ("subreddit+keyword", ["subreddit", "keyword"], kw), ("day+subreddit+keyword", _KEYS, kw), ("all", [], None)):
        e = (rows if fits is None else rows.where(fits)).groupBy(*keys).agg(F.count_distinct("author").alias("exact"))
        e = e.select(F.lit(level).alias("level"), *[(F.col(k) if k in keys else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in _KEYS], "exact")
        exact = e if exact is None else exact.unionByName(e)
    g, e = got.alias("g"), exact.alias("e")
    same = F.col("g.level") == F.col("e.level")
    for k in _KEYS:
        same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"e.{k}"))
    ok = F.col("exact").between(F.col("low") - 2, F.col("high") + 2)
    return e.join(g, same, "left").groupBy("e.level").agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(ok, 1)).alias("n_within"))


def _scored(spark: SparkSession, d: str, restored: bool = True) -> DataFrame:
    comments = table(spark, d, "reddit_comments")
    scorer = abuse.fit(comments, table(spark, d, "moderation_labels"), table(spark, d, "language_samples"))
    return abuse.score(comments, scorer, ["kafka_partition", "kafka_offset", "id", "subreddit"], "body", restored)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The comments with an abusive body."""
    found = _scored(spark, d, restored=False).where((F.col("id") != "") & (F.col("score") >= abuse.THRESHOLD))
    return found.select("id").distinct()


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every comment, with the restored sentence that it comes from."""
    return _scored(spark, d)


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per subreddit, the comments, the abusive ones and their share."""
    bad = F.count(F.when(F.col("score") >= abuse.THRESHOLD, 1))
    return _scored(spark, d, restored=False).groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_comments"), bad.alias("n_abusive"), (bad / F.count(F.lit(1))).alias("rate")
    )


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode(table(spark, d, "documents"))


def p8_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of all tokens of every document, which are those of its text, and the end of what they decode to."""

    @F.pandas_udf("bytes bigint, tail string")
    def decoded(column: pd.Series) -> pd.DataFrame:
        lengths = tokens.encoder()[1]
        return pd.DataFrame({"bytes": [int(lengths[np.asarray(x, np.int64)].sum()) for x in column], "tail": [tokens.decode([int(i) for i in x[-40:]])[-8:] for x in column]})

    return tokens.encode(table(spark, d, "documents")).select("doc_id", decoded("ids").alias("r")).select("doc_id", "r.*")


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    listed = docs.where(F.col("text").isNotNull()).join(F.broadcast(targets.select("source")), "source", "left_semi")
    return tokens.measure(listed, ["doc_id", "source"]), targets


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: each chosen document with how often it is used."""
    return mix.mix(*_sized(spark, d), "doc_id")[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """What the mixture takes from each source, beside the target shares."""
    return mix.mix(*_sized(spark, d), "doc_id")[1]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """By listed source, whether it is used within its cap, and whether it gives its share of the largest total at which all can.

    Records are taken whole, so that a share can be missed by part of a record: by a five-hundredth of it, or less than the
    largest record of the source.
    """
    sized, targets = _sized(spark, d)
    sized = cut(sized)
    report = mix.mix(sized, targets, "doc_id")[1]
    largest = sized.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    total = report.where("size > 0").agg(F.floor(F.min(F.col("size") * F.col("max_repeats") / F.col("target_share"))).alias("t"))
    wanted = F.col("target_share") * total.scalar()
    near = F.abs(F.col("tokens") - wanted) <= F.greatest(mix.TOLERANCE * wanted, F.coalesce("largest", F.lit(0)))
    return report.join(F.broadcast(largest), "source", "left").select(  # one row for each listed source
        "source", "target_share", "max_repeats", (F.col("repeats") <= F.col("max_repeats")).alias("within_cap"), (near | (F.col("size") == 0)).alias("near")
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are longer than 512 tokens, from the pieces that they are cut into."""
    return split.split(table(spark, d, "documents"), with_text=False).where("piece = 0").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all long documents."""
    return split.split(table(spark, d, "documents"))


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of every document of over 512 words: whether its pieces stay within the limit, follow each other with an overlap and cover the whole text."""
    pieces = p10_pieces(spark, d)
    w = W.partitionBy("doc_id").orderBy("piece")
    follows = F.col("start").between(F.lag("start").over(w) + 1, F.lag("end").over(w))
    marked = pieces.withColumn("_ok", F.when(F.col("piece") == 0, F.col("start") == 0).otherwise(follows) & (F.col("n_tokens") <= 512) & (F.length("text") == F.col("end") - F.col("start")))
    by_doc = marked.groupBy("doc_id").agg(F.min("_ok").alias("ok"), F.max("end").alias("end"))
    docs = table(spark, d, "documents").where(F.size(F.regexp_extract_all("text", F.lit("[^ \\t\\r\\n]+"), F.lit(0))) > 512).select("doc_id", F.length("text").alias("n"))
    return docs.join(by_doc, "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(False)).alias("ok"), (F.coalesce("end", F.lit(0)) == F.col("n")).alias("whole"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_counts, p5_found, p5_segments, p5_comments, p6_authors, p6_published, p6_published_bounds, p6_bounds, p7_found, p7_scores, p7_rates,
        p8_ids, p8_bytes, p9_mixture, p9_shares, p9_checks, p10_found, p10_pieces, p10_checks,
    )
}

_P1 = """WITH t AS (SELECT lower(unnest(tokens)) AS item FROM reddit_comments_cleaned),
  tc AS (SELECT item, count(*) AS count FROM t WHERE trim(item) <> '' GROUP BY item),
  i AS (SELECT unnest(items) AS x FROM analytics_results),
  ic AS (SELECT lower(x.token) AS item, CAST(sum(coalesce(x.count, 0)) AS BIGINT) AS count FROM i WHERE trim(x.token) <> '' GROUP BY 1),
  f AS (SELECT 'tokens' AS field, * FROM tc WHERE count >= 0.0031 * (SELECT sum(count) FROM tc)
  UNION ALL SELECT 'items', * FROM ic WHERE count >= 0.01 * (SELECT sum(count) FROM ic))"""
_GROUPS = """WITH r AS (SELECT CAST(to_timestamp(created_utc) AS DATE) AS day, subreddit, author, matched_keywords AS k
    FROM reddit_comments_cleaned WHERE author NOT IN ('', 'None', '[deleted]')),
  w AS (SELECT day, subreddit, unnest(k) AS keyword FROM r), g AS (
  SELECT DISTINCT 'day' AS level, day, NULL AS subreddit, NULL AS keyword FROM r UNION ALL
  SELECT DISTINCT 'subreddit', NULL, subreddit, NULL FROM r UNION ALL SELECT DISTINCT 'day+subreddit', day, subreddit, NULL FROM r UNION ALL
  SELECT DISTINCT 'keyword', NULL, NULL, keyword FROM w WHERE keyword IS NOT NULL UNION ALL
  SELECT DISTINCT 'day+keyword', day, NULL, keyword FROM w WHERE keyword IS NOT NULL UNION ALL
  SELECT DISTINCT 'subreddit+keyword', NULL, subreddit, keyword FROM w WHERE keyword IS NOT NULL UNION ALL
  SELECT DISTINCT 'day+subreddit+keyword', day, subreddit, keyword FROM w WHERE keyword IS NOT NULL UNION ALL
  SELECT DISTINCT 'all', NULL, NULL, NULL FROM r)"""

SQL = {
    "p1_found": f"{_P1} SELECT field, item FROM f",
    "p1_counts": f"{_P1} SELECT * FROM f",
    "p6_published_bounds": """WITH a AS (SELECT DISTINCT CAST(to_timestamp(created_utc) AS DATE) AS day, unnest(matched_keywords) AS keyword
      FROM reddit_comments_cleaned WHERE author NOT IN ('', 'None', '[deleted]')),
    r AS (SELECT CAST(to_timestamp(window_start) AS DATE) AS day, keyword, count(unique_authors) AS windows, CAST(sum(unique_authors) AS BIGINT) AS sum_of_windows,
      max(unique_authors) AS largest_window FROM analytics_results WHERE type = 'reach' AND keyword IS NOT NULL GROUP BY 1, 2)
    SELECT day, keyword, windows, sum_of_windows, largest_window, true AS within FROM a FULL JOIN r USING (day, keyword) WHERE keyword IS NOT NULL""",
    "p8_bytes": "SELECT doc_id, coalesce(strlen(text), 0) AS bytes, coalesce(right(text, 8), '') AS tail FROM documents",
    "p9_checks": "SELECT source, target_share, max_repeats, true AS within_cap, true AS near FROM mix_targets",
    "p10_checks": "SELECT doc_id, true AS ok, true AS whole FROM documents WHERE len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) > 512",
    "p6_bounds": f"{_GROUPS} SELECT level, count(*) AS n_groups, count(*) AS n_within FROM g GROUP BY level",
}
