"""Queries of the processing stages, from raw JSON to windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.config import parse_subkeywords
from rivulet.functions import sketches
from rivulet.functions import text as X
from rivulet.operators import countmin, keywords, language, late, parse, trending, windows
from rivulet.plans.stated import LANGUAGE, STOP, WORD, clean, has_word, listed, strip, tokens
from rivulet.schemas import RAW
from rivulet.session import scratch, table
from rivulet.sources import replay

POS = ["kafka_partition", "kafka_offset"]
HOUR, FIVE_MINUTES = 3600, 300
#: Context words of senses that the tables have (an example of the parameter; fixed values).
SENSES = {
    "python": {"language": ["firmware", "software", "update", "version"], "snake": ["greenhouse", "tent", "festival"]},
    "mercury": {"planet": ["telescope", "orbit", "night"], "metal": ["thermostat", "sensor", "charger"]},
}


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reddit_comments_cleaned")


def raw_json(spark: SparkSession, d: str) -> DataFrame:
    """The raw comments as the JSON that a topic carries."""
    df = table(spark, d, "reddit_comments")
    return df.select(F.to_json(F.struct(*RAW.names), {"ignoreNullFields": "false"}).alias("value"), *POS)


def parse_valid(spark: SparkSession, d: str) -> DataFrame:
    return parse.valid(parse.parse(raw_json(spark, d))).select(*RAW.names, *POS)


def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse(raw_json(spark, d)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def parse_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The rejected records parsed again, with the class of their error."""
    df = table(spark, d, "reddit_comments_malformed").withColumnRenamed("raw", "value")
    found = parse.parse(df.select("value", F.col("ingest_ts").alias("arrival")))
    out = parse.malformed(found.withColumnRenamed("arrival", "at"), F.col("at"))
    return out.select("raw", F.regexp_replace("error", "^json_decode_error.*", "json_decode_error").alias("error"), "ingest_ts")


def malformed_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.split_part(F.col("error"), F.lit(":"), F.lit(1))
    return table(spark, d, "reddit_comments_malformed").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reddit_comments").select(*POS, X.clean(F.col("body")).alias("cleaned_body"))


def token_lists(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.tokenize(F.col("cleaned_body"))
    return _cleaned(spark, d).select(*POS, F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("bigint").alias("n"))


def tokens_without_stopwords(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.tokenize(F.col("cleaned_body"), X.STOPWORDS)
    return _cleaned(spark, d).select(*POS, F.array_join(tokens, "|").alias("tokens"))


def clean_lower(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reddit_comments").select(*POS, X.clean(F.col("body"), lower=True).alias("cleaned_body"))


def detector(spark: SparkSession, d: str) -> language.Detector:
    return language.train(table(spark, d, "language_samples"))


def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    found = language.detect(spark, X.clean(F.col("body")), detector(spark, d))
    return table(spark, d, "reddit_comments").select(*POS, found.alias("language"))


def english_gate(spark: SparkSession, d: str) -> DataFrame:
    found = language.is_english(spark, X.clean(F.col("body")), detector(spark, d))
    return table(spark, d, "reddit_comments").select(*POS, found.alias("english"))


def cleaned_comments(spark: SparkSession, d: str) -> DataFrame:
    """Raw JSON to cleaned records: parse, clean, English gate, tokens."""
    out = parse.cleaned(parse.valid(parse.parse(raw_json(spark, d))), detector(spark, d))
    return out.select("id", "author", "created_utc", "subreddit", "original_body", "cleaned_body", F.array_join("tokens", "|").alias("tokens"), "score", "controversiality", "language", *POS)


def tag_comments(spark: SparkSession, d: str) -> DataFrame:
    words = keywords.tracked(table(spark, d, "tracked_keywords"))
    tagged = keywords.tag(_cleaned(spark, d).drop("matched_keywords", "keyword_senses"), words, SENSES)
    senses = F.transform(F.array_sort(F.map_entries("keyword_senses")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return tagged.select(*POS, F.array_join("matched_keywords", "|").alias("matched"), F.array_join(senses, "|").alias("senses"))


def keyword_set(spark: SparkSession, d: str) -> DataFrame:
    """Tracked keywords in normal form with their sub-keywords, as the registry gives them after changes by hand."""
    registry = keywords.Registry(spark, scratch(spark, "registry"))
    for k, subs in keywords.tracked(table(spark, d, "tracked_keywords")).items():
        registry.last[k] = subs
    registry.set_subkeywords(" New Word ", ["B", "a", "b "])
    registry.add("Zebra")
    registry.remove(" ANCHOR")
    found = keywords.Registry(spark, registry.path).load()
    return spark.createDataFrame([(k, "|".join(s)) for k, s in found.items()], "keyword string, subkeywords string")


def keyword_validity(spark: SparkSession, d: str) -> DataFrame:
    """Whether each token could be a tracked keyword."""
    tokens = _cleaned(spark, d).select(F.explode("tokens").alias("token")).distinct()
    return tokens.select("token", keywords.valid_keyword(F.col("token")).alias("valid"))


def subkeyword_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of sub-keywords in normal form, null where one of them is invalid; the same from the text form of settings."""
    df = table(spark, d, "tracked_keywords")
    own = df.select("keyword", F.array_join(keywords.clean_list(F.col("subkeywords")), "|").alias("words"), F.lit("list").alias("origin"))
    text = ";".join(f" {r['keyword'].upper()} : {', '.join(r['subkeywords'])},," for r in df.where("subkeywords IS NOT NULL").collect())
    parsed = parse_subkeywords(f"bad;:x;y:;{text}")
    return own.unionByName(spark.createDataFrame([(k, "|".join(v), "text") for k, v in parsed.items()], "keyword string, words string, origin string"))


def _token_vectors(spark: SparkSession, d: str) -> dict[str, list[float]]:
    """Vectors for the tokens met five times, an example of a vocabulary: that of number 7 * code + length among the embeddings."""
    words = _cleaned(spark, d).select(F.explode("tokens").alias("t")).groupBy(F.lower("t").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5 AND word <> ''")
    at = words.select("word", ((7 * F.ascii("word") + F.length("word")) % 400).cast("bigint").alias("vec_id"))
    rows = at.join(table(spark, d, "embeddings"), "vec_id").select("word", "embedding").collect()
    return {r["word"]: [float(x) for x in r["embedding"]] for r in rows}


def embedding_senses(spark: SparkSession, d: str) -> DataFrame:
    """Senses of the keywords with sub-keywords by word vectors, and the tags of comments that they give."""
    words = keywords.tracked(table(spark, d, "tracked_keywords"))
    tagged = keywords.tag(_cleaned(spark, d).drop("matched_keywords", "keyword_senses"), words, {}, _token_vectors(spark, d))
    senses = F.transform(F.array_sort(F.map_entries("keyword_senses")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return tagged.where(F.size("keyword_senses") > 0).select(*POS, F.array_join(senses, "|").alias("senses"))


def keyword_fanout(spark: SparkSession, d: str) -> DataFrame:
    return windows.keyword_rows(_cleaned(spark, d), *POS)


def sentiment_windows(spark: SparkSession, d: str) -> DataFrame:
    """Positive ratio of every keyword and hour."""
    return windows.sentiment(_cleaned(spark, d), HOUR)


def sentiment_minutes(spark: SparkSession, d: str) -> DataFrame:
    return windows.sentiment(_cleaned(spark, d), 60)


def reach_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.reach(_cleaned(spark, d), FIVE_MINUTES).select("keyword", "window_start", "window_end", "unique_authors", "comment_count")


def reach_merged(spark: SparkSession, d: str) -> DataFrame:
    """Hours from the sketches of five minutes."""
    return windows.merge_reach(windows.reach_sketches(_cleaned(spark, d), FIVE_MINUTES), HOUR)


def trending_terms(spark: SparkSession, d: str) -> DataFrame:
    return trending.term_counts(trending.first_of_body(_cleaned(spark, d), HOUR), HOUR)


def trending_windows(spark: SparkSession, d: str) -> DataFrame:
    out = trending.trending(_cleaned(spark, d), 24 * HOUR)
    items = F.transform("items", lambda i: F.concat_ws(":", i["token"], i["count"]))
    return out.select("keyword", "window_start", "window_end", F.array_join(items, "|").alias("items"), F.col("sketch.stream_total").alias("stream_total"))


def zipf_words(spark: SparkSession, d: str) -> DataFrame:
    """Zipf frequencies of the words of all comments."""
    return trending.zipf_table(_cleaned(spark, d)).withColumn("zipf", F.round("zipf", 6))


def trending_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Trending windows of a day ranked by count times informativeness, without the words that hold 1 % of all tokens."""
    zipf = trending.zipf_table(_cleaned(spark, d))
    stop = [*trending.STOPWORDS, *trending.common_words(zipf, 0.01)]
    out = trending.trending(_cleaned(spark, d), 24 * HOUR, stop, zipf=zipf)
    items = F.transform("items", lambda i: F.concat_ws(":", i["token"], i["count"]))
    return out.select("keyword", "window_start", F.array_join(items, "|").alias("items"))


def trending_counters(spark: SparkSession, d: str) -> DataFrame:
    """Trending counters of six hours merged to days: their terms, the estimates that are too low (none), how many of the terms
    with 1 % of all occurrences are among the candidates (all), and how many terms are ranked."""
    rows = trending.term_rows(trending.first_of_body(_cleaned(spark, d), HOUR), trending.STOPWORDS, "created_utc")
    rows = rows.withColumns({"window_start": windows.bucket(F.col("created_utc"), 6 * HOUR), "day": windows.bucket(F.col("created_utc"), 24 * HOUR)})
    days = trending.Counters.build(rows, ["keyword", "window_start", "day"]).merge(["keyword", "day"])
    exact = rows.groupBy("keyword", "day", "term").agg(F.count(F.lit(1)).alias("n"))
    totals = days.totals().withColumnRenamed("total", "n_terms")
    got = exact.join(totals, ["keyword", "day"]).join(days.estimates(), ["keyword", "day", "term"], "left")
    ranked = days.top().groupBy("keyword", "day").agg(F.count(F.lit(1)).alias("n_ranked"))
    heavy = F.col("n") >= F.col("n_terms") * 0.01
    by_day = got.groupBy("keyword", "day", "n_terms").agg(
        F.count(F.when(F.col("count") < F.col("n"), 1)).alias("n_low"),
        F.count(F.when(heavy, 1)).alias("n_heavy"),
        F.count(F.when(heavy & F.col("count").isNotNull(), 1)).alias("n_found"),
    )
    return by_day.join(ranked, ["keyword", "day"])


def sketch_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per keyword, how many terms a Count-Min sketch counts, how many too low, and whether 95 % keep the bound of e / width."""
    rows = trending.term_rows(_cleaned(spark, d)).select("keyword", "term")
    exact = rows.groupBy("keyword", "term").agg(F.count(F.lit(1)).alias("n"))
    got = countmin.estimate(countmin.build(rows, ["keyword"], "term"), exact, ["keyword"], "term")
    total = rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("total"))
    over = F.col("estimate") - F.col("n") <= F.col("total") * 2.718281828 / countmin.CMS_WIDTH
    return exact.join(got, ["keyword", "term"]).join(total, "keyword").groupBy("keyword").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.count(F.when(F.col("estimate") < F.col("n"), 1)).alias("n_low"),
        (F.avg(F.when(over, 1.0).otherwise(0.0)) >= 0.95).alias("within_bound"),
    )


def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent keywords, by the built-in sketch of frequent items."""
    rows = _cleaned(spark, d).select(F.explode("matched_keywords").alias("keyword"))
    top = rows.agg(F.explode(sketches.top_values(F.col("keyword"), 10)).alias("t"))
    return top.select(F.col("t.item").alias("keyword"), F.col("t.count").alias("n"))


def late_drops(spark: SparkSession, d: str) -> DataFrame:
    df = _cleaned(spark, d).where(F.col("created_utc") > 0)
    return late.late_drops(df, HOUR, 5, 600)


def language_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return windows.by_language(_cleaned(spark, d))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return windows.label_counts(_cleaned(spark, d))


def replay_range(spark: SparkSession, d: str) -> DataFrame:
    out = parse.decode_dump(raw_json(spark, d), start=replay.DATE_START, end=replay.DATE_END)
    return out.select(*RAW.names, *POS)


def replay_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal creation times in the order of arrival, by partition."""
    df = table(spark, d, "reddit_comments").where(F.col("created_utc").isNotNull())
    return replay.runs(df, ["kafka_partition"], ["kafka_offset"], "created_utc")


def replay_slice(spark: SparkSession, d: str) -> DataFrame:
    """Records 100 to 599 of the window in the order of arrival."""
    df = table(spark, d, "reddit_comments").where(F.col("created_utc").between(replay.DATE_START, replay.DATE_END))
    return replay.slice_of(df, ["ingest_ts", *POS], 100, 500).select(*POS, "id", "created_utc")


QUERIES = {
    f.__name__: f
    for f in (
        sentiment_windows, sentiment_minutes, reach_windows, reach_merged, trending_terms, trending_windows, trending_weighted,
        trending_counters, zipf_words, sketch_bounds, top_keywords, late_drops,
        parse_valid, parse_errors, parse_rejected, malformed_counts, clean_bodies, token_lists, tokens_without_stopwords,
        clean_lower, detected_languages, english_gate, cleaned_comments, tag_comments, keyword_set, keyword_validity,
        subkeyword_lists, embedding_senses, keyword_fanout, language_breakdown, label_counts, replay_range,
        replay_groups, replay_slice,
    )
}


_VALID = f"body IS NOT NULL AND {strip('body')} <> '' AND body NOT IN ('[deleted]', '[removed]') AND created_utc >= 0"
_FAN = """SELECT kafka_partition, kafka_offset, created_utc, sentiment_label, k AS base_keyword,
  CASE WHEN coalesce(keyword_senses[k], '') <> '' THEN k || ':' || keyword_senses[k] ELSE k END AS keyword
  FROM (SELECT *, unnest(matched_keywords) AS k FROM reddit_comments_cleaned WHERE sentiment_label <> '')"""
_AUTHORS = """SELECT created_utc, ingest_ts, author, unnest(matched_keywords) AS keyword FROM reddit_comments_cleaned
  WHERE author NOT IN ('', '[deleted]')"""


def _terms_sql(source: str, common: str = "[]") -> str:
    stop = f"list_concat({listed(STOP)}, common)"
    return f"""k AS (SELECT *, lower(unnest(matched_keywords)) AS keyword, {common} AS common FROM {source}),
  t AS (SELECT * EXCLUDE (tokens), list_transform(coalesce(tokens, []), lambda x: lower(x)) AS tokens FROM k),
  m AS (SELECT *, list_transform(tokens, lambda x: CASE WHEN x = keyword OR (length(x) >= 3 AND regexp_full_match(x, '\\p{{L}}+')
    AND NOT list_contains({stop}, x)) THEN x END) AS kept FROM t),
  s AS (SELECT *, unnest(list_distinct(list_concat(list_filter(kept, lambda x: x IS NOT NULL AND x <> keyword),
    list_filter(list_transform(range(1, len(kept)), lambda i: CASE WHEN kept[i] IS NOT NULL AND kept[i + 1] IS NOT NULL
      AND NOT (kept[i] = keyword AND kept[i + 1] = keyword) THEN kept[i] || ' ' || kept[i + 1] END),
      lambda x: x IS NOT NULL AND x <> keyword)))) AS term FROM m)"""


_ZIPF = """z AS (SELECT word, count(*) AS n, log10(count(*) / sum(count(*)) OVER () * 1e9) AS zipf FROM
    (SELECT lower(unnest(tokens)) AS word FROM reddit_comments_cleaned) WHERE regexp_full_match(word, '\\p{L}+') GROUP BY word)"""


def _first_sql(size: int) -> str:
    return f"""f AS (SELECT * FROM reddit_comments_cleaned QUALIFY row_number() OVER (PARTITION BY coalesce(original_body, ''),
    created_utc // {size} ORDER BY created_utc, id, tokens NULLS FIRST, matched_keywords NULLS FIRST) = 1)"""


def _sentiment_sql(size: int) -> str:
    return f"""SELECT keyword, created_utc // {size} * {size} AS window_start, created_utc // {size} * {size} + {size} AS window_end,
    round_even(avg(CASE WHEN sentiment_label = 'positive' THEN 1.0::DOUBLE ELSE 0 END), 4) AS positive_ratio, count(*) AS comment_count
    FROM ({_FAN}) GROUP BY 1, 2, 3"""


def _sense_sql(k: str) -> str:
    n = {s: " + ".join(f"CAST({has_word("text", w)} AS INT)" for w in ws) for s, ws in SENSES[k].items()}
    (a, x), (b, y) = n.items()
    return f"CASE WHEN ({x}) > ({y}) THEN '{a}' WHEN ({y}) > ({x}) THEN '{b}' ELSE 'ambiguous' END"


#: m: (kafka_partition, kafka_offset, text, keyword) of every tracked keyword in a comment; single words are found by equality.
_MATCHED = f"""k AS (SELECT lower(trim(keyword)) AS keyword, subkeywords FROM tracked_keywords),
    t AS (SELECT kafka_partition, kafka_offset, coalesce(nullif(cleaned_body, ''), array_to_string(tokens, ' '), '') AS text FROM reddit_comments_cleaned),
    w AS (SELECT DISTINCT kafka_partition, kafka_offset, text, unnest(string_split_regex(lower(text), '[^{WORD}]+')) AS word FROM t),
    m AS (SELECT kafka_partition, kafka_offset, text, keyword FROM w JOIN k ON word = keyword WHERE regexp_full_match(keyword, '[{WORD}]+')
      UNION ALL SELECT kafka_partition, kafka_offset, text, keyword FROM t, (SELECT keyword FROM k WHERE NOT regexp_full_match(keyword, '[{WORD}]+'))
      WHERE contains(lower(text), keyword)
      AND regexp_matches(text, '(?i)(^|[^{WORD}])' || regexp_replace(keyword, '([.+#-])', '\\\\\\1', 'g') || '($|[^{WORD}])'))"""
_LATE = """w AS (SELECT *, CAST(epoch_us(ingest_ts) // 600000000 * 600 AS BIGINT) AS period,
    created_utc // 3600 * 3600 + 3600 AS wend FROM reddit_comments_cleaned WHERE created_utc > 0),
  p AS (SELECT period, max(created_utc) AS top FROM w GROUP BY period),
  mk AS (SELECT period, max(top) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5 AS watermark FROM p),
  l AS (SELECT w.* FROM w JOIN mk USING (period) WHERE wend <= watermark)"""

SQL = {
    "sentiment_windows": _sentiment_sql(3600),
    "sentiment_minutes": _sentiment_sql(60),
    "reach_windows": f"""SELECT keyword, created_utc // 300 * 300 AS window_start, created_utc // 300 * 300 + 300 AS window_end,
    count(DISTINCT author) AS unique_authors, count(*) AS comment_count FROM ({_AUTHORS}) GROUP BY 1, 2, 3""",
    "reach_merged": f"""SELECT keyword, created_utc // 3600 * 3600 AS window_start, count(DISTINCT author) AS unique_authors,
    count(*) AS comment_count FROM ({_AUTHORS}) GROUP BY 1, 2""",
    "trending_terms": f"""WITH {_first_sql(3600)}, {_terms_sql("f")}
    SELECT keyword, created_utc // 3600 * 3600 AS window_start, term, count(*) AS count FROM s GROUP BY 1, 2, 3""",
    "trending_windows": f"""WITH {_first_sql(86400)}, {_terms_sql("f")},
    c AS (SELECT keyword, created_utc // 86400 * 86400 AS ws, term, count(*) AS n FROM s GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY keyword, ws ORDER BY n DESC, term) AS rank, sum(n) OVER (PARTITION BY keyword, ws) AS total FROM c)
    SELECT keyword, ws AS window_start, ws + 86400 AS window_end, CAST(any_value(total) AS BIGINT) AS stream_total,
    coalesce(string_agg(term || ':' || n, '|' ORDER BY rank) FILTER (rank <= 20 AND n >= 2), '') AS items
    FROM r WHERE total >= 30 GROUP BY keyword, ws""",
    "zipf_words": f"WITH {_ZIPF} SELECT word, n, round(zipf, 6) AS zipf FROM z",
    "trending_weighted": f"""WITH {_ZIPF}, {_first_sql(86400)}, {_terms_sql("f", "(SELECT list(word) FROM z WHERE zipf >= 7)")},
    c AS (SELECT keyword, created_utc // 86400 * 86400 AS ws, term, count(*) AS n FROM s GROUP BY 1, 2, 3),
    u AS (SELECT term, unnest(string_split(term, ' ')) AS word FROM (SELECT DISTINCT term FROM c)),
    i AS (SELECT term, greatest(1.0, 7.5 - min(CASE WHEN coalesce(zipf, 0) <= 0 THEN 2.5 ELSE zipf END)) AS w FROM u LEFT JOIN z USING (word) GROUP BY term),
    r AS (SELECT *, n * w AS score, row_number() OVER (PARTITION BY keyword, ws ORDER BY n * w DESC, term) AS rank,
      sum(n) OVER (PARTITION BY keyword, ws) AS total FROM c JOIN i USING (term))
    SELECT keyword, ws AS window_start, coalesce(string_agg(term || ':' || n, '|' ORDER BY rank) FILTER (rank <= 20 AND n >= 2), '') AS items FROM r WHERE total >= 30 GROUP BY keyword, ws""",
    "trending_counters": f"""WITH {_first_sql(3600)}, {_terms_sql("f")},
    c AS (SELECT keyword, created_utc // 86400 * 86400 AS day, term, count(*) AS n FROM s GROUP BY 1, 2, 3),
    w AS (SELECT *, sum(n) OVER (PARTITION BY keyword, day) AS total FROM c)
    SELECT keyword, day, CAST(max(total) AS BIGINT) AS n_terms, 0 AS n_low, count(*) FILTER (n * 100 >= total) AS n_heavy,
    count(*) FILTER (n * 100 >= total) AS n_found, least(count(*), 20) AS n_ranked FROM w GROUP BY keyword, day""",
    "sketch_bounds": f"""WITH {_terms_sql("reddit_comments_cleaned")}, c AS (SELECT DISTINCT keyword, term FROM s)
    SELECT keyword, count(*) AS n_terms, 0 AS n_low, true AS within_bound FROM c GROUP BY keyword""",
    "top_keywords": """SELECT k AS keyword, count(*) AS n FROM (SELECT unnest(matched_keywords) AS k FROM reddit_comments_cleaned)
    GROUP BY k ORDER BY n DESC, k LIMIT 10""",
    "late_drops": f"""WITH {_LATE}, {_terms_sql("l")}, e AS (
      SELECT 'sentiment' AS pipeline, period FROM (SELECT period, unnest(matched_keywords) FROM l WHERE sentiment_label <> '')
      UNION ALL SELECT 'reach', period FROM (SELECT period, unnest(matched_keywords) FROM l WHERE author NOT IN ('', '[deleted]'))
      UNION ALL SELECT 'trending', period FROM s)
    SELECT 'late_drop' AS type, pipeline, count(*) AS count, period + 600 AS emitted_at FROM e GROUP BY pipeline, period""",
    "parse_valid": f"""SELECT coalesce(id, 'None') AS id, coalesce(author, 'None') AS author, created_utc, body, coalesce(score, 0) AS score,
    coalesce(subreddit, 'None') AS subreddit, coalesce(controversiality, 0) AS controversiality, kafka_partition, kafka_offset
    FROM reddit_comments WHERE {_VALID}""",
    "parse_errors": f"""SELECT CASE WHEN body IS NULL OR {strip("body")} = '' THEN 'empty_body'
    WHEN body IN ('[deleted]', '[removed]') THEN 'deleted_body' WHEN coalesce(created_utc, -1) < 0 THEN 'invalid_created_utc' END AS error,
    count(*) AS n FROM reddit_comments GROUP BY 1""",
    "parse_rejected": f"""WITH m AS (SELECT raw, ingest_ts, CASE WHEN json_valid(raw) THEN raw END AS j FROM reddit_comments_malformed),
    x AS (SELECT *, list_sort(list_filter({listed(["author", "body", "controversiality", "created_utc", "id", "score", "subreddit"])},
      lambda k: NOT list_contains(json_keys(j), k))) AS missing, json_extract(j, '$.body') AS b, j ->> '$.body' AS body FROM m)
    SELECT substr(raw, 1, 2000) AS raw, coalesce(ingest_ts, 0) AS ingest_ts, CASE WHEN j IS NULL THEN 'json_decode_error' WHEN json_type(j) <> 'OBJECT' THEN 'root_not_object'
      WHEN len(missing) > 0 THEN 'missing_fields: [''' || array_to_string(missing, ''', ''') || ''']'
      WHEN b IS NULL OR json_type(b) <> 'VARCHAR' OR {strip("body")} = '' THEN 'empty_body' WHEN body IN ('[deleted]', '[removed]') THEN 'deleted_body'
      WHEN coalesce(TRY_CAST(trunc(TRY_CAST(j ->> '$.created_utc' AS DOUBLE)) AS BIGINT), -1) < 0 THEN 'invalid_created_utc' END AS error
    FROM x WHERE error IS NOT NULL""",
    "malformed_counts": "SELECT split_part(error, ':', 1) AS kind, count(*) AS n FROM reddit_comments_malformed GROUP BY 1",
    "clean_bodies": f"SELECT kafka_partition, kafka_offset, {clean('body')} AS cleaned_body FROM reddit_comments",
    "token_lists": f"SELECT kafka_partition, kafka_offset, array_to_string({tokens('cleaned_body')}, '|') AS tokens, len({tokens('cleaned_body')}) AS n FROM reddit_comments_cleaned",
    "tokens_without_stopwords": f"SELECT kafka_partition, kafka_offset, array_to_string(list_filter({tokens('cleaned_body')}, lambda x: NOT list_contains({listed(STOP)}, lower(x))), '|') AS tokens FROM reddit_comments_cleaned",
    "clean_lower": f"SELECT kafka_partition, kafka_offset, lower({clean('body')}) AS cleaned_body FROM reddit_comments",
    "detected_languages": f"""WITH x AS (SELECT kafka_partition, kafka_offset, {clean('body')} AS t FROM reddit_comments), {LANGUAGE}
    SELECT kafka_partition, kafka_offset, language FROM x LEFT JOIN y USING (kafka_partition, kafka_offset)""",
    "english_gate": f"""WITH x AS (SELECT kafka_partition, kafka_offset, {clean('body')} AS t FROM reddit_comments), {LANGUAGE}
    SELECT kafka_partition, kafka_offset, length(t) < 20 OR coalesce(language, 'en') = 'en' AS english
    FROM x LEFT JOIN y USING (kafka_partition, kafka_offset)""",
    "cleaned_comments": f"""WITH x AS (SELECT *, {clean("body")} AS t FROM reddit_comments WHERE {_VALID}), {LANGUAGE}
    SELECT coalesce(id, 'None') AS id, coalesce(author, 'None') AS author, created_utc, coalesce(subreddit, 'None') AS subreddit,
    body AS original_body, t AS cleaned_body, array_to_string({tokens("t")}, '|') AS tokens, coalesce(score, 0) AS score,
    coalesce(controversiality, 0) AS controversiality, 'en' AS language, kafka_partition, kafka_offset
    FROM x LEFT JOIN y USING (kafka_partition, kafka_offset) WHERE length(t) < 20 OR coalesce(y.language, 'en') = 'en'""",
    "tag_comments": f"""WITH {_MATCHED},
    h AS (SELECT kafka_partition, kafka_offset, keyword, CASE
        {" ".join(f"WHEN keyword = '{k}' THEN {_sense_sql(k)}" for k in SENSES)} WHEN len(subkeywords) > 0 THEN 'ambiguous' END AS sense
      FROM m JOIN k USING (keyword))
    SELECT t.kafka_partition, t.kafka_offset, coalesce(string_agg(keyword, '|' ORDER BY keyword), '') AS matched,
    coalesce(string_agg(keyword || '=' || sense, '|' ORDER BY keyword), '') AS senses
    FROM t LEFT JOIN h USING (kafka_partition, kafka_offset) GROUP BY ALL""",
    "keyword_set": """SELECT lower(trim(keyword)) AS keyword, coalesce(array_to_string(subkeywords, '|'), '') AS subkeywords FROM tracked_keywords
    WHERE lower(trim(keyword)) <> 'anchor' UNION ALL SELECT 'new word', 'b|a' UNION ALL SELECT 'zebra', ''""",
    "keyword_validity": f"""SELECT DISTINCT token, coalesce(regexp_full_match(lower({strip("token")}), '[a-z0-9 .+#-]{{1,40}}'), false) AS valid
    FROM (SELECT unnest(tokens) AS token FROM reddit_comments_cleaned)""",
    "subkeyword_lists": """SELECT keyword, array_to_string(subkeywords, '|') AS words, 'list' AS origin FROM tracked_keywords
    UNION ALL SELECT keyword, array_to_string(subkeywords, '|'), 'text' FROM tracked_keywords WHERE subkeywords IS NOT NULL""",
    "embedding_senses": f"""WITH {_MATCHED},
    n AS (SELECT lower(t) AS word FROM (SELECT unnest(tokens) AS t FROM reddit_comments_cleaned) GROUP BY 1 HAVING count(*) >= 5 AND word <> ''),
    e AS (SELECT word, i, CAST(x AS DOUBLE) AS x FROM (SELECT word, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
      FROM n JOIN embeddings ON vec_id = (7 * unicode(word) + length(word)) % 400)),
    s AS (SELECT DISTINCT m.kafka_partition, m.kafka_offset, keyword, subkeywords FROM m JOIN k USING (keyword) WHERE len(subkeywords) > 0),
    tw AS (SELECT kafka_partition, kafka_offset, lower(unnest(tokens)) AS word FROM reddit_comments_cleaned),
    a AS (SELECT kafka_partition, kafka_offset, i, avg(x) AS x FROM (SELECT DISTINCT kafka_partition, kafka_offset FROM s) JOIN tw USING (kafka_partition, kafka_offset)
      JOIN e USING (word) GROUP BY ALL),
    u AS (SELECT *, unnest(subkeywords) AS sub FROM s),
    c AS (SELECT u.kafka_partition, u.kafka_offset, keyword, sub, sum(a.x * e.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(e.x * e.x))) AS score
      FROM u JOIN e ON sub = e.word JOIN a ON a.kafka_partition = u.kafka_partition AND a.kafka_offset = u.kafka_offset AND a.i = e.i GROUP BY ALL
      UNION ALL SELECT kafka_partition, kafka_offset, keyword, sub, 1.0 FROM u WHERE sub NOT IN (SELECT word FROM e)
      AND (kafka_partition, kafka_offset, sub) IN (SELECT kafka_partition, kafka_offset, word FROM tw WHERE word IS NOT NULL)),
    r AS (SELECT *, row_number() OVER z AS rank, lead(score) OVER z AS second FROM c WINDOW z AS (PARTITION BY kafka_partition, kafka_offset, keyword ORDER BY score DESC, sub)),
    b AS (SELECT kafka_partition, kafka_offset, keyword, CASE WHEN score >= 0.20 AND (second IS NULL OR score - second >= 0.05) THEN sub ELSE 'ambiguous' END AS sense FROM r WHERE rank = 1)
    SELECT kafka_partition, kafka_offset, string_agg(keyword || '=' || coalesce(sense, 'ambiguous'), '|' ORDER BY keyword) AS senses
    FROM s LEFT JOIN b USING (kafka_partition, kafka_offset, keyword) GROUP BY 1, 2""",
    "keyword_fanout": f"SELECT kafka_partition, kafka_offset, keyword, base_keyword, sentiment_label FROM ({_FAN})",
    "language_breakdown": """SELECT coalesce(language, 'unknown') AS language, count(*) AS comment_count,
    round_even(avg(CASE WHEN sentiment_label = 'positive' THEN 1.0::DOUBLE ELSE 0 END), 4) AS positive_ratio
    FROM reddit_comments_cleaned WHERE sentiment_label <> '' GROUP BY 1""",
    "label_counts": "SELECT sentiment_label AS label, count(*) AS n FROM reddit_comments_cleaned GROUP BY 1",
    "replay_range": f"""SELECT coalesce(id, '') AS id, coalesce(author, '') AS author, created_utc, body, coalesce(score, 0) AS score,
    coalesce(subreddit, '') AS subreddit, coalesce(controversiality, 0) AS controversiality, kafka_partition, kafka_offset FROM reddit_comments
    WHERE created_utc BETWEEN 1554076800 AND 1555472130 AND trim(body) <> '' AND body NOT IN ('[deleted]', '[removed]')""",
    "replay_groups": """WITH r AS (SELECT *, lag(created_utc) OVER w AS before FROM reddit_comments WHERE created_utc IS NOT NULL
      WINDOW w AS (PARTITION BY kafka_partition ORDER BY kafka_offset)),
    g AS (SELECT *, sum(CASE WHEN before = created_utc THEN 0 ELSE 1 END) OVER (PARTITION BY kafka_partition ORDER BY kafka_offset) AS run FROM r)
    SELECT kafka_partition, CAST(run AS BIGINT) AS run, created_utc, count(*) AS n, min(kafka_offset) AS first FROM g GROUP BY kafka_partition, run, created_utc""",
    "replay_slice": f"""SELECT kafka_partition, kafka_offset, id, created_utc FROM reddit_comments
    WHERE created_utc BETWEEN 1554076800 AND 1555472130 ORDER BY ingest_ts, kafka_partition, kafka_offset LIMIT 500 OFFSET 100""",
}
