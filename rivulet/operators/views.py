"""Serving views over the published windows and the scored comments, as ordinary DataFrame queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions import text as X
from rivulet.operators.windows import bucket
from rivulet.schemas import REQUIRED
from rivulet.sources.replay import DATE_END, DATE_START

#: How much of each keyword the views keep (fixed values).
MAX_WINDOWS, MAX_REACH, MAX_TRENDING, MAX_COMMENTS = 500, 200, 8, 100
MAX_POINTS, MAX_FEED = 120, 60
MOMENTUM = 0.10


def base_of(keyword: Column) -> Column:
    return F.lower(F.split_part(keyword, F.lit(":"), F.lit(1)))


def valid_windows(df: DataFrame) -> DataFrame:
    """Sentiment windows with a keyword, and their base keyword; null counts and ratios become 0."""
    return df.where(F.coalesce(F.col("keyword"), F.lit("")) != "").withColumns(
        {
            "base_keyword": base_of(F.col("keyword")),
            "positive_ratio": F.coalesce("positive_ratio", F.lit(0.0)),
            "comment_count": F.coalesce("comment_count", F.lit(0)).cast("bigint"),
        }
    )


def valid_comments(df: DataFrame) -> DataFrame:
    """Scored comments with a keyword, the shown body, and senses that are never null."""
    ok = (F.size(F.coalesce("matched_keywords", F.array().cast("array<string>"))) > 0) & (F.coalesce(F.col("sentiment_label"), F.lit("")) != "")
    return df.where(ok).withColumns(
        {
            "body": F.coalesce("original_body", F.lit("")),
            "sentiment_score": F.coalesce("sentiment_score", F.lit(0.0)),
            "keyword_senses": F.coalesce("keyword_senses", F.create_map().cast("map<string,string>")),
        }
    )


def valid_analytics(df: DataFrame) -> DataFrame:
    known = F.col("type").isin("trending", "reach") & (F.coalesce(F.col("keyword"), F.lit("")) != "")
    return df.where((F.col("type") == "late_drop") | known)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The n last rows of each key. Rows are numbered per key, and the limit is applied before the shuffle already."""
    w = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def replaced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows published again under the same keys only the last; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, "_r.*").select(*df.columns)


def known_keywords(df: DataFrame) -> DataFrame:
    return df.select("keyword").distinct().orderBy("keyword")


def latest_sentiment(windows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The last window of each series."""
    return last_per_key(windows, ["keyword"], order)


def timeseries(windows: DataFrame, base: str | Sequence[str]) -> DataFrame:
    """All windows of the series of a keyword, or of several to compare, with their base and sense."""
    names = [base] if isinstance(base, str) else list(base)
    sense = F.when(F.col("keyword").contains(":"), F.substring_index("keyword", ":", -1))
    return windows.where(base_of(F.col("keyword")).isin(*[n.lower() for n in names])).withColumns(
        {"base_keyword": base_of(F.col("keyword")), "sense": sense}
    )


def rebucket(windows: DataFrame, seconds: int) -> DataFrame:
    """Windows of a series put together by their end; the ratio is weighted by comments, a window without any counts as one.

    Buckets of up to one second change nothing.
    """
    if seconds <= 1:
        return windows.select("keyword", "window_end", "positive_ratio", "comment_count")
    weight = F.greatest("comment_count", F.lit(1))
    return (
        windows.groupBy("keyword", bucket(F.col("window_end"), seconds).alias("window_end"))
        .agg(
            (F.sum(F.col("positive_ratio") * weight) / F.sum(weight)).alias("positive_ratio"),
            F.sum("comment_count").alias("comment_count"),
        )
    )


def merge_senses(windows: DataFrame) -> DataFrame:
    """One series for each base keyword: ratios weighted by comments, 0 without any."""
    n = F.sum("comment_count")
    return windows.groupBy(base_of(F.col("keyword")).alias("keyword"), "window_end").agg(
        n.alias("comment_count"),
        F.when(n > 0, F.sum(F.col("positive_ratio") * F.col("comment_count")) / n).otherwise(0.0).alias("positive_ratio"),
    )


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")


def headline(windows: DataFrame, seconds: int) -> DataFrame:
    """Per series the per cent of the last bucket, its comments, and the change in points from the bucket before."""
    b = rebucket(windows, seconds)
    w = W.partitionBy("keyword").orderBy("window_end")
    before = F.lag("positive_ratio").over(w)
    b = b.withColumns({"delta": F.col("positive_ratio") - before, "_next": F.lead("window_end").over(w)})
    return b.where(F.col("_next").isNull()).select(
        "keyword",
        round_half_up(F.col("positive_ratio") * 100).alias("pct"),
        F.col("comment_count").alias("count"),
        round_half_up(F.col("delta") * 100).alias("delta_pct"),
    )


def label_buckets(comments: DataFrame, seconds: int) -> DataFrame:
    """Per keyword and bucket the positive, negative and neutral comments; every other label counts as neutral."""
    label = F.coalesce("sentiment_label", F.lit(""))
    rows = comments.select(
        F.explode(F.array_distinct(F.transform("matched_keywords", lambda k: F.lower(k)))).alias("keyword"),
        bucket(F.coalesce("created_utc", F.lit(0)), seconds).alias("window_end"),
        label.alias("label"),
    )
    n = lambda cond: F.count(F.when(cond, 1))
    return rows.groupBy("keyword", "window_end").agg(
        n(F.col("label") == "positive").alias("positive"),
        n(F.col("label") == "negative").alias("negative"),
        n(~F.col("label").isin("positive", "negative")).alias("neutral"),
    )


def chart(comments: DataFrame, windows: DataFrame, a: str, b: str, seconds: int) -> DataFrame:
    """Bars and lines of two keywords by bucket.

    Bars count labelled comments; a bucket without any is filled from the windows with the rounded share of their
    comments. Lines are the per cent of the windows, null where there is none.
    """
    bars = label_buckets(comments, seconds).where(F.col("keyword").isin(a, b))
    lines = rebucket(windows.where(F.col("keyword").isin(a, b)), seconds)
    both = bars.join(lines, ["keyword", "window_end"], "full")
    counted = F.coalesce(F.col("positive") + F.col("negative") + F.col("neutral"), F.lit(0)) > 0
    fill = ~counted & (F.coalesce("comment_count", F.lit(0)) > 0)
    from_line = round_half_up(F.col("positive_ratio") * F.col("comment_count"))
    rows = both.select(
        F.col("window_end").alias("t"),
        "keyword",
        F.when(fill, from_line).otherwise(F.coalesce("positive", F.lit(0))).alias("positive"),
        F.when(fill, F.greatest(F.col("comment_count") - from_line, F.lit(0))).otherwise(F.coalesce("negative", F.lit(0))).alias("negative"),
        F.coalesce("neutral", F.lit(0)).alias("neutral"),
        round_half_up(F.col("positive_ratio") * 100).alias("pct"),
    )
    out = []
    for side, kw in (("a", a), ("b", b)):
        mine = F.col("keyword") == kw
        for c in ("positive", "negative", "neutral"):
            out.append(F.coalesce(F.max(F.when(mine, F.col(c))), F.lit(0)).alias(f"{side}_{c}"))
        out.append(F.max(F.when(mine, F.col("pct"))).alias(f"{side}_pct"))
    return rows.groupBy("t").agg(*out)


def scatter(comments: DataFrame, keyword: str) -> DataFrame:
    """One signed score for each scored comment on the keyword."""
    on = F.exists("matched_keywords", lambda k: F.lower(k) == keyword.lower())
    ok = F.col("sentiment_score").isNotNull() & ~F.isnan("sentiment_score") & (F.abs("sentiment_score") < float("inf"))
    return comments.where(on & ok).select(
        F.col("created_utc").alias("t"),
        X.signed_score(F.col("sentiment_label"), F.col("sentiment_score")).alias("score"),
        F.col("sentiment_label").alias("label"),
        "author",
        F.col("original_body").alias("body"),
    )


def by_keyword(comments: DataFrame) -> DataFrame:
    return comments.withColumn("keyword", F.explode(F.array_distinct(F.transform("matched_keywords", lambda k: F.lower(k)))))


def recent_comments(comments: DataFrame, order: Sequence[str], limit: int = MAX_COMMENTS) -> DataFrame:
    """The newest comments of each keyword."""
    return last_per_key(by_keyword(comments), ["keyword"], order, limit)


def matching_comments(
    comments: DataFrame, keyword: str, term: str, order: Sequence[str], limit: int = 3, exclude: Sequence[str] = ()
) -> DataFrame:
    """The newest comments on a keyword that contain a term as whole words, with a snippet around it."""
    on = F.exists("matched_keywords", lambda k: F.lower(k) == keyword.lower())
    hit = F.regexp_like(F.coalesce("original_body", F.lit("")), X.term_pattern(F.lit(term)))
    df = comments.where(on & hit)
    if exclude:
        df = df.where(~F.coalesce("id", F.lit("")).isin(*exclude))
    df = df.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(limit)
    return df.withColumn("snippet", X.snippet(F.col("original_body"), F.lit(term)))


def trending_windows(analytics: DataFrame, order: Sequence[str], tracked: DataFrame | None = None) -> DataFrame:
    """The stored trending windows of each keyword, the last publication of each, numbered from the newest (1)."""
    df = analytics.where((F.col("type") == "trending") & F.col("keyword").isNotNull()).withColumn("keyword", F.lower("keyword"))
    df = df.select("keyword", "window_end", "items", "sketch", *order)
    if tracked is not None:
        df = df.join(tracked.select(F.lower("keyword").alias("keyword")).distinct(), "keyword", "left_semi")
    df = replaced(df, ["keyword", "window_end"], order)
    w = W.partitionBy("keyword").orderBy(F.desc("window_end"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MAX_TRENDING)


def trending_overview(stored: DataFrame, k: int | None = 20) -> DataFrame:
    """The terms of the latest windows over all keywords, with their momentum.

    count and score are summed over keywords (the count stands in for a missing score). Momentum compares only keywords
    that have an earlier window: flat without any, new if the term was in none, else up or down beyond a tenth.
    """
    at = lambda n: F.first(F.when(F.col("rank") == n, F.col("items")), ignorenulls=True)
    two = stored.where(F.col("rank") <= 2).groupBy("keyword").agg(at(1).alias("cur"), at(2).alias("prev"), F.max("rank").alias("n"))
    same = F.filter("prev", lambda x: x["token"] == F.col("i.token"))
    rows = two.select("keyword", (F.col("n") == 2).alias("known"), "prev", F.explode("cur").alias("i")).select(
        "keyword", "known", "i.*", F.coalesce(F.array_max(F.transform(same, lambda x: x["count"])), F.lit(0)).alias("before")
    )
    known = F.col("known")
    merged = rows.groupBy("token").agg(
        F.sum("count").alias("count"),
        # as decimals, so that the sum is the same in any order
        F.round(F.sum(F.coalesce("score", F.col("count")).cast("decimal(18,3)")), 2).cast("double").alias("score"),
        F.array_sort(F.collect_set("keyword")).alias("keywords"),
        F.max(known).alias("known"),
        F.coalesce(F.sum(F.when(known, F.col("before"))), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.when(known, F.col("count"))), F.lit(0)).alias("now"),
    )
    change = (F.col("now") - F.col("before")) / F.col("before")
    momentum = (
        F.when(~F.col("known"), "flat")
        .when(F.col("before") <= 0, "new")
        .when(change > MOMENTUM, "up")
        .when(change < -MOMENTUM, "down")
        .otherwise("flat")
    )
    out = merged.select(
        "token", "count", "score", "keywords", momentum.alias("momentum"),
        F.when(F.col("known") & (F.col("before") > 0), F.bround(change, 3)).alias("change"),
    )
    return out if k is None else out.orderBy(F.desc("score"), "token").limit(k)


def trending_history(stored: DataFrame, k: int = 5) -> DataFrame:
    """(token, window_end, count): the k best terms of the newest window over all stored windows; null where a term is in none.

    The windows are at most eight for each keyword and the terms k, so their combinations are few.
    """
    rows = stored.select("window_end", F.explode_outer("items").alias("i")).groupBy("window_end", "i.token").agg(
        F.sum("i.count").alias("count"), F.sum(F.coalesce("i.score", F.col("i.count").cast("double"))).alias("score")
    )
    newest = stored.agg(F.max("window_end").alias("w"))
    top = (
        rows.where((F.col("window_end") == newest.scalar()) & F.col("token").isNotNull())
        .orderBy(F.desc("score"), "token")
        .limit(k)
        .agg(F.collect_list("token").alias("tokens"))
    )
    ends = rows.select("window_end").distinct().withColumn("token", F.explode(top.scalar()))
    return ends.join(rows.select("window_end", "token", "count"), ["window_end", "token"], "left")


def trending_examples(
    overview: DataFrame, comments: DataFrame, order: Sequence[str], n_terms: int = 3, per_term: int = 2
) -> DataFrame:
    """Comments behind the best terms, none of them for two terms: term by term, its keywords in order, newest first.

    n_terms (10 at most) terms are asked for, and each looks at the newest hundred comments of its keywords only; for
    each of them n_terms * per_term comments can matter at most, and these few are shared out on the driver.
    """
    if not 1 <= n_terms <= 10 or not 1 <= per_term <= 5:
        raise ValueError("terms must be from 1 to 10 and per_term from 1 to 5")
    best = [r.asDict() for r in overview.orderBy(F.desc("score"), "token").limit(n_terms).collect()]
    spark = comments.sparkSession
    schema = "rank int, token string, position int, id string, author string, snippet string, sentiment_label string, sentiment_score double, created_utc bigint"
    if not best:
        return spark.createDataFrame([], schema)
    pairs = [(i, t["token"], j, k) for i, t in enumerate(best) for j, k in enumerate(t["keywords"])]
    wanted = spark.createDataFrame(pairs, "rank int, token string, place int, keyword string")
    stored = by_keyword(comments).join(F.broadcast(wanted.select("keyword").distinct()), "keyword", "left_semi")
    stored = stored.select("keyword", "id", "author", "original_body", "sentiment_label", "sentiment_score", "created_utc", *[c for c in order if c != "created_utc" and c != "id"])
    stored = last_per_key(stored, ["keyword"], order, MAX_COMMENTS)
    hits = stored.join(F.broadcast(wanted), "keyword").where(F.regexp_like(F.coalesce("original_body", F.lit("")), X.term_pattern(F.col("token"))))
    w = W.partitionBy("rank", "place").orderBy(*[F.desc_nulls_last(c) for c in order])
    hits = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n_terms * per_term)
    rows = hits.withColumn("snippet", X.snippet(F.col("original_body"), F.col("token"))).orderBy("rank", "place", "n").collect()
    used, out, taken = set(), [], {}
    for r in rows:
        if taken.get(r["rank"], 0) < per_term and r["id"] not in used:
            used.add(r["id"])
            taken[r["rank"]] = taken.get(r["rank"], 0) + 1
            out.append((r["rank"], r["token"], taken[r["rank"]], r["id"], r["author"], r["snippet"], r["sentiment_label"], r["sentiment_score"], r["created_utc"]))
    return spark.createDataFrame(out, schema)


def reach_series(analytics: DataFrame, order: Sequence[str]) -> DataFrame:
    """The reach of each keyword and window, the last publication of each, the newest windows of each keyword."""
    df = analytics.where((F.col("type") == "reach") & F.col("keyword").isNotNull()).withColumn("keyword", F.lower("keyword"))
    df = replaced(df.select("keyword", "window_end", "unique_authors", "comment_count", *order), ["keyword", "window_end"], order)
    return last_per_key(df, ["keyword"], ["window_end"], MAX_REACH).select("keyword", "window_end", "unique_authors", "comment_count")


def reach_latest(analytics: DataFrame, order: Sequence[str], tracked: DataFrame | None = None) -> DataFrame:
    """The last reach of each keyword, of tracked ones only if these are given."""
    latest = last_per_key(reach_series(analytics, order), ["keyword"], ["window_end"])
    if tracked is not None:
        latest = latest.join(tracked.select(F.lower("keyword").alias("keyword")).distinct(), "keyword", "left_semi")
    return latest


def late_status(analytics: DataFrame) -> DataFrame:
    """Dropped elements and the last time, by pipeline and (pipeline null) in total."""
    df = analytics.where((F.col("type") == "late_drop") & F.col("pipeline").isNotNull())
    return df.rollup("pipeline").agg(F.sum("count").alias("total"), F.max("emitted_at").alias("last_at"))


def live_points(windows: DataFrame, order: Sequence[str], n: int = MAX_POINTS) -> DataFrame:
    """What a client shows of each series: a window that follows its own repetition replaces it, the newest n stay."""
    low = windows.withColumn("keyword", F.lower("keyword"))
    w = W.partitionBy("keyword").orderBy(*order)
    again = F.lead("window_end").over(w).eqNullSafe(F.col("window_end")) & F.lead(F.lit(True)).over(w).isNotNull()
    shown = low.withColumn("_again", F.coalesce(again, F.lit(False))).where(~F.col("_again")).drop("_again")
    return last_per_key(shown, ["keyword"], order, n).select("keyword", "window_end", "positive_ratio", "comment_count", *order)


def live_feed(comments: DataFrame, order: Sequence[str], n: int = MAX_FEED) -> DataFrame:
    """The newest n comments, each id once (its first delivery)."""
    row = F.struct(*[c for c in comments.columns if c != "id"])
    first = comments.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(row, F.struct(*order)).alias("r")).select("id", "r.*")
    return first.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(n)


def series_of_sense(windows: DataFrame, sense: str | None) -> DataFrame:
    """Windows of one sense; all of them for no sense or ``all``."""
    if not sense or sense == "all":
        return windows
    return windows.where(F.col("keyword").contains(":") & (F.substring_index("keyword", ":", -1) == sense))


def comments_of_senses(comments: DataFrame, keywords: Sequence[str], senses: dict[str, str]) -> DataFrame:
    """Comments on any of the keywords, for each in its chosen sense if one is chosen."""
    chosen = {k.lower(): s for k, s in senses.items() if s and s != "all"}

    def fits(k: Column) -> Column:
        low = F.lower(k)
        ok = low.isin(*[x.lower() for x in keywords])
        for name, sense in chosen.items():
            ok = ok & ((low != name) | (F.coalesce(F.try_element_at("keyword_senses", low), F.lit("")) == sense))
        return ok

    return comments.where(F.exists("matched_keywords", fits))


#: What a client is sent of each keyword in a second, and at once (fixed values).
COMMENT_RATE, COMMENT_BURST, WINDOW_RATE, WINDOW_BURST = 5, 3, 20, 10


def throttled(df: DataFrame, key: str, seconds: str, order: Sequence[str], rate: float, burst: int) -> DataFrame:
    """The rows that a token bucket for each key lets through: burst at once, then rate a second, in the given order.

    A bucket that is full again forgets what was before: no row takes more than one token, so rows of more than
    burst / rate seconds without another start anew. Such a stretch is folded by itself, which splits a busy key in time.
    """
    if rate <= 0 or burst < 1:
        raise ValueError("rate must be positive and burst one at least")
    w = W.partitionBy(key).orderBy(*order)
    gap = F.col(seconds) - F.lag(seconds).over(w)
    marked = df.withColumns({"_new": F.when(F.coalesce(gap, F.lit(burst / rate)) >= burst / rate, 1).otherwise(0), "_t": F.col(seconds)})
    marked = marked.withColumn("_stretch", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "_t", F.struct(*df.columns).alias("row"))
    rows = marked.groupBy(key, "_stretch").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.array().cast(T.ArrayType(T.BooleanType()))
    start = F.struct(F.lit(float(burst)).alias("left"), F.lit(None).cast("double").alias("at"), none.alias("sent"))

    def step(state: Column, r: Column) -> Column:
        t = r["_t"].cast("double")
        left = F.least(F.lit(float(burst)), state["left"] + F.coalesce(t - state["at"], F.lit(0.0)) * rate)
        return F.struct(F.when(left >= 1, left - 1).otherwise(left).alias("left"), t.alias("at"), F.concat(state["sent"], F.array(left >= 1)).alias("sent"))

    sent = rows.select("rows", F.aggregate("rows", start, step)["sent"].alias("sent"))
    kept = sent.select(F.explode(F.filter(F.arrays_zip("rows", "sent"), lambda x: x["sent"])).alias("x"))
    return kept.select("x.rows.row.*")


def delivered_comments(comments: DataFrame, keywords: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Comments on a client's keywords with key, the first of these by name, thinned out by key."""
    mine = F.array_intersect(F.transform("matched_keywords", lambda k: F.lower(k)), F.array(*[F.lit(k.lower()) for k in keywords]))
    on = comments.withColumn("key", F.array_min(mine)).where(F.col("key").isNotNull())
    return throttled(on.select("key", "id", "created_utc", *[c for c in order if c not in ("id", "created_utc")]), "key", "created_utc", order, COMMENT_RATE, COMMENT_BURST)


def delivered_windows(windows: DataFrame, keywords: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Windows of a client's keywords, thinned out by base keyword."""
    on = windows.where(F.col("base_keyword").isin(*[k.lower() for k in keywords])).withColumn("key", F.col("base_keyword"))
    return throttled(on.select("key", "keyword", "window_end", *[c for c in order if c != "window_end"]), "key", "window_end", order, WINDOW_RATE, WINDOW_BURST)


def health(stages: dict[str, DataFrame], arrival: str = "ingest_ts", stale_s: int = 600) -> DataFrame:
    """(stage, n, behind_s, status) of each stage: empty, stale (so far behind the newest stage), or ok."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"), F.max(F.unix_timestamp(arrival)).alias("last_s"))
        out = one if out is None else out.unionByName(one)
    newest = F.max("last_s").over(W.partitionBy())  # one row for each stage
    behind = newest - F.col("last_s")
    return out.withColumn("behind_s", behind).select("stage", "n", "behind_s", F.when(F.col("n") == 0, "empty").when(F.col("behind_s") > stale_s, "stale").otherwise("ok").alias("status"))


_EMOJI = r"[\x{1F300}-\x{1FAFF}]"


def _checks(records: DataFrame, topic: str, required: Sequence[str], dates: Column, bodies: Column, tokens: Column, lost: Column) -> DataFrame:
    """(topic, n, n_missing, n_dates, n_bodies, n_tokens, n_lost): how many JSON records of a topic break each rule."""
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))) > 0
    n = lambda c: F.count(F.when(F.coalesce(c, F.lit(True)), 1))
    return records.agg(
        F.lit(topic).alias("topic"), F.count(F.lit(1)).alias("n"), n(missing).alias("n_missing"), n(dates).alias("n_dates"),
        n(bodies).alias("n_bodies"), n(tokens).alias("n_tokens"), n(lost).alias("n_lost"),
    )


def raw_checks(lines: DataFrame) -> DataFrame:
    """Rules of the raw topic: all fields, dates within the replay, a body that is neither empty nor deleted."""
    field = lambda k: F.get_json_object("value", f"$.{k}")
    dates = ~field("created_utc").cast("bigint").between(DATE_START, DATE_END)
    return _checks(lines, "raw", REQUIRED, dates, field("body").isin("", "[deleted]", "[removed]"), F.lit(False), F.lit(False))


def cleaned_checks(lines: DataFrame) -> DataFrame:
    """Rules of the cleaned topic: all fields, a date, a body, tokens as a list, and no text that lost its emoji."""
    field = lambda k: F.get_json_object("value", f"$.{k}")
    lost = F.coalesce(field("original_body").rlike(_EMOJI) & ~field("cleaned_body").rlike(_EMOJI), F.lit(False))
    required = ["id", "created_utc", "subreddit", "original_body", "cleaned_body", "tokens", "score", "controversiality"]
    return _checks(lines, "cleaned", required, field("created_utc").isNull(), field("original_body") == "", ~F.startswith(field("tokens"), F.lit("[")), lost)
