
import pytest
from pyspark.sql import functions as F

from rivulet.operators import views

ORDER = ["n"]


def analytics(spark, *rows):
    """(keyword, window_end, items); arrival in the order given."""
    data = [("trending", k, e, [(t, c, s) for t, c, s in items], None, None, None, None, i) for i, (k, e, items) in enumerate(rows)]
    return spark.createDataFrame(data, "type string, keyword string, window_end bigint, items array<struct<token:string,count:bigint,score:double>>, sketch struct<stream_total:bigint>, unique_authors bigint, comment_count bigint, pipeline string, n int")


def overview(spark, *rows, tracked=None):
    t = spark.createDataFrame([(k,) for k in tracked], "keyword string") if tracked else None
    return {r["token"]: r for r in views.trending_overview(views.trending_windows(analytics(spark, *rows), ORDER, t)).collect()}


ROWS = [
    ("apple", 100, [("battery life", 50, None), ("lawsuit", 30, None)]),
    ("apple", 200, [("battery life", 90, None), ("leak", 40, None)]),
    ("tesla", 200, [("battery life", 10, None)]),
]


def test_overview_and_history(spark):
    got = overview(spark, *ROWS)
    assert got["battery life"]["count"] == 100 and got["battery life"]["keywords"] == ["apple", "tesla"] and got["battery life"]["momentum"] == "up"
    assert got["leak"]["momentum"] == "new" and "lawsuit" not in got
    assert overview(spark, *ROWS, tracked=["tesla"])["battery life"]["momentum"] == "flat"
    h = {(r["token"], r["window_end"]): r["count"] for r in views.trending_history(views.trending_windows(analytics(spark, *ROWS), ORDER)).collect()}
    assert h == {("battery life", 100): 50, ("battery life", 200): 100, ("leak", 100): None, ("leak", 200): 40}


def test_momentum_ignores_first_windows(spark):
    r = overview(spark, ("apple", 100, [("x", 40, None)]), ("apple", 200, [("x", 44, None)]), ("tesla", 200, [("x", 100, None)]))["x"]
    assert (r["count"], r["momentum"], r["change"]) == (144, "flat", 0.1)


def test_ranking_and_replacement(spark):
    rows = [("apple", 100, [("already", 20, 9.8), ("cranberry", 5, 13.0), ("legacy term", 11, None)])]
    stored = views.trending_windows(analytics(spark, ("apple", 100, [("old", 1, 1.0)]), *rows), ORDER)
    assert [r["token"] for r in views.trending_overview(stored).collect()] == ["cranberry", "legacy term", "already"]
    empty = views.trending_windows(analytics(spark), ORDER)
    assert views.trending_overview(empty).count() == 0


def windows(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "keyword string, window_end bigint, positive_ratio double, comment_count bigint, n int")


def test_rebucket_headline_and_senses(spark):
    df = windows(spark, ("a", 60, 0.2, 10), ("a", 120, 0.8, 30), ("b", 10, 0.5, 0), ("b", 20, 1.0, 0))
    got = {r["keyword"]: (r["window_end"], round(r["positive_ratio"], 6), r["comment_count"]) for r in views.rebucket(df, 300).collect()}
    assert got == {"a": (0, 0.65, 40), "b": (0, 0.75, 0)} and views.rebucket(df, 1).count() == 4
    h = {r["keyword"]: (r["pct"], r["count"], r["delta_pct"]) for r in views.headline(df, 60).collect()}
    assert h == {"a": (80, 30, 60), "b": (75, 0, None)}
    m = views.merge_senses(windows(spark, ("a:x", 60, 1.0, 1), ("a:y", 60, 0.0, 3), ("c", 60, 0.5, 0))).collect()
    assert {r["keyword"]: r["positive_ratio"] for r in m} == {"a": 0.25, "c": 0.0}
    both = windows(spark, ("a:x", 60, 1.0, 1), ("A", 60, 0.0, 3), ("ab", 60, 0.0, 3))
    assert views.timeseries(both, "a").count() == 2 and views.timeseries(both, ["a", "ab"]).count() == 3
    assert [r["keyword"] for r in views.series_of_sense(both, "x").collect()] == ["a:x"] and views.series_of_sense(both, "all").count() == 3


def comments(spark, *rows):
    data = [(f"c{i}", "u", i, body, kws, senses, label, score, i) for i, (body, kws, senses, label, score) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, author string, created_utc bigint, original_body string, matched_keywords array<string>, keyword_senses map<string,string>, sentiment_label string, sentiment_score double, n int")


def test_matching_and_examples(spark):
    df = comments(
        spark,
        ("ios is fine", ["apple"], {}, "positive", 0.9), ("pure curiosity", ["apple"], {}, "positive", 0.9),
        ("great Battery-Life here", ["apple"], {}, "negative", 0.2), ("battery life of ios", ["Apple", "tesla"], {"apple": "company"}, "neutral", 0.5),
        ("no label", ["apple"], {}, None, None), ("no keyword", [], {}, "positive", 0.5), (None, None, None, "positive", 0.5),
    )
    ok = views.valid_comments(df)
    assert ok.count() == 4
    ids = lambda x: [r["id"] for r in x.collect()]
    assert ids(views.matching_comments(ok, "apple", "ios", ORDER)) == ["c3", "c0"]
    assert ids(views.matching_comments(ok, "apple", "battery life", ORDER, exclude=["c3"])) == ["c2"]
    assert sorted(ids(views.comments_of_senses(ok, ["apple"], {"apple": "company"}))) == ["c3"]
    top = views.trending_overview(views.trending_windows(analytics(spark, ("apple", 1, [("battery life", 9, 9.0), ("ios", 5, 5.0)]), ("tesla", 1, [("battery life", 9, 9.0)])), ORDER))
    ex = views.trending_examples(top, ok, ORDER, 2, 2).collect()
    assert [(r["token"], r["id"]) for r in ex] == [("battery life", "c3"), ("battery life", "c2"), ("ios", "c0")]
    with pytest.raises(ValueError):
        views.trending_examples(top, ok, ORDER, 11, 2)
    feed = views.live_feed(ok.unionByName(ok), ORDER, 3)
    assert ids(feed) == ["c3", "c2", "c1"]
    s = views.scatter(df, "apple").collect()
    assert sorted(r["score"] for r in s) == [-0.2, 0.0, 0.9, 0.9]


def test_chart_fills_from_windows(spark):
    c = comments(spark, ("x", ["a"], {}, "positive", 0.5), ("y", ["a"], {}, "odd", 0.5))
    w = windows(spark, ("a", 60, 0.5, 3), ("b", 0, 0.25, 4))
    got = {r["t"]: r.asDict() for r in views.chart(c, w, "a", "b", 60).collect()}
    assert got[0] == {"t": 0, "a_positive": 1, "a_negative": 0, "a_neutral": 1, "a_pct": None, "b_positive": 1, "b_negative": 3, "b_neutral": 0, "b_pct": 25}
    assert got[60]["a_positive"] == 2 and got[60]["a_negative"] == 1 and got[60]["a_pct"] == 50


def test_live_points_and_late(spark):
    df = windows(spark, ("A", 1, 0.1, 1), ("a", 1, 0.2, 1), ("a", 2, 0.3, 1), ("a", 1, 0.4, 1))
    assert [r["positive_ratio"] for r in views.live_points(df, ORDER).orderBy("n").collect()] == [0.2, 0.3, 0.4]
    late = spark.createDataFrame([("late_drop", "trending", 30, 100), ("late_drop", "trending", 12, 150), ("late_drop", "reach", 5, 200)], "type string, pipeline string, count bigint, emitted_at bigint")
    got = {r["pipeline"]: (r["total"], r["last_at"]) for r in views.late_status(late).collect()}
    assert got == {None: (47, 200), "trending": (42, 150), "reach": (5, 200)}
    assert views.last_per_key(df, ["keyword"], ORDER).count() == 2 and views.replaced(df, ["keyword"], ORDER).count() == 2
    raw = df.select(F.lit(None).cast("string").alias("keyword"), "window_end", "positive_ratio", "comment_count")
    assert views.valid_windows(raw).count() == 0


def test_token_bucket_by_brute_force(spark):
    import random

    rnd = random.Random(2)
    rows = [(k, rnd.randrange(40), i) for k in ("a", "b", None) for i in range(150)] + [("c", None, 1)]
    want = []
    for k in ("a", "b", None, "c"):
        left, last = 3.0, None
        for t, i in sorted((r[1:] for r in rows if r[0] == k), key=lambda x: (x[0] is not None, x)):
            left = min(3.0, left + ((t - last) if last is not None and t is not None else 0) * 0.5)
            if left >= 1:
                left -= 1
                want.append((str(k), i))
            last = t
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = [(str(r["k"]), r["i"]) for r in views.throttled(df, "k", "t", ["t", "i"], 0.5, 3).collect()]
    assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        views.throttled(df, "k", "t", ["i"], 0, 1)
