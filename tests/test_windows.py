import pytest
from pyspark.sql import functions as F

from rivulet.functions import sketches
from rivulet.operators import late, trending, windows

BASE = 1554076800
SCHEMA = "id string, author string, created_utc bigint, original_body string, tokens array<string>, matched_keywords array<string>, keyword_senses map<string,string>, sentiment_label string"


def comments(spark, *rows):
    full = [{"id": str(i), "author": "a", "created_utc": BASE, "original_body": f"b{i}", "tokens": [], "matched_keywords": ["apple"], "keyword_senses": {}, "sentiment_label": "positive"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in full], SCHEMA)


def test_fan_out(spark):
    df = comments(spark, {"matched_keywords": ["apple", "android"], "keyword_senses": {"apple": "company"}}, {"sentiment_label": None}, {"sentiment_label": ""}, {"matched_keywords": []})
    assert sorted(r["keyword"] for r in windows.keyword_rows(df).collect()) == ["android", "apple:company"]


def test_sentiment(spark):
    df = comments(
        spark,
        {"created_utc": BASE + 10}, {"created_utc": BASE + 20, "sentiment_label": "negative"}, {"created_utc": BASE + 3700},
        {"created_utc": BASE + 5, "matched_keywords": ["android"], "sentiment_label": "negative"},
    )
    got = {(r["keyword"], r["window_start"]): (r["positive_ratio"], r["comment_count"]) for r in windows.sentiment(df, 3600).collect()}
    assert got == {("apple", BASE): (0.5, 2), ("apple", BASE + 3600): (1.0, 1), ("android", BASE): (0.0, 1)}
    with pytest.raises(ValueError):
        windows.sentiment(df, 0)


def test_ratio_rounds_half_even(spark):
    df = spark.range(32).select(F.when(F.col("id") == 0, "positive").otherwise("negative").alias("l"))
    assert df.agg(windows.ratio(F.col("l"))).first()[0] == 0.0312
    assert df.where("id > 99").agg(windows.ratio(F.col("l"))).first()[0] == 0.0


def test_reach(spark):
    df = comments(spark, {"author": "u1"}, {"author": "u2"}, {"author": "u2"}, {"author": "[deleted]"}, {"author": ""}, {"author": None})
    r = windows.reach(df, 300).first()
    assert (r["unique_authors"], r["comment_count"], r["sketch"]["precision"]) == (2, 3, 12)
    assert windows.merge_reach(windows.reach_sketches(df, 60), 3600).first()["unique_authors"] == 2


def test_hll_error_and_bounds(spark):
    for n in (100, 1000, 50_000):
        got = spark.range(n).agg(sketches.hll_count(sketches.hll(F.col("id").cast("string")))).first()[0]
        assert abs(got - n) <= max(2, 4 * sketches.hll_std_error() * n)
    with pytest.raises(ValueError):
        sketches.hll_std_error(3)
    assert spark.range(10).agg(sketches.count_min(F.col("id"))).first()[0]
    top = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "x").otherwise(F.col("id").cast("string")).alias("v")).agg(sketches.top_values(F.col("v"), 1)).first()[0]
    assert top[0]["item"] == "x"


@pytest.mark.parametrize(
    ("keyword", "tokens", "expected"),
    [
        ("tesla", "the Apple at x1 🚀 market AND", {"apple", "market"}),
        ("apple", "battery life sucks", {"battery", "life", "battery life", "sucks", "life sucks"}),
        ("tesla", "king of pop", {"king", "pop"}),
        ("apple", "Apple watch rocks", {"watch", "apple watch", "rocks", "watch rocks"}),
        ("ai", "ai safety research", {"ai safety", "safety", "research", "safety research"}),
        ("tesla", "video video video custom video", {"video", "video video", "custom", "video custom", "custom video"}),
        ("apple", "apple apple", set()),
        ("apple", "", set()),
    ],
)
def test_terms(spark, keyword, tokens, expected):
    df = spark.createDataFrame([(keyword, tokens.split())], "k string, t array<string>")
    got = df.select(trending.terms(F.col("t"), F.col("k")).alias("x")).first()["x"]
    assert set(got) == expected and len(got) == len(set(got))


def test_publish(spark):
    counts = lambda **n: spark.createDataFrame([("apple", 0, k.replace("_", " "), v) for k, v in n.items()], "keyword string, window_start bigint, term string, count bigint")
    assert trending.publish(counts(a=29), 60).count() == 0 and trending.publish(counts(a=30), 60).count() == 1
    r = trending.publish(counts(battery_life=2, cranberry=1), 60, min_terms=3).first()
    assert [i["token"] for i in r["items"]] == ["battery life"] and r["sketch"]["stream_total"] == 3 and r["window_end"] == 60
    assert trending.publish(counts(x=1, y=1), 60, min_terms=2).first()["items"] == []
    zipf = spark.createDataFrame([("common", 7.0), ("rare", 2.5)], "word string, zipf double")
    weighed = trending.publish(counts(common=5, rare=4), 60, min_terms=1, zipf=zipf).first()["items"]
    assert [(i["token"], i["score"]) for i in weighed] == [("rare", 20.0), ("common", 5.0)]


def test_repeated_body_counts_once(spark):
    df = comments(spark, *[{"original_body": "spam", "tokens": ["spam", "menu"]}] * 5, {"original_body": "spam", "tokens": ["spam", "menu"], "created_utc": BASE + 7200})
    got = {(r["window_start"], r["term"]): r["count"] for r in trending.term_counts(trending.first_of_body(df, 3600), 3600).collect()}
    assert got[(BASE, "spam")] == 1 and got[(BASE + 7200, "spam")] == 1


def test_late(spark):
    df = comments(spark, {"created_utc": BASE + 100}, {"created_utc": BASE + 4000}, {"created_utc": BASE + 50, "matched_keywords": ["a", "b"], "tokens": ["word"]})
    df = df.withColumn("ingest_ts", F.timestamp_seconds(F.lit(BASE) + F.col("id").cast("int") * 10))
    got = {r["pipeline"]: r["count"] for r in late.late_drops(df, 3600, 5, 10).collect()}
    assert got == {"sentiment": 2, "reach": 2, "trending": 2}


def test_breakdowns(spark):
    df = comments(spark, {}, {"sentiment_label": "negative"}, {"sentiment_label": None}).withColumn("language", F.when(F.col("id") == "0", "en"))
    assert {r["language"]: r["positive_ratio"] for r in windows.by_language(df).collect()} == {"en": 1.0, "unknown": 0.0}
    assert {r["label"]: r["n"] for r in windows.label_counts(df).collect()} == {"positive": 1, "negative": 1, None: 1}
