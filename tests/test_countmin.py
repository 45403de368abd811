import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rivulet.ml import vectors
from rivulet.operators import countmin, trending


def test_estimates_merge_and_bounds(spark):
    rnd = random.Random(1)
    rows = [("k", f"v{int(rnd.paretovariate(0.8))}") for _ in range(6000)] + [("j", "v1"), ("k", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    c = Counter(v for k, v in rows if k == "k" and v)
    whole = countmin.build(df, ["k"], "v", 256, 4)
    got = {r["v"]: r["estimate"] for r in countmin.estimate(whole, df.where("k = 'k' AND v IS NOT NULL"), ["k"], "v", 256, 4).collect()}
    assert set(got) == set(c) and all(got[v] >= n for v, n in c.items())
    assert sum(got[v] - n > 2.72 / 256 * sum(c.values()) for v, n in c.items()) < 0.05 * len(c)
    halves = [countmin.build(df.where(F.xxhash64("v") % 2 == i), ["k"], "v", 256, 4) for i in (0, 1, -1)]
    merged = countmin.merge(halves[0].unionByName(halves[1]).unionByName(halves[2]), ["k"])
    assert merged.exceptAll(whole).count() == 0 == whole.exceptAll(merged).count()
    asked = spark.createDataFrame([("j", "absent")], "k string, v string")
    assert countmin.estimate(whole, asked, ["k"], "v", 256, 4).first()["estimate"] == 0
    assert countmin.build(df.where("false"), ["k"], "v").count() == 0
    with pytest.raises(ValueError):
        countmin.build(df, ["k"], "v", 0)


def test_vectors(spark):
    rows = [(["Apple", "iphone", "mac"],), (["apple", "tree", "juice"],), ([" "],), (None,)] * 20
    m = vectors.train(spark.createDataFrame(rows, "tokens array<string>"), size=8, min_count=2, partitions=1)
    known = vectors.lookup(m, ["apple", "absent"])
    assert set(known) == {"apple"} and len(known["apple"]) == 8 and len(vectors.lookup(m)) == 5
    got = vectors.probe(m, ["apple", "absent"], 2)
    assert got["absent"] is None and len(got["apple"]) == 2


def _terms(spark, *counts):
    """(keyword, day, term), one row for each occurrence."""
    rows = [(k, d, t) for k, d, words in counts for t, n in words.items() for _ in range(n)]
    return spark.createDataFrame(rows, "keyword string, day int, term string").repartition(4)


def test_counters_find_heavy_terms_in_order(spark):
    noise = {f"noise{i}": 1 for i in range(2000)}
    c = trending.Counters.build(_terms(spark, ("all", 1, {"apple": 500, "tesla": 300, "brexit": 100, **noise})), ["keyword"])
    top = c.top().orderBy("rank").collect()
    assert [r["term"] for r in top[:3]] == ["apple", "tesla", "brexit"] and len(top) == 20
    assert all(r["count"] >= n for r, n in zip(top, (500, 300, 100)))


def test_counters_merge(spark):
    c = trending.Counters.build(_terms(spark, ("a", 1, {"apple": 60, "tesla": 80}), ("a", 2, {"apple": 60, "brexit": 80}), ("b", 1, {"x": 3})), ["keyword", "day"])
    top = {(r["keyword"], r["rank"]): (r["term"], r["count"]) for r in c.merge(["keyword"]).top().collect()}
    assert top["a", 1] == ("apple", 120) and top["a", 2] == ("brexit", 80) and top["b", 1] == ("x", 3)


def test_counters_rank_telling_terms_first(spark):
    zipf = spark.createDataFrame([("people", 6.0), ("lawsuit", 4.0), ("battery", 4.5), ("life", 6.2)], "word string, zipf double")
    c = trending.Counters.build(_terms(spark, ("a", 1, {"people": 30, "lawsuit": 14, "battery life": 16, "zzq": 9})), ["keyword"])
    got = [(r["term"], r["score"]) for r in c.top(zipf).orderBy("rank").collect()]
    assert got == [("lawsuit", 49.0), ("battery life", 48.0), ("people", 45.0), ("zzq", 45.0)]
    assert trending.Counters.build(_terms(spark, ("a", 1, {})), ["keyword"]).top().count() == 0


def test_common_words_by_rule(spark):
    df = spark.createDataFrame([(["The", "the", "cat"],), (["the", "x1", None, "dog"],), (None,)], "tokens array<string>")
    z = {r["word"]: (r["n"], round(r["zipf"], 4)) for r in trending.zipf_table(df).collect()}
    assert z == {"the": (3, 8.7782), "cat": (1, 8.301), "dog": (1, 8.301)}
    assert trending.common_words(trending.zipf_table(df), 0.5) == ["the"] and len(trending.common_words(trending.zipf_table(df), 0.2)) == 3
    assert trending.zipf_table(df.where("false")).count() == 0
