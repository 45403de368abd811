import pytest

from rivulet.config import Settings, normalise_keywords, parse_subkeywords
from rivulet.operators import keywords as K


@pytest.mark.parametrize(
    ("body", "matched", "senses"),
    [
        ("I love my Apple iPhone", ["apple"], {"apple": "company"}),
        ("The weather is nice today", [], {}),
        ("Comparing Apple vs Android phones", ["android", "apple"], {"apple": "ambiguous"}),
        ("I love pineapple juice", [], {}),
        ("APPLE makes great phones", ["apple"], {"apple": "ambiguous"}),
        ("I ate an apple from the tree", ["apple"], {"apple": "fruit"}),
        ("", [], {}),
        (None, [], {}),
    ],
)
def test_tag(spark, body, matched, senses):
    df = spark.createDataFrame([(body, None)], "cleaned_body string, tokens array<string>")
    r = K.tag(df, {"apple": [], "android": []}).first()
    assert (r["matched_keywords"], r["keyword_senses"]) == (matched, senses)


def test_tag_by_tokens_signs_and_vectors(spark):
    df = spark.createDataFrame([(None, ["big", "jaguar"]), ("c++11 and heat pumps, a heat pump", [])], "cleaned_body string, tokens array<string>")
    words = {"jaguar": ["car", "animal"], "c++": [], "heat pump": []}
    got = K.tag(df, words).collect()
    assert got[0]["keyword_senses"] == {"jaguar": "ambiguous"} and got[1]["matched_keywords"] == ["c++", "heat pump"]
    vectors = {"big": [1.0, 0.0], "car": [1.0, 0.1], "animal": [0.0, 1.0]}
    assert K.tag(df, words, vectors=vectors).first()["keyword_senses"] == {"jaguar": "car"}


def v(c):
    return [c, (1 - c * c) ** 0.5]


def test_embedding_sense():
    vec = {"iphone": v(1), "company": v(1), "fruit": v(0), "tree": v(0)}
    assert K.embedding_sense(["iPhone"], ["company", "fruit"], vec) == "company"
    assert K.embedding_sense(["iphone", "tree"], ["company", "fruit"], vec) == "ambiguous"
    assert K.embedding_sense([], ["company"], vec) == "ambiguous"
    assert K.embedding_sense(["orchard"], ["orchard", "fruit"], vec) == "orchard"
    assert K.embedding_sense(None, ["x"], {}) == "ambiguous"


def test_registry(spark, tmp_path):
    r = K.Registry(spark, str(tmp_path / "keywords"))
    assert r.load() == {}
    assert r.add(" Apple ") == ["apple"] and r.add("c++") == ["apple", "c++"]
    assert r.set_subkeywords("apple", ["Fruit", "company", "fruit"]) == ["fruit", "company"]
    assert K.Registry(spark, r.path).load()["apple"] == ["fruit", "company"]
    with pytest.raises(ValueError):
        r.add("no/slash")
    with pytest.raises(ValueError):
        r.set_subkeywords("apple", ["ok", "no/slash"])
    assert r.set_subkeywords("apple", []) == [] and r.remove("apple") == ["c++"]
    (tmp_path / "keywords").rename(tmp_path / "gone")
    assert r.load() == {"c++": []}


def test_settings():
    assert normalise_keywords([" A", "b", "a", ""]) == ["a", "b"]
    assert parse_subkeywords("a:x,y;b:z;bad;:q;c:") == {"a": ["x", "y"], "b": ["z"]}
    s = Settings.from_env({"KEYWORDS": "Apple, tesla", "WINDOW_SIZE_SEC": "60"})
    assert s.keywords == ("apple", "tesla") and s.analytics_window_s == 60
    with pytest.raises(ValueError):
        Settings(window_s=0)


def test_tracked_keywords_in_any_spelling(spark):
    rows = [(" Apple ", ["Company", "fruit"]), ("Apple", ["x", "fruit", "no/slash"]), ("tesla", None), ("bad/one", ["y"]), (None, ["z"]), ("", None)]
    table = spark.createDataFrame(rows, "keyword string, subkeywords array<string>")
    got = K.tracked(table)
    assert list(got) == ["apple", "tesla"] and sorted(got["apple"]) == ["company", "fruit", "x"] and got["tesla"] == []
    assert K.tracked(table.where("false")) == {}


def test_many_keywords_by_brute_force(spark):
    """Whole-word search by pattern, one keyword after the other."""
    import re

    texts = ["C++ and c++11, node.js!", "Tim Cook ate .net5 at at-t", "tim  cook", "tim\ncook", "a b c", "x-y z", "#tag c# c#sharp", "éapple apple_ APPLE", "1 2 3 1.5", "b b b", "ß.net", "++ a++b", ""]
    words = ["c++", "node.js", "tim cook", ".net", "at-t", "a b", "b", "x-y", "c#", "apple", "1.5", "++", "b b", "z", "cook"] + [f"word{i}" for i in range(3000)]

    def edge(c: str, ahead: bool) -> str:
        word = r"\w"
        return (f"(?!{word})" if ahead else f"(?<!{word})") if re.match(word, c) else (f"(?={word})" if ahead else f"(?<={word})")

    want = [sorted(k for k in words if re.search(edge(k[0], False) + re.escape(k) + edge(k[-1], True), t, re.I)) for t in texts]
    df = spark.createDataFrame([(t, []) for t in texts], "cleaned_body string, tokens array<string>").coalesce(1)
    got = [r["matched_keywords"] for r in K.tag(df, dict.fromkeys(words, [])).collect()]
    assert got == want


def test_senses_of_a_batch_are_those_of_each_list():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    vectors = {w: rng.normal(size=3).tolist() for w in "abcdefgh"} | {"zero": [0.0] * 3}
    subs = {"k": ["a", "b", "q"], "m": ["c"], "n": ["zero", "d", "r", "e"], "o": ["q", "r"]}
    lists = [[str(t) for t in rng.choice([*"abcdefghqrst", "zero"], int(rng.integers(0, 6)))] for _ in range(300)]
    names = sorted(vectors)
    got = K._sense_batch(lists, pd.Index(names), np.array([vectors[w] for w in names]), subs, 0.20, 0.05)
    for k, listed in subs.items():
        assert got[k].tolist() == [K.embedding_sense(ts, listed, vectors) for ts in lists]


def test_no_keywords_at_all(spark):
    df = spark.createDataFrame([("some text", ["some", "text"]), (None, None)], "cleaned_body string, tokens array<string>")
    assert [(r["matched_keywords"], r["keyword_senses"]) for r in K.tag(df, {}).collect()] == [([], {})] * 2
