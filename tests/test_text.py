import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.functions.stem import stem, stem_tokens


def one(spark, expr, **columns):
    df = spark.createDataFrame([Row(**columns)]) if columns else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [
        ("See [click here](https://x.com) for more", "See click here for more"),
        ("Thanks /u/someone in /r/python", "Thanks in"),
        ("a &amp; b &#39;c", "a b c"),
        ("go to HTTPS://x.y/z or www.a.b now", "go to or now"),
        ("line one\nline\t two ", "line one\nline two"),
        ("Café naïve résumé 🎉", "Café naïve résumé 🎉"),
        ("", ""),
        ("   \n ", ""),
    ],
)
def test_clean(spark, raw, cleaned):
    assert one(spark, X.clean(F.col("b")), b=raw) == cleaned


def test_clean_null_and_lower(spark):
    assert one(spark, X.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, X.clean(F.col("b"), lower=True), b="AbC") == "abc"


def test_tokens(spark):
    t = lambda s, stop=(): one(spark, X.tokenize(F.col("b"), stop), b=s)
    assert t("I am happy :-) and sad :(") == ["I", "am", "happy", ":-)", "and", "sad", ":("]
    assert t("don't stop!!! Café 🎉🎉 x_1") == ["don't", "stop", "!!!", "Café", "🎉🎉", "x_1"]
    assert t("the quick brown fox", X.STOPWORDS) == ["quick", "brown", "fox"]
    assert t("") == []


@pytest.mark.parametrize(
    ("word", "text", "hit"),
    [
        ("apple", "I love pineapple", False), ("apple", "APPLE rocks", True), ("apple", "éapple", False), ("apple", "apple_", False),
        ("c++", "c++ a", False), ("c++", "c++11", True), ("heat pump", "a Heat Pump.", True),
    ],
)
def test_whole_word(spark, word, text, hit):
    assert one(spark, F.col("b").rlike(X.whole_word(word)), b=text) is hit


def test_term_and_snippet(spark):
    hit = lambda body, term: one(spark, F.regexp_like("b", X.term_pattern(F.lit(term))), b=body)
    assert hit("new battery-life record", "battery life") and not hit("curiosity", "ios")
    s = one(spark, X.snippet(F.col("b"), F.lit("needle")), b="x" * 200 + " needle " + "y" * 200)
    assert s.startswith("…") and s.endswith("…") and "needle" in s and len(s) <= 290
    assert one(spark, X.snippet(F.col("b"), F.lit("none")), b="z" * 500) == "z" * 280
    assert one(spark, X.snippet(F.lit(None).cast("string"), F.lit("none"))) == ""


def test_numbers(spark):
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 1.0
    assert one(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, X.informativeness(F.lit(0.0))) == 5.0 and one(spark, X.informativeness(F.lit(7.0))) == 1.0
    assert one(spark, X.signed_score(F.lit("negative"), F.lit(0.4))) == -0.4
    assert [one(spark, X.label_of(F.lit(x))) for x in (0.05, -0.05, 0.0)] == ["positive", "negative", "neutral"]
    with pytest.raises(ValueError):
        X.label_of(F.lit(0.0), -1)
    assert one(spark, X.hash64(F.lit("a"), 1)) != one(spark, X.hash64(F.lit("a"), 2))
    assert one(spark, X.first_text(F.lit(" "), F.lit("b"), tokens=F.array(F.lit("c")))) == "b"
    assert one(spark, X.first_text(F.lit(" "), tokens=F.array(F.lit("c"), F.lit("d")))) == "c d"


def test_stem(spark):
    assert [stem(w) for w in ("running", "Cities", "glass", "🎉", "hopefulness")] == ["run", "citi", "glass", "🎉", "hope"]
    assert one(spark, stem_tokens(F.array(F.lit("jumped"), F.lit("x1")))) == ["jump", "x1"]



def test_stems_of_the_published_sample(spark):
    from rivulet.functions.stem import stem, stem_tokens

    words = """consign consigned consisting consistency consolatory consoled consolidating consolingly consonant conspiracy conspirators constables constancy
    knack knackeries knavish kneaded kneeling knightly knitted knives knocker generously hoping hopping national relational sky dying flies ties gas proceed
    happily agreed luxuriated by say enjoy cry controlling""".split()
    stems = """consign consign consist consist consolatori consol consolid consol conson conspiraci conspir constabl constanc
    knack knackeri knavish knead kneel knight knit knive knocker generous hope hop nation relat sky die fli tie gas proceed
    happili agre luxuri by say enjoy cri control""".split()
    assert [stem(w) for w in words] == stems
    assert [stem(w) for w in ("Running", "it's", "x2", "!!", "🎉", "s", "")] == ["run", "it", "x2", "!!", "🎉", "s", ""]
    df = spark.createDataFrame([(["Dogs", None, "dogs"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in df.select(stem_tokens(F.col("t"))).collect()] == [["dog", None, "dog"], None, []]


def test_slices_of_a_batch():
    for sizes in ([], [0], [5], [1, 2, 3, 4], [9, 1, 1, 9, 0, 0, 3], [0] * 5):
        for most in (1, 3, 100):
            out = list(X.slices(sizes, most))
            assert [i for p in out for i in range(p.start, p.stop)] == list(range(len(sizes)))
            assert all(p.stop - p.start == 1 or sum(sizes[p]) <= most for p in out)
