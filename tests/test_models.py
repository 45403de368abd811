import random

import pytest
from pyspark.sql import functions as F

from rivulet.ml import lexicon, model

GOOD, BAD = "good great love nice superb happy".split(), "bad awful hate poor broken sad".split()


def corpus(spark, n=40, seed=5):
    rnd = random.Random(seed)
    rows = [([rnd.choice(words), rnd.choice(words), f"w{rnd.randrange(9)}"], label) for _ in range(n) for words, label in ((GOOD, "positive"), (BAD, "negative"))]
    return spark.createDataFrame(rows, "tokens array<string>, label string")


def test_train_score_store(spark, tmp_path):
    train, rest = model.split(corpus(spark))
    assert train.count() + rest.count() == 80 and train.intersect(rest).count() == 0
    m = model.fit(train)
    got = model.macro(model.evaluation(m.transform(rest))).first()
    assert got["accuracy"] >= 0.9
    store = model.Store(spark, str(tmp_path))
    assert store.latest() is None and store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.load()
    v = store.save(m, {"accuracy": got["accuracy"]}, "v1")
    assert store.latest() == v and store.versions() == ["v1"] and store.metadata("v1")["labels"] == ["negative", "positive"]
    again, version = store.load()
    df = spark.createDataFrame([(["love", "superb", "nice"],), (["awful", "hate", "x"],), (["love", " "],), (None,), ([],)], "tokens array<string>")
    s = model.score(df, again, version).collect()
    assert [r["sentiment_label"] for r in s] == ["positive", "negative", None, None, None]
    assert s[0]["sentiment_score"] > 0.5 > s[1]["sentiment_score"] and s[0]["sentiment_model"] == "v1" and s[2]["tokens"] == ["love", " "]
    assert [r["sentiment_status"] for r in s] == ["scored", "scored"] + ["skipped_too_short"] * 3
    assert model.score(df, None).first()["sentiment_status"] == "no_model_available" and model.null_score(df).first()["sentiment_status"] == "pending_ml_integration"


def test_word2vec(spark):
    m = model.fit(corpus(spark), "word2vec", size=16, min_count=1)
    assert m.transform(corpus(spark, 10)).where("predicted = label").count() >= 10


def test_training_needs_labels(spark):
    with pytest.raises(ValueError):
        model.fit(corpus(spark).where("label = 'positive'"))
    with pytest.raises(ValueError):
        model.fit(corpus(spark, 1))
    with pytest.raises(ValueError):
        model.fit(corpus(spark), "other")


def test_idf_weights(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["a", "c"],), (["d"],)], "tokens array<string>")
    m = model.fit_features(df, model.tfidf_stages())
    assert m.stages[0].vocabulary == ["a", "c"]
    from math import log

    assert [round(x, 6) for x in m.stages[1].getScalingVec()] == [round(log(5 / 4) + 1, 6), round(log(5 / 3) + 1, 6)]
    assert m.transform(df).select("features").collect()[3][0].numNonzeros() == 0


def test_dataset_and_evaluation(spark):
    df = spark.createDataFrame([(["a", " "], "x"), (["a", "b"], ""), (["a", "b"], None), (["a", "b"], "y")], "tokens array<string>, label string")
    assert [r["label"] for r in model.dataset(df, 2).collect()] == ["y"] and model.dataset(df).count() == 2
    p = spark.createDataFrame([("p", "p"), ("p", "n"), ("n", "n"), ("z", "p")], "label string, predicted string")
    e = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in model.evaluation(p).collect()}
    assert e == {"p": (0.5, 0.5, 0.5, 2), "n": (0.5, 1.0, 0.6667, 1), "z": (0.0, 0.0, 0.0, 1)}


def test_lexicon(spark):
    texts = ["I love this, it's wonderful!", "This is awful and a total disaster.", "The package arrived on Tuesday.", "", None]
    df = spark.createDataFrame([(t, None, None) for t in texts], "original_body string, cleaned_body string, tokens array<string>")
    got = lexicon.label_corpus(df, keep_neutral=True).collect()
    assert [r["label"] for r in got] == ["positive", "negative", "neutral", "neutral", "neutral"]
    assert lexicon.label_corpus(df).count() == 2
    assert lexicon.compound("not good") < 0 < lexicon.compound("good") < lexicon.compound("very good!")


def test_retrainer(spark, tmp_path):
    r = model.Retrainer(model.Store(spark, str(tmp_path)), every=10)
    assert [r.add(n) for n in (4, 5, 1, 9)] == [False, False, True, False]
    assert model.Retrainer(r.store, 0).add(10**6) is False
    v = r.cycle(corpus(spark))
    assert r.store.latest() == v and r.store.metadata(v)["accuracy"] >= 0.8
    assert corpus(spark).select(F.col("label")).distinct().count() == 2


def _plain_compound(text):
    """The scoring rules, one word after the other."""
    import math

    words = lexicon._words(text)
    low, n = [w.lower() for w in words], len(words)
    caps = sum(w.isupper() for w in words)
    loud = 0 < caps < n
    values = []
    for i, w in enumerate(low):
        if w not in lexicon.VALENCE or w in lexicon.STRONGER | lexicon.WEAKER:
            continue
        v = lexicon.VALENCE[w]
        sign = lambda x: math.copysign(1, x)
        if words[i].isupper() and loud:
            v += sign(v) * 0.733
        for k in (1, 2, 3):
            if i < k or low[i - k] in lexicon.VALENCE:
                continue
            p = low[i - k]
            if p in lexicon.STRONGER or p in lexicon.WEAKER:
                b = 0.293 if p in lexicon.STRONGER else -0.293
                b = -b if v < 0 else b
                if words[i - k].isupper() and loud:
                    b += 0.733 if v > 0 else -0.733
                v += b * (1, 0.95, 0.9)[k - 1]
            between = low[i - k + 1 : i]
            if p == "never" and {"so", "this"} & set(between):
                v *= 1.25
            elif p == "without" and "doubt" in between:
                pass
            elif p in lexicon.NEGATIONS or "n't" in p:
                v *= -0.74
        if i > 0 and low[i - 1] == "least" and low[i - 1] not in lexicon.VALENCE and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= -0.74
        if "but" in low:
            v *= 0.5 if i < low.index("but") else 1.5
        values.append(v)
    s = sum(values)
    q = text.count("?")
    marks = min(text.count("!"), 4) * 0.292 + (0 if q < 2 else q * 0.18 if q <= 3 else 0.96)
    s += marks if s > 0 else -marks if s < 0 else 0
    return round(s / math.sqrt(s * s + 15), 4)


def test_lexicon_by_brute_force():
    rnd = random.Random(11)
    words = "good GREAT awful hate not never so this very BARELY least at but without doubt isn't phone , ok :) love! sad?? the".split()
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(0, 14))) for _ in range(3000)] + ["good", "", "   ", "but", "!!!"]
    got = lexicon.compounds([*texts, None])
    assert all(abs(a - _plain_compound(t)) < 1.1e-4 for a, t in zip(got, texts)) and got[-1] == 0
    assert lexicon.compounds([]).shape == (0,)
    assert sum(abs(a - _plain_compound(t)) > 1e-9 for a, t in zip(got, texts)) < 20


def test_valences_from_a_file(tmp_path):
    (tmp_path / "v.txt").write_text("grumpy\t-1.8\t0.4\t[1]\n\nsunny\t1.9\n")
    table = lexicon.read_valences(str(tmp_path / "v.txt"))
    assert table == {"grumpy": -1.8, "sunny": 1.9}
    a, b = lexicon.compounds(["a grumpy day", "a sunny day"], table)
    assert a < 0 < b


def test_vectors_are_trained_on_a_spread_sample(spark):
    from rivulet.ml import vectors

    df = spark.range(4000).select(F.array(F.concat(F.lit("w"), F.col("id") % 50), F.lit("all"), F.lit(" "), F.lit(None).cast("string"), F.concat(F.lit("x"), "id")).alias("tokens"))
    m = vectors.train(df, max_rows=1000, size=4, min_count=2, epochs=1, partitions=2)
    found = vectors.lookup(m)
    assert len(found) == 51 and set(vectors.lookup(m, ["ALL", "none"])) == {"all"} and vectors.probe(m, ["zzz"]) == {"zzz": None}
