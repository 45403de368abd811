import numpy as np
import pyarrow.parquet as pq
import pytest

from rivulet.llm import language


@pytest.fixture(scope="module")
def samples(sf):
    t = pq.read_table(f"{sf}/language_samples.parquet").to_pydict()
    return sorted(zip(t["lang"], t["text"], strict=True))


@pytest.fixture(scope="module")
def net(samples):
    return language.train(samples[::2])


def test_held_out_accuracy(samples, net):
    held = samples[1::2]
    found = language.classify(net, [t for _, t in held])
    right = sum({s[0] for s in f} == {lang} for f, (lang, _) in zip(found, held, strict=True))
    assert right >= 0.95 * len(held)


def test_mixed_texts_and_plain_letters(samples, net):
    by = {}
    for lang, t in samples[1::2]:
        by.setdefault(lang, t)
    a, b = by["en"], by["de"]
    got = language.classify(net, [f"{a} {b}", language.plain(by["ru"], "ru"), by["fr"].upper()])
    assert {"en", "de"} <= {s[0] for s in got[0]}
    assert got[1][0][0] == "ru" and got[2][0][0] == "fr"
    assert all(0 < s[2] <= 1 for g in got for s in g)


def test_edges(net):
    got = language.classify(net, [None, "", "  \n ", "https://x.y /u/someone 123", "🎉🎉", "the " * 20_000])
    assert got[:5] == [[]] * 5 and sum(len(s[1]) for s in got[5]) > 70_000
    assert language.n_words("one two 3 /u/x https://a.b four") == 3
    assert language.windows("x" * 500)[-1] == b"x" * language.WINDOW and len(language.windows("")) == 1


def test_probabilities_do_not_depend_on_the_batch(net):
    rows = [w for t in ("This is a sentence.", "Das ist ein Satz.", "kurz", "Une phrase assez longue pour deux fenêtres " * 3) for w in language.windows(t)]
    whole = net.probabilities(rows)
    one = np.concatenate([net.probabilities([r]) for r in rows])
    assert np.abs(whole - one).max() < 0.2 and (whole.argmax(1) == one.argmax(1)).all()


def test_segments_and_sampling(spark, net):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "Does anyone know whether this fits the door? Weiß jemand, ob das Zelt auch passt?", 1), ("b", None, 2), ("b", None, 2)], "id string, body string, language int")
    got = language.segments(df, net, ["id"], "body").collect()
    assert [len(r["segments"]) for r in sorted(got, key=lambda r: r["id"])] == [2, 0, 0]
    assert language.segments(df.where("false"), net, ["id"], "body").count() == 0
    many = spark.range(4000).select(F.when(F.col("id") % 10 < 9, "en").otherwise("de").alias("lang"), F.col("id").cast("string").alias("text"))
    got = language.sample(many, 50)
    assert len([1 for a, _ in got if a == "en"]) <= 50 and 20 <= len([1 for a, _ in got if a == "de"]) <= 50 and got == language.sample(many.repartition(5), 50)
    with pytest.raises(ValueError):
        language.fit(many.where("lang = 'en'"))


@pytest.mark.parametrize(("label", "code"), [("en-US", "en"), ("DE", "de"), (" fr ", "fr"), ("und", None), ("unknown", None), ("", None), (None, None), ("pt_BR", "pt")])
def test_stated(spark, label, code):
    from pyspark.sql import functions as F

    assert spark.range(1).select(language.stated(F.lit(label).cast("string"))).first()[0] == code


def test_sentences_run_together_are_cut_at_every_change():
    """a, b and c are languages, u is none; capitals are windows of which the network is sure."""
    runs = lambda s: [s[a:b] for a, b in language._runs(["abcu".index(x.lower()) for x in s], [0.95 if x.isupper() else 0.5 for x in s], 3)]
    assert runs("AAA") == ["AAA"] and runs("ABA") == ["A", "B", "A"] and runs("AbaB") == ["A", "baB"]
    assert runs("AaaBcC") == ["Aaa", "B", "cC"] and runs("AUA") == ["AUA"] and runs("uab") == ["uab"] and runs("A") == ["A"]


def test_words_of_plain_and_other_texts_are_counted_alike():
    import random

    rnd = random.Random(5)
    bits = ["word ", "it's ", "two. ", "lol ", "haha! ", "é ", "12 ", "\n", "a-b ", "🎉", "smh", "? ", "(x) ", "[l](http://a.b) ", "#tag ", "&amp; "]
    for _ in range(2000):
        t = "".join(rnd.choices(bits, k=rnd.randrange(0, 12)))
        total, found = language.counted(language.quiet(t))
        assert total == len(language._WORD.findall(language._NOISE.sub(" ", t))) == language.n_words(t)
        assert [s for s, _ in found] == [" ".join(s.split()) for s in language._END.split(language._NOISE.sub(" ", t)) if s and len(language._WORD.findall(s)) >= 2]
