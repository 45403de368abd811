import json

import pytest
from pyspark.sql import functions as F

from rivulet.operators import parse
from rivulet.operators import language

BASE = {"id": "abc123", "author": "user1", "created_utc": 1554076812, "body": "Hello https://x.com world this is a test comment", "score": 42, "subreddit": "technology", "controversiality": 0}


def run(spark, *values):
    rows = [(v if isinstance(v, str) else json.dumps(v),) for v in values]
    return parse.parse(spark.createDataFrame(rows, "value string")).collect()


@pytest.mark.parametrize(
    ("value", "error"),
    [
        (BASE, None), ("{not json", "json_decode_error"), ("[1]", "root_not_object"), ("3", "root_not_object"),
        ({"id": "x", "body": "hi"}, "missing_fields: ['author', 'controversiality', 'created_utc', 'score', 'subreddit']"),
        ({**BASE, "body": "[deleted]"}, "deleted_body"), ({**BASE, "body": "[removed]"}, "deleted_body"), ({**BASE, "body": " [deleted]"}, None),
        ({**BASE, "body": "   "}, "empty_body"), ({**BASE, "body": " \n"}, "empty_body"), ({**BASE, "body": 5}, "empty_body"), ({**BASE, "body": None}, "empty_body"),
        ({**BASE, "created_utc": -1}, "invalid_created_utc"), ({**BASE, "created_utc": "1.5"}, "invalid_created_utc"), ({**BASE, "created_utc": None}, "invalid_created_utc"),
    ],
)
def test_errors(spark, value, error):
    got = run(spark, value)[0]["error"]
    assert got == error or (error == "json_decode_error" and got.startswith(error))


def test_coercion(spark):
    r = run(spark, {**BASE, "created_utc": "12", "score": 1.9, "controversiality": True, "id": None, "author": 7})[0]
    assert (r["created_utc"], r["score"], r["controversiality"], r["id"], r["author"]) == (12, 1, 1, "None", "7")
    assert run(spark, {**BASE, "score": "x", "created_utc": " 12 "})[0]["score"] == 0


def test_side_output_and_record(spark):
    df = parse.parse(spark.createDataFrame([(json.dumps(BASE),), ("x" * 3000,)], "value string"))
    bad = parse.malformed(df).collect()
    assert len(bad) == 1 and len(bad[0]["raw"]) == 2000 and bad[0]["ingest_ts"] == 0
    good = parse.cleaned(parse.valid(df))
    assert good.columns == ["id", "author", "created_utc", "subreddit", "original_body", "cleaned_body", "tokens", "score", "controversiality", "language"]
    r = good.first()
    assert "https" not in r["cleaned_body"] and r["tokens"][0] == "Hello" and r["language"] == "en"


@pytest.fixture(scope="module")
def detector(spark, sf):
    return language.train(spark.read.parquet(f"{sf}/language_samples.parquet"))


def test_english_gate(spark, detector):
    texts = ["hi", "", "This is the best thing that I have seen all day", "Dit is een heel lange Nederlandse zin die niet Engels is", "Это предложение написано на русском языке"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(language.is_english(spark, F.col("t"), detector)).collect()]
    assert got == [True, True, True, False, False]


def test_dump(spark):
    from rivulet.sources import replay

    rows = [{**BASE, "id": i, "created_utc": t} for i, t in enumerate([replay.DATE_START - 1, replay.DATE_START, replay.DATE_END, replay.DATE_END + 1])]
    rows += [{**BASE, "body": "[removed]"}, {"created_utc": 1554076900, "body": "only these"}, [1, 2]]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    got = parse.decode_dump(df, start=replay.DATE_START, end=replay.DATE_END).collect()
    assert sorted(r["id"] for r in got) == ["", "1", "2"]
    assert [r["score"] for r in got if r["id"] == ""] == [0]


def test_detector(spark, detector, sf):
    """Languages of sentences that it has not seen, and texts of which it knows nothing."""
    samples = spark.read.parquet(f"{sf}/language_samples.parquet").collect()
    half = language.train(spark.createDataFrame([(r["lang"], r["text"]) for r in samples if r["sample_id"] % 2], "lang string, text string"))
    rest = [r for r in samples if r["sample_id"] % 2 == 0]
    right = sum(a == r["lang"] for a, r in zip(half.detect([f" {r['text'].lower()} " for r in rest]), rest, strict=True))
    assert right >= 0.97 * len(rest)
    assert detector.detect(["", "  ", "漢字", " the end of the story "]) == [None, None, None, "en"] and detector.detect([]) == []
    empty = spark.createDataFrame([(None, "x"), ("en", None), ("en", "12 34")], "lang string, text string")
    with pytest.raises(ValueError):
        language.train(empty)
    df = spark.createDataFrame([("Dit is een heel lange Nederlandse zin",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(language.is_english(spark, F.col("t"), None)).collect()] == [True] * 3


def test_detector_reads_long_texts_piece_by_piece(detector, monkeypatch):
    texts = [" the end of the story ", "", " der hund und die katze ", " le chien et le chat " * 40, "ab", " x "]
    whole = detector.detect(texts)
    for size in (1, 3, 50):
        monkeypatch.setattr(language, "PIECE", size)
        assert detector.detect(texts) == whole
