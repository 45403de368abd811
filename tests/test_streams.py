import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rivulet.config import Settings
from rivulet.operators import panes, windows
from rivulet.sources import replay, topics
from rivulet.streaming import job, sinks
from rivulet.streaming.panes import PaneStream

BASE = 1554076800
ONCE = {"availableNow": True}


def raw(i, t, body="I love my apple battery life", author="a"):
    return json.dumps({"id": f"c{i}", "author": author, "created_utc": BASE + t, "body": body, "score": 1, "subreddit": "s", "controversiality": 0})


def feed(folder, n, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(lines) + "\n")


def run(queries):
    for q in queries if isinstance(queries, list) else [queries]:
        q.awaitTermination()


def test_job(spark, tmp_path):
    settings = Settings(keywords=("apple",), window_s=60, analytics_window_s=60, trending_min_terms=2, trending_min_count=1)
    j = job.Job(spark, settings, str(tmp_path / "out"))
    lines = lambda: topics.lines_stream(spark, str(tmp_path / "in"), 1)
    feed(tmp_path / "in", 1, raw(1, 0), raw(2, 10, "apple watch again", "b"), "broken", raw(3, 20, "[deleted]"))
    run(j.start_cleaning(lines(), **ONCE))
    feed(tmp_path / "in", 2, raw(4, 200, "apple once more, I said so"), raw(5, 1000, "the last apple of the day"))
    run(j.start_cleaning(lines(), **ONCE))
    cleaned = spark.read.parquet(f"{j.root}/cleaned")
    assert cleaned.count() == 4 and {r["sentiment_status"] for r in cleaned.collect()} == {"no_model_available"}
    errors = {r["error"].split(":")[0] for r in spark.read.parquet(f"{j.root}/malformed").collect()}
    assert errors == {"json_decode_error", "deleted_body"}

    labelled = cleaned.withColumn("sentiment_label", F.lit("positive")).drop("batch")
    labelled.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "labelled"))
    stream = lambda: topics.table_stream(spark, str(tmp_path / "labelled"), labelled.schema, 1)
    run(j.start_windows(stream(), **ONCE))
    got = {(r["keyword"], r["window_start"]): (r["positive_ratio"], r["comment_count"]) for r in spark.read.parquet(f"{j.root}/sentiment").collect()}
    want = {(r["keyword"], r["window_start"]): (r["positive_ratio"], r["comment_count"]) for r in windows.sentiment(labelled, 60).collect() if r["window_end"] <= BASE + 1000 - 5}
    assert got == want and len(got) == 2
    reach = {r["window_start"]: r["unique_authors"] for r in spark.read.parquet(f"{j.root}/reach").collect()}
    assert reach[BASE] == 2
    trend = {r["window_start"]: [i["token"] for i in r["items"]] for r in spark.read.parquet(f"{j.root}/trending").collect()}
    assert "battery life" in trend[BASE]
    j.reset()
    assert not (tmp_path / "out").exists()


def test_late_counter(spark, tmp_path):
    counter = job.LateCounter(spark, str(tmp_path / "late"), 60, 5)
    schema = "created_utc bigint, author string, tokens array<string>, matched_keywords array<string>, keyword_senses map<string,string>, sentiment_label string"
    row = lambda t: (BASE + t, "a", ["battery"], ["apple", "pear"], {}, "positive")
    counter(spark.createDataFrame([row(0), row(500)], schema), 0)
    counter(spark.createDataFrame([row(10), row(490)], schema), 1)
    counter(spark.createDataFrame([row(10), row(490)], schema), 1)  # a repeated batch replaces itself
    got = {r["pipeline"]: r["count"] for r in spark.read.parquet(str(tmp_path / "late/late")).collect()}
    assert got == {"sentiment": 2, "reach": 2, "trending": 2}


def test_labelling_retrains(spark, tmp_path):
    from rivulet.ml.model import Retrainer, Store

    said = []
    store = Store(spark, str(tmp_path / "models"))
    label = job.Labelling(spark, str(tmp_path), Retrainer(store, every=30), said.append)
    rows = [(f"this is {w} number {i}", None, ["this", w, str(i % 5)]) for i in range(20) for w in ("great", "awful", "plain")]
    df = spark.createDataFrame([*rows, ("great", None, [])], "original_body string, cleaned_body string, tokens array<string>")
    label(df.limit(15), 0)
    assert store.latest() is None and label.corpus().count() == 10
    label(df, 1)
    assert store.latest() and said == [f"model {store.latest()} is ready"] and label.corpus().count() == 50
    bad = job.Labelling(spark, str(tmp_path / "bad"), Retrainer(store, every=1), said.append)
    bad(df.where("original_body LIKE '%great%'"), 0)
    assert said[-1].startswith("retraining failed")


def test_pane_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2019, 4, 1, tzinfo=timezone.utc)
    rows = [(f"{i % 3}", BASE + (i * 977) % 40000, t0 + timedelta(seconds=(i * 977) % 40000 + (i % 7) * 2500), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, created_utc bigint, ingest_ts timestamp, i int")
    size, slide = 7200, 3600
    state = PaneStream(spark, str(tmp_path), size, slide, 7200, ["k"])
    for b in range(4):
        part = df.where(F.col("i") % 4 == b)
        state(part, b)
    state(df.where(F.col("i") % 4 == 3), 3)
    state(df.where("false"), 4)
    judged = panes.judge(df, F.col("created_utc"), F.col("ingest_ts"), 3600, 7200)
    want = panes.recompose(panes.panes(judged, ["k"], {}), ["k"], state.sums, size, slide)
    as_set = lambda x: {tuple(r[c] for c in ("k", "window_start", "n", "n_late", "n_past")) for r in x.collect()}
    assert as_set(state.current()) == as_set(want)


def test_pane_stream_by_window_equals_batch(spark, tmp_path):
    t0 = datetime(2019, 4, 1, tzinfo=timezone.utc)
    rows = [(f"{i % 3}", BASE + (i * 977) % 40000, t0 + timedelta(seconds=(i * 977) % 40000 + (i % 7) * 2500), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, created_utc bigint, ingest_ts timestamp, i int")
    size, slide = 7200, 3600
    state = PaneStream(spark, str(tmp_path), size, slide, 7200, ["k"], by_window=True)
    for b in (0, 1, 2, 3, 3):
        state(df.where(F.col("i") % 4 == b), b)
    want = panes.recompose_windows(panes.window_panes(df, ["k"], F.col("created_utc"), F.col("ingest_ts"), {}, size, slide, 7200), ["k"], [], size, slide)
    as_set = lambda x: {tuple(r[c] for c in ("k", "window_start", "n", "n_late", "n_past")) for r in x.collect()}
    assert as_set(state.current()) == as_set(want)


def test_replay_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(100, 1), (100, 2), (101, 3), (102, 4), (102, 5), (100, 6)], "t bigint, i bigint").withColumn("p", F.lit(0))
    got = sorted((r["run"], r["t"], r["n"]) for r in replay.runs(df, ["p"], ["i"], "t").collect())
    assert got == [(1, 100, 2), (2, 101, 1), (3, 102, 2), (4, 100, 1)]
    assert [r["i"] for r in replay.slice_of(df, ["i"], 1, 2).collect()] == [2, 3] and replay.slice_of(df, ["i"], 4, None).count() == 2
    assert replay.restamp(df, "t").agg(F.max("t")).first()[0] > 1_700_000_000
    (tmp_path / "c.jsonl").write_text('{"tokens":["a"],"label":"x"}\n\nbad\n[1]\n')
    from rivulet.schemas import LIVE_CORPUS

    assert [r["label"] for r in topics.corpus(spark, str(tmp_path / "c.jsonl"), LIVE_CORPUS).collect()] == ["x"]
    import zstandard

    (tmp_path / "dump.zst").write_bytes(zstandard.ZstdCompressor().compress((raw(1, 0) + "\n" + raw(2, 5)).encode()))
    lines = replay.numbered(replay.read_lines(spark, str(tmp_path / "dump.zst")))
    assert lines.count() == 2
    msg = replay.messages(spark.createDataFrame([("k", "a", 5, "b", 1, "s", None)], "id string, author string, created_utc bigint, body string, score bigint, subreddit string, controversiality bigint")).first()
    assert msg["key"] == "k" and json.loads(msg["value"])["controversiality"] is None
    assert sinks.as_json(df.limit(1), "i").columns == ["key", "value"]
    assert topics.synthetic(spark, 5, ["a", "b"]).isStreaming
    assert job.replay_warning(1, 5) and job.replay_warning(5, 5) is None and job.clamp("speed", 5000) == 1000


def test_runs_by_brute_force(spark):
    import random
    from itertools import groupby

    rnd = random.Random(3)
    rows = [(p, i, rnd.choice([1, 1, 1, 2, None])) for p in (0, 1, None) for i in range(400)]
    df = spark.createDataFrame(rows, "p int, i int, t int").repartition(7)
    want = set()
    for p in (0, 1, None):
        for n, (t, g) in enumerate(groupby((r for r in rows if r[0] == p), key=lambda r: r[2]), 1):
            g = list(g)
            want.add((p, n, t, len(g), g[0][1]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {tuple(r) for r in replay.runs(df, ["p"], ["i"], "t").collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert replay.runs(df.where("false"), ["p"], ["i"], "t").count() == 0


@pytest.mark.parametrize("by_window", [False, True])
def test_pane_stream_compacts(spark, tmp_path, by_window):
    t0 = datetime(2019, 4, 1, tzinfo=timezone.utc)
    rows = [(f"{i % 2}", BASE + (i * 977) % 200_000, t0 + timedelta(seconds=(i * 977) % 200_000 + (i % 7) * 2500), i) for i in range(240)]
    df = spark.createDataFrame(rows, "k string, created_utc bigint, ingest_ts timestamp, i int")
    made = [PaneStream(spark, str(tmp_path / name), 7200, 3600, 7200, ["k"], by_window=by_window, compact_every=n) for name, n in (("often", 2), ("never", 100))]
    for state in made:
        for b in (0, 1, 2, 3, 3, 4, 5, 5, 6):
            state(df.where(F.col("i") % 7 == b), b)
    a, b = ({tuple(r[c] for c in ("k", "window_start", "n", "n_late", "n_past")) for r in m.current().collect()} for m in made)
    assert a == b
    assert sorted(x.name for x in (tmp_path / "often/bases").iterdir()) == ["upto=3", "upto=5"]
    assert sorted(x.name for x in (tmp_path / "often/panes").iterdir()) == ["batch=4", "batch=5", "batch=6"]


def test_a_broken_read_is_no_empty_one(spark, tmp_path):
    schema = "created_utc bigint, author string, tokens array<string>, matched_keywords array<string>, keyword_senses map<string,string>, sentiment_label string"
    df = spark.createDataFrame([(BASE, "a", ["battery"], ["apple"], {}, "positive")], schema)
    counter = job.LateCounter(spark, str(tmp_path / "late"), 60, 5)
    counter(df, 0)
    for f in (tmp_path / "late/seen/batch=0").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader says, the micro-batch must fail
        counter(df, 1)


def test_a_broken_model_leaves_the_last_good_one(spark, tmp_path):
    from rivulet.ml import model

    rows = [([w, f"x{i % 3}"], y) for i in range(12) for w, y in (("good", "positive"), ("bad", "negative"))]
    store, said = model.Store(spark, str(tmp_path / "models")), []
    j = job.Job(spark, Settings(), str(tmp_path / "out"), store=store, report=said.append)
    assert j.model() == (None, None)
    store.save(model.fit(spark.createDataFrame(rows, "tokens array<string>, label string"), max_iter=3), version="v1")
    assert j.model()[1] == "v1"
    store._write(f"{store.root}/LATEST", "v2")
    good, version = j.model()
    assert version == "v1" and good is not None and said[0].startswith("model not loaded")


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    from rivulet import session

    class Cluster:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)
    folder = session.scratch(spark, "test")
    spark.range(3).write.parquet(folder)
    assert session.exists(spark, folder) and "_SUCCESS" in session.children(spark, folder) and session.children(spark, folder + "x") == []
    session.forget(spark)
    assert not session.exists(spark, folder)
