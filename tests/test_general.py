"""Repeated deliveries, hot keys and late rows against brute force."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from math import ceil

import duckdb
import pytest
from pyspark.sql import functions as F

from rivulet.operators import dedup, panes, skew
from rivulet.plans import general

T0 = datetime(2019, 4, 1, tzinfo=timezone.utc)
SCHEMA = "id string, ingest_ts timestamp, kafka_partition int, kafka_offset bigint, body string, _file string, bits string"


def deliveries(n, seed=1):
    """A third of the rows are one id; some ids are missing."""
    rnd = random.Random(seed)
    ids = lambda: "hot" if rnd.random() < 0.34 else rnd.choice([None, "", "None", "a", "A", " a", *map(str, range(n // 3))])
    return [(ids(), T0 + timedelta(seconds=rnd.randrange(50)), rnd.randrange(3), i, f"body {i} " * rnd.randrange(3), "f", None) for i in range(n)]


def brute_dedup(rows):
    first, keep = {}, []
    for r in rows:
        if r[0] in (None, "", "None"):
            keep.append(r)
        elif r[0] not in first or (r[1], r[2], r[3]) < (first[r[0]][1], first[r[0]][2], first[r[0]][3]):
            first[r[0]] = r
    return sorted(keep + list(first.values()), key=lambda r: r[3])


@pytest.mark.parametrize("bound", [dedup.BROADCAST_BYTES, 1])
def test_dedup(spark, tmp_path, bound, monkeypatch):
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(dedup, "HOT_ROWS", 20)
    rows = deliveries(900)
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(str(tmp_path / "t"))
    plan = dedup.dedup_plan(spark, str(tmp_path / "t"))
    got = sorted((tuple(r) for r in plan.apply(bound=bound).collect()), key=lambda r: r[3])
    assert [r[3] for r in got] == [r[3] for r in brute_dedup(rows)] and [r[4] for r in got] == [r[4] for r in brute_dedup(rows)]
    counts = Counter(r[0] for r in rows)
    assert {r["id"]: r["copies"] for r in plan.duplicated_ids().collect()} == {k: n for k, n in counts.items() if n > 1 and k not in (None, "", "None")}


def test_dedup_ties_and_empty(spark, tmp_path):
    same = [("x", T0, 0, 1, "b", None, None)] * 3 + [("y", None, None, None, None, None, None)] * 2
    spark.createDataFrame(same, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "same"))
    assert sorted(r["id"] for r in dedup.dedup_plan(spark, str(tmp_path / "same")).apply().collect()) == ["x", "y"]
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    plan = dedup.dedup_plan(spark, str(tmp_path / "none"))
    assert plan.apply().count() == 0 and plan.duplicated_ids().count() == 0


def test_cleaned_comments_keep_their_nested_columns(spark, sf):
    path = f"{sf}/reddit_comments_cleaned.parquet"
    df = general.p2_cleaned_whole(spark, sf)
    assert df.schema == spark.read.parquet(path).schema
    cur = duckdb.execute(f"""SELECT * FROM '{path}' QUALIFY id IS NULL OR id IN ('', 'None') OR
        row_number() OVER (PARTITION BY id ORDER BY ingest_ts NULLS FIRST, kafka_partition, kafka_offset) = 1""")
    names, want = [c[0] for c in cur.description], cur.fetchall()
    assert names == df.columns and any(r[names.index("tokens")] for r in want) and any(r[names.index("keyword_senses")] for r in want)
    text = lambda v: sorted(v.items()) if isinstance(v, dict) else v.replace(tzinfo=None) if isinstance(v, datetime) else v
    plain = lambda rows: sorted(repr([text(v) for v in r]) for r in rows)
    assert plain(tuple(r) for r in df.collect()) == plain(want)


def keyed(n, seed=2):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.4 else rnd.choice([None, "", *"abcdefg"]), rnd.choice([None, *range(-20, 60)])) for _ in range(n)]


def test_weighted_percentiles_and_summary(spark):
    rows = keyed(2000)
    w = skew.compress(spark.createDataFrame(rows, "k string, v bigint"), "k", "v")
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    probs = (0.0, 0.5, 0.9, 1.0)
    got = {r["key"]: tuple(r[f"q{i}"] for i in range(4)) for r in skew.weighted_percentiles(w, probs).collect()}
    for k, vs in by.items():
        s = sorted(v for v in vs if v is not None)
        assert got[k] == tuple(s[max(1, ceil(p * len(s))) - 1] for p in probs)
    summary = {r["key"]: r for r in skew.key_summary(w).collect()}
    for k, vs in by.items():
        c = Counter(v for v in vs if v is not None)
        top = min(c, key=lambda v: (-c[v], v))
        assert (summary[k]["n_rows"], summary[k]["n_values"], summary[k]["mode"], summary[k]["mode_count"]) == (len(vs), len(c), top, c[top])


def test_skew_edges(spark):
    none = spark.createDataFrame([], "k string, v bigint")
    w = skew.compress(none, "k", "v")
    assert skew.key_summary(w).count() == 0 and skew.weighted_percentiles(w, (0.5,)).count() == 0 and skew.heavy_keys(w, 0.05).count() == 0
    only_null = skew.compress(spark.createDataFrame([("a", None), (None, None)], "k string, v bigint"), "k", "v")
    assert {(r["key"], r["n_rows"], r["n_values"], r["mode"]) for r in skew.key_summary(only_null).collect()} == {("a", 1, 0, None), (None, 1, 0, None)}
    clash = spark.createDataFrame([("a", 1, 2, 3)], "key string, value bigint, weight bigint, piece int")
    assert skew.weighted_percentiles(skew.compress(clash, "key", "value"), (0.5,)).first()["q0"] == 1


def test_heavy_keys(spark):
    w = skew.compress(spark.createDataFrame(keyed(1000), "k string, v bigint"), "k", "v")
    c = Counter(k for k, _ in keyed(1000))
    assert {r["key"] for r in skew.heavy_keys(w, 0.05).collect()} == {k for k, n in c.items() if k and n >= 50}


def test_judge_edges(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    start = int(T0.timestamp())
    rows = [(start, at(3600)), (start, at(3601)), (start, at(3600 + 7200)), (start, at(3600 + 7200) + timedelta(microseconds=1)), (None, at(0)), (start, None)]
    df = spark.createDataFrame(rows, "e bigint, a timestamp")
    got = [r["status"] for r in panes.judge(df, F.col("e"), F.col("a"), 3600, 7200).collect()]
    assert got == ["on_time", "late", "late", "past_cutoff", None, "on_time"]


def test_first_deliveries(spark):
    rows = [("x", 2, 1), ("x", 1, 9), ("x", 1, 8), (None, 5, 5), ("", 6, 6), (None, 5, 5)]
    df = spark.createDataFrame(rows, "id string, t int, o int")
    got = panes.first_deliveries(df, [F.col("id")], F.col("id").isNotNull() & (F.col("id") != ""), ["t", "o"], ["t", "o"])
    assert sorted(map(tuple, got.collect())) == [(1, 8), (5, 5), (5, 5), (6, 6)]


def events(n=400, seed=3):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot", "hot", "a", None]), t := int(T0.timestamp()) + rnd.randrange(6 * 3600), T0 + timedelta(seconds=t - int(T0.timestamp()) + rnd.choice([0, 1, 4000, 9000, 30000]))) for _ in range(n)]


def brute_windows(rows, size, slide, cutoff):
    step, out = panes.pane_size(size, slide), defaultdict(lambda: [0, 0, 0])
    for k, e, a in rows:
        p = e // step * step
        late = a.timestamp() - (p + step)
        for w in range(p // slide * slide, p + step - size - 1, -slide):
            out[k, w][0] += late <= cutoff
            out[k, w][1] += 0 < late <= cutoff
            out[k, w][2] += late > cutoff
    return dict(out)


@pytest.mark.parametrize(("size", "slide"), [(3600, 3600), (7200, 1800), (5400, 3600)])
def test_panes_and_revisions(spark, size, slide):
    rows = events()
    df = spark.createDataFrame(rows, "k string, e bigint, a timestamp")
    judged = panes.judge(df, F.col("e"), F.col("a"), panes.pane_size(size, slide), 7200)
    got = panes.recompose(panes.panes(judged, ["k"], {}), ["k"], ["n", "n_late", "n_past"], size, slide).collect()
    want = brute_windows(rows, size, slide, 7200)
    assert {(r["k"], r["window_start"]): [r["n"], r["n_late"], r["n_past"]] for r in got} == want
    last = {}
    for r in sorted(panes.revisions(judged, ["k"], F.col("a"), size, slide, 600).collect(), key=lambda r: r["revision"]):
        assert r["emitted_s"] >= r["window_end"]
        last[r["k"], r["window_start"]] = r["n"]
    assert last == {k: v[0] for k, v in want.items() if v[0]}


@pytest.mark.parametrize(("size", "slide", "cutoff"), [(3600, 3600, 7200), (7200, 1800, 7200), (5400, 3600, 1000), (21600, 7200, 0)])
def test_windows_are_judged_by_their_own_end(spark, size, slide, cutoff):
    start = int(T0.timestamp())
    edge = [("e", start, T0 + timedelta(seconds=size + cutoff, microseconds=u)) for u in (0, 1)] + [("e", start, None), ("e", None, T0)]
    rows, want = events() + edge, defaultdict(lambda: [0, 0, 0])
    for k, e, a in rows:
        for w in range(e // slide * slide, e - size, -slide) if e is not None else ():
            late = 0 if a is None else (a - T0) / timedelta(seconds=1) + start - (w + size)
            want[k, w][0] += late <= cutoff
            want[k, w][1] += 0 < late <= cutoff
            want[k, w][2] += late > cutoff
    df = spark.createDataFrame(rows, "k string, e bigint, a timestamp")
    p = panes.window_panes(df, ["k"], F.col("e"), F.col("a"), {"v": F.lit(2)}, size, slide, cutoff)
    got = panes.recompose_windows(p, ["k"], ["v"], size, slide).collect()
    assert {(r["k"], r["window_start"]): [r["n"], r["n_late"], r["n_past"]] for r in got} == dict(want)
    assert all(r["v"] == 2 * r["n"] and r["window_end"] == r["window_start"] + size for r in got)


def test_pane_size():
    assert panes.pane_size(5400, 3600) == 1800
    with pytest.raises(ValueError):
        panes.pane_size(0, 1)


def test_panes_give_back_the_rows_they_turn_away(spark):
    rnd = random.Random(8)
    t0 = datetime(2019, 4, 1, tzinfo=timezone.utc)
    rows = [(rnd.randrange(3), i, 1554076800 + rnd.randrange(30_000), t0 + timedelta(seconds=rnd.randrange(45_000))) for i in range(400)] + [(0, 900, None, t0), (0, 901, 1554076800, None)]
    df = spark.createDataFrame(rows, "p int, o int, t bigint, a timestamp").repartition(4)
    judged = panes.judge(df, F.col("t"), F.col("a"), 3600, 7200)
    parts = panes.past_panes(judged, ["p"], [F.floor(F.col("o") / 32)], ["o"])
    got = parts.select("p", F.inline("past")).collect()
    end = lambda t: t // 3600 * 3600 + 3600
    want = {(p, o) for p, o, t, a in rows if t is not None and a is not None and a.timestamp() > end(t) + 7200}
    assert {(r["p"], r["o"]) for r in got} == want and len(got) == len(want) > 50
    whole = panes.panes(judged, ["p"], {})
    for c in ("n", "n_late", "n_past"):
        assert parts.agg(F.sum(c)).first() == whole.agg(F.sum(c)).first()
    assert max(r["n_past"] for r in parts.collect()) <= 32
