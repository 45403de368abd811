import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import distinct, frequent


def zipf_lists(n=3000, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    out = [rnd.choices(words, weights, k=rnd.randrange(0, 12)) for _ in range(n)]
    return [[w.upper() if rnd.random() < 0.3 else w for w in x] + rnd.choice([[], [""], ["  "], [None]]) for x in out] + [None, []]


def brute(lists):
    return Counter(w.lower() for x in lists if x for w in x if w and w.strip())


@pytest.mark.parametrize("width", [frequent.WIDTH, 64, 3])
def test_frequent_is_exact_at_any_width(spark, width):
    lists = zipf_lists()
    c = brute(lists)
    df = spark.createDataFrame([(x,) for x in lists], "tokens array<string>").repartition(5)
    f = frequent.frequent(df, 0.01, width=width)
    assert f.total == sum(c.values())
    got = f.items.collect()
    assert {r["item"]: r["count"] for r in got} == {w: n for w, n in c.items() if n >= 0.01 * f.total}
    assert all(r["lower"] <= r["count"] <= r["upper"] for r in got)


def test_frequent_weights_and_edges(spark):
    df = spark.createDataFrame([(["a", "B"], [5, None]), (["b", "a "], [7, 1]), (None, None), ([], [])], "t array<string>, w array<bigint>")
    f = frequent.frequent(df, 0.0)
    assert {r["item"]: r["count"] for r in f.items.collect()} == {"a": 5, "b": 7, "a ": 1} and f.total == 13
    none = spark.createDataFrame([], "t array<string>")
    assert frequent.frequent(none, 0.1).items.count() == 0
    with pytest.raises(ValueError):
        frequent.Sketch(0, 5)


def test_sketch_bounds_and_merge():
    rng = np.random.default_rng(1)
    values = [f"v{int(x)}" for x in rng.zipf(1.3, 20_000) if x < 5000]
    parts = [Counter(values[i::3]) for i in range(3)]
    whole = frequent.Sketch(4, 128)
    for p in parts:
        s = frequent.Sketch(4, 128)
        s.add(frequent.hashes(list(p)), np.array(list(p.values())))
        whole.merge(s)
    c = Counter(values)
    low, high = whole.bounds(frequent.hashes(list(c)))
    n = np.array(list(c.values()))
    assert (low <= n).all() and (n <= high).all() and whole.total[0].sum() == len(values)
    heavy = n >= len(values) / 64
    assert (low[heavy] > 0).all()
    with pytest.raises(ValueError):
        whole.merge(frequent.Sketch(4, 64))


def test_distinct_error_merge_and_combinations(spark):
    n = 40_000
    df = spark.range(n).select(F.concat(F.lit("u"), F.col("id") % 30_000).alias("author"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"), (F.col("id") % 7).alias("day"))
    parts = distinct.registers(df, ["k", "day"], "author")
    whole = distinct.estimate(distinct.merge(parts, []), []).first()
    assert abs(whole["estimate"] - 30_000) <= 4 * distinct.std_error() * 30_000 and whole["low"] <= 30_000 <= whole["high"]
    direct = distinct.registers(df, [], "author")
    assert distinct.merge(parts, []).exceptAll(direct).count() == 0 == direct.exceptAll(distinct.merge(parts, [])).count()
    half = distinct.registers(df.where("id % 2 = 0"), [], "author").unionByName(distinct.registers(df.where("id % 2 = 1"), [], "author"))
    assert distinct.merge(half, []).exceptAll(direct).count() == 0
    got = distinct.estimate(distinct.combine(parts, ["k", "day"], {"k": F.col("k").isNotNull()}), ["level", "k", "day"]).collect()
    levels = Counter(r["level"] for r in got)
    assert levels == {"all": 1, "k": 2, "day": 7, "k+day": 14}
    exact = {(r["k"], r["day"]): r["n"] for r in df.groupBy("k", "day").agg(F.count_distinct("author").alias("n")).collect()}
    for r in got:
        if r["level"] == "k+day":
            assert abs(r["estimate"] - exact[r["k"], r["day"]]) <= 5 * distinct.std_error() * exact[r["k"], r["day"]] + 2


def test_distinct_small_and_empty(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("y", None), (None, "c")], "k string, author string")
    got = {r["k"]: r["estimate"] for r in distinct.estimate(distinct.registers(df, ["k"], "author"), ["k"]).collect()}
    assert got == {"x": 2, None: 1}
    none = distinct.registers(df.where("false"), ["k"], "author")
    assert none.count() == 0 and distinct.estimate(none, ["k"]).count() == 0


def test_registers_round_trip_and_estimator_is_unbiased(spark):
    bits = [1, 2, 3, 0b1011, 1 << 52, (1 << 52) | 1, (1 << 40) | (1 << 39) | (1 << 38) | 5]
    df = spark.createDataFrame([(b,) for b in bits], "bits bigint")
    packed = df.select("bits", distinct.pack(F.col("bits")).alias("r"))
    again = packed.select("bits", "r", distinct.pack(distinct.unpack(F.col("r"))).alias("r2"), distinct.unpack(F.col("r")).alias("u")).collect()
    for r in again:
        top = r["bits"].bit_length() - 1
        assert r["r"] == r["r2"] and r["u"] == r["bits"] & (0b111 << max(0, top - 2) if top >= 2 else 0b111)
    rng, p, n, errors = np.random.default_rng(2), 8, 5000, []
    for _ in range(60):
        idx, rank = rng.integers(0, 1 << p, n), np.minimum(rng.geometric(0.5, n), 64 - p + 1)
        seen = np.zeros((1 << p, 64 - p + 2), bool)
        seen[idx, rank] = True
        top = seen.shape[1] - 1 - seen[:, ::-1].argmax(axis=1)
        used = np.flatnonzero(seen.any(axis=1))
        reg = [4 * top[i] + 2 * (top[i] > 1 and seen[i, top[i] - 1]) + (top[i] > 2 and seen[i, top[i] - 2]) for i in used]
        v, c = np.unique(np.array(reg, int), return_counts=True)
        a, b = distinct.likelihood_terms(v, c.astype(float), np.zeros(len(v), int), 1, p)
        errors.append(distinct.solve(a, b, p)[0] / n - 1)
    assert abs(np.mean(errors)) < 3 * distinct.std_error(p) / 60**0.5 and np.std(errors) < 1.35 * distinct.std_error(p)


def _rows_of(sketches):
    return {tuple(r[c] for c in sketches.columns[:-1]): sorted(r["sketch"]) for r in sketches.collect()}


def test_packed_combinations_hold_the_same_registers(spark, monkeypatch):
    monkeypatch.setattr(distinct, "HELD", 700)
    df = spark.range(5000).select(
        F.concat(F.lit("u"), F.col("id") % 900).alias("author"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("day"), F.lit("clash").alias("sketch"), F.lit(1).alias("level"),
    ).repartition(5)
    df = df.unionByName(df.limit(40).withColumn("author", F.lit(None).cast("string")))
    known = {"k": F.col("k").isNotNull()}
    got = _rows_of(distinct.cube(df, ["k", "day"], "author", known))
    parts = distinct.combine(distinct.registers(df, ["k", "day"], "author"), ["k", "day"], known)
    want: dict = {}
    for r in parts.collect():
        want.setdefault((r["level"], r["k"], r["day"]), []).append(r["idx"] * 256 + r["register"])
    assert got == {k: sorted(v) for k, v in want.items()}
    a = {tuple(r[:3]): r[3:] for r in distinct.estimate(parts, ["level", "k", "day"]).collect()}
    b = {tuple(r[:3]): r[3:] for r in distinct.estimate_packed(distinct.cube(df, ["k", "day"], "author", known), ["level", "k", "day"]).collect()}
    assert a == b
    assert distinct.cube(df.where("false"), ["k"], "author").count() == 0
    one = distinct.cube(df, ["k"], "author", sets=[["k"]])
    assert {r[0] for r in one.select("level").distinct().collect()} == {"k"} and one.count() == 3


def test_packing_by_arrays():
    bits = np.array([1, 2, 3, 0b1011, 1 << 41, (1 << 41) - 1, (1 << 60) | (1 << 59), (1 << 60) - 1], np.uint64)
    packed = distinct._pack(bits)
    tops = [int(b).bit_length() - 1 for b in bits]
    assert packed.tolist() == [4 * (t + 1) + 2 * (int(b) >> (t - 1) & 1 if t >= 1 else 0) + (int(b) >> (t - 2) & 1 if t >= 2 else 0) for t, b in zip(tops, bits)]
    assert (distinct._pack(distinct._unpack(packed)) == packed).all()
