import random

import pytest
from pyspark.sql import functions as F

from rivulet.llm import mix


def table(spark, seed=1, n=3000):
    rnd = random.Random(seed)
    rows = [(i, rnd.choices(["big", "mid", "small", None, "unplanned"], [60, 20, 5, 1, 5])[0], rnd.choice([0, 5, 20, 100, 400])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint")


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def check(rows, plan, chosen, report):
    sizes = {}
    for i, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    caps = {s: m for s, _, m in plan}
    used = {}
    by_id = {i: (s, n) for i, s, n in rows}
    for r in chosen:
        s, n = by_id[r["id"]]
        assert (r["source"], r["n_tokens"]) == (s, n) and 1 <= r["copies"] <= caps[s]
        used[s] = used.get(s, 0) + n * r["copies"]
    for r in report:
        assert r["tokens"] == used.get(r["source"], 0) and r["tokens"] <= sizes.get(r["source"], 0) * r["max_repeats"]
        assert r["actual_share"] is None or abs(r["actual_share"] - r["tokens"] / sum(used.values())) < 1e-12
    return used


def test_shares(spark):
    rows, df = table(spark)
    plan = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 6), ("absent", 0.0, 1)]
    chosen, report = mix.mix(df, targets(spark, *plan), "id")
    report = report.collect()
    check(rows, plan, chosen.collect(), report)
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.01 for r in report)
    again = mix.mix(df.repartition(7), targets(spark, *plan), "id")[0]
    assert again.exceptAll(chosen).count() == 0 == chosen.exceptAll(again).count()


def test_given_total_hits_caps(spark):
    rows, df = table(spark)
    plan = [("big", 0.5, 1), ("small", 0.5, 2)]
    chosen, report = mix.mix(df, targets(spark, *plan), "id", total=10**9)
    used = check(rows, plan, chosen.collect(), report.collect())
    total = lambda s: sum(n for _, x, n in rows if x == s)
    assert used == {"big": total("big"), "small": 2 * total("small")}


def test_one_giant_record_is_skipped(spark):
    rows = [(i, "a", 10) for i in range(500)] + [(10_000 + i, "a", 3000) for i in range(3)] + [(20_000 + i, "b", 10) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint")
    plan = [("a", 0.5, 1), ("b", 0.5, 1)]
    chosen, report = mix.mix(df, targets(spark, *plan), "id")
    check(rows, plan, chosen.collect(), report.collect())
    assert all(abs(r["actual_share"] - 0.5) < 0.02 for r in report.collect())


def test_edges(spark):
    _, df = table(spark)
    chosen, report = mix.mix(df.where("false"), targets(spark, ("big", 1.0, 1)), "id")
    assert chosen.count() == 0 and [(r["tokens"], r["actual_share"]) for r in report.collect()] == [(0, None)]
    same = spark.createDataFrame([(1, "a", 5)] * 40, "id bigint, source string, n_tokens bigint")
    chosen, report = mix.mix(same, targets(spark, ("a", 1.0, 1)), "id")
    assert chosen.count() == 40
    assert mix.mix(df, targets(spark, ("nowhere", 1.0, 3)), "id")[0].count() == 0


@pytest.mark.parametrize("around", [mix.AROUND, 50, 1])
def test_budgets_are_met_at_any_depth(spark, monkeypatch, around):
    """Refined to few records and to many, the budgets are met, and with them the shares."""
    monkeypatch.setattr(mix, "AROUND", around)
    rows, df = table(spark, 7, 2000)
    plan = [("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 3)]
    sized = df.where("n_tokens > 0 AND source IS NOT NULL").select("source", "n_tokens", mix._hash(F.col("id")).alias("h"))
    for b in mix.budgets(sized, targets(spark, *plan)):
        assert abs(b.full * b.size + b.extra - b.wanted) <= mix.TOLERANCE * b.wanted + 5
    chosen, report = mix.mix(df, targets(spark, *plan), "id")
    check(rows, plan, chosen.collect(), report.collect())


def test_what_is_left_is_filled_from_far_records(spark, monkeypatch):
    """Behind the boundary stand large records only; the small one that fits is far away."""
    monkeypatch.setattr(mix, "AROUND", 1)
    rows = [(i, "a", 1000) for i in range(400)] + [(9000 + i, "a", 300) for i in range(2)] + [(20_000, "b", 100_350)]
    df = spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint")
    plan = [("a", 0.5, 1), ("b", 0.5, 1)]
    chosen, report = mix.mix(df, targets(spark, *plan), "id")
    used = check(rows, plan, chosen.collect(), report.collect())
    assert abs(used["a"] - 100_350) <= mix.TOLERANCE * 100_350 + 100
