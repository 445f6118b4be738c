"""Exact quantiles and interval joins against plain code."""

import math
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalign.operators import hot, intervals, quantiles

POINTS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


def linear(values, p):
    v = sorted(values)
    h = (len(v) - 1) * p
    a, b = v[math.floor(h)], v[math.ceil(h)]
    return a if a == b else a + (b - a) * (h - math.floor(h))


@pytest.mark.parametrize(("bins", "few"), [(4, 3), (256, 4096)])
def test_quantiles_of_hard_groups(spark, bins, few, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 50)
    rng = random.Random(3)
    groups = {
        "plain": [rng.gauss(0, 1) for _ in range(300)], "ties": [1.5] * 200 + [2.5] * 3, "one": [7.0], "two": [1.0, 2.0], "wide": [10.0 ** rng.uniform(-300, 300) for _ in range(120)],
        "minus": [-(10.0 ** rng.uniform(-5, 5)) for _ in range(90)], "zero": [0.0, -0.0, 1e-12, -1e-12] * 9, "ends": [float("inf"), -float("inf"), 1.0, 2.0, 3.0], None: [3.0, 1.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("plain", None), ("plain", float("nan")), ("empty", None)]
    rng.shuffle(rows)
    got = {r["g"]: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", POINTS, ["g"], bins=bins, few=few).collect()}
    assert set(got) == {*groups, "empty"} and got["empty"]["n"] == 0 and got["empty"]["p50"] is None
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        for p, name in zip(POINTS, ("p00", "p01", "p25", "p50", "p90", "p99_9", "p100"), strict=True):
            want = linear(vs, p)
            assert got[g][name] == want or math.isnan(got[g][name]) and math.isnan(want), (g, p)


def test_one_group_of_many_values_needs_few_rounds(spark, monkeypatch):
    seen = []
    real = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: seen.append(1) or real(*a))
    df = spark.range(300_000).select((F.pow(F.lit(10.0), F.pmod(F.xxhash64("id"), F.lit(1000)) / 50 - 10) + F.col("id") * 1e-9).alias("v"))
    got = quantiles.exact_quantiles(df, "v", (0.05, 0.5, 0.95)).first()
    values = np.array([r["v"] for r in df.collect()])
    assert [got[c] for c in ("p05", "p50", "p95")] == [linear(values.tolist(), p) for p in (0.05, 0.5, 0.95)]
    assert len(seen) <= 8


def brute(rows, table):
    return Counter((i, k) for i, x in rows if x is not None for k, lo, hi in table if lo < x <= hi)


@pytest.mark.parametrize("kind", ["long", "date"])
def test_intervals_of_all_lengths(spark, kind, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 20)
    rng = random.Random(5)
    spread = 9_000 if kind == "date" else 1 << 40
    table = [(k, lo, lo + rng.choice([0, -3, 1, 2, 3, 64, 65, 1000, spread // 3])) for k, lo in enumerate(rng.randrange(-spread, spread) for _ in range(300))] + [(900, None, 5), (901, 5, None)]
    rows = [(i, rng.randrange(-spread, spread)) for i in range(400)] + [(500 + i, 7) for i in range(60)] + [(999, None)] + [(700 + k, table[k][2]) for k in range(20)] + [(800 + k, table[k][1]) for k in range(20)]
    day = (lambda v: None if v is None else date(2000, 1, 1) + timedelta(days=v)) if kind == "date" else (lambda v: v)
    r = spark.createDataFrame([(i, day(x)) for i, x in rows], f"i long, at {kind}")
    t = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in table], f"k long, start {kind}, end {kind}")
    whole = [(k, a, b) for k, a, b in table if a is not None and b is not None]
    joined = intervals.interval_join(r, "at", t)
    assert Counter((x["i"], x["k"]) for x in joined.collect()) == brute(rows, whole)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    firsts = intervals.first_match(r, "at", t.withColumn("g", F.col("k") % 3), "g", ["k"])
    best = defaultdict(lambda: 10**9)
    for i, k in brute(rows, whole):
        best[i, k % 3] = min(best[i, k % 3], k)
    assert Counter((x["i"], x["g"], x["k"]) for x in firsts.collect()) == Counter((i, g, k) for (i, g), k in best.items())


@pytest.mark.parametrize("kind", ["long", "date"])
def test_totals_are_the_counts_of_all_matches(spark, kind, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 20)
    monkeypatch.setattr(intervals, "matches", None)  # no match is formed
    rng = random.Random(8)
    spread = 300 if kind == "date" else 1 << 40
    table = [(k, lo, lo + rng.choice([0, -3, 1, 2, 64, spread // 3])) for k, lo in enumerate(rng.randrange(-spread, spread) for _ in range(200))] + [(300 + k, 5, 9) for k in range(50)] + [(900, None, 5), (901, 5, None)]
    rows = [(i, rng.randrange(-spread, spread)) for i in range(300)] + [(500 + i, 7) for i in range(60)] + [(999, None)] + [(700 + k, table[k][2]) for k in range(20)] + [(800 + k, table[k][1]) for k in range(20)]
    day = (lambda v: None if v is None else date(2000, 1, 1) + timedelta(days=v)) if kind == "date" else (lambda v: v)
    r = spark.createDataFrame([(i, day(x)) for i, x in rows], f"i long, at {kind}").repartition(5)
    t = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in table], f"k long, start {kind}, end {kind}")
    want = Counter(k for _, k in brute(rows, [x for x in table if None not in x]).elements())
    got = intervals.interval_totals(r, "at", t)
    assert {x["k"]: x["n"] for x in got.collect()} == want and got.columns == ["k", "start", "end", "n"]
    assert intervals.interval_totals(r.filter("false"), "at", t).count() == 0 and intervals.interval_totals(r, "at", t.filter("false")).count() == 0


def test_joins_of_intervals_broadcast_no_matches(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 20)
    r = spark.range(200).select("id", F.lit(7).cast("long").alias("at"))
    t = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 9).alias("start"), F.lit(8).cast("long").alias("end"))
    shares = []
    real = hot.materialize
    monkeypatch.setattr(hot, "materialize", lambda df, name: shares.append((name, real(df, name))) or shares[-1][1])
    joined = intervals.interval_join(r, "at", t)
    assert joined.count() == 200 * sum(k % 9 < 7 for k in range(300))
    dealt = dict(shares)["dealt"].groupBy("_share").count().collect()
    assert len(dealt) == 10 and max(x["count"] for x in dealt) < 40
    assert "found" not in joined._jdf.queryExecution().toString()


def test_no_intervals_and_no_rows(spark):
    r = spark.createDataFrame([(1, 5)], "i long, at long")
    none = spark.createDataFrame([], "k long, start long, end long")
    assert intervals.interval_join(r, "at", none).count() == 0
    assert intervals.interval_join(r.filter("false"), "at", spark.createDataFrame([(1, 2, 9)], "k long, start long, end long")).count() == 0
