"""Star contraction against union-find, on the shapes that are hard for it."""

import random

import pytest
from pyspark.sql import functions as F

from stratalign.operators import hot, stars


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(up)}


def labels(found):
    return {r["node"]: r["label"] for r in found.labels.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(hot, "LEAST_HOT", 3)
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, k) for k in range(501, 540)]
    odd = [(None, 3), (4, None), (7, 7)]
    got = labels(stars.star_components(spark.createDataFrame(pairs + pairs[:20] + odd, "a long, b long")))
    assert got == union_find([p for p in pairs if p[0] != p[1]])
    text = labels(stars.star_components(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "a string, b string")))
    assert {int(k[1:]): int(v[1:]) for k, v in text.items()} == got


def test_no_edges(spark):
    found = stars.star_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"))
    assert found.rounds == 0 and found.labels.count() == 0


def test_a_path_of_a_hundred_thousand_takes_few_rounds(spark):
    n = 100_000
    shuffled = (F.col("id") * 7919 + 13) % n  # neighbours on the path are far apart in order
    path = spark.range(n - 1).select(shuffled.alias("a"), (((F.col("id") + 1) * 7919 + 13) % n).alias("b"))
    found = stars.star_components(path)
    assert found.rounds <= 20
    assert found.labels.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first() == (n, 0, 0)


def test_a_star_of_a_million_meets_in_no_task(spark):
    n = 1_000_000
    star = spark.range(1, n).select(F.lit(n + 5).alias("a"), F.col("id").alias("b"))  # the hub is the largest node
    found = stars.star_components(star)
    assert found.rounds <= 5
    assert found.labels.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first() == (n, 1, 1)
    turned = star.select("a", "b")
    heavy = hot.hot_keys(turned, ["a"])
    assert [r["a"] for r in heavy.collect()] == [n + 5]
    # what is left to the shuffle holds fewer rows of any key than the mark, and hot keys are few by count
    rest = turned.join(heavy, "a", "left_anti").groupBy("a").count().agg(F.max("count")).first()[0]
    assert rest is None or rest < hot.LEAST_HOT


def test_hot_join_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 10)
    rows = spark.createDataFrame([(None, 0)] + [(k % 7 if k % 2 else 3, k) for k in range(200)] + [(99, 1)] * 12 + [(98, 1)], "k long, v long")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "k long, t string")
    for how in ("left", "inner"):
        want = sorted(map(str, rows.join(table, "k", how).select("k", "v", "t").collect()))
        assert sorted(map(str, hot.hot_join(rows, table, ["k"], how).select("k", "v", "t").collect())) == want
