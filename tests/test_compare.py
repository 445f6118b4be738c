"""Keyed comparison and one-to-one proofs against plain code."""

import random
from collections import Counter

import pytest

from stratalign.operators import compare
from stratalign.storage import SnapshotError


def test_every_class_of_difference(spark):
    schema = "k long, j string, x double, s string, n long"
    left = [(1, "a", 1.0, "s", 1), (2, "a", 1.0, "s", 1), (3, "a", 1.0, None, 1), (4, "a", None, "s", 1), (5, "a", 1.0, "s", 1), (5, "a", 1.0, "s", 1), (6, "a", 1.0, "s", 1), (7, None, 1.0, "s", 1), (8, "a", float("nan"), "s", 1), (9, "a", None, None, None)]
    right = [(1, "a", 1.0, "s", 1), (2, "a", 1.0 + 1e-10, "t", 2), (3, "a", 1.0, "s", 1), (4, "a", 2.0, "s", 1), (5, "a", 1.0, "s", 1), (7, None, 1.5, "s", 1), (8, "a", float("nan"), "s", 1), (9, "a", None, None, None), (10, "b", 1.0, "s", 1)]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = Counter(map(tuple, compare.compare_tables(a, b, ["k", "j"], {"x": 1e-9}).collect()))
    assert got == Counter([
        (2, "a", "value", "s", "s", "t"), (2, "a", "value", "n", "1", "2"), (3, "a", "null_left", "s", None, "s"), (4, "a", "null_left", "x", None, "2.0"), (5, "a", "repeated", None, "2", "1"),
        (6, "a", "left_only", None, None, None), (7, None, "value", "x", "1.0", "1.5"), (10, "b", "right_only", None, None, None),
    ])
    assert compare.compare_tables(a.filter("k < 5"), a.filter("k < 5"), ["k"]).count() == 0
    assert compare.compare_tables(a.filter("k = 99"), b.filter("k = 99"), ["k"]).count() == 0
    odd = b.withColumn("n", b["n"].cast("string")).withColumn("more", b["k"])
    assert compare.shared_columns(a, odd, ["k", "j"]) == (["x", "s"], [("more", "", "bigint"), ("n", "bigint", "string")])
    with pytest.raises(SnapshotError):
        compare.compare_tables(a, b.withColumn("k", b["k"].cast("string")), ["k"])


def test_relations_of_all_degrees(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(14), rng.randrange(14)) for g in ("x", None) for _ in range(9)] + [("y", 1, 1), ("y", 2, 2), ("y", 2, None), ("y", None, 3), ("y", 1, 1)]
    want = Counter()
    for g in ("x", "y", None):
        links = {(a, b) for h, a, b in rows if h == g and a is not None and b is not None}
        todo = set(links)
        while todo:
            part = {todo.pop()}
            while more := {e for e in todo if any(e[0] == p[0] or e[1] == p[1] for p in part)}:
                part |= more
                todo -= more
            l, r = {str(a) for a, _ in part}, {b for _, b in part}
            kind = {(True, True): "one_to_one", (True, False): "one_to_many", (False, True): "many_to_one", (False, False): "many_to_many"}[len(l) == 1, len(r) == 1]
            want[g, min(l), len(l), len(r), len(part), kind] += 1
    got = compare.one_to_one(spark.createDataFrame(rows, "g string, a long, b long"), ["g"], "a", "b")
    assert Counter(map(tuple, got.collect())) == want
