"""Batches of occurrences against one resolution of all of them."""

import random

import pytest
from pyspark.sql import functions as F

from stratalign.operators import components as C
from stratalign.streaming.identity import IncrementalIdentity

SCHEMA = "occurrence_id string, aliases array<string>, fallback_alias string"


def full(spark, rows):
    mapping, table, gone = C.protected_components(spark.createDataFrame(rows, SCHEMA), "document")
    return (
        {r["occurrence_id"]: r["canonical_key"] for r in mapping.collect()},
        {r["canonical_key"]: tuple(r["aliases"]) for r in table.collect()},
        {(r["alias"], r["iteration"]) for r in gone.select("alias", "iteration").distinct().collect()},
    )


def state(inc):
    ids = inc.identities().collect()
    assert len({r["occurrence_id"] for r in ids}) == len(ids)
    return (
        {r["occurrence_id"]: r["canonical_key"] for r in ids},
        {r["canonical_key"]: tuple(r["aliases"]) for r in inc.components().collect()},
        {(r["alias"], r["iteration"]) for r in inc.quarantined().collect()},
    )


def occ(i, *aliases):
    return (f"o{i}", list(aliases), f"LOCAL_DOC_QUAR:{i}")


PLANTED = [
    [occ(1, "DOI:a", "DOC_TITLE:t"), occ(2, "DOI:b"), occ(3, "PMID:9", "DOC_TITLE:z")],
    [occ(4, "DOI:c", "CHEMBL_DOC:1")],
    [occ(5, "DOC_TITLE:t", "DOI:b")],  # a and b meet by a title: the title goes, and the family splits
    [occ(6, "CHEMBL_DOC:1", "PMID:9")],  # two families become one
    [occ(7, "DOC_TITLE:t"), occ(8, "DOI:a", "PMID:1")],
]


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 2, 0, 3, 1)])
def test_batches_in_any_order_equal_one_resolution(spark, tmp_path, order):
    inc, seen = IncrementalIdentity(spark, str(tmp_path / "state"), "document", compact_every=3), []
    for n, k in enumerate(order):
        inc.update(spark.createDataFrame(PLANTED[k], SCHEMA), n)
        seen += PLANTED[k]
        if n == 4:
            assert state(inc) == full(spark, seen), n
    assert any(a == "DOC_TITLE:t" for a, _ in state(inc)[2])


def test_random_batches(spark, tmp_path):
    rng = random.Random(7)
    pool = [f"DOI:{i}" for i in range(25)] + [f"PMID:{i}" for i in range(25)] + [f"DOC_TITLE:{i}" for i in range(12)] + [f"CHEMBL_DOC:{i}" for i in range(25)]
    rows = [occ(i, *rng.sample(pool, rng.randint(1, 2))) for i in range(50)]
    inc = IncrementalIdentity(spark, str(tmp_path / "state"), "document")
    for n in range(2):
        inc.update(spark.createDataFrame(rows[n::2], SCHEMA), n)
    assert state(inc) == full(spark, rows)


def test_a_batch_reads_what_it_touches_and_may_be_repeated(spark, tmp_path):
    inc = IncrementalIdentity(spark, str(tmp_path / "state"), "document")
    many = spark.range(5_000).select(F.concat(F.lit("o"), "id").alias("occurrence_id"), F.array(F.concat(F.lit("DOI:"), F.floor(F.col("id") / 5))).alias("aliases"), F.concat(F.lit("LOCAL_DOC_QUAR:"), "id").alias("fallback_alias"))
    inc.update(many, 0)
    late = spark.createDataFrame([("x1", ["DOI:3", "CHEMBL_DOC:1"], "LOCAL_DOC_QUAR:x1"), ("x2", ["DOI:8"], "LOCAL_DOC_QUAR:x2"), ("x3", [], "LOCAL_DOC_QUAR:x3")], SCHEMA)
    inc.update(late, 1)
    once = state(inc)
    inc.update(late, 1)
    assert state(inc) == once
    work = {r["n"]: (r["batch_rows"], r["touched_families"], r["state_rows"]) for r in inc.work().collect()}
    assert work == {0: (5_000, 1_000, 0), 1: (2, 2, 10)}
    assert len(once[0]) == 5_002
