"""Registered queries that must see whole tables and whole values, on small fixtures."""

import hashlib

import pytest

from stratalign.plans import catalogue


@pytest.fixture
def stored(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_multi_target_reads_every_line(spark, stored):
    lines = [(1, 1, 7, 1), (1, 2, 7, 1), (1, 3, 7, 2), (2, 1, 8, 1), (2, 4, 9, 1), (3, 1, 7, 3)]
    d = stored("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    audit = catalogue.queries()["multi_target_audit"](spark, d).collect()
    assert [tuple(r) for r in audit] == [(7, 3, "1|2|3")]
    kept = catalogue.queries()["multi_target_exclusion"](spark, d).collect()
    assert sorted(tuple(r) for r in kept) == [(2, 2), (3, 1)]


def test_weak_aliases_ares(spark, stored):
    opening = "the same opening of more than forty characters, "
    texts = [(1, opening + "then one end"), (2, opening + "then another"), (3, "A  title "), (4, "a Title"), (5, None), (6, None), (7, "A  title ")]
    d = stored("documents", texts, "doc_id long, text string")
    parts = catalogue.queries()["alias_components"](spark, d).collect()
    # two texts of their own, one bridged pair, and each null text by itself
    assert sorted((r["n_aliases"], r["n_doi_aliases"], r["n_weak_aliases"]) for r in parts) == [(1, 0, 0), (1, 0, 0), (2, 1, 1), (2, 1, 1), (3, 2, 1)]


def test_weak_bridges_are_whole_columns(spark, stored):
    rows = [(1, "a", "s", 7), (2, "b", "s", 7), (3, "c", "s", 8), (4, "c", "s", 8), (5, None, "s", 7), (6, "d", None, 7), (7, "e", "t", 7)]
    d = stored("documents", rows, "doc_id long, text string, source string, n_chars long")
    lost = catalogue.queries()["quarantine_weak_bridges"](spark, d).collect()
    assert [(r["alias"], r["iteration"]) for r in lost] == [("DOC_PAGE:" + hashlib.sha256(b"S\x1f7").hexdigest(), 1)]


def test_differing_keys_takes_every_id(spark, stored):
    stored("documents", [(1, "en"), (2, "de"), (3, "fr"), (3, "fr")], "doc_id long, lang string")
    d = stored("labels", [(2, 1), (5, 0)], "doc_id long, quality int")
    got = catalogue.queries()["differing_keys"](spark, d).collect()
    assert sorted(tuple(r) for r in got) == [(1, "left_only"), (3, "left_only"), (5, "right_only")]
