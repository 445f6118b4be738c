"""Faults that a review found, each as a test: doubled pages, untitled licences, names of columns, skewed buckets."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalign.llm import license_scan, line_dedup, mixing, near_dedup, queries, url_filter
from tests.llm.conftest import ODD


def test_hosts_of_one_domain_under_two_suffixes_come_once(spark, tmp_path):
    import duckdb

    urls = [(1, "http://1.2/a"), (2, "http://x.1.2/b"), (3, "http://y.org/")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in queries.op5_url_filter(spark, str(tmp_path)).collect())
    assert [r[0] for r in got] == [1, 2, 3]
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.op5_sql()})").fetchall()) == got
    hosts = spark.createDataFrame([("1.2", 1, 1), ("x.1.2", 1, 0)], "host string, n long, bad long")
    assert url_filter.host_reputation(hosts).count() == 2


def test_licences_with_and_without_their_title(spark, docs_of):
    rows, want = [], {}
    for k, (name, text) in enumerate(sorted(license_scan.TEXTS.items())):
        body = text.strip().partition("\n")[2]
        holder = "Copyright (c) 2019 A. Nother,\nand further holders\n"
        for j, t in enumerate((text, body, "Copyright (c) 2019 A. Nother\n" + body)):
            rows.append((10 * k + j, t, "s"))
            want[10 * k + j] = (name, None)
        rows.append((10 * k + 5, "readme " * 30 + "\n" + holder + body + "\nmore", "s"))
        want[10 * k + 5] = (None, name)
    got = {r["doc_id"]: (r["license"], r["blocks"]) for r in license_scan.scan_licenses(docs_of(rows)).collect()}
    for i, (whole, inside) in want.items():
        assert got[i][0] == whole, (i, whole)
        assert (whole or inside) in got[i][1], (i, inside)


def test_holders_of_any_length(spark, docs_of):
    mit = license_scan.TEXTS["MIT"].partition("holders>\n")[2]
    rows = [(n, "Copyright " + "Some Holder Inc. and " * n + "Co 2019\n" + mit, "s") for n in (1, 20, 4000)]
    got = {r["doc_id"]: (r["license"], r["digest"]) for r in license_scan.scan_licenses(docs_of(rows)).collect()}
    assert got == {i: ("MIT", license_scan.digest_of(t)) for i, t, _ in rows}


def test_many_openings_take_time_in_proportion(spark, docs_of):
    opening = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    scan = lambda n: license_scan.scan_licenses(docs_of([(1, opening * n + license_scan.TEXTS["MIT"], "s")])).collect()[0]
    scan(10)
    began = time.time()
    assert scan(10_000)["blocks"] == ["MIT"]  # about 0.9 MB; it took minutes
    assert time.time() - began < 30


@pytest.mark.parametrize("keys", [500_000, -1])
def test_columns_of_any_name_pass_through_every_stage(spark, docs_of, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", keys)
    spark.createDataFrame([(4, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(ODD, extra=True).withColumns({"near_id": F.lit(1), "a.b": F.lit("dot"), "value": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.filter("near_id <> 1 OR `a.b` <> 'dot' OR value <> 2").count() == 0, name
        out.count()
    assert near_dedup.keep_representatives(docs).count() == len(ODD) - 1  # id 5 is a copy of id 4


@pytest.mark.parametrize("weight", [1.0, 0.2, 0.05, 0.01])
def test_buckets_stay_small_whatever_the_weights(spark, weight):
    n, buckets = 200_000, 512
    key = -F.ln(mixing.unit_interval(F.lit("k"), F.col("id").cast("string"))) / F.lit(weight)
    most = spark.range(n).select(key.alias("key")).select(mixing._slot(buckets).alias("slot")).groupBy("slot").count().agg(F.max("count")).first()[0]
    assert most <= 1.5 * n / (math.e * buckets)


def test_mixed_weights_share_the_bound(spark):
    n, buckets = 200_000, 512
    weight = F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.02)
    key = -F.ln(mixing.unit_interval(F.lit("k"), F.col("id").cast("string"))) / weight
    most = spark.range(n).select(key.alias("key")).select(mixing._slot(buckets).alias("slot")).groupBy("slot").count().agg(F.max("count")).first()[0]
    assert most <= 1.5 * n / (math.e * buckets)


def test_scores_of_the_queries_equal_plain_code(spark, tmp_path):
    """Features, the held-out fifth and the cut written out again; the model is the query's own."""
    import zlib

    from stratalign.llm import quality, toxicity

    rng = np.random.default_rng(4)
    good, bad = ["river", "stone", "house", "field", "quiet"], ["%%*", "buy$$", "##", "zzqx", "||!!"]
    docs = [(i, " ".join(rng.choice(good if i % 3 else bad, 30)), "s") for i in range(240)] + [(500, "", "s"), (501, None, "s")]
    spark.createDataFrame([(i, t, "en", s, None) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query, least in ((queries.op7_quality, 0.3), (queries.op9_toxicity, 0.5)):
        rows = query(spark, str(tmp_path)).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in docs)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
        flag = {i: (q if query is queries.op7_quality else t) for i, q, t in labels}
        unseen = [r for r in rows if r["held_out"] and r["doc_id"] in flag]
        assert np.mean([r["predicted"] == flag[r["doc_id"]] for r in unseen]) > 0.95
    # labels of the held-out fifth change nothing
    before = {r["doc_id"]: r["score"] for r in queries.op7_quality(spark, str(tmp_path)).collect()}
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    d2 = tmp_path / "flipped"
    spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.parquet(f"{d2}/labels.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{d2}/documents.parquet")
    assert {r["doc_id"]: r["score"] for r in queries.op7_quality(spark, str(d2)).collect()} == before
    assert quality.CONFIG and toxicity
