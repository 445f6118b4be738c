"""Outcomes of pages from the table of labels."""

from stratalign.llm import queries


def test_rows_without_any_label_are_no_outcome(spark, tmp_path):
    rows = [(1, None, None), (2, 1, None), (3, None, 0), (4, 0, None), (5, None, 1), (6, 1, 0), (7, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: r["bad"] for r in queries.page_labels(spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0, 7: 1}


def planted(spark, tmp_path):
    """Pages of hosts good and bad, one host of each kind without labels, and rules for some."""
    urls, rows = [], []
    for h, (host, bad) in enumerate([("good.example", 0.02), ("shop.bad.example", 0.97), ("mail.bad.example", 0.95), ("mixed.org", 0.5), ("fine.net", 0.0), ("few.bad2.io", 1.0), ("x.co.uk", 0.1)]):
        for i in range(3 if host.startswith("few") else 120):
            urls.append((1000 * h + i, f"https://{host}/p{i}?q#f"))
            rows.append((1000 * h + i, 0 if i < bad * 120 else 1, None))
    urls += [(90_001, "https://new.bad.example/"), (90_002, "https://new.fine.net/"), (90_003, "http://unknown.dev/" + "x" * 50_000), (90_004, None), (90_005, "no scheme"), (90_006, "https://Shop.bad.example:8080/a")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(rows + [(77_777, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_reputation_decides_on_planted_hosts_as_sql_does(spark, tmp_path):
    import duckdb

    d = planted(spark, tmp_path)
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in queries.op5_url_filter(spark, d).collect()}
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.op5_sql()})").fetchall()}
    assert got == want
    by_method = {h: {v for i, (host, _, rule, v) in got.items() if host == h and rule is None} for h in {x[0] for x in got.values()}}
    # hosts with bad pages, and a new one of their domain, are blocked; no other is
    assert {h for h, v in by_method.items() if v == {"block"}} == {"shop.bad.example", "mail.bad.example", "new.bad.example", "shop.bad.example:8080"} | ({"few.bad2.io"} & {h for h, v in by_method.items() if v == {"block"}})
    assert by_method["good.example"] == by_method["unknown.dev"] == by_method[""] == {"allow"}


def test_more_rules_than_expressions(spark, monkeypatch):
    from stratalign.llm import url_filter

    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "a.com/"), ("allow", "com/ab"), ("allow", "b.a.com/abc")] + [("block", f"h{i}.io/") for i in range(70)]
    urls = ["https://x.net/", "https://example.net/en/1", "https://example.net/de", "https://a.com/ab", "https://b.a.com/abcd", "https://z.h69.io/q", "https://h70.io/", None, "nothing", "https://com/ab", "https://a.com/ab"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, None, rules).collect()}
    monkeypatch.setattr(url_filter, "INLINE_RULES", 1000)
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", -1)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, None, rules).collect()} == table
    assert table[3] == ("a.com/", "block") and table[4] == ("b.a.com/abc", "allow") and table[5] == ("h69.io/", "block") and table[6] == (None, "allow")
