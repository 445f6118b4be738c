"""Text, audit, policy and release functions that no registered query runs, on small cases."""

import pytest
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators import attribution as AT
from stratalign.operators import audits as AU
from stratalign.operators import comparator as CO
from stratalign.operators import diagnostics as DI
from stratalign.operators import firstseen as FS
from stratalign.operators import occurrences as OC
from stratalign.operators import policy as PO
from stratalign.sources import releases as RE
from stratalign.sources import snapshots as S
from stratalign.storage import SnapshotError


def rows_of(df, *names):
    return sorted((tuple(r[c] for c in names) if names else tuple(r) for r in df.collect()), key=repr)


def test_text_functions(spark):
    one = spark.createDataFrame([(123.0, "a|b||c", "SRCASSAY:37:T_POL_2=>x", "22.1", "1")], "d double, p string, a string, r string, s string")
    r = one.select(
        X.norm_identity(F.col("d"), "double").alias("n"), X.norm_text(F.col("d")).alias("t"), X.pipe_count(F.col("p")).alias("c"), X.has_token(F.col("p"), "b").alias("has"), X.has_token(F.col("p"), "z").alias("not"),
        X.belongs_to_family(F.col("a"), "37:T").alias("mine"), X.belongs_to_family(F.col("a"), "37:TX").alias("other"), X.release_token(F.col("r")).alias("k1"), X.release_token(F.col("s")).alias("k2"),
        X.archive_urls(F.col("s"), "https://x.org/releases").alias("urls"), X.percent(F.lit(1), F.lit(3)).alias("pc"),
    ).first()
    assert (r["n"], r["t"], r["has"], r["not"], r["mine"], r["other"], r["k1"], r["k2"], r["pc"]) == ("123", "123.0", True, False, True, False, "22_1", "01", 33.33)
    assert r["c"] >= 3
    assert r["urls"] == ["https://x.org/releases/chembl_01/chembl_01_sqlite.tar.gz", "https://x.org/releases/chembl_01/archived/chembl_01_sqlite.tar.gz"]


OBS = "release_label string, schema_generation string, confidence_score double, target_relationship_type string, historical_confidence_equivalence string, native_assay_id string, target_identity_source string, target_accession string, document_identity_key string, document_year string, assay_identity_key string, ok boolean"


@pytest.fixture
def obs(spark):
    return spark.createDataFrame([
        ("R1", "post15", 9.0, "D", "m", "a1", "native_accession", "P1", "d1", "2001", "LEGACY_ASSAY_FP:x", True),
        ("R1", "post15", 9.0, "D", "m", "a2", "native_accession", "P2", "d2", "3000", "LEGACY_ASSAY_FP:x", None),
        ("R2", "post15", 8.0, None, "m", "a1", "exact_sequence_bridge", "P1", "d2", "1999", "CHEMBL_ASSAY:A", False),
        ("R2", "post15", 8.0, None, "m", "a3", "exact_sequence_bridge", "P1", "d3", None, "LEGACY_ASSAY_FP:y", True),
    ], OBS)


def test_audit_aggregates(spark, obs):
    assert rows_of(AU.mapping_audit(obs), "confidence_score", "rows", "unique_assays") == [(8.0, 2, 2), (9.0, 2, 2)]
    assert rows_of(AU.bridge_sources(obs), "target_identity_source", "rows", "unique_targets") == [("exact_sequence_bridge", 2, 1), ("native_accession", 2, 2)]
    assert rows_of(AU.extraction_summary(obs, ["ok"]), "release_label", "rows", "ok") == [("R1", 2, 1), ("R2", 2, 1)]
    assert rows_of(AU.fingerprint_collisions(obs), "assay_identity_key", "rows", "native_ids", "documents", "collision") == [("LEGACY_ASSAY_FP:x", 2, 2, 2, True), ("LEGACY_ASSAY_FP:y", 1, 1, 1, False)]
    assert rows_of(AU.suspicious_years(obs), "document_identity_key", "years", "implausible_years", "bad_rows", "rows") == [("d2", "1999|3000", "3000", 1, 2)]
    docs = spark.createDataFrame([(1999, "t", "j", "1", "5", None), (None, "", "j", "1", "5", "10.1/x"), (None, None, None, None, None, None), (None, None, None, None, None, None)], "year int, title string, journal string, volume string, first_page string, doi string")
    r = AU.document_completeness(docs).first()
    assert r["documents"] == 3 and abs(r["year_null_rate"] - 2 / 3) < 1e-12 and abs(r["bridgeable_rate"] - 2 / 3) < 1e-12
    t = spark.createDataFrame([("PROTEIN", "Homo sapiens"), ("Protein", "Mus"), ("CELL-LINE", "homo sapiens")], "target_type string, organism string")
    assert tuple(AU.target_probe(t, "PROTEIN", "Homo sapiens").first()) == (3, 2, 2, 1)


def test_bridge_audit(spark):
    bridge = AU.build_bridge(spark.createDataFrame([("M K", "Homo sapiens", "P1"), ("MR", "Homo sapiens", "P2"), ("MR", "Homo sapiens", "P3")], "sequence string, organism string, accession string"))
    early = spark.createDataFrame([(1, "mk", "homo  sapiens", "P1"), (2, "MK", "Homo sapiens", "P9"), (3, "MR", "Homo sapiens", None), (4, "MZ", "Homo sapiens", "P5")], "tid int, sequence string, organism string, accession string")
    got = AU.audit_bridge(early, bridge)
    assert rows_of(got, "tid", "status", "n_accessions", "native_bridge_accession_consistent") == [(1, "unique", 1, True), (2, "unique", 1, False), (3, "ambiguous", 2, True), (4, "unmapped", 0, True)]


def test_guarded_casts(spark):
    good = spark.createDataFrame([("2001.0",), (" ",), (None,), ("7",)], "y string")
    assert [r["y"] for r in AU.guarded_int(good, "y").collect()] == [2001, None, None, 7]
    for bad in ("x", "1.5"):
        with pytest.raises(SnapshotError):
            AU.guarded_int(spark.createDataFrame([(bad,)], "y string"), "y")


AUDIT = (
    "canonical_key string, schema_generations array<string>, release_labels array<string>, aliases array<string>, n_occurrences long, n_aliases int, n_chembl_aliases int, n_doi_aliases int, n_pmid_aliases int, n_source_aliases int, "
    "n_weak_aliases int, n_local_aliases int, external_identity_conflict boolean, internal_id_multiplicity boolean, weak_only_component boolean, internal_id_multiplicity_external_supported boolean, internal_id_multiplicity_weak_only boolean, "
    "release_local_only_component boolean, assay_type_drift boolean, n_quarantined_weak_aliases long, quarantined_weak_aliases string"
)


@pytest.fixture
def audit(spark):
    f, t = False, True
    return spark.createDataFrame([
        ("c1", ["G1"], ["R1", "R2"], ["DOI:1", "DOI:2", "PMID:9", "DOC_TITLE:x"], 3, 4, 0, 2, 1, 0, 1, 0, t, f, f, f, f, f, f, 2, "DOC_TITLE:a|DOC_TITLE:b"),
        ("c2", ["G1", "G2"], ["R2"], ["DOC_TITLE:y", "EXISTING_ASSAY:1", "EXISTING_ASSAY:2"], 1, 3, 0, 0, 0, 0, 1, 0, f, f, t, f, f, f, t, 0, ""),
        ("c3", ["G2"], ["R1"], ["LOCAL_DOC_ID:z"], 1, 1, 0, 0, 0, 0, 0, 1, f, f, f, f, f, t, f, 0, ""),
        ("c4", ["G2"], ["R1", "R2"], ["CHEMBL_DOC:1", "CHEMBL_DOC:2", "PMID:1", "PMID:2"], 5, 4, 2, 0, 2, 0, 0, 0, t, t, f, t, f, f, f, 0, ""),
    ], AUDIT)


def test_policy_aggregates(spark, audit):
    assert rows_of(PO.component_sizes(audit)) == [("G1", 1, 1), ("G1", 3, 1), ("G2", 1, 2), ("G2", 5, 1)]
    assert rows_of(PO.weak_rate(audit)) == [("G1", 2, 0.5), ("G2", 3, 1 / 3)]
    assert rows_of(PO.quarantine_summary(audit, "document")) == [("document", "c1", 2, "DOC_TITLE:a|DOC_TITLE:b", "G1", "R1|R2")]
    s = {r["schema_generation"]: r for r in PO.reconciliation_summary(audit, "document").collect()}
    assert (s["G1"]["n_components"], s["G1"]["n_external_identity_conflict"], s["G1"]["sum_n_aliases"], s["G2"]["n_release_local_only_component"], s["G2"]["n_assay_type_drift"]) == (2, 1, 7, 1, 1)
    table = PO.release_local_table(audit, "document", 0.2)
    got = PO.annotate_release_local(audit, table)
    # c2 is in both generations and takes the worse of each
    assert rows_of(got, "canonical_key", "family_release_local_only_components", "release_local_identity_policy_pass") == [("c1", 0, True), ("c2", 1, False), ("c3", 1, False), ("c4", 1, False)]
    both = PO.release_local_rates(audit, audit, 0.5)
    assert rows_of(both, "kind", "schema_generation", "policy_pass") == [("assay", "G1", True), ("assay", "G2", True), ("document", "G1", True), ("document", "G2", True)]
    flags = AT.bridge_flags(audit)
    assert rows_of(flags, "canonical_key", "bridges_internal_ids", "bridges_extraction_keys", "bridges_releases") == [("c1", False, False, True), ("c2", False, True, False), ("c3", False, False, False), ("c4", True, False, True)]


def test_diagnostics(spark, audit):
    assert rows_of(DI.touched_by_quarantine({"document": audit, "assay": audit.filter("false")})) == [("assay", 0, 0, 0), ("document", 4, 1, 2)]
    assert rows_of(DI.conflict_classes(audit)) == [("MULTI_DOI", 1), ("MULTI_PMID", 1)]
    occ = spark.createDataFrame([(0, "o1", ["DOI:1", "DOC_TITLE:x"]), (1, "o2", ["DOI:2", "PMID:9", "DOC_TITLE:x"]), (1, "o3", ["DOI:2"])], "release_order int, occurrence_id string, aliases array<string>")
    assert rows_of(DI.conflict_chronology(audit.filter("canonical_key = 'c1'"), occ)) == [("c1", 0, "DOI:1", 1), ("c1", 1, "DOI:2|PMID:9", 2)]
    context = spark.createDataFrame([("D1", "10.1/A", "1"), ("D2", "10.1/A", "2"), ("", "10.1/A", "3"), ("D1", "10.1/B", "2")], "chem string, doi string, pmid string")
    assert rows_of(DI.id_exclusivity(context)) == [("DOI", "10.1/A", 2, "D1|D2"), ("PMID", "2", 2, "D1|D2")]
    docs = spark.createDataFrame([(0, "d", "t", "007"), (0, "d", "T ", "7"), (0, "d", "u", "x"), (1, "d", "u", None)], "release_order int, document_identity_key string, document_title string, document_pubmed_id string")
    assert rows_of(DI.metadata_multiplicity(docs)) == [(0, "d", "document_title", "T|U")]
    assert rows_of(DI.pmid_forms(docs)) == [("canonical", 1, 1), ("empty", 1, 1), ("no id", 1, 1), ("other writing", 1, 1)]
    seen = [("a", 0, "T"), ("a", 1, "T_POL_1"), ("b", 0, "U"), ("b", 1, "U_POL_1"), ("b", 1, "U_POL_2"), ("c", 0, "V"), ("c", 0, "V_POL_1"), ("d", 0, "W_POL_1"), ("d", 0, "W_POL_2"), ("e", 0, "X_POL_1"), ("e", 1, "X")]
    rows = spark.createDataFrame([(o, "37", s) for _, o, s in seen], "release_order int, assay_source_id string, assay_source_assay_id string")
    comps = spark.createDataFrame([(k, sorted({f"SRCASSAY:37:{s}" for kk, _, s in seen if kk == k})) for k in "abcde"], "canonical_key string, aliases array<string>")
    assert rows_of(DI.assay_topologies(comps, rows), "canonical_key", "topology") == [("a", "ONE_TO_ONE_TEMPORAL_RENAME"), ("b", "ONE_TO_MANY_PARTITION"), ("c", "PLAIN_POL_SIMULTANEOUS"), ("d", "MULTI_POL_SIMULTANEOUS"), ("e", "OTHER")]


def test_locks(spark):
    m = spark.createDataFrame([(10, 2.5)], "n int, mean double")
    assert AT.check_locks(m, {"n": (10, 0), "mean": (2.4999, 1e-3)}).filter("ok").count() == 2
    assert AT.check_locks(m, {"n": (9, 0), "gone": (1, 0)}, strict=False).filter("NOT ok").count() == 2
    with pytest.raises(SnapshotError):
        AT.check_locks(m, {"n": (9, 0)})


def test_first_dates_merge_and_misaligned_frames(spark):
    a = spark.createDataFrame([("k", "2024-01-03"), ("m", "2024-01-01")], "activity_key string, first_available_date string")
    b = spark.createDataFrame([("k", "2024-01-02"), ("n", "2024-01-09")], "activity_key string, first_available_date string")
    assert rows_of(FS.merge_first(a, b)) == rows_of(FS.merge_first(b, a)) == [("k", "2024-01-02"), ("m", "2024-01-01"), ("n", "2024-01-09")]
    lay = spark.createDataFrame([("k", "B1"), ("k", "B1"), ("k", "B2")], "activity_key string, backtest string")
    assert rows_of(FS.repeated_assignments(lay)) == [("k", "B1", 2)]
    assert rows_of(CO.misaligned_frames(spark.createDataFrame([(0, "R1"), (1, "R2"), (1, "R3")], "release_order int, release_label string")), "release_order", "labels") == [(1, 2)]
    bridge = spark.createDataFrame([("s1", "l1"), ("s1", "l2"), ("s2", "l2"), ("s1", "l1")], "safe_activity_key string, release_local_activity_key string")
    assert rows_of(CO.bridge_degrees(bridge), "safe_activity_key", "release_local_activity_key", "release_local_degree", "identity_safe_degree") == [("s1", "l1", 2, 1), ("s1", "l2", 2, 2), ("s2", "l2", 1, 2)]


def test_extraction_keys(spark):
    df = spark.createDataFrame([("A1", "d", "x"), (None, "d", "x"), ("", "d", "y")], "assay_chembl_id string, document_identity_key string, assay_description string")
    keys = [r[0] for r in df.select(OC.extraction_assay_key(df)).collect()]
    assert keys[0] == "CHEMBL_ASSAY:A1" and all(k.startswith("LEGACY_ASSAY_FP:") for k in keys[1:]) and keys[1] != keys[2]


def test_releases(spark):
    m = spark.createDataFrame([("R1", "2009-01-01", "/a"), ("R2", "2009", "/b"), ("R3", None, None), ("R4", "2012-05-05", "/d")], "release_label string, exact_release_date string, local_path string")
    assert rows_of(RE.date_issues(m.filter("exact_release_date IS NOT NULL")), "release_label", "value") == [("R2", "2009")]
    assert rows_of(RE.archive_status(m, spark.createDataFrame([("/a",)], "path string")), "release_label", "status") == [("R1", "ready"), ("R2", "missing_local_file"), ("R3", "missing"), ("R4", "missing_local_file")]
    assert rows_of(RE.required_releases(m.filter("release_label IN ('R1', 'R4')"), "2010-01-01"), "release_label") == [("R1",)]
    page = spark.createDataFrame([("""<a href="x_sqlite.tar.gz">x</a><a href='b.txt'>b</a><a href="a_sqlite.zip">a</a><a href="x_sqlite.tar.gz">x</a>""",)], "html string")
    assert [r["href"] for r in RE.archive_links(page).collect()] == ["a_sqlite.zip", "x_sqlite.tar.gz"]
    with pytest.raises(SnapshotError, match="conflicting"):
        RE.payload_dates(spark, [{"release": "1", "date": "2009-01-01"}, {"a": [{"release": "1", "date": "2009-01-02"}]}])


def test_tables_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("22.1", 1), ("22", 2)], "release string, n int")
    S.write_once(df, f"{tmp_path}/x.parquet")
    S.write_summary(df, f"{tmp_path}/csv")
    S.write_summary(df, f"{tmp_path}/json", "json")
    assert rows_of(S.read_table(spark, f"{tmp_path}/x.parquet")) == rows_of(S.read_table(spark, f"{tmp_path}/csv", "release string, n int")) == [("22", 2), ("22.1", 1)]
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    df.write.parquet(f"{tmp_path}/db/t")
    assert S.load_tables(spark, f"{tmp_path}/db", ["t"])["t"].count() == 2
    both = S.collect_sidecars([df.withColumn("release_label", F.lit("R1")), df.withColumn("release_label", F.lit("R2")).withColumn("more", F.lit(1))], ["R1", "R2"])
    assert both.count() == 4 and "more" in both.columns
    with pytest.raises(SnapshotError, match="R3"):
        S.collect_sidecars([both], ["R1", "R3"])


def test_release_is_committed_once_for_each_content(spark, tmp_path):
    path, a, b = f"{tmp_path}/out", spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, "y")], "i int, s string")
    commit = lambda db, version, rows: S.commit_release(spark, path, "R1", db, version, rows)
    assert commit("h1", "v1", a) and not commit("h1", "v1", b)
    assert commit("h2", "v1", b) and commit("h2", "v2", b) and not commit("h2", "v2", b)
    # rows that were changed behind the marker are written again
    a.write.mode("overwrite").parquet(f"{path}/release_label=R1")
    assert commit("h2", "v2", b) and rows_of(spark.read.parquet(f"{path}/release_label=R1")) == [(2, "y")]


def test_names_and_linked_documents(spark):
    tables = {
        "molecule_dictionary": spark.createDataFrame([(1, "M1", "Ethanol"), (2, "M2", None)], "molregno int, chembl_id string, pref_name string"),
        "molecule_synonyms": spark.createDataFrame([(1, "ethanol"), (2, "Spirit")], "molregno int, synonyms string"),
        "assays": spark.createDataFrame([(1, 20), (2, 20)], "assay_id int, doc_id int"), "docs": spark.createDataFrame([(20, "t"), (21, "u")], "doc_id int, title string"),
    }
    assert rows_of(S.name_index(tables), "molecule_chembl_id", "name") == [("M1", "ETHANOL"), ("M2", "SPIRIT")]
    assert rows_of(S.linked_documents(tables), "doc_id", "document_title") == [(20, "t")]


def test_contracts_fail_when_the_result_is_read(spark):
    manifest = spark.createDataFrame([("R1", "2024-01-01"), ("R2", "2024-02-01")], "release_label string, exact_release_date string")
    bridge = spark.createDataFrame([("R1", "s", "l"), ("R2", "s", "m")], "release_label string, safe_activity_key string, release_local_activity_key string").withColumns({"safe_assay_identity_key": F.lit("a"), "release_local_assay_identity_key": F.lit("b")})
    safe, local = CO.safe_first(bridge, manifest), CO.local_first(bridge, manifest)
    assert rows_of(CO.displacement(bridge, safe, local), "safe_activity_key", "max_delay_releases") == [("s", 1)]
    with pytest.raises(Exception, match="unknown to the manifest: R9"):
        CO.safe_first(bridge.withColumn("release_label", F.lit("R9")), manifest).collect()
    with pytest.raises(Exception, match="without a first release"):
        CO.displacement(bridge, safe, local.filter("activity_key = 'l'")).collect()
    with pytest.raises(SnapshotError, match="not unique"):
        CO.displacement(bridge, safe.unionAll(safe), local)
    obs = spark.createDataFrame([("R1", "k", "p", True), ("R9", "k", "p", True)], "release_label string, activity_key string, pair_key string, primary_record_eligible boolean")
    with pytest.raises(Exception, match="manifest: R9"):
        FS.first_seen(obs, manifest)[0].collect()
    with pytest.raises(SnapshotError, match="missing in the manifest"):
        FS.first_seen(obs, manifest.withColumn("exact_release_date", F.lit(None).cast("string")))


def test_printf_of_doubles_is_exact(spark):
    """Random bit patterns, powers of ten and two, subnormals, and values half-way between two roundings."""
    import random
    import struct

    from stratalign.functions import printf

    rng = random.Random(12)
    values = [0.0, -0.0, float("nan"), float("inf"), -float("inf"), None, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 123456789012.5, 123456789013.5, 999999999999.5, 9999999999995.0, 100000000000.05]
    values += [float(f"1e{k}") for k in range(-323, 309)] + [2.0**k for k in range(-1074, 1024, 13)]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(20_000)]
    values += [rng.randint(10**11, 10**12 - 1) + 0.5 for _ in range(500)] + [(rng.randint(10**12, 10**13 - 1) * 10 + 5) / 10 ** rng.randint(1, 20) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", printf.g12(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in rows] == [None if x is None else format(x, ".12g") for x in values]
