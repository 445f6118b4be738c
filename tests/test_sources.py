"""Extraction from the three schema generations, structures, streams and driver utilities."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from stratalign.operators.audits import build_bridge
from stratalign.operators.quality import eligibility_tracks, exclude_multi_target, measured
from stratalign.operators.structure import identity_backend, standardize, standardize_inputs
from stratalign.sources import snapshots as S
from stratalign.storage import SnapshotError
from stratalign.streaming.incremental import latest, start_first_seen


def post15(spark, **over):
    def t(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "activities": t([(1, 1, "IC50", "=", 1000.0, over.get("units", "nM"), over.get("validity"), over.get("dup", 0.0))], "assay_id int, molregno int, standard_type string, standard_relation string, standard_value double, standard_units string, data_validity_comment string, potential_duplicate double"),
        "assays": t([(1, "CHEMBL_ASSAY", 10, 20, over.get("confidence", 9), over.get("type", "B"))], "assay_id int, chembl_id string, tid int, doc_id int, confidence_score int, assay_type string"),
        "target_dictionary": t([(10, over.get("target_type", "SINGLE PROTEIN"), "Homo sapiens", "CHEMBL_T")], "tid int, target_type string, organism string, chembl_id string"),
        "target_components": t([(10, 30)] + over.get("components", []), "tid int, component_id int"),
        "component_sequences": t([(30, "P56817", "MK"), (31, "Q99999", "MR")], "component_id int, accession string, sequence string"),
        "compound_structures": t([(1, "CCO")], "molregno int, canonical_smiles string"),
        "molecule_dictionary": t([(1, "CHEMBL_M", "ethanol")], "molregno int, chembl_id string, pref_name string"),
        "docs": t([(20, "CHEMBL_D", 2000, "title", "10.1/A")], "doc_id int, chembl_id string, year int, title string, doi string"),
    }
    return tables


def run(tables, bridge=None):
    rows = S.extract(tables, "R1", bridge=bridge)
    return eligibility_tracks(measured(standardize(rows, backend=identity_backend)))


def test_post15_base_row(spark):
    r = run(post15(spark)).collect()
    assert len(r) == 1 and abs(r[0]["standard_value_molar"] - 1e-6) < 1e-15 and r[0]["primary_record_eligible"]


@pytest.mark.parametrize("over,track,other", [({"confidence": 8}, "confidence8_B_record_eligible", "primary_record_eligible"), ({"type": "F"}, "confidence9_all_assay_eligible", "primary_record_eligible")])
def test_post15_tracks(spark, over, track, other):
    r = run(post15(spark, **over)).first()
    assert r[track] and not r[other]


def test_post15_units_flags_and_types(spark):
    r = run(post15(spark, units="ug.mL-1")).first()
    assert not r["unit_convertible"] and not r["primary_record_eligible"]
    assert not run(post15(spark, dup=1.0)).first()["quality_eligible"]
    assert run(post15(spark, validity="Manually validated")).first()["quality_eligible"]
    assert run(post15(spark, target_type="PROTEIN")).count() == 0


def test_post15_two_components_raise(spark):
    rows = S.extract(post15(spark, components=[(10, 31)]), "R1")
    with pytest.raises(SnapshotError, match="multiple target accessions"):
        exclude_multi_target(rows, "assay_chembl_id", limit=0.001)


def legacy(spark, rel, conf):
    t = dict(post15(spark))
    t["assays"] = t["assays"].drop("tid", "confidence_score")
    t["assay2target"] = spark.createDataFrame([(1, 10, rel, conf)], "assay_id int, tid int, relationship_type string, confidence_score int")
    t["target_dictionary"] = spark.createDataFrame([(10, "PROTEIN", "MK", "Homo sapiens", "P56817", "CHEMBL_T")], "tid int, target_type string, protein_sequence string, organism string, protein_accession string, chembl_id string")
    t["activities"] = t["activities"].withColumnRenamed("standard_relation", "relation")
    del t["target_components"], t["component_sequences"]
    return t


@pytest.mark.parametrize("rel,conf,primary,eight,consistent", [("D", 9, True, True, True), ("H", 8, False, True, True), ("H", 9, False, True, False)])
def test_legacy(spark, rel, conf, primary, eight, consistent):
    r = run(legacy(spark, rel, conf)).first()
    assert (r["primary_record_eligible"], r["confidence8_B_record_eligible"], r["legacy_mapping_consistent"]) == (primary, eight, consistent)


def early(spark, conf=7, rel="D"):
    t = legacy(spark, rel, conf)
    t["assay2target"] = t["assay2target"].withColumnRenamed("confidence_score", "confidence")
    t["target_dictionary"] = t["target_dictionary"].drop("protein_accession", "target_type", "chembl_id")
    t["compounds"] = spark.createDataFrame([(1, "mol", "name")], "molregno int, molfile string, pref_name string")
    del t["molecule_dictionary"], t["compound_structures"]
    return t


def test_early_with_bridge(spark):
    targets = spark.createDataFrame([("M K", "Homo sapiens", "P56817", "PROTEIN")], "sequence string, organism string, accession string, target_type string")
    r = run(early(spark), build_bridge(targets)).first()
    assert r["target_identity_source"] == "exact_sequence_bridge" and r["primary_record_eligible"] and r["std_input_format"] == "molblock"
    two = targets.unionByName(targets.withColumn("accession", F.lit("Q99999")))
    assert build_bridge(two).first()["status"] == "ambiguous"
    assert run(early(spark), build_bridge(two)).count() == 0
    assert run(early(spark, conf=1), build_bridge(targets)).count() == 0


def test_early_release_without_bridge_raises(spark):
    with pytest.raises(SnapshotError, match="bridge"):
        S.extract(early(spark), "R1")
    bare = early(spark)
    bare["compounds"] = bare["compounds"].drop("molfile")
    with pytest.raises(SnapshotError, match="neither"):
        S.extract(bare, "R1", bridge=build_bridge(S.reference_targets(legacy(spark, "D", 9))))


def early_with(spark, accession, kind, score="confidence", **over):
    t = early(spark, over.get("conf", 7), over.get("rel", "D"))
    cols, row = "tid int, protein_sequence string, organism string", (10, "MK", "Homo sapiens")
    if accession is not None:
        cols, row = cols + ", protein_accession string", row + (accession,)
    if kind is not None:
        cols, row = cols + ", target_type string", row + (kind,)
    t["target_dictionary"] = spark.createDataFrame([row], cols)
    t["assay2target"] = t["assay2target"].withColumnRenamed("confidence", score)
    return t


def test_native_accessions_need_the_bridge_where_types_are_missing(spark):
    bridge = build_bridge(S.reference_targets(legacy(spark, "D", 9)))
    assert [(r["target_types"], r["status"]) for r in bridge.collect()] == [("PROTEIN", "unique")]
    sure = S.extract(early_with(spark, "P56817", None), "R1", bridge=bridge).collect()
    assert [(r["target_accession"], r["target_identity_source"]) for r in sure] == [("P56817", "native_accession_bridge_confirmed")]
    assert S.extract(early_with(spark, "P00000", None), "R1", bridge=bridge).count() == 0
    # where the release has both, no bridge is asked; other types of target never stay
    assert run(early_with(spark, "P00000", "PROTEIN")).first()["target_identity_source"] == "native_accession"
    assert S.extract(early_with(spark, "P56817", "PROTEIN FAMILY"), "R1").count() == 0
    # a bridge to another type certifies no protein
    other = bridge.withColumn("target_type", F.lit("CELL-LINE"))
    assert S.extract(early_with(spark, "P56817", None), "R1", bridge=other).count() == 0


def test_early_scores_are_read_by_their_column(spark):
    # a late column with scores up to 7 is the 0 to 9 scale: nothing reaches 8
    assert S.extract(early_with(spark, "P56817", "PROTEIN", "confidence_score", conf=7), "R1").count() == 0
    nine = run(early_with(spark, "P56817", "PROTEIN", "confidence_score", conf=9)).first()
    eight = run(early_with(spark, "P56817", "PROTEIN", "confidence_score", conf=8, rel="H")).first()
    assert nine["primary_record_eligible"] and nine["historical_confidence_equivalence"] == "modern_0_9_legacy_location"
    assert not eight["primary_record_eligible"] and eight["confidence8_B_record_eligible"] and eight["broad_prior_knowledge_eligible"]


def test_early_molecules_keep_what_the_release_has(spark):
    t = early_with(spark, "P56817", "PROTEIN")
    t["compounds"] = spark.createDataFrame([(1, "block", "CCO", "CHEMBL7", "ethanol")], "molregno int, molfile string, canonical_smiles string, chembl_id string, pref_name string")
    r = run(t).first()
    assert (r["molecule_chembl_id"], r["canonical_smiles"], r["std_input_format"]) == ("CHEMBL7", "CCO", "smiles")


def test_chemistry_is_not_replaced_silently(spark, tmp_path):
    from stratalign.operators import structure as ST

    try:
        import rdkit  # noqa: F401
    except ImportError:
        with pytest.raises(SnapshotError, match="RDKit"):
            ST.default_backend()
    path = str(tmp_path / "cache")
    x = spark.createDataFrame([("CCO", "smiles"), ("CCN", "smiles"), (" ", "smiles")], "text string, fmt string")
    assert {r["status"] for r in ST.refreshed_cache(spark, path, x.limit(2), identity_backend).collect()} == {"ok"}
    assert ST.refreshed_cache(spark, path, x, identity_backend).count() == 3
    assert spark.read.parquet(path).count() == 3

    def never(text, fmt):
        raise AssertionError("computed again")

    assert ST.refreshed_cache(spark, path, x, never).count() == 3
    torn = spark.read.parquet(path).withColumn("input_length", F.lit(99))
    with pytest.raises(SnapshotError, match="hash of another text"):
        standardize_inputs(x, never, torn)


def test_stereo_and_missing_keys(monkeypatch):
    """The backend's own rules, against stand-ins for the chemistry."""
    import sys
    import types

    from stratalign.operators import structure as ST

    seen = []

    class Tautomers:
        SetRemoveSp3Stereo = lambda self, x: seen.append(("sp3", x))
        SetRemoveBondStereo = lambda self, x: seen.append(("bond", x))
        Canonicalize = lambda self, m: m

    step = lambda name: (lambda *a, **k: types.SimpleNamespace(**{name: lambda m: m}))
    std = types.SimpleNamespace(TautomerEnumerator=Tautomers, LargestFragmentChooser=step("choose"), Normalizer=step("normalize"), Reionizer=step("reionize"), Uncharger=step("uncharge"))
    ring = types.SimpleNamespace(GetNumAtoms=lambda: 0)
    chem = types.SimpleNamespace(MolFromSmiles=lambda t: None if t == "bad" else t, MolFromMolBlock=lambda t: t, SanitizeMol=lambda m: None, MolToInchiKey=lambda m: "" if m == "keyless" else "K-" + m, MolToSmiles=lambda m: m)
    mods = {"rdkit": types.ModuleType("rdkit"), "rdkit.Chem": types.ModuleType("rdkit.Chem"), "rdkit.Chem.MolStandardize": types.ModuleType("m"), "rdkit.Chem.Scaffolds": types.ModuleType("s")}
    mods["rdkit"].Chem = mods["rdkit.Chem"]
    vars(mods["rdkit.Chem"]).update(vars(chem))
    mods["rdkit.Chem.MolStandardize"].rdMolStandardize = std
    mods["rdkit.Chem.Scaffolds"].MurckoScaffold = types.SimpleNamespace(GetScaffoldForMol=lambda mol: ring)
    for name, m in mods.items():
        monkeypatch.setitem(sys.modules, name, m)
    ST._chemistry.cache_clear()
    try:
        assert ST.rdkit_backend("CCO", "smiles") == ("CCO", "K-CCO", "", "ok", "")
        assert ST.rdkit_backend("bad", "smiles")[3] == "failed" and "no InChIKey" in ST.rdkit_backend("keyless", "smiles")[4]
        assert sorted(seen) == [("bond", False), ("sp3", False)]
    finally:
        ST._chemistry.cache_clear()


def test_structure_cache_is_reused(spark):
    x = spark.createDataFrame([("CCO", "smiles"), ("CCO", "smiles"), ("C", "smiles")], "text string, fmt string")
    first = standardize_inputs(x, identity_backend)
    assert first.count() == 2

    def never(text, fmt):
        raise AssertionError("computed again")

    assert standardize_inputs(x, never, first).count() == 2


def test_ingest_and_archive(spark, tmp_path):
    db = str(tmp_path / "x.db")
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE docs (doc_id INTEGER, title TEXT, score REAL)")
    con.executemany("INSERT INTO docs VALUES (?, ?, ?)", [(i, f"t{i}", i / 2) for i in range(5)])
    con.commit()
    con.close()
    assert S.ingest_sqlite(spark, db, str(tmp_path / "out"), batch=2) == ["docs"]
    assert spark.read.parquet(str(tmp_path / "out/docs")).agg(F.sum("score")).first()[0] == 5.0
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(db, "inner/x.db")
    assert S.extract_single_database(str(tmp_path / "a.tar.gz"), str(tmp_path / "u")).name == "x.db"
    assert S.sha256_file(db) == S.file_hashes(spark, db).first()["sha256"]
    import gzip
    import zipfile

    with open(db, "rb") as f, gzip.open(tmp_path / "y.db.gz", "wb") as g:
        g.write(f.read())
    assert S.sha256_file(str(S.extract_single_database(str(tmp_path / "y.db.gz"), str(tmp_path / "g")))) == S.sha256_file(db)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.write(db, "a.db")
        z.write(db, "b.sqlite")
    with pytest.raises(SnapshotError, match="2 databases"):
        S.extract_single_database(str(tmp_path / "two.zip"), str(tmp_path / "z"))
    with pytest.raises(SnapshotError, match="not an archive"):
        S.unpack(db, str(tmp_path / "n"))


def test_streaming_first_seen_any_order(spark, tmp_path):
    schema = "key string, day date"
    with pytest.raises(FileNotFoundError):
        latest(spark, str(tmp_path / "state"))
    for i, rows in enumerate([[("a", "2024-01-05"), ("b", "2024-01-02")], [("a", "2024-01-01"), ("c", "2024-01-09")], [("a", "2024-01-03"), ("b", "2024-01-04")]]):
        df = spark.createDataFrame(rows, "key string, day string").select("key", F.col("day").cast("date").alias("day"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        start_first_seen(events, "key", "day", str(tmp_path / "state"), str(tmp_path / "cp"), compact_every=2).awaitTermination()
    got = {r["key"]: str(r["first_available_date"]) for r in latest(spark, str(tmp_path / "state")).collect()}
    assert got == {"a": "2024-01-01", "b": "2024-01-02", "c": "2024-01-09"}
    # two batches are merged, the third is a delta of its own
    assert sorted(p.name for p in (tmp_path / "state").glob("kind=*/n=*")) == ["n=1", "n=2"]


@pytest.mark.parametrize("generation", ["pre9_early", "pre15_legacy", "post15"])
def test_extraction_broadcasts_no_table(spark, generation):
    """Small files of many rows: the planner may not take a file's size for its rows'."""
    from stratalign.plans import generated as G

    tables = G._snapshot(spark, "/root/testdata/sf0.001", generation)
    targets = spark.createDataFrame([("M KA", "Homo sapiens", "P0", "PROTEIN")], "sequence string, organism string, accession string, target_type string")
    plan = S.extract(tables, "R", bridge=build_bridge(targets))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_structures_are_computed_once_and_rows_without_one_stay(spark):
    rows = spark.createDataFrame([(1, "C", None), (2, None, "block"), (3, None, None), (4, " C ", "block"), (5, " ", "block")], "i int, canonical_smiles string, molfile string")
    out = standardize(rows, backend=identity_backend)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["i"], r["std_input_format"], r["canonical_isomeric_smiles"], r["std_status"]) for r in out.orderBy("i").collect()] == [(1, "smiles", "C", "ok"), (2, "molblock", "block", "ok"), (3, "missing", None, "missing"), (4, "smiles", "C", "ok"), (5, "molblock", "block", "ok")]
    none = standardize(rows.filter("i = 3"), backend=identity_backend)
    assert [(r["std_input_format"], r["std_status"]) for r in none.collect()] == [("missing", "missing")]
