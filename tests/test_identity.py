"""Resolution of documents and assays across releases, and what must fail closed."""

import pytest

from stratalign.operators.identity import IdentityLimits, resolve_documents, resolve_identities
from stratalign.storage import SnapshotError

FIELDS = (
    "release_order int, release_label string, row_ordinal long, schema_generation string, document_journal string, document_year string, document_volume string, document_first_page string, document_title string, "
    "document_doi string, document_pubmed_id string, document_chembl_id string, native_document_id string, assay_description string, assay_type string, target_accession string, assay_chembl_id string, "
    "assay_source_id string, assay_source_assay_id string, native_assay_id string, assay_identity_key string"
)
LOOSE = IdentityLimits(weak_only_multiplicity=1.0, release_local_only=1.0)


def frame(spark, *rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    base = {"schema_generation": "post15", "native_document_id": "n", "assay_chembl_id": "A", "native_assay_id": "a", "assay_description": "d", "assay_type": "B", "target_accession": "P"}
    out = []
    for i, r in enumerate(rows):
        full = base | {"release_order": 0, "row_ordinal": i} | r
        full["release_label"] = f"R{full['release_order'] + 1}"
        out.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(out, FIELDS)


def docs_of(df, limits=LOOSE):
    return [r["document_identity_key"] for r in resolve_documents(df, limits)[0].orderBy("row_ordinal").collect()]


def test_doi_forms_are_one_document(spark):
    keys = docs_of(frame(spark, {"document_doi": "https://doi.org/10.1/A", "document_chembl_id": "D1"}, {"release_order": 1, "document_doi": "10.1/a", "document_chembl_id": "D2"}))
    assert keys[0] == keys[1]


def test_weak_alias_never_bridges_two_dois(spark):
    page = {"document_year": "2001", "document_journal": "J", "document_first_page": "5"}
    df = frame(spark, page | {"document_doi": "10.1/A"}, page | {"release_order": 1, "document_doi": "10.1/B"})
    out, audit, gone, _ = resolve_documents(df, LOOSE)
    keys = [r["document_identity_key"] for r in out.orderBy("row_ordinal").collect()]
    assert keys[0] != keys[1]
    assert [r["alias"].split(":")[0] for r in gone.collect()] == ["DOC_PAGE"]


def test_journal_year_volume_does_not_merge(spark):
    vol = {"document_journal": "J", "document_year": "2001", "document_volume": "7"}
    keys = docs_of(frame(spark, vol | {"document_chembl_id": "D1"}, vol | {"release_order": 1, "document_chembl_id": "D2"}))
    assert keys[0] != keys[1]


def test_one_document_id_with_two_dois_fails(spark):
    with pytest.raises(SnapshotError, match="conflicting external ids"):
        resolve_documents(frame(spark, {"document_doi": "10.1/A", "document_chembl_id": "D"}, {"release_order": 1, "document_doi": "10.1/B", "document_chembl_id": "D"}), LOOSE)


def test_strict_recuration_is_excused(spark):
    rows = [{"release_order": i, "document_chembl_id": "D", "document_pubmed_id": p} for i, p in enumerate(["111", "111", "222", "222"])]
    out, _, _, recurations = resolve_documents(frame(spark, *rows), LOOSE)
    assert out.select("document_identity_key").distinct().count() == 1
    r = recurations.collect()
    assert [(x["is_recuration"], x["earlier_value"], x["later_value"]) for x in r] == [(True, "111", "222")]


def test_reversion_fails(spark):
    rows = [{"release_order": i, "document_chembl_id": "D", "document_pubmed_id": p} for i, p in enumerate(["111", "222", "111", "222"])]
    with pytest.raises(SnapshotError):
        resolve_documents(frame(spark, *rows), LOOSE)


def test_local_only_documents_fail(spark):
    bare = {"native_document_id": None}
    with pytest.raises(SnapshotError, match="release-local"):
        resolve_documents(frame(spark, bare, bare | {"release_order": 1}))


def test_temporal_rename_end_to_end(spark):
    rows = [{"release_order": i, "document_chembl_id": "D", "assay_source_id": "37", "assay_source_assay_id": s, "assay_chembl_id": "A1"} for i, s in enumerate(["T", "T", "T_POL_1", "T_POL_1"])]
    out = resolve_identities(frame(spark, *rows), LOOSE)
    assert out.observations.select("assay_identity_key").distinct().count() == 1
    assert {r["policy_type"] for r in out.policy.collect()} == {"TEMPORAL_RENAME"}


def test_simultaneous_source_ids_fail(spark):
    rows = [{"document_chembl_id": "D", "assay_source_id": "37", "assay_source_assay_id": s, "assay_chembl_id": "A1"} for s in ("T", "T_POL_1")]
    with pytest.raises(SnapshotError):
        resolve_identities(frame(spark, *rows), LOOSE)


def test_same_semantics_two_source_assays_split(spark):
    rows = [{"release_order": i, "document_chembl_id": "D", "assay_source_id": "1", "assay_source_assay_id": s, "assay_chembl_id": None} for i, s in enumerate(["A1", "A2"])]
    out = resolve_identities(frame(spark, *rows), LOOSE)
    assert out.observations.select("assay_identity_key").distinct().count() == 2
    assert [r["alias"].split(":")[0] for r in out.assay_quarantine.collect()] == ["ASSAY_SEM"]
