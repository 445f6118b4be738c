"""The composed run, and what its identities rest on."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalign.operators import archive as AR
from stratalign.operators import attribution as AT
from stratalign.operators import firstseen as FS
from stratalign.operators.identity import IdentityLimits, resolve_assays
from stratalign.plans import surrogates
from stratalign.storage import SnapshotError
from tests.test_identity import LOOSE, frame

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
def test_composed_run(spark):
    run = AR.run_archive(surrogates.archive_observations(spark, SF), surrogates.manifest(spark), backtests=surrogates.BACKTESTS)
    families = {r["family_id"]: r["policy"] for r in run.families.collect()}
    assert {k: v for k, v in families.items() if k in ("37:T0", "37:T1", "37:T5", "37:T6")} == {"37:T0": AT.RENAME, "37:T5": AT.RENAME, "37:T1": AT.PARTITION, "37:T6": AT.PARTITION}
    assert set(families.values()) <= {AT.RENAME, AT.PARTITION, AT.AMBIGUOUS}
    # every assay of a renamed family is one identity, of a parted one two
    per = run.resolved.observations.groupBy(F.substring("assay_chembl_id", 1, 2).alias("f")).agg(F.count_distinct("assay_identity_key").alias("n"))
    assert {r["f"]: r["n"] for r in per.collect()} == {f"A{i}": 2 if i % 5 == 1 else 1 for i in range(10)}
    first = run.first["primary"]
    assert first.count() == run.displacement.count() == run.audit.count()
    assert {"prior_other_endpoint_exposure", "curation_lag_days_approx"} <= set(first.columns)
    assert run.attributed.filter("NOT has_later_branch").count() == 0 and run.attributed.count() > 0
    assert run.overmerge.count() >= 0 and run.events.count() == 0 and run.layered.count() == 0  # the releases come after all layers
    assert FS.not_nested(run.first["primary"], run.first["relaxed"]).count() == 0
    tables = {k: v.collect() for k, v in AR.summaries(run).items()}
    assert sum(r["n"] for r in tables["mechanisms"]) == tables["delays"][0]["n"] == run.attributed.count()
    assert tables["policies"][0]["rename_families"] >= 2 and tables["policies"][0]["partition_families"] == 2
    assert {r["reconstruction"]: r["identities_delta"] for r in tables["sensitivity"]}["primary"] == 0
    assert {r["kind"] for r in tables["reconciliation"]} == {"document", "assay"} and {r["kind"] for r in tables["weak_quarantine"]} == {"assay"}
    assert tables["layers"] == [] == tables["participation"] and all(r["policy_pass"] for r in tables["release_local_rates"])
    m = AR.locked_metrics(run).first().asDict()
    assert (m["document_identities"], m["assay_identities"], m["primary_activities"]) == (10, 12, first.count()) and m["identity_safe_activities"] == first.count()
    assert AT.check_locks(AR.locked_metrics(run), {"assay_identities": (12, 0), "delayed_activities": (m["delayed_activities"], 0)}).filter("ok").count() == 2


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
def test_composed_run_fails_closed(spark):
    obs = surrogates.archive_observations(spark, SF).limit(50)
    with pytest.raises(SnapshotError, match="unknown to the manifest"):
        AR.run_archive(obs, surrogates.manifest(spark).filter("release_label < 'R02'"))
    with pytest.raises(SnapshotError, match="relaxed lacks"):
        AR.run_archive(obs.withColumn("relaxed_confidence_B_record_eligible", F.lit(False)), surrogates.manifest(spark), IdentityLimits(1.0, 1.0))


def test_weak_aliases_are_quarantined_while_a_generation_has_too_many(spark):
    """Two assays of one description and no source id are one weak-only component; beyond the limit its weak alias goes."""
    one = {"document_chembl_id": "D", "document_identity_key": "DOC", "assay_description": "same"}
    rows = frame(spark, one | {"assay_chembl_id": "A1"}, one | {"assay_chembl_id": "A2"}).withColumn("document_identity_key", F.lit("DOC"))
    loose, audit, gone, _ = resolve_assays(rows, LOOSE)
    assert loose.select("assay_identity_key").distinct().count() == 1 and gone.count() == 0 and audit.first()["internal_id_multiplicity_weak_only"]
    strict, audit, gone, policy = resolve_assays(rows, IdentityLimits(weak_only_multiplicity=0.0, release_local_only=1.0))
    assert strict.select("assay_identity_key").distinct().count() == 2 and policy is None
    assert [(r["alias"].split(":")[0], r["iteration"]) for r in gone.collect()] == [("ASSAY_SEM", 0)]
    # the audit is ready for attribution: policies and lost aliases are in it
    assert {(r["n_quarantined_weak_aliases"], r["assay_source_policy_types"]) for r in audit.collect()} == {(1, "")}
    assert AT.family_policies(audit).count() == 0


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
def test_keyed_tables_spare_the_exchange_on_their_key(spark):
    from stratalign.storage import bucketed, discard

    rows, manifest = surrogates.observations(spark, SF), surrogates.manifest(spark)
    table = bucketed(rows, "keyed-test", ["activity_key"], 4)
    spread = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(activity_key" in x or "hashpartitioning(release_label" in x]
    got, audit = FS.first_seen(table, manifest)
    plain, _ = FS.first_seen(rows, manifest)
    assert spread(plain) and not spread(got) and not spread(audit)
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, plain.select(*sorted(got.columns)).collect()))
    discard(table)
    assert not spark.catalog.tableExists(table._table)
