"""Cross-release identity resolution: documents first, then assays, failing closed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.operators import components as C
from stratalign.operators import occurrences as O
from stratalign.operators import policy as P
from stratalign.storage import SnapshotError, assert_none, materialize


@dataclass(frozen=True)
class IdentityLimits:
    """Greatest fractions that pass (a fraction equal to its limit passes)."""

    weak_only_multiplicity: float = 0.01
    release_local_only: float = 0.01
    min_releases: int = 2


#: What the assay audit says about source policies, joined texts.
POLICY_COLUMNS = ("assay_source_policy_types", "assay_source_policy_families", "renamed_external_aliases", "quarantined_external_aliases")


@dataclass(frozen=True)
class Resolved:
    observations: DataFrame
    document_audit: DataFrame
    assay_audit: DataFrame
    document_quarantine: DataFrame
    assay_quarantine: DataFrame
    policy: DataFrame | None
    recurations: DataFrame


def fail_external(audit: DataFrame, excused: DataFrame | None, kind: str) -> None:
    bad = audit.filter("external_identity_conflict")
    if excused is not None:
        bad = bad.join(excused.select("canonical_key"), "canonical_key", "left_anti")
    if bad.limit(1).count():
        raise SnapshotError(f"{kind}: conflicting external ids remain in a component", bad)


def fail_release_local(audit: DataFrame, kind: str, limits: IdentityLimits) -> None:
    bad = P.release_local_table(audit, kind, limits.release_local_only, limits.min_releases).filter("NOT policy_pass")
    if bad.limit(1).count():
        raise SnapshotError(f"{kind}: release-local components exceed the limit {limits.release_local_only}", bad)


def fail_multiplicity(audit: DataFrame, kind: str, limits: IdentityLimits) -> None:
    bad = P.multiplicity_table(audit, kind, limits.weak_only_multiplicity).filter("fraction > max_fraction")
    if bad.limit(1).count():
        raise SnapshotError(f"{kind}: weak-only internal multiplicity exceeds the limit {limits.weak_only_multiplicity}", bad)


def _map_back(rows: DataFrame, occurrence: str, occ: DataFrame, mapping: DataFrame, out: str) -> DataFrame:
    keys = occ.select("occurrence_id", "release_order", F.col("occurrence_key").alias(occurrence)).join(mapping, "occurrence_id").select("release_order", occurrence, F.col("canonical_key").alias(out))
    mapped = rows.drop(out).join(keys, ["release_order", occurrence], "left")
    assert_none(mapped.filter(F.col(out).isNull()).select("release_order", occurrence), "occurrences without a canonical identity")
    return mapped


def resolve_documents(observations: DataFrame, limits: IdentityLimits = IdentityLimits()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(observations with document_identity_key, audit, quarantined aliases, recurations)."""
    occ, rows = O.document_occurrences(observations)
    occ = materialize(occ, "document-occurrences")
    mapping, table, quarantined = C.protected_components(occ, "document")
    mapping = materialize(mapping, "document-map")
    audit = P.with_lost_aliases(P.augment_components(table, occ, mapping, "document"), quarantined, occ, mapping)
    audit = materialize(audit, "document-audit")
    recurations = P.temporal_recuration(audit.filter("external_identity_conflict").select("canonical_key", "aliases"), P.recuration_context(observations))
    recurations = materialize(recurations, "document-recurations")
    fail_external(audit, recurations.filter("is_recuration"), "document")
    fail_release_local(audit, "document", limits)
    fail_multiplicity(audit, "document", limits)
    return _map_back(rows, "document_occurrence", occ, mapping, "document_identity_key"), audit, quarantined, recurations


def resolve_assays(observations: DataFrame, limits: IdentityLimits = IdentityLimits()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(observations with assay_identity_key, audit, quarantined aliases, source policy).

    The source policy comes from conflicts that remain without any policy. While the rate of
    weak-only multiplicity of a generation exceeds its limit, the weak aliases of the
    components that cause it are quarantined and the graph is solved again from the start.
    """
    plain, _ = O.assay_occurrences(observations)
    plain = materialize(plain, "assay-occurrences")
    _, table, _ = C.protected_components(plain, "assay")
    conflicts = materialize(table.filter("n_source_aliases > 1").select("canonical_key", "aliases"), "assay-conflicts")
    policy = None
    occ, rows = plain, O.assay_occurrences(observations)[1]
    if conflicts.limit(1).count():
        policy = materialize(P.source_policy(conflicts, observations), "assay-policy")
        occ, rows = O.assay_occurrences(observations, policy)
        occ = materialize(occ, "assay-occurrences")
    forced = None
    while True:
        mapping, table, quarantined = C.protected_components(occ, "assay", forced)
        mapping = materialize(mapping, "assay-map")
        audit = materialize(P.augment_components(table, occ, mapping, "assay"), "assay-audit")
        fail_external(audit, None, "assay")
        over = P.multiplicity_table(audit, "assay", limits.weak_only_multiplicity).filter("fraction > max_fraction").select("schema_generation")
        odd = P._by_generation(audit.filter("internal_id_multiplicity_weak_only AND NOT release_local_only_component")).join(F.broadcast(over), "schema_generation")
        hit = mapping.join(odd.select("canonical_key").distinct(), "canonical_key", "left_semi")
        weak = occ.join(hit, "occurrence_id", "left_semi").select(F.explode("aliases").alias("alias")).filter(F.col("alias").startswith("ASSAY_SEM:")).distinct()
        if forced is not None:
            weak = weak.join(forced, "alias", "left_anti")
        weak = materialize(weak, "assay-forced")
        if not weak.limit(1).count():
            break
        forced = weak if forced is None else materialize(forced.unionByName(weak), "assay-forced")
    fail_release_local(audit, "assay", limits)
    fail_multiplicity(audit, "assay", limits)
    resolved = _map_back(rows, "assay_occurrence", occ, mapping, "assay_identity_key")
    audit = P.with_lost_aliases(audit.drop("quarantined_external_aliases"), quarantined, occ, mapping)
    if policy is None:
        audit = audit.withColumns({c: F.lit("") for c in POLICY_COLUMNS})
    else:
        audit = audit.join(P.source_policy_audit(resolved, policy), "canonical_key", "left").fillna("", list(POLICY_COLUMNS))
    return resolved, materialize(audit, "assay-audit"), quarantined, policy


def resolve_identities(observations: DataFrame, limits: IdentityLimits = IdentityLimits()) -> Resolved:
    """Both passes. ``observations`` has release_order, release_label and row_ordinal."""
    docs, doc_audit, doc_gone, recurations = resolve_documents(observations, limits)
    docs = materialize(docs, "documents-resolved")
    out, assay_audit, assay_gone, policy = resolve_assays(docs, limits)
    return Resolved(out.withColumn("historical_identity_canonicalized", F.lit(True)), doc_audit, assay_audit, doc_gone, assay_gone, policy, recurations)
