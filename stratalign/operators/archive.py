"""The whole run over an archive of releases: identities, first dates, comparator, attribution.

``run_archive`` composes the other operators. Its policies fail closed while it is built:
misaligned releases, identity conflicts, tracks that do not nest, bridges that do not cover the
first dates and policies that lose aliases raise. Everything it returns is a lazy frame over
written tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators import attribution as AT
from stratalign.operators import audits as AU
from stratalign.operators import comparator as CO
from stratalign.operators import firstseen as FS
from stratalign.operators import occurrences as OC
from stratalign.operators import policy as PO
from stratalign.operators.identity import IdentityLimits, Resolved, resolve_identities
from stratalign.storage import assert_none, bucketed, materialize

#: Track name -> eligibility column; all others must hold what ``primary`` holds.
TRACKS = {"primary": "primary_record_eligible", "relaxed": "relaxed_confidence_B_record_eligible", "all_direct": "primary_direct_all_assay_eligible"}


@dataclass(frozen=True)
class ArchiveRun:
    """``first`` holds the first dates of each track; the rest is about the primary one."""

    resolved: Resolved
    first: dict[str, DataFrame]
    audit: DataFrame
    layered: DataFrame | None
    bridge: DataFrame
    local_first: DataFrame
    displacement: DataFrame
    overmerge: DataFrame
    attributed: DataFrame
    families: DataFrame
    events: DataFrame


def keyed_observations(resolved: DataFrame) -> DataFrame:
    """Resolved observations with activity keys, and with the assay key that each release gives by itself."""
    local = OC.with_policy(resolved, None)
    local = local.withColumn("release_local_assay_key", OC.assay_local_key(local)).drop("src_raw", "src_alias", "src_quarantined", "src_renamed")
    return FS.add_activity_key(local).withColumn("molar_text", X.canon_float(F.col("standard_value_molar").cast("double")))


def run_archive(
    observations: DataFrame,
    manifest: DataFrame,
    limits: IdentityLimits = IdentityLimits(),
    tracks: Mapping[str, str] = TRACKS,
    broad: str = "broad_prior_knowledge_eligible",
    backtests: Sequence[FS.Backtest] = (),
    buckets: int | None = None,
) -> ArchiveRun:
    """``observations`` has release_label, row_ordinal, the identity fields, standard values and eligibility columns;
    ``manifest`` (release_label, exact_release_date) orders the releases (N1). Keyed observations are a table of ``buckets`` by
    activity key, so that every track's first dates read it without an exchange on that key."""
    order = materialize(CO.release_order(manifest), "release-order")
    rows = observations.drop("release_order").join(F.broadcast(order.select("release_label", "release_order")), "release_label", "left")
    assert_none(rows.filter("release_order IS NULL").select("release_label").distinct(), "releases unknown to the manifest")
    done = resolve_identities(rows, limits)
    keyed = bucketed(keyed_observations(done.observations), "keyed-observations", ["activity_key"], buckets)
    assert_none(CO.misaligned_frames(keyed), "several labels at one place of the sequence")

    firsts, audit = {}, None
    for name, column in tracks.items():
        found = FS.first_seen(keyed, manifest, column)
        firsts[name] = materialize(found[0], f"first-{name}")
        audit = found[1] if name == "primary" else audit
    primary = firsts["primary"]
    for name, first in firsts.items():
        if name != "primary":
            assert_none(FS.not_nested(primary, first), f"primary activities that {name} lacks")
    if broad in keyed.columns:
        primary = FS.prior_other_endpoint(primary, FS.first_seen(keyed, manifest, broad)[0])
    if "document_year" in keyed.columns:
        primary = FS.curation_lag(primary)
    firsts["primary"] = primary
    layered = materialize(FS.assign_layers(primary, backtests), "layered") if backtests else None
    if layered is not None:
        assert_none(FS.repeated_assignments(layered), "activities that a backtest holds twice")

    bridge = materialize(CO.build_bridge(keyed.filter(X.truthy(F.col(tracks["primary"])))), "bridge")
    safe, local = CO.safe_first(bridge, manifest), materialize(CO.local_first(bridge, manifest), "local-first")
    keys = primary.select(F.col("activity_key").alias("safe_activity_key"))
    assert_none(CO.differing_keys(keys, bridge, ["safe_activity_key"]), "keys of the first dates or the bridge alone")
    moved = materialize(CO.displacement(bridge, safe, local), "displacement")
    assays = primary.select(F.col("activity_key").alias("safe_activity_key"), "assay_identity_key")
    families = AT.family_policies(done.assay_audit)
    assert_none(AT.lost_aliases(done.assay_audit, families), "aliases that no family accounts for")
    return ArchiveRun(
        done, firsts, audit, layered, bridge, local, moved, CO.overmerge(bridge),
        AT.attribute_mechanisms(moved.join(assays, "safe_activity_key"), done.assay_audit), families, AT.document_events(done.observations),
    )


def summaries(run: ArchiveRun, base: str = "primary") -> dict[str, DataFrame]:
    """The tables that a report shows, by name; each is small."""
    docs, assays = run.resolved.document_audit, run.resolved.assay_audit
    out = {
        "comparator": CO.comparator_summary(run.bridge, run.displacement),
        "delays": CO.delay_quantiles(run.displacement),
        "mechanisms": AT.mechanism_decomposition(run.attributed),
        "safeguards": AT.flag_attribution(run.attributed, ["ambiguous_temporal_safeguard", "weak_alias_quarantine_safeguard"]),
        "policies": AT.policy_summary(run.families),
        "sensitivity": AU.sensitivity_summary(run.first, base),
        "reconciliation": PO.reconciliation_summary(docs, "document").unionByName(PO.reconciliation_summary(assays, "assay")),
        "release_local_rates": PO.release_local_rates(docs, assays),
        "weak_quarantine": PO.quarantine_summary(docs, "document").unionByName(PO.quarantine_summary(assays, "assay")),
    }
    if run.layered is not None:
        out["layers"] = AU.layer_crosstab(run.layered)
        out["participation"] = AU.participation(run.layered)
    return out


def locked_metrics(run: ArchiveRun) -> DataFrame:
    """One row of the counts that ``attribution.check_locks`` compares with frozen values."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        n(run.resolved.document_audit, "document_identities"), n(run.resolved.assay_audit, "assay_identities"),
        *[n(first, f"{name}_activities") for name, first in run.first.items()],
        run.first["primary"].agg(F.count_distinct("pair_key").alias("primary_pairs"), F.coalesce(F.sum(X.truthy(F.col("first_availability_left_censored")).cast("long")), F.lit(0)).alias("primary_left_censored")),
        CO.comparator_summary(run.bridge, run.displacement), AT.policy_summary(run.families), n(run.attributed, "delayed_activities"), n(run.events, "document_events"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # one row each
    return out
