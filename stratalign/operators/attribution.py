"""Attribution of displaced first dates to mechanisms, source policies, document events, locks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.storage import SnapshotError, assert_none

RENAME, PARTITION, AMBIGUOUS = "TEMPORAL_RENAME", "PARTITION_QUARANTINE", "AMBIGUOUS_TEMPORAL_RENAME"


def attribute_mechanisms(moved: DataFrame, assay_audit: DataFrame) -> DataFrame:
    """One mechanism per key with a later branch: rename before partition before ordinary."""
    weak = (F.coalesce(F.col("n_quarantined_weak_aliases").cast("string").try_cast("double"), F.lit(0.0)) > 0) if "n_quarantined_weak_aliases" in assay_audit.columns else F.lit(False)
    tags = assay_audit.select(F.col("canonical_key").alias("assay_identity_key"), X.split_pipe(F.col("assay_source_policy_types")).alias("_tags"), weak.alias("_weak"))
    out = moved.filter("has_later_branch").join(tags, "assay_identity_key", "left")
    has = lambda tag: F.coalesce(F.array_contains("_tags", tag), F.lit(False))
    return out.withColumns({
        "mechanism": F.when(has(RENAME), "STRICT_TEMPORAL_SOURCE_ASSAY_RENAME").when(has(PARTITION), "PARTITION_NONINJECTIVE_PROTECTION").otherwise("ORDINARY_DETERMINISTIC_ALIAS_BRIDGING"),
        "ambiguous_temporal_safeguard": has(AMBIGUOUS), "weak_alias_quarantine_safeguard": F.coalesce("_weak", F.lit(False)),
    }).drop("_tags", "_weak")


def mechanism_decomposition(attributed: DataFrame) -> DataFrame:
    """Count, share and delay statistics per mechanism."""
    x = F.col("max_delay_releases")
    per = attributed.groupBy("mechanism").agg(
        F.count(F.lit(1)).alias("n"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.9)).alias("p90"),
        F.percentile(x, F.lit(0.95)).alias("p95"), F.max(x).alias("max"),
    )
    whole = per.agg(F.sum("n").alias("all"))
    return per.join(F.broadcast(whole)).withColumn("share_percent", 100.0 * F.col("n") / F.col("all")).drop("all")


def flag_attribution(attributed: DataFrame, flags: list[str]) -> DataFrame:
    """Per flag, keys may have several: totals, shares and median delay."""
    n = attributed.agg(F.count(F.lit(1)).alias("all"))
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), X.truthy(F.col(f)).alias("set")) for f in flags])).alias("f")
    per = attributed.select("max_delay_releases", named).groupBy("f.flag").agg(F.sum(F.col("f.set").cast("long")).alias("n"), F.percentile(F.when(F.col("f.set"), F.col("max_delay_releases")), F.lit(0.5)).alias("median_delay"))
    return per.join(F.broadcast(n)).select("flag", "n", (100.0 * X.safe_ratio(F.col("n"), F.col("all"))).alias("share_percent"), "median_delay")


def bridge_flags(audit: DataFrame) -> DataFrame:
    """Structural flags of components that bridge without an exception policy."""
    return audit.select(
        "canonical_key", (F.col("n_chembl_aliases") > 1).alias("bridges_internal_ids"), (F.col("n_source_aliases") > 0).alias("has_source_alias"),
        (F.col("n_weak_aliases") > 0).alias("has_weak_alias"), (X.count_prefix(F.col("aliases"), "EXISTING_ASSAY:") > 1).alias("bridges_extraction_keys"),
        ((F.col("n_aliases") > 1) & (F.size("release_labels") > 1)).alias("bridges_releases"),
    )


def family_policies(assay_audit: DataFrame) -> DataFrame:
    """One policy per source family from the component audit (B6); unresolvable families raise."""
    rows = assay_audit.select(
        "canonical_key", X.split_pipe(F.col("assay_source_policy_types")).alias("tags"), X.split_pipe(F.col("renamed_external_aliases")).alias("renamed"),
        X.split_pipe(F.col("quarantined_external_aliases")).alias("gone"), F.explode(X.split_pipe(F.col("assay_source_policy_families"))).alias("family_id"),
    )
    plain = F.concat(F.lit("SRCASSAY:"), F.col("family_id"))
    mine = lambda a: (F.substring_index(a, "=>", 1) == plain) | F.startswith(F.substring_index(a, "=>", 1), F.concat(plain, F.lit("_POL_")))
    rows = rows.withColumns({"renamed": F.filter("renamed", mine), "gone": F.filter("gone", mine)})
    some = lambda c: X.sorted_set(F.flatten(F.collect_list(c)))
    per = rows.groupBy("family_id").agg(F.array_sort(F.collect_set("canonical_key")).alias("components"), some("tags").alias("tags"), some("renamed").alias("renamed"), some("gone").alias("gone"))
    principal = F.array_intersect("tags", F.array(F.lit(AMBIGUOUS), F.lit(PARTITION), F.lit(RENAME)))
    per = per.withColumns({"principal": F.array_sort(principal), "plain": F.concat(F.lit("SRCASSAY:"), F.col("family_id"))})
    only = lambda *t: F.col("principal") == F.array(*[F.lit(x) for x in sorted(t)])
    mixed, several = only(PARTITION, AMBIGUOUS), F.size("components") > 1
    has_plain = F.exists("gone", lambda a: F.substring_index(a, "=>", 1) == F.col("plain"))
    has_pol = F.exists("gone", lambda a: F.startswith(F.substring_index(a, "=>", 1), F.concat(F.col("plain"), F.lit("_POL_"))))
    renames = F.size("renamed") > 0
    policy = (
        F.when(renames, F.when(F.array_contains("principal", RENAME), RENAME)).when(only(PARTITION), PARTITION).when(only(AMBIGUOUS), AMBIGUOUS)
        .when(mixed & several, PARTITION).when(mixed & has_plain & has_pol, AMBIGUOUS)
    )
    resolution = (
        F.when(renames, "family_specific_renamed_alias_audit").when(only(PARTITION) | only(AMBIGUOUS), "unambiguous_final_audit_tag")
        .when(mixed & several, "multi_component_family_specific_partition_evidence").otherwise("single_component_plain_plus_pol_quarantine_evidence")
    )
    out = per.withColumns({"policy": policy, "policy_resolution": resolution})
    assert_none(out.filter("policy IS NULL").select("family_id", F.array_join("tags", "|")), "families whose policy can't be resolved")
    return out.select(
        F.substring_index("family_id", ":", 1).alias("source_id"), F.regexp_extract("family_id", r"^[^:]*:(.*)$", 1).alias("base_source_assay_id"), "family_id", "policy", "policy_resolution",
        F.array_join("tags", "|").alias("all_row_policy_tags"), F.size("components").cast("long").alias("n_canonical_assay_components"), F.array_join("components", "|").alias("safe_assay_identities"),
        F.array_join("renamed", "|").alias("renamed_external_aliases"), F.array_join("gone", "|").alias("quarantined_external_aliases"),
        F.size("renamed").cast("long").alias("n_reconciled_raw_aliases"), F.size("gone").cast("long").alias("n_quarantined_raw_aliases"),
    )


def lost_aliases(assay_audit: DataFrame, families: DataFrame) -> DataFrame:
    """Aliases of the audit that no family accounts for; empty if policies conserve them."""
    def flat(df: DataFrame) -> DataFrame:
        both = F.concat(X.split_pipe(F.col("renamed_external_aliases")), X.split_pipe(F.col("quarantined_external_aliases")))
        return df.select(F.explode(both).alias("alias")).distinct()

    return flat(assay_audit).join(flat(families), "alias", "left_anti")


def policy_summary(families: DataFrame) -> DataFrame:
    """One row: families per policy, different aliases renamed and quarantined."""
    count = lambda p: F.coalesce(F.sum((F.col("policy") == p).cast("long")), F.lit(0))
    one = families.agg(count(RENAME).alias("rename_families"), count(PARTITION).alias("partition_families"), count(AMBIGUOUS).alias("ambiguous_families"))
    n = lambda c, name: families.select(F.explode(X.split_pipe(F.col(c))).alias("a")).agg(F.count_distinct("a").alias(name))
    return one.join(F.broadcast(n("renamed_external_aliases", "reconciled_aliases"))).join(F.broadcast(n("quarantined_external_aliases", "quarantined_aliases")))


def state_stats(rows: DataFrame, value: str) -> DataFrame:
    """Per document and value: releases, their number, first and last order."""
    some = rows.filter(F.col(value) != "")
    return some.groupBy("document_identity_key", F.col(value).alias("value")).agg(
        F.array_sort(F.collect_set(F.struct("release_order", "release_label"))).alias("releases"), F.count_distinct("release_label").alias("n_releases"),
        F.min("release_order").alias("min_order"), F.max("release_order").alias("max_order"),
    )


def document_events(observations: DataFrame) -> DataFrame:
    """Malformed numeric DOIs, DOIs shared by documents within a release, strict recurations."""
    rows = observations.select(
        "release_order", "release_label", "document_identity_key", X.norm_text(F.col("document_doi")).alias("raw"), X.norm_doi(F.col("document_doi")).alias("doi"), X.norm_text(F.col("document_pubmed_id")).alias("pmid")
    ).distinct()
    event = lambda df, kind, key, ext, a, b, rel, n, what: df.select(F.lit(kind).alias("event_type"), key.alias("document_identity_key"), ext.alias("external_id_type"), a.alias("earlier_value"), b.alias("later_value"), rel.alias("release_labels"), n.cast("long").alias("n_release_groups"), F.lit(what).alias("decision"))
    bad = rows.filter((F.col("raw") != "") & X.numeric_like(F.col("raw"))).select("release_label", "document_identity_key", "raw").distinct()
    malformed = event(bad, "MALFORMED_NUMERIC_DOI_LIKE", F.col("document_identity_key"), F.lit("DOI"), F.col("raw"), F.lit(""), F.col("release_label"), F.lit(1), "EXCLUDE_FROM_DOI_IDENTITY_EVIDENCE")
    dois = rows.filter("doi <> ''")
    per_release = dois.groupBy("doi", "release_order", "release_label").agg(F.collect_set("document_identity_key").alias("ids"))
    shared = per_release.groupBy("doi").agg(
        X.sorted_set(F.flatten(F.collect_list("ids"))).alias("ids"), F.array_sort(F.collect_set(F.when(F.size("ids") > 1, F.struct("release_order", "release_label")))).alias("rels")
    ).filter(F.size("ids") > 1)
    labels = F.array_join(F.transform("rels", lambda r: r["release_label"]), "|")
    collisions = event(shared, "SHARED_DOI_COLLISION", F.array_join("ids", "|"), F.lit("DOI"), F.col("doi"), F.lit(""), labels, F.size("rels"), "QUARANTINE_SHARED_DOI_ALIAS")
    stats = state_stats(rows, "doi").withColumn("ext", F.lit("DOI")).unionByName(state_stats(rows, "pmid").withColumn("ext", F.lit("PMID")))
    per = stats.groupBy("document_identity_key", "ext").agg(F.array_sort(F.collect_list(F.struct("min_order", "max_order", "n_releases", "value", "releases"))).alias("s"))
    other = per.select("document_identity_key", F.when(F.col("ext") == "DOI", "PMID").otherwise("DOI").alias("ext"), F.size("s").alias("others"))
    two = per.join(other, ["document_identity_key", "ext"], "left").filter(F.size("s") == 2).filter(F.coalesce("others", F.lit(0)) <= 1).withColumns({"o": F.col("s")[0], "w": F.col("s")[1]})
    two = two.filter("o.n_releases >= 2 AND w.n_releases >= 2 AND o.max_order < w.min_order")
    rels = F.array_sort(F.array_union("o.releases", "w.releases"))
    strict = event(two, "STRICT_TEMPORAL_EXTERNAL_ID_RECURATION", F.col("document_identity_key"), F.col("ext"), F.col("o.value"), F.col("w.value"), F.array_join(F.transform(rels, lambda r: r["release_label"]), "|"), F.size(rels), "ACCEPT_TEMPORAL_RECURATION")
    return malformed.unionByName(collisions).unionByName(strict)


def check_locks(metrics: DataFrame, expected: Mapping[str, tuple[float, float]], strict: bool = True) -> DataFrame:
    """(name, expected, tolerance, actual, ok) for one-row ``metrics``; raises if any fails and ``strict``."""
    row = metrics.first().asDict()
    rows = [(k, float(v), float(tol), None if row.get(k) is None else float(row[k]), row.get(k) is not None and abs(float(row[k]) - v) <= tol) for k, (v, tol) in expected.items()]
    out = metrics.sparkSession.createDataFrame(rows, "name string, expected double, tolerance double, actual double, ok boolean")
    if strict and not all(r[4] for r in rows):
        raise SnapshotError(f"locked values differ: {[r for r in rows if not r[4]]}", out)
    return out
