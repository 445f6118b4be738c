"""Record quality: eligibility tracks per schema generation and exclusion of ambiguous assays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.storage import SnapshotError, assert_none

GENERATIONS = ("pre9_early", "pre15_legacy", "post15")
EARLY, MODERN = "early_0_7_high_confidence", "modern_0_9_legacy_location"


def measured(df: DataFrame) -> DataFrame:
    """Adds the molar value, pactivity and the four components of base eligibility.

    Needs standard_relation, standard_value, standard_units, potential_duplicate,
    data_validity_comment and std_status.
    """
    molar = X.to_molar(F.col("standard_value"), F.col("standard_units"))
    flagged = X.duplicate_flag(F.col("potential_duplicate"))
    out = df.withColumns({
        "standard_relation": F.trim(X.text(F.col("standard_relation"))), "relation_eligible": X.relation_ok(F.col("standard_relation")),
        "standard_value_molar": molar, "potential_duplicate_flagged": flagged,
        "quality_eligible": X.validity_ok(F.col("data_validity_comment")) & ~flagged, "structure_eligible": F.coalesce(F.col("std_status") == "ok", F.lit(False)),
    })
    return out.withColumns({"unit_convertible": F.col("standard_value_molar").isNotNull(), "pactivity": X.pactivity(F.col("standard_value_molar"))})


def eligibility_tracks(df: DataFrame, primary_confidence: int = 9, least_confidence: int = 8, assay_type: str = "B") -> DataFrame:
    """Adds the tracks E1 to E9. The relationship type is available if any record of the release has one.

    ``df`` has the four base components, release_label, schema_generation, confidence_score,
    assay_type, target_relationship_type and, for pre9_early, early_confidence_regime.
    """
    regime = F.coalesce(F.col("early_confidence_regime"), F.lit("")) if "early_confidence_regime" in df.columns else F.lit("")
    known = F.col("schema_generation").isin(*GENERATIONS)
    bad = df.filter(~known | ((F.col("schema_generation") == "pre9_early") & ~regime.isin(EARLY, MODERN)))
    assert_none(bad.select("release_label", "schema_generation").distinct(), "unknown schema generation or confidence regime")

    conf, rel = F.col("confidence_score").try_cast("double"), F.upper(F.trim(X.text(F.col("target_relationship_type"))))
    out = df.withColumns({"_rel": rel, "_conf": conf, "_type": F.upper(F.trim(X.text(F.col("assay_type")))) == assay_type})
    # a row per release, not a window that would sort whole releases into one task each
    known_types = out.groupBy("release_label").agg(F.max(F.col("_rel") != "").alias("_there"))
    base = X.truthy(F.col("quality_eligible")) & X.truthy(F.col("structure_eligible")) & X.truthy(F.col("relation_eligible")) & X.truthy(F.col("unit_convertible"))
    out = out.withColumn("_base", base).join(F.broadcast(known_types.withColumnRenamed("release_label", "_label")), F.col("release_label").eqNullSafe(F.col("_label"))).drop("_label")
    pre9, legacy = F.col("schema_generation") == "pre9_early", F.col("schema_generation") == "pre15_legacy"
    early = pre9 & (regime == EARLY)
    is_d, is_dh, there, conf = F.col("_rel") == "D", F.col("_rel").isin("D", "H"), F.col("_there"), F.col("_conf")
    # what stands for a direct mapping, and for one that sensitivity analyses admit
    direct = F.when(pre9, there & is_d).otherwise(~legacy | is_d)
    wide = F.when(pre9, ~there | is_dh).otherwise(~legacy | is_dh)
    top = F.coalesce(F.when(early, conf == 7).otherwise(conf == primary_confidence), F.lit(False))
    enough = F.coalesce(F.when(early, conf == 7).otherwise(conf >= least_confidence), F.lit(False))
    b, t = F.col("_base"), F.col("_type")
    eight, historical = b & enough & wide & t & ~early, b & enough & wide & t & early
    at = lambda x: F.coalesce(conf == x, F.lit(False))
    consistent = (
        F.when(early, (top & direct) | (enough & wide))
        .when(pre9, F.when(at(primary_confidence), direct).otherwise(enough & wide))
        .when(legacy & at(9), is_d).when(legacy & at(8), F.col("_rel") == "H").otherwise(True)
    )
    label = (
        F.when(early, F.when(there, "early7+D_required_for_primary").otherwise("uncertified_no_relationship_type"))
        .when(pre9, F.when(there, "modern_0_9_legacy_location").otherwise("modern_0_9_uncertified_no_relationship_type"))
        .otherwise("modern_0_9")
    )
    tracks: dict[str, Column] = {
        "primary_record_eligible": b & top & direct & t,
        "confidence8_B_record_eligible": eight,
        "historical_high_confidence_B_sensitivity_eligible": historical,
        "relaxed_confidence_B_record_eligible": eight | historical,
        "confidence9_all_assay_eligible": b & top & direct,
        "primary_direct_all_assay_eligible": b & top & direct,
        "broad_prior_knowledge_eligible": b & enough & wide,
        "legacy_mapping_consistent": consistent,
        "primary_mapping_certified": top & direct,
        "historical_confidence_equivalence": label,
    }
    return out.withColumns(tracks).drop("_rel", "_conf", "_type", "_there", "_base")


def multi_target_audit(df: DataFrame, assay: str = "native_assay_id", target: str = "target_accession") -> DataFrame:
    """One row per assay with several targets: counts, D and H mappings and joined lists."""
    rel = F.upper(F.trim(X.text(F.col("target_relationship_type")))) if "target_relationship_type" in df.columns else F.lit("")
    pairs = df.select(F.col(assay).alias(assay), F.col(target).cast("string").alias("_t"), rel.alias("_r"))
    grouped = pairs.groupBy(assay).agg(
        F.array_sort(F.collect_set("_t")).alias("_ts"), F.count_distinct(F.when(F.col("_r") == "D", F.col("_t"))).alias("n_direct"),
        F.count_distinct(F.when(F.col("_r") == "H", F.col("_t"))).alias("n_homologous"), F.array_join(F.array_sort(F.collect_set("_r")), "|").alias("relationship_types"),
    )
    return grouped.filter(F.size("_ts") > 1).select(assay, F.size("_ts").cast("long").alias("n_targets"), F.array_join("_ts", "|").alias("targets"), "n_direct", "n_homologous", "relationship_types")


def exclude_multi_target(df: DataFrame, assay: str = "native_assay_id", target: str = "target_accession", limit: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of assays with one target, audit). Above ``limit`` as the fraction of assays it raises."""
    audit = multi_target_audit(df, assay, target)
    if limit is not None:
        n, bad = df.select(assay).distinct().count(), audit.count()
        if n and bad / n > limit:
            raise SnapshotError(f"multiple target accessions: {bad} of {n} assays exceed the limit {limit}", audit)
    return df.join(audit.select(assay), assay, "left_anti"), audit
