"""The release-local comparator: the same observations keyed without reconciliation.

Topology (fragmentation, overmerging) and displacement of first dates between the two keyings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.storage import assert_unique, known_unique, required


def release_order(manifest: DataFrame) -> DataFrame:
    """(release_label, exact_release_date, release_order from 0): chronology of the manifest, a few dozen rows."""
    order = W.orderBy(F.col("exact_release_date").cast("date"), "release_label")
    return manifest.select("release_label", F.col("exact_release_date").cast("date").alias("exact_release_date"), (F.row_number().over(order) - 1).alias("release_order"))


def misaligned_frames(observations: DataFrame) -> DataFrame:
    """Release positions that carry more than one label (B1); empty if frames and manifest align."""
    return observations.groupBy("release_order").agg(F.countDistinct("release_label").alias("labels")).filter("labels <> 1")


def build_bridge(observations: DataFrame, safe_assay: str = "assay_identity_key", local_assay: str = "release_local_assay_key", fields: tuple[str, ...] = ("full_inchikey", "standard_type", "standard_relation", "molar_text", "target_accession")) -> DataFrame:
    """Different (release, safe key, local key, both assay keys) (B2). The local key has no release in it."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    local = F.concat(F.lit("RELEASE_LOCAL_ASSAY:"), X.text(F.col(local_assay)))
    rest = [word(c) for c in fields]
    key = lambda assay: F.sha2(F.array_join(F.array(assay, *rest), "|"), 256)
    return observations.select(
        "release_label", key(word(safe_assay)).alias("safe_activity_key"), key(local).alias("release_local_activity_key"),
        word(safe_assay).alias("safe_assay_identity_key"), local.alias("release_local_assay_identity_key"),
    ).distinct()


def _first_of(bridge: DataFrame, order: DataFrame, key: str, assay: str) -> DataFrame:
    rows = bridge.select("release_label", F.col(key).alias("activity_key"), F.col(assay).alias("assay_identity_key")).join(F.broadcast(order), "release_label", "left")
    known = required(F.col("release_order"), F.concat(F.lit("release unknown to the manifest: "), X.text(F.col("release_label"))))
    least = F.min(F.struct(known.alias("release_order"), "release_label", "assay_identity_key", "exact_release_date")).alias("f")
    out = rows.groupBy("activity_key").agg(least).select(
        "activity_key", F.col("f.assay_identity_key").alias("assay_identity_key"), F.col("f.release_label").alias("first_available_release"),
        F.col("f.exact_release_date").alias("first_available_date"), F.col("f.release_order").alias("release_order"),
        (F.col("f.release_order") == 0).alias("first_availability_left_censored"),
    )
    return known_unique(out, "activity_key")


def safe_first(bridge: DataFrame, manifest: DataFrame) -> DataFrame:
    return _first_of(bridge, release_order(manifest), "safe_activity_key", "safe_assay_identity_key")


def local_first(bridge: DataFrame, manifest: DataFrame) -> DataFrame:
    return _first_of(bridge, release_order(manifest), "release_local_activity_key", "release_local_assay_identity_key")


def release_audit(bridge: DataFrame, first: DataFrame, manifest: DataFrame) -> DataFrame:
    """Identities observed and new per release of the manifest, zero where there are none."""
    observed = bridge.groupBy("release_label").agg(F.countDistinct("release_local_activity_key").alias("unique_release_local_identities_observed"))
    newly = first.groupBy(F.col("first_available_release").alias("release_label")).agg(F.count(F.lit(1)).alias("new_release_local_identities_at_F0"))
    out = manifest.select("release_label", F.col("exact_release_date").cast("date").alias("exact_release_date"))
    return out.join(observed, "release_label", "left").join(newly, "release_label", "left").fillna(0, ["unique_release_local_identities_observed", "new_release_local_identities_at_F0"])


def topology(bridge: DataFrame) -> DataFrame:
    return bridge.select("safe_activity_key", "release_local_activity_key").distinct()


def displacement(bridge: DataFrame, safe: DataFrame, local: DataFrame, check: bool = True) -> DataFrame:
    """Per safe key: branches, smallest and greatest shift of first release and flags."""
    if check:
        assert_unique(safe, ["activity_key"], "safe first")
        assert_unique(local, ["activity_key"], "local first")
    s = safe.select(F.col("activity_key").alias("safe_activity_key"), F.col("first_available_release").alias("safe_first_available_release"), F.col("release_order").alias("safe_order"), F.col("first_available_date").alias("safe_date"))
    r = local.select(F.col("activity_key").alias("release_local_activity_key"), F.col("release_order").alias("local_order"), F.col("first_available_date").alias("local_date"))
    merged = topology(bridge).join(s, "safe_activity_key", "left").join(r, "release_local_activity_key", "left")
    if check:
        whole = lambda c: required(F.col(c), "a bridge row without a first release")
        merged = merged.withColumns({"safe_order": whole("safe_order"), "local_order": whole("local_order")})
    shift, days = F.col("local_order") - F.col("safe_order"), F.datediff("local_date", "safe_date")
    out = merged.groupBy("safe_activity_key").agg(
        F.first("safe_first_available_release").alias("safe_first_available_release"), F.first("safe_order").alias("safe_first_release_ordinal"),
        F.count(F.lit(1)).alias("n_release_local_branches"), F.min(shift).alias("min_shift_releases"), F.max(shift).alias("max_delay_releases"),
        F.min(days).alias("min_shift_days"), F.max(days).alias("max_delay_days"),
    )
    return out.withColumns({
        "any_f0_difference": (F.col("min_shift_releases") != 0) | (F.col("max_delay_releases") != 0),
        "has_later_branch": F.col("max_delay_releases") > 0,
        "has_earlier_branch": F.col("min_shift_releases") < 0,
    })


def overmerge(bridge: DataFrame) -> DataFrame:
    """Local keys that stand for several safe keys."""
    grouped = topology(bridge).groupBy("release_local_activity_key").agg(F.array_sort(F.collect_set("safe_activity_key")).alias("keys"))
    return grouped.filter(F.size("keys") > 1).select("release_local_activity_key", F.size("keys").cast("long").alias("n_safe_activity_keys"), F.array_join("keys", "|").alias("safe_activity_keys"))


def bridge_degrees(bridge: DataFrame) -> DataFrame:
    """Different (safe key, local key) with the degree of each end (B5): local keys of the safe one, safe keys of the local one."""
    pairs = topology(bridge)
    safe = pairs.groupBy("safe_activity_key").agg(F.count(F.lit(1)).alias("release_local_degree"))
    local = pairs.groupBy("release_local_activity_key").agg(F.count(F.lit(1)).alias("identity_safe_degree"))
    return pairs.join(safe, "safe_activity_key").join(local, "release_local_activity_key")


def comparator_summary(bridge: DataFrame, moved: DataFrame) -> DataFrame:
    """One row of ten measures."""
    degrees = topology(bridge).groupBy("release_local_activity_key").agg(F.count(F.lit(1)).alias("d"))
    local = degrees.agg(F.count(F.lit(1)).alias("release_local_activities"), F.coalesce(F.sum((F.col("d") > 1).cast("int")), F.lit(0)).alias("overmerged_release_local_identities"))
    ones = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    safe = moved.agg(
        F.count(F.lit(1)).alias("identity_safe_activities"), ones(F.col("n_release_local_branches") > 1).alias("fragmented_safe_activities"),
        ones(F.col("any_f0_difference")).alias("safe_activities_with_any_f0_difference"), ones(F.col("has_later_branch")).alias("safe_activities_with_later_branch"),
    )
    both = safe.join(F.broadcast(local))
    n, m = F.col("identity_safe_activities"), F.col("release_local_activities")
    return both.select(
        "identity_safe_activities", "release_local_activities", (m - n).alias("absolute_inflation"), (100.0 * X.safe_ratio(m - n, n)).alias("inflation_percent_of_safe"),
        "fragmented_safe_activities", (100.0 * X.safe_ratio(F.col("fragmented_safe_activities"), n)).alias("fragmented_percent_of_safe"),
        "safe_activities_with_any_f0_difference", "safe_activities_with_later_branch", "overmerged_release_local_identities",
        (100.0 * X.safe_ratio(F.col("overmerged_release_local_identities"), m)).alias("overmerged_percent_of_release_local"),
    )


def delay_quantiles(moved: DataFrame, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99), shares: tuple[int, ...] = (3, 5, 7, 10)) -> DataFrame:
    """Exact linear quantiles, mean, extremes and shares at or above marks of delayed keys."""
    delayed = moved.filter("has_later_branch").select(F.col("max_delay_releases").alias("x"))
    cols = [F.percentile("x", F.lit(p)).alias(f"p{round(p * 100):02d}") for p in points]
    cols += [(100.0 * F.avg((F.col("x") >= s).cast("double"))).alias(f"share_ge_{s}") for s in shares]
    return delayed.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), *cols)


def differing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    l, r = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    out = l.join(r, keys, "full_outer")
    return out.filter("_l IS NULL OR _r IS NULL").select(*keys, F.when(F.col("_l").isNull(), "right_only").otherwise("left_only").alias("side"))
