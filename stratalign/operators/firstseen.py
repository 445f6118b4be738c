"""First availability over a sequence of releases.

One window over (release, key) takes a representative and the multiplicity; one aggregate
per key takes its first release. Sorts put nulls last, and every order ends in row_ordinal.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.storage import assert_none, required

STABLE = ("release_date", "release_label", "document_identity_key", "assay_identity_key", "document_chembl_id", "assay_chembl_id", "molecule_chembl_id", "activity_key", "row_ordinal")
TIE = ("document_identity_key", "assay_identity_key", "document_chembl_id", "assay_chembl_id", "activity_key")


def stable_order(df: DataFrame, names: Sequence[str] = STABLE) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in names if c in df.columns]


def add_activity_key(df: DataFrame) -> DataFrame:
    """Adds the three keys of an observation (H1)."""
    if "assay_identity_key" not in df.columns:
        df = df.withColumn("assay_identity_key", F.concat(F.lit("CHEMBL_ASSAY:"), X.text(F.col("assay_chembl_id"))))
    molar = X.canon_float(F.col("standard_value_molar").cast("double"))
    return df.withColumns(X.activity_keys("assay_identity_key", "full_inchikey", "standard_type", "standard_relation", molar, "target_accession"))


def within_release(keyed: DataFrame) -> DataFrame:
    """One row per (release_label, activity_key), with within_release_duplicate_multiplicity (F2)."""
    group = W.partitionBy("release_label", "activity_key")
    ranked = keyed.withColumns({
        "within_release_duplicate_multiplicity": F.count(F.lit(1)).over(group),
        "_rank": F.row_number().over(group.orderBy(*stable_order(keyed))),
    })
    return ranked.filter("_rank = 1").drop("_rank")


def left_censor(manifest: DataFrame) -> DataFrame:
    """One row: the manifest's earliest date and its labels (F4). Empty releases count."""
    m = manifest.select("release_label", F.col("exact_release_date").cast("date").alias("d"))
    low = m.agg(F.min("d").alias("archive_left_censor_release_date"))
    return m.join(F.broadcast(low), F.col("d") == F.col("archive_left_censor_release_date")).groupBy("archive_left_censor_release_date").agg(
        F.array_join(F.array_sort(F.collect_set("release_label")), "|").alias("archive_left_censor_release_label")
    )


def first_seen(observations: DataFrame, manifest: DataFrame, eligible: str = "primary_record_eligible") -> tuple[DataFrame, DataFrame]:
    """(first, audit) from keyed observations.

    ``observations`` has release_label, activity_key, pair_key and the eligibility column;
    ``manifest`` release_label and exact_release_date. A release without a date is an error: at once if
    the manifest lists it so, and when the result is read if only the observations know it.
    """
    dates = manifest.select("release_label", F.col("exact_release_date").cast("date").alias("release_date"))
    assert_none(dates.filter("release_date IS NULL"), "release dates missing in the manifest")
    rows = observations.filter(X.truthy(F.col(eligible))).join(F.broadcast(dates), "release_label", "left")
    rows = rows.withColumn("release_date", required(F.col("release_date"), F.concat(F.lit("release without a date in the manifest: "), X.text(F.col("release_label")))))
    combined = within_release(rows)
    key = W.partitionBy("activity_key")
    first = (
        combined.withColumns({"_rank": F.row_number().over(key.orderBy(*stable_order(combined))), "n_release_occurrences": F.count(F.lit(1)).over(key)})
        .filter("_rank = 1").drop("_rank")
        .withColumnsRenamed({"release_label": "first_available_release", "release_date": "first_available_date"})
        .join(F.broadcast(left_censor(manifest)))
    )
    boundary = F.col("archive_left_censor_release_date")
    pair = W.partitionBy("pair_key")
    first = first.withColumns({"first_availability_left_censored": F.col("first_available_date") == boundary, "pair_first_available_date": F.min("first_available_date").over(pair)})
    first = first.withColumns({"pair_first_left_censored": F.col("pair_first_available_date") == boundary, "is_pair_first_release": F.col("first_available_date") == F.col("pair_first_available_date")})
    late = (~F.col("is_pair_first_release")).cast("int")
    first = first.withColumns({
        "pair_first_tie_count": F.sum(F.col("is_pair_first_release").cast("int")).over(pair),
        "is_pair_first_representative": (F.row_number().over(pair.orderBy(late, *stable_order(first, TIE))) == 1) & F.col("is_pair_first_release"),
    })
    audit = first.select("activity_key", "first_available_release", "first_available_date", "first_availability_left_censored", "archive_left_censor_release_label", "archive_left_censor_release_date", "within_release_duplicate_multiplicity", "n_release_occurrences")
    return first, audit


def prior_other_endpoint(primary: DataFrame, broad: DataFrame) -> DataFrame:
    """Adds prior_other_endpoint_date and _exposure: the earliest date of the pair under another endpoint."""
    seen = broad.groupBy(F.col("cross_endpoint_pair_key").alias("_cross"), F.col("standard_type").alias("_type")).agg(F.min("first_available_date").alias("_seen"))
    asked = primary.select("cross_endpoint_pair_key", "standard_type").distinct()
    prior = (
        asked.join(seen, (F.col("cross_endpoint_pair_key") == F.col("_cross")) & (F.col("standard_type") != F.col("_type")))
        .groupBy("cross_endpoint_pair_key", "standard_type").agg(F.min("_seen").alias("prior_other_endpoint_date"))
    )
    out = primary.join(prior, ["cross_endpoint_pair_key", "standard_type"], "left")
    return out.withColumn("prior_other_endpoint_exposure", F.coalesce(F.col("prior_other_endpoint_date") < F.col("pair_first_available_date"), F.lit(False)))


def curation_lag(first: DataFrame, year: str = "document_year") -> DataFrame:
    """Adds the publication date (mid-year), the lag in days and its eligibility."""
    left = X.truthy(F.col("first_availability_left_censored")) if "first_availability_left_censored" in first.columns else F.lit(False)
    out = first.withColumn("document_publication_date", X.publication_date(F.col(year)))
    return out.withColumns({
        "curation_lag_days_approx": F.datediff(F.col("first_available_date").cast("date"), F.col("document_publication_date")),
        "curation_lag_main_eligible": ~left & F.col("document_publication_date").isNotNull(),
        "curation_lag_left_censored": left,
    })


@dataclass(frozen=True)
class Backtest:
    """Ends of the layers E, R, C and P; each interval excludes its start and includes its end."""

    name: str
    e_end: date
    r_end: date
    c_end: date
    p_end: date


def layer_of(day: Column, b: Backtest) -> Column:
    """E, R, C or P, or null after the last end."""
    return (
        F.when(day <= F.lit(b.e_end), "E").when(day <= F.lit(b.r_end), "R")
        .when(day <= F.lit(b.c_end), "C").when(day <= F.lit(b.p_end), "P")
    )


def assign_layers(first: DataFrame, backtests: Sequence[Backtest], date_col: str = "first_available_date") -> DataFrame:
    """One row per observation and backtest in whose layers it falls (F10): backtest, layer and P eligibility.

    Backtests are a handful, so their rows come from one array per observation, without a join.
    """
    day = F.col(date_col).cast("date")
    options = F.array(*[F.struct(F.lit(b.name).alias("backtest"), layer_of(day, b).alias("layer")) for b in backtests])
    out = first.withColumn("_at", F.explode(F.filter(options, lambda x: x["layer"].isNotNull())))
    out = out.withColumns({"backtest": F.col("_at.backtest"), "layer": F.col("_at.layer")}).drop("_at")
    in_p = F.col("layer") == "P"
    if "is_pair_first_release" in first.columns:
        in_p = in_p & F.col("is_pair_first_release")
    out = out.withColumn("eligible_primary_P", in_p)
    if "is_pair_first_representative" in first.columns:
        out = out.withColumn("eligible_primary_P_representative", F.col("eligible_primary_P") & F.col("is_pair_first_representative"))
    return out


def not_nested(inner: DataFrame, outer: DataFrame, key: str = "activity_key") -> DataFrame:
    """Keys of ``inner`` that ``outer`` lacks; empty if the tracks nest."""
    return inner.select(key).distinct().join(outer.select(key), key, "left_anti")


def repeated_assignments(layered: DataFrame) -> DataFrame:
    """(activity_key, backtest) that were assigned twice."""
    return layered.groupBy("activity_key", "backtest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merge_first(old: DataFrame, batch: DataFrame, keys: Sequence[str] = ("activity_key",)) -> DataFrame:
    """First dates of two sets of releases; batches may come in any order."""
    both = old.select(*keys, "first_available_date").unionByName(batch.select(*keys, "first_available_date"))
    return both.groupBy(*keys).agg(F.min("first_available_date").alias("first_available_date"))
