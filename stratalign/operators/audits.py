"""Audit aggregates: one pass each, partial sums on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.storage import SnapshotError, assert_none


def unit_audit(df: DataFrame, keys: Sequence[str] = ("release_label", "target_accession", "standard_type", "assay_type", "confidence_score")) -> DataFrame:
    """Conversion success of relation-eligible rows by the keys there are; null is a group (G1)."""
    there = [k for k in keys if k in df.columns]
    per = df.filter(X.truthy(F.col("relation_eligible"))).groupBy(*there).agg(F.count(F.lit(1)).alias("relation_eligible_rows"), F.sum(X.truthy(F.col("unit_convertible")).cast("long")).alias("unit_convertible_rows"))
    return per.withColumns({
        "unit_unconvertible_rows": F.col("relation_eligible_rows") - F.col("unit_convertible_rows"),
        "unit_convertible_rate": F.col("unit_convertible_rows") / F.greatest("relation_eligible_rows", F.lit(1)),
    })


def composition(layered: DataFrame, by: str, targets: Sequence[str] | None = None, endpoint: str | None = "IC50") -> DataFrame:
    """Different activities, molecules and documents per backtest, layer, target and ``by``."""
    rows = layered
    if endpoint is not None:
        rows = rows.filter(F.col("standard_type") == endpoint)
    if targets is not None:
        rows = rows.filter(F.col("target_accession").isin(*targets))
    if by == "confidence_score":
        rows = rows.withColumn(by, F.col(by).cast("string").try_cast("double"))
    return rows.groupBy("backtest", "layer", "target_accession", by).agg(
        F.count_distinct("activity_key").alias("activity_identities"), F.count_distinct("full_inchikey").alias("unique_molecules"), F.count_distinct("document_identity_key").alias("unique_documents")
    )


def prior_exposure(layered: DataFrame, endpoint: str = "IC50") -> DataFrame:
    """Per backtest and target: primary P pairs, those seen before under another endpoint, their share."""
    rows = layered.filter((F.col("standard_type") == endpoint) & (F.col("layer") == "P") & F.col("eligible_primary_P") & F.col("target_accession").isNotNull())
    pairs = rows.groupBy("backtest", "target_accession", "pair_key").agg(F.min_by(X.truthy(F.col("prior_other_endpoint_exposure")), "activity_key").alias("prior"))
    per = pairs.groupBy("backtest", "target_accession").agg(F.count(F.lit(1)).alias("unique_primary_P_pairs"), F.sum(F.col("prior").cast("long")).alias("pairs_with_prior_other_endpoint"))
    return per.withColumns({"endpoint": F.lit(endpoint), "prior_other_endpoint_fraction": X.safe_ratio(F.col("pairs_with_prior_other_endpoint"), F.col("unique_primary_P_pairs"), None)})


def mapping_audit(df: DataFrame) -> DataFrame:
    """Rows and assays per generation, confidence, relationship and equivalence label."""
    return df.groupBy("schema_generation", "confidence_score", "target_relationship_type", "historical_confidence_equivalence").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("native_assay_id").alias("unique_assays"))


def build_bridge(targets: DataFrame) -> DataFrame:
    """(sequence, organism) to accessions and target types: the joined sets, how many, and whether unique."""
    kind = F.col("target_type").cast("string") if "target_type" in targets.columns else F.lit(None).cast("string")
    rows = targets.select(X.norm_sequence(F.col("sequence")).alias("sequence"), X.norm_text(F.col("organism")).alias("organism"), "accession", kind.alias("kind")).filter("sequence <> '' AND accession IS NOT NULL")
    per = rows.groupBy("sequence", "organism").agg(F.array_sort(F.collect_set("accession")).alias("a"), X.join_pipe(F.collect_set("kind")).alias("target_types"))
    one = F.size("a") == 1
    return per.select(
        "sequence", "organism", F.array_join("a", "|").alias("accessions"), F.size("a").cast("long").alias("n_accessions"), "target_types",
        F.when(one, "unique").otherwise("ambiguous").alias("status"), F.when(one, F.element_at("a", 1)).alias("accession"), F.when(one, F.col("target_types")).alias("target_type"),
    )


def apply_bridge(df: DataFrame, bridge: DataFrame, native_accession: bool, native_type: bool) -> DataFrame:
    """Accession and type of early targets by a reference's exact sequences.

    Only unique bridge rows certify anything. Where the release has accessions of its own, the
    bridge must confirm them: others become null. Where it has types of its own, they stay.
    """
    b = bridge.filter("status = 'unique'").select(F.col("sequence").alias("_s"), F.col("organism").alias("_o"), F.col("accession").alias("_a"), F.col("target_type").alias("_t"))
    out = df.join(b, (X.norm_sequence(F.col("target_sequence")) == F.col("_s")) & (X.norm_text(F.col("organism")) == F.col("_o")), "left")
    if native_accession:
        sure = (X.text(F.col("target_accession")) != "") & F.coalesce(F.col("target_accession") == F.col("_a"), F.lit(False))
        named = {"target_identity_source": F.when(sure, "native_accession_bridge_confirmed").otherwise("unmapped_or_inconsistent_bridge"), "target_accession": F.when(sure, F.col("target_accession"))}
    else:
        named = {"target_identity_source": F.when(F.col("_a").isNotNull(), "exact_sequence_bridge").otherwise("unmapped_sequence"), "target_accession": F.col("_a")}
    if not native_type:
        named["target_type"] = F.col("_t")
    return out.withColumns(named).drop("_s", "_o", "_a", "_t")


def bridge_sources(df: DataFrame) -> DataFrame:
    """Rows and targets per identity source."""
    return df.groupBy("target_identity_source").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("target_accession").alias("unique_targets"))


def audit_bridge(targets: DataFrame, bridge: DataFrame) -> DataFrame:
    """Each historical target with its bridge status, 'unmapped' where there is none."""
    b = bridge.select(F.col("sequence").alias("_s"), F.col("organism").alias("_o"), "status", "n_accessions", "accessions", F.col("accession").alias("_a"))
    out = targets.join(b, (X.norm_sequence(F.col("sequence")) == F.col("_s")) & (X.norm_text(F.col("organism")) == F.col("_o")), "left").drop("_s", "_o")
    native = X.text(F.col("accession").cast("string")) if "accession" in targets.columns else F.lit("")
    return out.withColumns({
        "status": F.coalesce("status", F.lit("unmapped")), "n_accessions": F.coalesce("n_accessions", F.lit(0).cast("long")),
        "native_bridge_accession_consistent": (native == "") | F.col("_a").isNull() | (native == F.col("_a")),
    }).drop("_a")


def document_completeness(docs: DataFrame) -> DataFrame:
    """Null rates of bibliographic fields, and the share that could bridge releases by them."""
    empty = lambda c: X.text(F.col(c)) == ""
    full = lambda *cs: ~F.array_contains(F.array(*[empty(c) for c in cs]), True)
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    bridgeable = full("year", "title") | full("year", "journal", "first_page") | full("journal", "volume", "first_page")
    return docs.distinct().agg(F.count(F.lit(1)).alias("documents"), *[rate(empty(c)).alias(f"{c}_null_rate") for c in ("year", "title", "journal", "volume", "first_page", "doi")], rate(bridgeable).alias("bridgeable_rate"))


def target_probe(targets: DataFrame, target_type: str, organism: str) -> DataFrame:
    """Counts of targets by type and organism of a snapshot."""
    kind, home = F.upper(F.col("target_type")) == target_type.upper(), F.upper(F.col("organism")) == organism.upper()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return targets.agg(F.count(F.lit(1)).alias("targets"), n(kind).alias("of_type"), n(home).alias("of_organism"), n(kind & home).alias("of_both"))


def extraction_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows and eligible rows per release."""
    return df.groupBy("release_label").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(X.truthy(F.col(f)).cast("long")).alias(f) for f in flags])


def fingerprint_collisions(df: DataFrame) -> DataFrame:
    """Extraction fingerprints with the native ids and documents that share them."""
    some = df.filter(F.col("assay_identity_key").startswith("LEGACY_ASSAY_FP:"))
    per = some.groupBy("assay_identity_key").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("native_assay_id").alias("native_ids"), F.count_distinct("document_identity_key").alias("documents"))
    return per.withColumn("collision", F.col("native_ids") > 1)


def suspicious_years(df: DataFrame, low: int = 1800, high: int = 2026) -> DataFrame:
    """Documents with an implausible year: joined values and counts."""
    y = F.col("document_year").cast("string")
    per = df.withColumn("_bad", (X.text(y) != "") & ~F.coalesce(X.plausible_year(y, low, high), F.lit(False))).groupBy("document_identity_key").agg(
        X.join_pipe(F.collect_set(y)).alias("years"), X.join_pipe(F.collect_set(F.when(F.col("_bad"), y))).alias("implausible_years"), F.sum(F.col("_bad").cast("long")).alias("bad_rows"), F.count(F.lit(1)).alias("rows")
    )
    return per.filter("bad_rows > 0")


def resolve_years(df: DataFrame, low: int = 1800, high: int = 2026, strict: bool = True) -> DataFrame:
    """An implausible year gives way to the document's only plausible one elsewhere (K7).

    Adds document_year_raw, document_year (int) and document_year_status; unresolved ones raise if ``strict``.
    """
    raw = F.col("document_year").cast("string")
    y = raw.try_cast("double")
    good = F.coalesce(y.between(low, high), F.lit(False))
    empty = X.text(raw) == ""
    known = df.filter(good).groupBy("document_identity_key").agg(F.collect_set(y.cast("int")).alias("_ys"))
    out = df.join(known, "document_identity_key", "left")
    status = F.when(empty, "MISSING").when(good, "AS_RECORDED").when(F.size("_ys") == 1, "RESOLVED_FROM_DOCUMENT").otherwise("UNRESOLVED")
    out = out.withColumns({"document_year_status": status, "document_year_raw": raw})
    if strict:
        assert_none(out.filter("document_year_status = 'UNRESOLVED'").select("document_identity_key", "document_year_raw").distinct(), "implausible publication years")
    return out.withColumn("document_year", F.when(good, y.cast("int")).when(F.col("document_year_status") == "RESOLVED_FROM_DOCUMENT", F.element_at("_ys", 1))).drop("_ys")


def guarded_int(df: DataFrame, column: str) -> DataFrame:
    """Text to integer; non-numeric or fractional values raise, empty ones are null (K6)."""
    raw = F.col(column).cast("string")
    x = raw.try_cast("double")
    some = F.trim(X.text(raw)) != ""
    bad = df.filter(some & (x.isNull() | (x != F.floor(x))))
    if bad.limit(1).count():
        raise SnapshotError(f"{column} is not integral", bad)
    return df.withColumn(column, F.when(some, x.cast("long")))


def layer_crosstab(layered: DataFrame, percent: bool = False) -> DataFrame:
    """Backtest by layer: counts, or row percentages."""
    wide = layered.groupBy("backtest").pivot("layer", ["E", "R", "C", "P"]).agg(F.count(F.lit(1))).fillna(0)
    if not percent:
        return wide
    total = F.col("E") + F.col("R") + F.col("C") + F.col("P")
    return wide.select("backtest", *[X.percent(F.col(c), total).alias(c) for c in "ERCP"])


def participation(layered: DataFrame, most: int | None = None) -> DataFrame:
    """How many keys are in how many backtests; more than ``most`` raises."""
    per = layered.groupBy("activity_key").agg(F.count_distinct("backtest").alias("n_backtests"))
    if most is not None:
        assert_none(per.filter(F.col("n_backtests") > most), "keys in too many backtests")
    return per.groupBy("n_backtests").agg(F.count(F.lit(1)).alias("n_keys"))


def sensitivity_summary(tracks: dict[str, DataFrame], base: str) -> DataFrame:
    """Identities and pairs per reconstruction, and their change against the base."""
    parts = [df.agg(F.count_distinct("activity_key").alias("identities"), F.count_distinct("pair_key").alias("pairs")).select(F.lit(n).alias("reconstruction"), "*") for n, df in tracks.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.filter(F.col("reconstruction") == base).select(F.col("identities").alias("_i"), F.col("pairs").alias("_p"))
    return every.join(F.broadcast(one)).select("reconstruction", "identities", "pairs", (F.col("identities") - F.col("_i")).alias("identities_delta"), (F.col("pairs") - F.col("_p")).alias("pairs_delta"), (100.0 * X.safe_ratio(F.col("identities") - F.col("_i"), F.col("_i"))).alias("identities_delta_percent"))


def compress_states(df: DataFrame, entity: str, order: str, state: str) -> DataFrame:
    """Rows at which the entity's state differs from the one before: (entity, order, state, was) (A2)."""
    was = F.lag(state).over(W.partitionBy(entity).orderBy(order))
    return df.select(entity, order, state, was.alias("was")).filter(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col(state)))
