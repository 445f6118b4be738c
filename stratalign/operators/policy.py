"""Identity policies: temporal recuration of documents, source-assay families, fractions per generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators.occurrences import BIB, field, source_alias


def augment_components(table: DataFrame, occurrences: DataFrame, mapping: DataFrame, kind: str) -> DataFrame:
    """The component audit: occurrences, releases, generations and flags."""
    rows = occurrences.join(mapping, "occurrence_id")
    optional = [X.sorted_set(F.flatten(F.collect_list("assay_types"))).alias("assay_types")] if "assay_types" in occurrences.columns else []
    per = rows.groupBy("canonical_key").agg(
        F.count(F.lit(1)).alias("n_occurrences"), X.sorted_set(F.flatten(F.collect_list("releases"))).alias("release_labels"),
        X.sorted_set(F.flatten(F.collect_list("schema_generation"))).alias("schema_generations"),
        X.sorted_set(F.flatten(F.collect_list("quarantined_external"))).alias("quarantined_external_aliases"), *optional,
    )
    out = table.join(per, "canonical_key", "left")
    external = (F.col("n_doi_aliases") + F.col("n_pmid_aliases")) if kind == "document" else F.col("n_source_aliases")
    many = F.col("n_chembl_aliases") > 1
    return out.withColumns({
        "external_identity_conflict": X.external_conflict(F.col("aliases"), kind), "internal_id_multiplicity": many,
        "weak_only_component": (F.col("n_weak_aliases") > 0) & (external == 0), "internal_id_multiplicity_external_supported": many & (external > 0),
        "internal_id_multiplicity_weak_only": many & (external == 0) & (F.col("n_weak_aliases") > 0),
        "release_local_only_component": F.col("n_local_aliases") == F.col("n_aliases"),
        "assay_type_drift": (F.size("assay_types") > 1) if optional else F.lit(False),
    })


def _by_generation(audit: DataFrame) -> DataFrame:
    gens = F.when(F.size("schema_generations") > 0, F.col("schema_generations")).otherwise(F.array(F.lit("UNKNOWN")))
    return audit.withColumn("schema_generation", F.explode(gens))


def _ones(c: Column) -> Column:
    return F.coalesce(F.sum(X.truthy(c).cast("long")), F.lit(0))


def release_local_table(audit: DataFrame, kind: str, limit: float = 0.01, min_releases: int = 2) -> DataFrame:
    """Per generation: share of components with local aliases only, and whether it passes."""
    g = _by_generation(audit)
    per = g.groupBy("schema_generation").agg(
        F.count(F.lit(1)).alias("n_components"), _ones(F.col("release_local_only_component")).alias("n_release_local_only_components"),
        F.size(F.array_distinct(F.flatten(F.collect_set("release_labels")))).cast("long").alias("n_processed_releases_in_family"),
    )
    share = X.safe_ratio(F.col("n_release_local_only_components"), F.col("n_components"))
    out = per.select(F.lit(kind).alias("kind"), "*", share.alias("release_local_only_fraction"), F.lit(min_releases).alias("min_releases_for_policy"), F.lit(float(limit)).alias("max_fraction"))
    evaluable = F.col("n_processed_releases_in_family") >= min_releases
    return out.withColumns({"policy_evaluable": evaluable, "policy_pass": ~evaluable | (F.col("release_local_only_fraction") <= limit)})


def annotate_release_local(audit: DataFrame, policy: DataFrame) -> DataFrame:
    """Per component the worst count and share of its generations, and whether all pass."""
    p = policy.select("schema_generation", F.col("n_release_local_only_components").alias("_n"), F.col("release_local_only_fraction").alias("_f"), F.col("policy_pass").alias("_p"))
    worst = _by_generation(audit).select("canonical_key", "schema_generation").join(F.broadcast(p), "schema_generation").groupBy("canonical_key").agg(
        F.max("_n").alias("family_release_local_only_components"), F.max("_f").alias("family_release_local_only_fraction"), F.bool_and("_p").alias("release_local_identity_policy_pass")
    )
    return audit.join(worst, "canonical_key", "left")


def multiplicity_table(audit: DataFrame, kind: str, limit: float = 0.01) -> DataFrame:
    """Per generation: weak-only internal multiplicity among components that are not release-local."""
    local, odd = X.truthy(F.col("release_local_only_component")), X.truthy(F.col("internal_id_multiplicity_weak_only"))
    per = _by_generation(audit).groupBy("schema_generation").agg(
        F.count(F.lit(1)).alias("n_components_total"), _ones(~local).alias("n_overmerge_denominator_components"), _ones(odd & ~local).alias("n_weak_only_internal_multiplicity")
    )
    share = X.safe_ratio(F.col("n_weak_only_internal_multiplicity"), F.col("n_overmerge_denominator_components"))
    return per.select(F.lit(kind).alias("kind"), "*", share.alias("fraction"), F.lit(float(limit)).alias("max_fraction"))


def reconciliation_summary(audit: DataFrame, kind: str) -> DataFrame:
    """Per generation: component counts by flag."""
    flags = ("external_identity_conflict", "internal_id_multiplicity", "weak_only_component", "internal_id_multiplicity_external_supported", "internal_id_multiplicity_weak_only", "release_local_only_component", "assay_type_drift")
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("n_occurrences", "n_aliases", "n_chembl_aliases", "n_doi_aliases", "n_pmid_aliases", "n_source_aliases", "n_weak_aliases", "n_local_aliases")]
    per = _by_generation(audit).groupBy("schema_generation").agg(F.count(F.lit(1)).alias("n_components"), *[_ones(F.col(f)).alias(f"n_{f}") for f in flags], *sums)
    return per.select(F.lit(kind).alias("kind"), "*")


def release_local_rates(document_audit: DataFrame, assay_audit: DataFrame, limit: float = 0.01, min_releases: int = 2) -> DataFrame:
    """The release-local tables of both kinds, one below the other."""
    return release_local_table(document_audit, "document", limit, min_releases).unionByName(release_local_table(assay_audit, "assay", limit, min_releases))


def component_sizes(audit: DataFrame) -> DataFrame:
    """(generation, n_occurrences) -> components."""
    return _by_generation(audit).groupBy("schema_generation", "n_occurrences").agg(F.count(F.lit(1)).alias("n_components"))


def weak_rate(audit: DataFrame) -> DataFrame:
    """Share of weak-only components per generation."""
    return _by_generation(audit).groupBy("schema_generation").agg(F.count(F.lit(1)).alias("n_components"), F.avg(X.truthy(F.col("weak_only_component")).cast("double")).alias("weak_only_rate"))


def with_lost_aliases(audit: DataFrame, quarantined: DataFrame, occurrences: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds n_quarantined_weak_aliases and quarantined_weak_aliases: what a component's occurrences lost."""
    flat = occurrences.select("occurrence_id", F.explode("aliases").alias("alias")).join(quarantined.select("alias"), "alias", "left_semi")
    per = flat.join(mapping, "occurrence_id").groupBy("canonical_key").agg(F.array_sort(F.collect_set("alias")).alias("_a"))
    out = audit.join(per, "canonical_key", "left")
    lost = F.coalesce("_a", F.expr("cast(array() as array<string>)"))
    return out.withColumns({"n_quarantined_weak_aliases": F.size(lost).cast("long"), "quarantined_weak_aliases": F.array_join(lost, "|")}).drop("_a")


def quarantine_summary(audit: DataFrame, kind: str) -> DataFrame:
    """Components whose occurrences lost weak aliases: how many and which."""
    return audit.filter("n_quarantined_weak_aliases > 0").select(
        F.lit(kind).alias("kind"), "canonical_key", "n_quarantined_weak_aliases", "quarantined_weak_aliases",
        X.join_pipe(F.col("schema_generations")).alias("schema_generations"), X.join_pipe(F.col("release_labels")).alias("release_labels"),
    )


def recuration_context(df: DataFrame) -> DataFrame:
    """Different document metadata per release: (release_order, chem, doi, pmid, six fields)."""
    pmid = X.norm_pmid(F.col("document_pubmed_id")) if "document_pubmed_id" in df.columns else F.lit("")
    doi = X.norm_doi(F.col("document_doi")) if "document_doi" in df.columns else F.lit("")
    bib = [(X.norm_bib(F.col(c), c) if c in df.columns else F.lit("")).alias(c) for c in BIB]
    return df.select("release_order", field(df, "document_chembl_id").alias("chem"), doi.alias("doi"), pmid.alias("pmid"), *bib).distinct()


def temporal_recuration(conflicted: DataFrame, context: DataFrame) -> DataFrame:
    """Classify components with two ids of one authority: one document, recurated in time, or a conflict.

    ``conflicted`` is (canonical_key, aliases). Conditions are judged in a fixed order; the
    first that fails is the reason. Returns the type, both values and their release counts.
    """
    c = conflicted.select(
        "canonical_key", F.transform(F.filter("aliases", lambda a: a.startswith("CHEMBL_DOC:")), lambda a: F.substring(a, 12, 1 << 20)).alias("docs"),
        F.transform(F.filter("aliases", lambda a: a.startswith("DOI:")), lambda a: F.substring(a, 5, 1 << 20)).alias("dois"),
        F.transform(F.filter("aliases", lambda a: a.startswith("PMID:")), lambda a: F.substring(a, 6, 1 << 20)).alias("pmids"),
    )
    kind = F.when((F.size("pmids") == 2) & (F.size("dois") <= 1), "PMID").when((F.size("dois") == 2) & (F.size("pmids") <= 1), "DOI")
    c = c.withColumns({"external_type": kind, "ids": F.when(kind == "PMID", F.col("pmids")).otherwise(F.col("dois")), "doc": F.when(F.size("docs") == 1, F.element_at("docs", 1))})
    rows = c.join(context, c["doc"] == context["chem"]).withColumn("state", F.when(F.col("external_type") == "PMID", F.col("pmid")).otherwise(F.col("doi")))
    bib = [X.sorted_set(F.collect_set(b)).alias(f"n_{b}") for b in BIB]
    contradictions = rows.groupBy("canonical_key").agg(*bib)
    states = rows.filter("state <> ''").groupBy("canonical_key", "release_order").agg(F.collect_set("state").alias("s"), F.min("state").alias("state"))
    order = W.partitionBy("canonical_key").orderBy("release_order")
    runs = states.withColumn("was", F.lag("state").over(order))
    per = runs.groupBy("canonical_key").agg(
        F.count(F.lit(1)).alias("releases"), F.max(F.size("s")).alias("together"), F.sum((F.col("was").isNotNull() & (F.col("was") != F.col("state"))).cast("int")).alias("changes"),
        F.count_distinct("state").alias("states"), F.min_by("state", "release_order").alias("earlier_value"), F.max_by("state", "release_order").alias("later_value"),
        F.array_sort(F.collect_set("state")).alias("seen"),
    )
    support = states.groupBy("canonical_key", "state").agg(F.count(F.lit(1)).alias("n")).groupBy("canonical_key").agg(F.min("n").alias("least_support"), F.sum("n").alias("support"))
    # an id is looked up under its own authority: each context row stands once for its DOI and once for its PMID
    used = c.select("canonical_key", "doc", "external_type", F.explode("ids").alias("value"))
    stated = F.array(F.struct(F.lit("DOI").alias("external_type"), F.col("doi").alias("value")), F.struct(F.lit("PMID").alias("external_type"), F.col("pmid").alias("value")))
    holders = context.filter("chem <> ''").select("chem", F.explode(stated).alias("x")).select("chem", "x.*").filter("value <> ''").distinct()
    elsewhere = used.join(holders, ["external_type", "value"]).filter(F.col("chem") != F.col("doc")).groupBy("canonical_key").agg(X.join_pipe(F.collect_set("chem")).alias("elsewhere"))
    j = c.join(per, "canonical_key", "left").join(support, "canonical_key", "left").join(contradictions, "canonical_key", "left").join(elsewhere, "canonical_key", "left")
    clashing = F.array_compact(F.array(*[F.when(F.size(f"n_{b}") > 1, F.concat(F.lit(f"{b}="), F.array_join(f"n_{b}", "|"))) for b in BIB]))
    # The reason codes, in the order in which the conditions are judged.
    reason = (
        F.when(F.size("docs") != 1, "NOT_EXACTLY_ONE_CHEMBL_DOCUMENT")
        .when(F.col("external_type").isNull(), "NOT_EXACTLY_TWO_IDS_OF_ONE_EXTERNAL_AUTHORITY")
        .when(F.col("releases").isNull(), "NO_ARCHIVE_EVIDENCE")
        .when(F.col("together") > 1, "EXTERNAL_IDS_SIMULTANEOUS_IN_RELEASE")
        .when(F.col("changes") != 1, "NOT_EXACTLY_ONE_ONE_WAY_TRANSITION")
        .when(F.col("seen") != F.array_sort("ids"), "TRANSITION_DOES_NOT_COVER_BOTH_EXTERNAL_IDS")
        .when(F.col("least_support") < 2, "INSUFFICIENT_REPLICATED_TEMPORAL_SUPPORT")
        .when(F.size(clashing) > 0, F.concat(F.lit("BIBLIOGRAPHIC_CONTRADICTION:"), F.array_join(clashing, ";")))
        .when(F.col("elsewhere").isNotNull(), F.concat(F.lit("EXTERNAL_ID_USED_BY_OTHER_CHEMBL_DOCUMENT:"), F.col("elsewhere")))
    )
    return j.select("canonical_key", reason.isNull().alias("is_recuration"), F.coalesce(reason, F.lit("")).alias("reason"), "external_type", "earlier_value", "later_value", F.col("releases").alias("n_releases"), "least_support")


def source_policy(conflicted: DataFrame, df: DataFrame) -> DataFrame:
    """(raw_alias, action, canonical_alias, policy_type, family) from components with several source ids (I8).

    A family is one source and one base id: the plain id, and ids ``base_POL_n``. One POL that
    replaces the plain id once and for good is a rename (ambiguous without two releases each);
    several POLs in a one-to-one mapping with the component's assays are a partition, which
    quarantines the plain id. Anything else gets no policy, and fails later.
    """
    c = conflicted.select("canonical_key", F.filter("aliases", lambda a: a.startswith("SRCASSAY:")).alias("srcs"), F.filter("aliases", lambda a: a.startswith("CHEMBL_ASSAY:")).alias("assays"))
    flat = c.select("canonical_key", "assays", F.explode("srcs").alias("raw_alias")).withColumn("parsed", X.parse_source_alias(F.col("raw_alias")))
    flat = flat.withColumns({"source": F.col("parsed.source"), "own": F.col("parsed.id")}).withColumns({"base": X.pol_base(F.col("own")), "is_pol": F.col("own").rlike(r"_POL_\d+$")})
    shape = flat.groupBy("canonical_key").agg(
        F.count_distinct("source").alias("sources"), F.count_distinct("base").alias("bases"), F.sum((~F.col("is_pol")).cast("int")).alias("plains"), F.sum(F.col("is_pol").cast("int")).alias("pols"),
        F.first("source").alias("family_source"), F.first("base").alias("family_base"), F.first(F.size("assays")).alias("n_assays"),
    ).filter("sources = 1 AND bases = 1 AND plains = 1 AND pols >= 1")
    seen = df.select("release_order", source_alias(df).alias("raw_alias"), field(df, "assay_chembl_id").alias("chem")).filter("raw_alias <> ''").distinct()
    ev = flat.select("canonical_key", "raw_alias", "is_pol").join(shape.select("canonical_key"), "canonical_key").join(seen, "raw_alias")
    per_release = ev.groupBy("canonical_key", "release_order").agg(F.count_distinct("is_pol").alias("kinds"))
    time = ev.groupBy("canonical_key").agg(
        F.max(F.when(~F.col("is_pol"), F.col("release_order"))).alias("plain_last"), F.min(F.when(F.col("is_pol"), F.col("release_order"))).alias("pol_first"),
        F.count_distinct(F.when(~F.col("is_pol"), F.col("release_order"))).alias("plain_n"), F.count_distinct(F.when(F.col("is_pol"), F.col("release_order"))).alias("pol_n"),
        F.count_distinct(F.when(F.col("chem") != "", F.col("chem"))).alias("chems"), F.count_distinct(F.when(F.col("is_pol") & (F.col("chem") != ""), F.col("chem"))).alias("pol_chems"),
    ).join(per_release.groupBy("canonical_key").agg(F.max("kinds").alias("together")), "canonical_key")
    by_pol = ev.filter("is_pol AND chem <> ''").groupBy("canonical_key", "raw_alias").agg(F.count_distinct("chem").alias("n")).groupBy("canonical_key").agg(F.max("n").alias("pol_degree"), F.count(F.lit(1)).alias("pols_mapped"))
    by_chem = ev.filter("is_pol AND chem <> ''").groupBy("canonical_key", "chem").agg(F.count_distinct("raw_alias").alias("n")).groupBy("canonical_key").agg(F.max("n").alias("chem_degree"))
    j = shape.join(time, "canonical_key").join(by_pol, "canonical_key", "left").join(by_chem, "canonical_key", "left")
    once = (F.col("pols") == 1) & (F.col("together") == 1) & (F.col("plain_last") < F.col("pol_first")) & (F.col("n_assays") == 1)
    bijection = (F.col("pols") >= 2) & (F.col("pol_degree") == 1) & (F.col("chem_degree") == 1) & (F.col("pols_mapped") == F.col("pols")) & (F.col("pol_chems") == F.col("n_assays"))
    # The policy types.
    kind = F.when(once & (F.col("plain_n") >= 2) & (F.col("pol_n") >= 2), "TEMPORAL_RENAME").when(once, "AMBIGUOUS_TEMPORAL_RENAME").when(bijection, "PARTITION_QUARANTINE")
    families = j.select("canonical_key", "family_source", "family_base", kind.alias("family_kind")).filter("family_kind IS NOT NULL")
    rows = flat.join(families, "canonical_key")
    partition = F.col("family_kind") == "PARTITION_QUARANTINE"
    action = F.when(F.col("family_kind") == "TEMPORAL_RENAME", "rename").when(partition & F.col("is_pol"), "none").otherwise("quarantine")
    renamed = X.sha_key("SRCASSAY:", F.lit("TEMPORAL_RENAME"), F.col("family_source"), F.col("family_base"))
    return rows.select(
        "raw_alias", action.alias("action"), F.when(F.col("family_kind") == "TEMPORAL_RENAME", renamed).otherwise(F.col("raw_alias")).alias("canonical_alias"),
        F.when(partition & F.col("is_pol"), "PARTITION_DESCENDANT").otherwise(F.col("family_kind")).alias("policy_type"), F.concat_ws(":", "family_source", "family_base").alias("family"),
    )


def source_policy_audit(observations: DataFrame, policy: DataFrame) -> DataFrame:
    """Per component: policy types, families, renamed and quarantined source aliases.

    ``observations`` are resolved: each row's source alias and its assay's canonical key.
    """
    seen = observations.select(source_alias(observations).alias("raw_alias"), F.col("assay_identity_key").alias("canonical_key")).distinct().join(policy, "raw_alias")
    some = lambda c: X.join_pipe(F.collect_set(c))
    return seen.groupBy("canonical_key").agg(
        some("policy_type").alias("assay_source_policy_types"), some("family").alias("assay_source_policy_families"),
        some(F.when(F.col("action") == "rename", F.concat("raw_alias", F.lit("=>"), "canonical_alias"))).alias("renamed_external_aliases"),
        some(F.when(F.col("action") == "quarantine", F.col("raw_alias"))).alias("quarantined_external_aliases"),
    )
