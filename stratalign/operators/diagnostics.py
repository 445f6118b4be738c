"""Read-only looks at what a resolution left behind; no policy depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators.occurrences import BIB, field, source_alias


def touched_by_quarantine(audits: dict[str, DataFrame]) -> DataFrame:
    """(kind, components, touched_components, lost_aliases) of component audits by kind."""
    out = None
    for kind, audit in audits.items():
        lost = F.coalesce(F.col("n_quarantined_weak_aliases"), F.lit(0))
        one = audit.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.sum((lost > 0).cast("long")), F.lit(0)).alias("touched_components"), F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("lost_aliases"))
        one = one.select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def conflict_classes(components: DataFrame) -> DataFrame:
    """(conflict, components) among document components (aliases) with several ids of an authority."""
    dois, pmids = X.count_prefix(F.col("aliases"), "DOI:") > 1, X.count_prefix(F.col("aliases"), "PMID:") > 1
    kind = F.when(dois & pmids, "MULTI_DOI_AND_PMID").when(dois, "MULTI_DOI").when(pmids, "MULTI_PMID")
    return components.select(kind.alias("conflict")).filter("conflict IS NOT NULL").groupBy("conflict").agg(F.count(F.lit(1)).alias("components"))


def conflict_chronology(components: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(canonical_key, release_order, external_aliases, n_occurrences): which authorities' ids a component shows when."""
    mine = components.select("canonical_key", F.explode("aliases").alias("alias"))
    seen = occurrences.select("release_order", "occurrence_id", F.explode("aliases").alias("alias"))
    rows = mine.join(seen, "alias")
    outside = F.when(F.col("alias").startswith("DOI:") | F.col("alias").startswith("PMID:") | F.col("alias").startswith("SRCASSAY:"), F.col("alias"))
    return rows.groupBy("canonical_key", "release_order").agg(X.join_pipe(F.collect_set(outside)).alias("external_aliases"), F.count_distinct("occurrence_id").alias("n_occurrences"))


def id_exclusivity(context: DataFrame) -> DataFrame:
    """(external_type, value, n_documents, documents) of ids that several documents' own ids stand beside."""
    stated = F.array(F.struct(F.lit("DOI").alias("external_type"), F.col("doi").alias("value")), F.struct(F.lit("PMID").alias("external_type"), F.col("pmid").alias("value")))
    rows = context.filter("chem <> ''").select("chem", F.explode(stated).alias("x")).select("chem", "x.*").filter("value <> ''")
    per = rows.groupBy("external_type", "value").agg(F.array_sort(F.collect_set("chem")).alias("d"))
    return per.filter(F.size("d") > 1).select("external_type", "value", F.size("d").cast("long").alias("n_documents"), F.array_join("d", "|").alias("documents"))


def metadata_multiplicity(observations: DataFrame, key: str = "document_identity_key") -> DataFrame:
    """(release_order, key, field, values): bibliographic fields with several values within a release."""
    stated = F.array(*[F.struct(F.lit(b).alias("field"), field(observations, b).alias("value")) for b in BIB])
    rows = observations.select("release_order", key, F.explode(stated).alias("x")).select("release_order", key, "x.*").filter("value <> ''")
    per = rows.groupBy("release_order", key, "field").agg(F.array_sort(F.collect_set("value")).alias("v"))
    return per.filter(F.size("v") > 1).select("release_order", key, "field", F.array_join("v", "|").alias("values"))


def pmid_forms(observations: DataFrame) -> DataFrame:
    """(form, rows, values): how PubMed ids are written, and which of the writings is an id."""
    raw = field(observations, "document_pubmed_id")
    norm = X.norm_pmid(F.col("document_pubmed_id")) if "document_pubmed_id" in observations.columns else F.lit("")
    form = F.when(raw == "", "empty").when(norm == "", "no id").when(raw == norm, "canonical").otherwise("other writing")
    return observations.select(form.alias("form"), raw.alias("v")).groupBy("form").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("v").alias("values"))


def assay_topologies(conflicted: DataFrame, observations: DataFrame) -> DataFrame:
    """(canonical_key, topology, n_plain_ids, n_pol_ids) of assay components with several source ids.

    The topology says how the plain id and its ``_POL_n`` forms follow each other over the releases.
    """
    srcs = conflicted.select("canonical_key", F.explode(F.filter("aliases", lambda a: a.startswith("SRCASSAY:"))).alias("raw_alias"))
    seen = observations.select("release_order", source_alias(observations).alias("raw_alias")).filter("raw_alias <> ''").distinct()
    rows = srcs.join(seen, "raw_alias").withColumn("is_pol", F.col("raw_alias").rlike(r"_POL_\d+$"))
    per = rows.groupBy("canonical_key", "release_order").agg(F.sum((~F.col("is_pol")).cast("int")).alias("plain"), F.sum(F.col("is_pol").cast("int")).alias("pol"))
    time = per.groupBy("canonical_key").agg(
        F.max((F.col("plain") > 0) & (F.col("pol") > 0)).alias("both"), F.max(F.col("pol") > 1).alias("many"), F.max(F.col("plain") + F.col("pol") > 1).alias("several"),
        F.max(F.when(F.col("plain") > 0, F.col("release_order"))).alias("last_plain"), F.min(F.when(F.col("pol") > 0, F.col("release_order"))).alias("first_pol"),
    )
    ids = rows.groupBy("canonical_key").agg(F.count_distinct(F.when(~F.col("is_pol"), F.col("raw_alias"))).alias("n_plain_ids"), F.count_distinct(F.when(F.col("is_pol"), F.col("raw_alias"))).alias("n_pol_ids"))
    one, pols = F.col("n_plain_ids") == 1, F.col("n_pol_ids")
    # The classes, in the order in which they are judged.
    topology = (
        F.when(one & (pols == 1) & ~F.col("several") & (F.col("last_plain") < F.col("first_pol")), "ONE_TO_ONE_TEMPORAL_RENAME")
        .when(one & (pols > 1) & F.col("many"), "ONE_TO_MANY_PARTITION").when(F.col("both"), "PLAIN_POL_SIMULTANEOUS").when(F.col("many"), "MULTI_POL_SIMULTANEOUS").otherwise("OTHER")
    )
    return ids.join(time, "canonical_key").select("canonical_key", topology.alias("topology"), "n_plain_ids", "n_pol_ids")
