"""Occurrences: release-local keys and alias sets of documents and assays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalign.functions import text as X

BIB = ("document_journal", "document_year", "document_volume", "document_issue", "document_first_page", "document_title")


def field(df: DataFrame, name: str) -> Column:
    """A normalised column, '' where the release has none."""
    return X.norm_text(F.col(name)) if name in df.columns else F.lit("")


def _present(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & (c != "")
    return out


def weak_document_aliases(df: DataFrame) -> Column:
    """Up to three hashes: year+title, year+journal+page, journal+volume+page (K1)."""
    j, y, v, p, t = (field(df, f"document_{x}") for x in ("journal", "year", "volume", "first_page", "title"))
    some = F.array(
        F.when(_present(y, t), X.sha_key("DOC_TITLE:", y, t)),
        F.when(_present(y, j, p), X.sha_key("DOC_PAGE:", y, j, p)),
        F.when(_present(j, v, p), X.sha_key("DOC_VOLPAGE:", j, v, p)),
    )
    return X.sorted_set(some)


def shared_doi_collisions(df: DataFrame) -> DataFrame:
    """(release_label, doi): DOIs that within a release stand for several documents, told apart one to one (I4).

    Several document ids and PMIDs in a one-to-one mapping that covers all of both; several
    pages or titles; at most one page and title per document; a strong id on every row.
    """
    meta = df.select(
        field(df, "release_label").alias("release_label"), X.norm_doi(F.col("document_doi")).alias("doi"), field(df, "document_pubmed_id").alias("pmid"),
        field(df, "document_chembl_id").alias("chem"), field(df, "document_first_page").alias("page"), field(df, "document_title").alias("title"),
    ).filter("doi <> ''").distinct()
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    pair = F.when((F.col("chem") != "") & (F.col("pmid") != ""), F.struct("chem", "pmid"))
    per_chem = meta.filter("chem <> ''").groupBy("release_label", "doi", "chem").agg(
        F.count_distinct(some("page")).alias("pages"), F.count_distinct(some("title")).alias("titles"), F.count_distinct(some("pmid")).alias("pmids")
    ).groupBy("release_label", "doi").agg(F.max("pages").alias("chem_pages"), F.max("titles").alias("chem_titles"), F.max("pmids").alias("chem_pmids"), F.min("pmids").alias("chem_pmids_least"))
    per_pmid = meta.filter("pmid <> ''").groupBy("release_label", "doi", "pmid").agg(F.count_distinct(some("chem")).alias("chems")).groupBy("release_label", "doi").agg(F.max("chems").alias("pmid_chems"), F.min("chems").alias("pmid_chems_least"))
    whole = meta.groupBy("release_label", "doi").agg(
        F.count_distinct(some("chem")).alias("chems"), F.count_distinct(some("pmid")).alias("pmids"), F.count_distinct(some("page")).alias("pages"),
        F.count_distinct(some("title")).alias("titles"), F.count_distinct(pair).alias("pairs"), F.min((F.col("pmid") != "") | (F.col("chem") != "")).alias("strong"),
    )
    joined = whole.join(per_chem, ["release_label", "doi"]).join(per_pmid, ["release_label", "doi"])
    return joined.filter(
        "chems > 1 AND pmids > 1 AND (pages > 1 OR titles > 1) AND chem_pmids = 1 AND chem_pmids_least = 1 "
        "AND pmid_chems = 1 AND pmid_chems_least = 1 AND chem_pages <= 1 AND chem_titles <= 1 AND strong"
    ).select("release_label", "doi")


def with_collisions(df: DataFrame) -> DataFrame:
    """Adds doi_ and doi_quarantined."""
    out = df.withColumn("doi_", X.norm_doi(F.col("document_doi")) if "document_doi" in df.columns else F.lit(""))
    if "document_doi" not in df.columns:
        return out.withColumn("doi_quarantined", F.lit(False))
    bad = shared_doi_collisions(df).select(F.col("release_label").alias("_r"), F.col("doi").alias("_d"), F.lit(True).alias("doi_quarantined"))
    joined = out.join(bad, (field(out, "release_label") == F.col("_r")) & (F.col("doi_") == F.col("_d")), "left").drop("_r", "_d")
    return joined.withColumn("doi_quarantined", F.coalesce("doi_quarantined", F.lit(False)))


def document_local_key(df: DataFrame) -> Column:
    """Release-local document key by precedence (K2); ``df`` has doi_, doi_quarantined, release_order and row_ordinal."""
    j, y, v, p, t = (field(df, f"document_{x}") for x in ("journal", "year", "volume", "first_page", "title"))
    pmid = X.norm_pmid(F.col("document_pubmed_id")) if "document_pubmed_id" in df.columns else F.lit("")
    chem, native, release = field(df, "document_chembl_id"), field(df, "native_document_id"), field(df, "release_label")
    named = lambda prefix, *parts: F.concat(F.lit(prefix), F.concat_ws("|", *parts))
    return F.coalesce(
        F.when((F.col("doi_") != "") & ~F.col("doi_quarantined"), named("DOI:", F.col("doi_"))),
        F.when(pmid != "", named("PMID:", pmid)), F.when(chem != "", named("CHEMBL_DOC:", chem)),
        F.when(_present(y, t), named("TITLE_RAW:", y, t)), F.when(_present(y, j, p), named("PAGE_RAW:", y, j, p)), F.when(_present(j, v, p), named("VOLPAGE_RAW:", j, v, p)),
        F.when(native != "", F.concat(F.lit("LOCAL_DOC_ID:"), release, F.lit(":"), native)),
        F.concat(F.lit("LOCAL_DOC_ROW:"), F.col("release_order").cast("string"), F.lit(":"), F.col("row_ordinal").cast("string")),
    )


def document_occurrences(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, observations with document_occurrence)."""
    rows = with_collisions(df)
    rows = rows.withColumn("document_occurrence", document_local_key(rows))
    pmid = X.norm_pmid(F.col("document_pubmed_id")) if "document_pubmed_id" in df.columns else F.lit("")
    chem = field(rows, "document_chembl_id")
    strong = F.array(
        F.when(chem != "", F.concat(F.lit("CHEMBL_DOC:"), chem)),
        F.when((F.col("doi_") != "") & ~F.col("doi_quarantined"), F.concat(F.lit("DOI:"), F.col("doi_"))),
        F.when(pmid != "", F.concat(F.lit("PMID:"), pmid)),
    )
    slim = rows.select(
        "release_order", F.col("document_occurrence").alias("occurrence_key"), X.sorted_set(F.concat(strong, weak_document_aliases(rows))).alias("a"),
        F.when(F.col("doi_quarantined"), F.concat(F.lit("DOI:"), F.col("doi_"))).alias("q"), field(rows, "schema_generation").alias("g"), field(rows, "release_label").alias("r"),
    ).distinct()
    return _grouped(slim, "document", "LOCAL_DOC_OCC:"), rows.drop("doi_", "doi_quarantined")


def _grouped(slim: DataFrame, kind: str, lone: str) -> DataFrame:
    from stratalign.operators.components import fallback_alias

    some = lambda c: X.sorted_set(F.collect_set(c))
    occ = slim.groupBy("release_order", "occurrence_key").agg(
        X.sorted_set(F.flatten(F.collect_set("a"))).alias("aliases"), some("q").alias("quarantined_external"), some("g").alias("schema_generation"), some("r").alias("releases")
    )
    alone = F.array(F.concat(F.lit(lone), F.col("occurrence_key")))
    occ = occ.withColumns({"aliases": F.when(F.size("aliases") == 0, alone).otherwise(F.col("aliases")), "release_label": F.array_join("releases", "|")})
    return occ.withColumns({"occurrence_id": F.concat_ws("#", F.col("release_order").cast("string"), "occurrence_key"), "fallback_alias": fallback_alias(kind)})


def source_alias(df: DataFrame) -> Column:
    """``SRCASSAY:source:id`` or ''."""
    source, own = field(df, "assay_source_id"), field(df, "assay_source_assay_id")
    return F.when(_present(source, own), F.concat(F.lit("SRCASSAY:"), source, F.lit(":"), own)).otherwise("")


def with_policy(df: DataFrame, policy: DataFrame | None) -> DataFrame:
    """Adds src_raw, src_alias (renamed), src_quarantined; ``policy`` is (raw_alias, action, canonical_alias)."""
    out = df.withColumn("src_raw", source_alias(df))
    if policy is None:
        return out.withColumns({"src_alias": F.col("src_raw"), "src_quarantined": F.lit(False), "src_renamed": F.lit(False)})
    p = policy.select(F.col("raw_alias").alias("src_raw"), F.col("action").alias("_act"), F.col("canonical_alias").alias("_to"))
    out = out.join(p, "src_raw", "left")
    act = F.coalesce("_act", F.lit(""))
    return out.withColumns({"src_alias": F.when(act == "rename", F.col("_to")).otherwise(F.col("src_raw")), "src_quarantined": act == "quarantine", "src_renamed": act == "rename"}).drop("_act", "_to")


def assay_local_key(df: DataFrame) -> Column:
    """Release-local assay key by precedence (K3); ``df`` has src_alias and src_quarantined."""
    chem, native, release = field(df, "assay_chembl_id"), field(df, "native_assay_id"), field(df, "release_label")
    doc, desc, kind, target = field(df, "document_identity_key"), field(df, "assay_description"), field(df, "assay_type"), field(df, "target_accession")
    return F.coalesce(
        F.when((F.col("src_alias") != "") & ~F.col("src_quarantined"), F.col("src_alias")),
        F.when(chem != "", F.concat(F.lit("CHEMBL_ASSAY:"), chem)),
        F.when(_present(doc, desc), F.concat(F.lit("SEMRAW:"), F.concat_ws("|", doc, desc, kind, target))),
        F.when(native != "", F.concat(F.lit("LOCAL_ASSAY_ID:"), release, F.lit(":"), native)),
        F.concat(F.lit("LOCAL_ASSAY_ROW:"), F.col("release_order").cast("string"), F.lit(":"), F.col("row_ordinal").cast("string")),
    )


def assay_occurrences(df: DataFrame, policy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences, observations with assay_occurrence) with the source policy applied."""
    rows = with_policy(df, policy)
    rows = rows.withColumn("assay_occurrence", assay_local_key(rows))
    doc, desc, kind, target = field(rows, "document_identity_key"), field(rows, "assay_description"), field(rows, "assay_type"), field(rows, "target_accession")
    chem, existing = field(rows, "assay_chembl_id"), field(rows, "assay_identity_key")
    aliases = F.array(
        F.when(_present(doc, desc), X.sha_key("ASSAY_SEM:", doc, desc, kind, target)), F.when(chem != "", F.concat(F.lit("CHEMBL_ASSAY:"), chem)),
        F.when((F.col("src_alias") != "") & ~F.col("src_quarantined"), F.col("src_alias")), F.when(existing != "", F.concat(F.lit("EXISTING_ASSAY:"), existing)),
    )
    slim = rows.select(
        "release_order", F.col("assay_occurrence").alias("occurrence_key"), X.sorted_set(aliases).alias("a"), F.when(F.col("src_quarantined"), F.col("src_raw")).alias("q"),
        field(rows, "schema_generation").alias("g"), field(rows, "release_label").alias("r"),
    ).distinct()
    kinds = rows.select("release_order", F.col("assay_occurrence").alias("occurrence_key"), field(rows, "assay_type").alias("t")).groupBy("release_order", "occurrence_key").agg(X.sorted_set(F.collect_set("t")).alias("assay_types"))
    return _grouped(slim, "assay", "LOCAL_ASSAY_OCC:").join(kinds, ["release_order", "occurrence_key"], "left"), rows.drop("src_raw", "src_alias", "src_quarantined", "src_renamed")


def extraction_document_key(df: DataFrame) -> Column:
    """Document key at extraction: id, DOI, PMID, hash of the bibliography (K4)."""
    chem, doi, pmid = field(df, "document_chembl_id"), field(df, "document_doi"), field(df, "document_pubmed_id")
    bib = [field(df, c) for c in BIB]
    return F.coalesce(F.when(chem != "", F.concat(F.lit("CHEMBL_DOC:"), chem)), F.when(doi != "", F.concat(F.lit("DOI:"), doi)), F.when(pmid != "", F.concat(F.lit("PMID:"), pmid)), X.sha_key("BIB:", *bib))


def extraction_assay_key(df: DataFrame) -> Column:
    """Assay key at extraction: id, or hash of document, description, type and target (K5)."""
    chem = field(df, "assay_chembl_id")
    parts = [field(df, c) for c in ("document_identity_key", "assay_description", "assay_type", "target_accession")]
    return F.when(chem != "", F.concat(F.lit("CHEMBL_ASSAY:"), chem)).otherwise(X.sha_key("LEGACY_ASSAY_FP:", *parts))
