"""Alias graphs: components with content-addressed keys, and quarantine of contradicted weak aliases.

Occurrences are rows (occurrence_id, aliases). Components come from star contraction (``stars``). A component whose aliases contradict each other
(two ids of one authority) loses all its weak aliases; only such components are solved again,
which equals solving everything again because an alias belongs to one component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators.stars import star_components
from stratalign.storage import SnapshotError, discard, materialize


def alias_labels(occurrences: DataFrame) -> DataFrame:
    """(alias, label): the smallest alias of each alias's component."""
    sets = materialize(occurrences.select(X.sorted_set(F.col("aliases")).alias("x")).filter(F.size("x") > 0).distinct(), "alias-sets")
    star = sets.select(F.element_at("x", 1).alias("b"), F.explode("x").alias("a"))
    linked = star_components(star).labels.select(F.col("node").alias("alias"), "label")
    # an alias that is never seen with another one is its own component
    alone = sets.filter(F.size("x") == 1).select(F.element_at("x", 1).alias("alias")).distinct().join(linked.select("alias"), "alias", "left_anti")
    labels = materialize(linked.unionByName(alone.select("alias", F.col("alias").alias("label"))), "alias-labels")
    discard(sets)
    return labels


def components(occurrences: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(occurrence_id -> canonical_key, component table) of an alias graph."""
    labels = alias_labels(occurrences)
    key = X.set_key({"document": "DOC_CANON:", "assay": "ASSAY_CANON:"}[kind], F.col("aliases"))
    weak = X.WEAK_PREFIXES["document"] + X.WEAK_PREFIXES["assay"]
    table = labels.groupBy("label").agg(F.array_sort(F.collect_set("alias")).alias("aliases")).withColumns({
        "canonical_key": key, "n_aliases": F.size("aliases"), "n_chembl_aliases": X.count_prefix(F.col("aliases"), "CHEMBL_"),
        "n_doi_aliases": X.count_prefix(F.col("aliases"), "DOI:"), "n_pmid_aliases": X.count_prefix(F.col("aliases"), "PMID:"),
        "n_source_aliases": X.count_prefix(F.col("aliases"), "SRCASSAY:"), "n_weak_aliases": X.count_prefix(F.col("aliases"), *weak),
        "n_local_aliases": X.count_prefix(F.col("aliases"), "LOCAL_"),
    })
    first = occurrences.select("occurrence_id", F.element_at(X.sorted_set(F.col("aliases")), 1).alias("alias"))
    mapped = first.join(labels, "alias", "left").join(table.select("label", "canonical_key"), "label", "left").select("occurrence_id", "canonical_key")
    return mapped, table.drop("label")


def fallback_alias(kind: str, release: str = "release_label", occurrence: str = "occurrence_key"):
    """The release-scoped alias of an occurrence that lost all others (H2)."""
    prefix = "LOCAL_DOC_QUAR:" if kind == "document" else "LOCAL_ASSAY_QUAR:"
    return X.sha_key(prefix, X.norm_text(F.col(release)), X.norm_text(F.col(occurrence)))


def protected_components(occurrences: DataFrame, kind: str, forced: DataFrame | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping, components, quarantined (alias, iteration)) with weak aliases never overriding authorities.

    ``occurrences`` adds fallback_alias to (occurrence_id, aliases). ``forced`` (alias) starts
    out quarantined, at iteration 0. Components left in conflict keep no weak alias.
    """
    work = occurrences.select("occurrence_id", "aliases", "fallback_alias")
    quarantined = None
    if forced is not None:
        quarantined = materialize(forced.select("alias", F.lit(0).alias("iteration")).distinct(), "quarantined")
        work = _without(work, quarantined)
    settled_map = settled = None
    for turn in range(1, limit + 1):
        mapping, table = components(work, kind)
        mapping, table = materialize(mapping, "component-map"), materialize(table, "components")
        bad = table.filter(X.external_conflict(F.col("aliases"), kind) & (F.col("n_weak_aliases") > 0)).select("canonical_key", "aliases")
        bad = materialize(bad, "conflicts")
        sound = table.join(bad.select("canonical_key"), "canonical_key", "left_anti")
        sound_map = mapping.join(bad.select("canonical_key"), "canonical_key", "left_anti")
        settled = sound if settled is None else settled.unionByName(sound)
        settled_map = sound_map if settled_map is None else settled_map.unionByName(sound_map)
        if not bad.limit(1).count():
            break
        lost = bad.select(F.explode(F.filter("aliases", lambda a: X.is_weak(a, kind))).alias("alias"), F.lit(turn).alias("iteration"))
        quarantined = materialize(lost if quarantined is None else quarantined.unionByName(lost), "quarantined")
        touched = mapping.join(bad.select("canonical_key"), "canonical_key", "left_semi").select("occurrence_id")
        if turn == limit:
            raise SnapshotError(f"{kind}: components still contradict themselves after {limit} turns", bad)
        work = materialize(_without(work.join(touched, "occurrence_id", "left_semi"), quarantined.filter(F.col("iteration") == turn)), "component-work")
    if quarantined is None:
        quarantined = occurrences.sparkSession.createDataFrame([], "alias string, iteration int")
    return settled_map.select("occurrence_id", "canonical_key"), settled, quarantined


def _without(work: DataFrame, gone: DataFrame) -> DataFrame:
    """Aliases less the given ones; the fallback where none is left."""
    flat = work.select("occurrence_id", F.explode("aliases").alias("alias")).join(gone.select("alias").distinct(), "alias", "left_anti")
    kept = flat.groupBy("occurrence_id").agg(F.collect_set("alias").alias("kept"))
    left = work.join(kept, "occurrence_id", "left")
    return left.select("occurrence_id", F.coalesce("kept", F.array("fallback_alias")).alias("aliases"), "fallback_alias")
