"""Release metadata: dates from payloads and overrides, archive listings, expectations."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.storage import assert_none, materialize

LABELS = ("release_label", "chembl_release", "release", "name")
DATES = ("exact_release_date", "creation_date", "release_date", "date")
ARCHIVE_STATUS = ("ready", "missing_local_file", "missing")


def _is_container(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")


def walk(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(node, depth): every object of JSON payloads, a row each, whatever the envelopes.

    Payloads are parsed once to VARIANT. Depth by depth, what a value holds is exploded, and what is neither
    object nor list is left behind; a depth is a written table, and their number is that of the deepest payload.
    Text that is no JSON raises; null payloads have no objects.
    """
    level = payloads.select(F.parse_json(F.col(column)).alias("node")).filter("node IS NOT NULL")
    found, depth = None, 0
    while True:
        level = materialize(level.filter(_is_container(F.col("node"))), "json-level")
        objects = level.filter(F.schema_of_variant("node").startswith("OBJECT")).withColumn("depth", F.lit(depth))
        found = objects if found is None else found.unionByName(objects)
        if not level.limit(1).count():
            return found
        held = payloads.sparkSession.tvf.variant_explode(F.col("node").outer())
        level, depth = level.lateralJoin(held).select(F.col("value").alias("node")), depth + 1


def dates_in(payloads: DataFrame, column: str = "payload", label_fields: tuple[str, ...] = LABELS, date_fields: tuple[str, ...] = DATES) -> DataFrame:
    """(release_label, exact_release_date) of the objects of JSON payloads; two dates for one release raise (IO15)."""
    node = F.col("node")

    def first(fields: tuple[str, ...], kinds: str) -> Column:
        def one(f: str) -> Column:
            kind = F.schema_of_variant(F.try_variant_get(node, f"$.{f}", "variant"))
            return F.when(kind.rlike(kinds), F.try_variant_get(node, f"$.{f}", "string"))

        return F.coalesce(*[one(f) for f in fields])

    rows = walk(payloads, column).select(first(label_fields, r"^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)").alias("label"), first(date_fields, "^STRING").alias("day"))
    out = rows.select(X.norm_release_label(F.col("label")).alias("release_label"), X.iso_date(F.col("day")).alias("exact_release_date"))
    out = materialize(out.filter("release_label <> '' AND exact_release_date IS NOT NULL").distinct(), "release-dates")
    assert_none(out.groupBy("release_label").agg(F.count_distinct("exact_release_date").alias("n")).filter("n > 1"), "conflicting release dates")
    return out


def payload_dates(spark: SparkSession, payload: Any, label_fields: tuple[str, ...] = LABELS, date_fields: tuple[str, ...] = DATES) -> DataFrame:
    """``dates_in`` of one decoded payload."""
    return dates_in(spark.createDataFrame([(json.dumps(payload),)], "payload string"), "payload", label_fields, date_fields)


def resolve_dates(manifest: DataFrame, official: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override before official date, with the source of each."""
    o = overrides.select("release_label", F.col("exact_release_date").cast("date").alias("_over"))
    f = official.select("release_label", F.col("exact_release_date").cast("date").alias("_off"))
    out = manifest.drop("exact_release_date").join(o, "release_label", "left").join(f, "release_label", "left")
    source = F.when(F.col("_over").isNotNull(), "override").when(F.col("_off").isNotNull(), "official").otherwise("unresolved")
    return out.withColumns({"exact_release_date": F.coalesce("_over", "_off"), "date_source": source, "date_conflict": F.coalesce(F.col("_over") != F.col("_off"), F.lit(False))}).drop("_over", "_off")


def date_issues(manifest: DataFrame) -> DataFrame:
    """Rows whose date is not written YYYY-MM-DD."""
    return manifest.filter(~X.is_exact_date(F.col("exact_release_date").cast("string"))).select("release_label", F.col("exact_release_date").cast("string").alias("value"), F.lit("not an exact date").alias("issue"))


def archive_links(pages: DataFrame, pattern: str = r"sqlite") -> DataFrame:
    """Sorted different links of index pages that match (IO16)."""
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))).alias("href"))
    return links.filter(F.col("href").rlike(pattern)).distinct().orderBy("href")


def archive_status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """ready, missing_local_file or missing per release, from (path) of the files there are (IO17)."""
    f = files.select(F.col("path").alias("local_path"), F.lit(True).alias("_there"))
    out = manifest.join(f, "local_path", "left")
    named = X.text(F.col("local_path")) != ""
    return out.withColumn("status", F.when(F.coalesce("_there", F.lit(False)), "ready").when(named, "missing_local_file").otherwise("missing")).drop("_there")


def required_releases(manifest: DataFrame, last_end: str) -> DataFrame:
    """Releases up to the last end of any backtest (R2)."""
    return manifest.filter(F.col("exact_release_date").cast("date") <= F.lit(last_end).cast("date"))


def expected_generation(release: str = "release") -> Column:
    """Schema generation by major version."""
    major = F.substring_index(F.col(release), ".", 1).try_cast("int")
    return F.when(major < 9, "pre9_early").when(major < 15, "pre15_legacy").otherwise("post15")
