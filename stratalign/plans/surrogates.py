"""The driver's generic tables seen as release sequences, layers and entity graphs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators import firstseen as FS
from stratalign.session import table

RELEASES = 31  # the thirty days of events and one release without any
BACKTESTS = (
    FS.Backtest("B1", date(1996, 1, 1), date(1997, 1, 1), date(1998, 1, 1), date(1999, 1, 1)),
    FS.Backtest("B2", date(1997, 1, 1), date(1998, 6, 1), date(1999, 6, 1), date(2000, 6, 1)),
    FS.Backtest("B3", date(1998, 1, 1), date(1999, 1, 1), date(2000, 1, 1), date(2001, 1, 1)),
)


def manifest(spark: SparkSession) -> DataFrame:
    """Release R00 a day before the events, R01 to R30 one a day."""
    i = F.col("id").cast("int")
    return spark.range(RELEASES).select(F.concat(F.lit("R"), F.lpad(i.cast("string"), 2, "0")).alias("release_label"), F.date_add(F.lit(date(2023, 12, 31)), i).alias("exact_release_date"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: the day is the release; coarse and fine assay ids come from props.k."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    order = F.datediff(F.col("ts").cast("date"), F.lit(date(2024, 1, 1))) + 1
    out = e.select(
        F.concat(F.lit("R"), F.lpad(order.cast("string"), 2, "0")).alias("release_label"), F.col("event_id").alias("row_ordinal"), k.alias("k"),
        F.concat(F.lit("A"), F.floor(k / 10).cast("string")).alias("assay_identity_key"), F.when(k < 20, "X").otherwise(F.floor(k / 2).cast("string")).alias("release_local_assay_key"),
        F.concat(F.lit("M"), (F.col("user_id") % 20).cast("string")).alias("full_inchikey"), F.col("event_type").alias("standard_type"), F.lit("=").alias("standard_relation"),
        F.floor(F.col("value") / 100).cast("string").alias("molar_text"), F.lit("T1").alias("target_accession"), (F.col("value") > 5).alias("primary_record_eligible"), (F.col("value") > 2).alias("relaxed_record_eligible"), F.lit(True).alias("broad_prior_knowledge_eligible"),
    )
    return out.withColumns(X.activity_keys("assay_identity_key", "full_inchikey", "standard_type", "standard_relation", F.coalesce("molar_text", F.lit("")), "target_accession"))


def archive_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of ten assay families over thirty releases, two families of each history.

    A family is props.k mod 10, its history the family mod 5: (0) a source id that is renamed after
    release 15, (1) one that parts into two after release 10, (2) a source id that only later releases
    have, (3) one that the last release alone renames, (4) none. Molecules tell which half of a
    parted family a record belongs to.
    """
    e = table(spark, sf_dir, "events")
    order = F.datediff(F.col("ts").cast("date"), F.lit(date(2024, 1, 1))) + 1
    family, half = F.get_json_object("props", "$.k").cast("int") % 10, F.col("user_id") % 2
    kind = family % 5
    own = lambda x: F.concat(F.lit(x), family.cast("string"))
    pol = lambda n: F.concat(own("T"), F.lit("_POL_"), n.cast("string"))
    source = (
        F.when(kind == 0, F.when(order <= 15, own("T")).otherwise(pol(F.lit(1)))).when(kind == 1, F.when(order <= 10, own("T")).otherwise(pol(half + 1)))
        .when((kind == 2) & (order > 12), own("U")).when(kind == 3, F.when(order < 30, own("T")).otherwise(pol(F.lit(1))))
    )
    return e.select(
        F.concat(F.lit("R"), F.lpad(order.cast("string"), 2, "0")).alias("release_label"), F.col("event_id").alias("row_ordinal"), F.lit("post15").alias("schema_generation"),
        own("D").alias("document_chembl_id"), F.concat(F.lit("10.1/"), own("D")).alias("document_doi"), own("").alias("native_document_id"), F.lit("2020").alias("document_year"),
        F.lit(None).cast("string").alias("document_pubmed_id"), own("").alias("native_assay_id"), F.when(kind == 1, F.concat(own("A"), F.lit("_"), half.cast("string"))).otherwise(own("A")).alias("assay_chembl_id"),
        F.when(source.isNotNull(), F.lit("37")).alias("assay_source_id"), source.alias("assay_source_assay_id"), F.when(kind == 1, own("description ")).alias("assay_description"), F.lit("B").alias("assay_type"),
        F.lit("T1").alias("target_accession"), F.lit(None).cast("string").alias("assay_identity_key"), F.concat(F.lit("M"), (F.col("user_id") % 20).cast("string")).alias("full_inchikey"),
        F.col("event_type").alias("standard_type"), F.lit("=").alias("standard_relation"), (F.floor(F.col("value") / 100) + 1).cast("double").alias("standard_value_molar"),
        (F.col("value") > 5).alias("primary_record_eligible"), (F.col("value") > 2).alias("relaxed_confidence_B_record_eligible"), (F.col("value") > 5).alias("primary_direct_all_assay_eligible"),
        F.lit(True).alias("broad_prior_knowledge_eligible"),
    )


def layered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as activities of a customer's pair, in the layers of three backtests."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("activity_key"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("pair_key"), F.col("o_custkey").cast("string").alias("full_inchikey"),
        F.col("o_orderstatus").alias("target_accession"), F.col("o_orderpriority").alias("assay_type"), F.lit("IC50").alias("standard_type"), (F.col("o_orderkey") % 97).cast("string").alias("document_identity_key"),
        F.col("o_orderdate").cast("date").alias("first_available_date"), (F.col("o_orderkey") % 10).cast("string").alias("confidence_score"), (F.col("o_orderkey") % 3 == 0).alias("prior_other_endpoint_exposure"),
    )
    return FS.assign_layers(rows, BACKTESTS)


OBS_SQL = """obs AS (
  SELECT 'R' || lpad(CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS VARCHAR), 2, '0') AS release_label,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS release_order, CAST(ts AS DATE) AS release_date, event_id AS row_ordinal,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'M' || CAST(user_id % 20 AS VARCHAR) AS full_inchikey, event_type AS standard_type,
         CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS molar_text, value > 5 AS primary_record_eligible, value > 2 AS relaxed_record_eligible FROM events),
ids AS (SELECT *, 'A' || CAST(CAST(floor(k / 10) AS BIGINT) AS VARCHAR) AS assay, CASE WHEN k < 20 THEN 'X' ELSE CAST(CAST(floor(k / 2) AS BIGINT) AS VARCHAR) END AS local_assay FROM obs),
keyed AS (SELECT *, sha256(assay || '|' || full_inchikey || '|' || standard_type || '|=|' || coalesce(molar_text, '') || '|T1') AS activity_key,
         sha256('RELEASE_LOCAL_ASSAY:' || local_assay || '|' || full_inchikey || '|' || standard_type || '|=|' || coalesce(molar_text, 'None') || '|T1') AS local_key,
         sha256(assay || '|' || full_inchikey || '|' || standard_type || '|=|' || coalesce(molar_text, 'None') || '|T1') AS safe_key,
         full_inchikey || '|T1|' || standard_type AS pair_key, full_inchikey || '|T1' AS cross_key FROM ids)"""

ARCHIVE_SQL = """raw AS (
  SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS o, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS f, user_id % 2 AS half, 'M' || CAST(user_id % 20 AS VARCHAR) AS mol,
         event_type AS endpoint, CAST(floor(value / 100) AS BIGINT) AS bin FROM events WHERE value > 5),
named AS (SELECT *, f % 5 AS kind, CASE WHEN f % 5 = 1 THEN f || '_' || half ELSE f || '' END AS safe, CASE
  WHEN f % 5 = 0 THEN CASE WHEN o <= 15 THEN 'S' ELSE 'S_POL_1' END WHEN f % 5 = 1 THEN CASE WHEN o <= 10 THEN 'S' ELSE 'S_POL_' || half END
  WHEN f % 5 = 2 AND o > 12 THEN 'U' WHEN f % 5 = 3 THEN CASE WHEN o < 30 THEN 'S' ELSE 'S_POL_1' END ELSE 'A' END || f AS loc FROM raw),
renamed AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS f FROM events WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 = 30),
pairs AS (SELECT DISTINCT kind, f, safe || '|' || mol || '|' || endpoint || '|' || bin AS sk, loc || '|' || mol || '|' || endpoint || '|' || bin AS lk, o FROM named),
sf AS (SELECT sk, min(o) AS so FROM pairs GROUP BY 1), lf AS (SELECT lk, min(o) AS lo FROM pairs GROUP BY 1),
late AS (SELECT sk, any_value(kind) AS kind, any_value(f) AS f, max(lo - so) AS delay FROM (SELECT DISTINCT kind, f, sk, lk FROM pairs) JOIN sf USING (sk) JOIN lf USING (lk) GROUP BY sk HAVING max(lo - so) > 0)"""

LAYERS_SQL = "lay AS (SELECT b.*, o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority, CAST(o_orderdate AS DATE) AS d, CASE WHEN CAST(o_orderdate AS DATE) <= e THEN 'E' WHEN CAST(o_orderdate AS DATE) <= r THEN 'R' WHEN CAST(o_orderdate AS DATE) <= c THEN 'C' WHEN CAST(o_orderdate AS DATE) <= p THEN 'P' END AS layer FROM orders o, (VALUES " + ", ".join(
    f"('{b.name}', DATE '{b.e_end}', DATE '{b.r_end}', DATE '{b.c_end}', DATE '{b.p_end}')" for b in BACKTESTS
) + ") b(backtest, e, r, c, p))"
