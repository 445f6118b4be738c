"""Registered queries of the snapshot operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators import archive as AR
from stratalign.operators import attribution as AT
from stratalign.operators import audits as AU
from stratalign.operators import comparator as CO
from stratalign.operators import components as CC
from stratalign.operators import firstseen as FS
from stratalign.operators import policy as PO
from stratalign.operators import quality as Q
from stratalign.plans import generated, scaled  # noqa: F401  (generated adds its queries to those of scaled)
from stratalign.plans.surrogates import ARCHIVE_SQL, LAYERS_SQL, OBS_SQL, archive_observations, layered_orders, manifest, observations
from stratalign.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return {**_QUERIES, **scaled.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **scaled.ORACLES}


FIRST_SQL = f"""WITH {OBS_SQL},
el AS (SELECT *, count(*) OVER (PARTITION BY release_label, activity_key) AS mult, row_number() OVER (PARTITION BY release_label, activity_key ORDER BY row_ordinal) AS rn FROM keyed WHERE coalesce(primary_record_eligible, false)),
one AS (SELECT *, count(*) OVER (PARTITION BY activity_key) AS occ, row_number() OVER (PARTITION BY activity_key ORDER BY release_order) AS fr FROM el WHERE rn = 1),
f AS (SELECT activity_key, pair_key, cross_key, standard_type, assay, release_label AS first_available_release, release_date AS first_available_date, mult, occ,
      min(release_date) OVER (PARTITION BY pair_key) AS pair_date FROM one WHERE fr = 1),
g AS (SELECT *, first_available_date = pair_date AS is_first FROM f)"""


def _first(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return FS.first_seen(observations(spark, d), manifest(spark))


@query(FIRST_SQL + " SELECT activity_key, first_available_release, first_available_date, mult AS within_release_duplicate_multiplicity, occ AS n_release_occurrences, false AS first_availability_left_censored, 'R00' AS archive_left_censor_release_label FROM g")
def first_seen(spark, d):
    return _first(spark, d)[1].drop("archive_left_censor_release_date")


@query(FIRST_SQL + """ SELECT activity_key, pair_key, pair_date AS pair_first_available_date, is_first AS is_pair_first_release, CAST(sum(is_first::INT) OVER (PARTITION BY pair_key) AS BIGINT) AS pair_first_tie_count,
  is_first AND row_number() OVER (PARTITION BY pair_key ORDER BY (NOT is_first)::INT, assay, activity_key) = 1 AS is_pair_first_representative FROM g""")
def pair_first_ties(spark, d):
    return _first(spark, d)[0].select("activity_key", "pair_key", "pair_first_available_date", "is_pair_first_release", "pair_first_tie_count", "is_pair_first_representative")


@query(f"WITH {OBS_SQL}, lo AS (SELECT min(release_date) AS d FROM keyed) SELECT release_label, release_date = d AS left_censored, count(DISTINCT activity_key) AS n FROM keyed, lo WHERE primary_record_eligible GROUP BY ALL")
def left_censor(spark, d):
    m = manifest(spark).filter("release_label <> 'R00'")
    first = observations(spark, d).filter("primary_record_eligible").join(F.broadcast(m), "release_label").join(F.broadcast(FS.left_censor(m)))
    return first.groupBy("release_label", (F.col("exact_release_date") == F.col("archive_left_censor_release_date")).alias("left_censored")).agg(F.count_distinct("activity_key").alias("n"))


@query(FIRST_SQL + f""", b AS (SELECT cross_key, standard_type, min(release_date) AS d FROM keyed GROUP BY ALL)
SELECT g.activity_key, min(b.d) AS prior_other_endpoint_date, coalesce(min(b.d) < any_value(g.pair_date), false) AS prior_other_endpoint_exposure
FROM g LEFT JOIN b ON g.cross_key = b.cross_key AND g.standard_type <> b.standard_type GROUP BY g.activity_key""")
def cross_endpoint_prior(spark, d):
    o = observations(spark, d)
    broad = FS.first_seen(o, manifest(spark), "broad_prior_knowledge_eligible")[0]
    return FS.prior_other_endpoint(_first(spark, d)[0], broad).select("activity_key", "prior_other_endpoint_date", "prior_other_endpoint_exposure")


@query("""SELECT o_orderkey, make_date(y, 7, 1) AS document_publication_date, CAST(date_diff('day', make_date(y, 7, 1), d) AS INTEGER) AS curation_lag_days_approx, NOT lc AND y IS NOT NULL AS curation_lag_main_eligible
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) - o_orderkey % 5 AS BIGINT) END AS y, o_orderkey % 7 = 0 AS lc FROM orders)""")
def curation_lag(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("first_available_date"), F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate") - F.col("o_orderkey") % 5).cast("string").alias("document_year"), (F.col("o_orderkey") % 7 == 0).alias("first_availability_left_censored")
    )
    return FS.curation_lag(o).select("o_orderkey", "document_publication_date", "curation_lag_days_approx", "curation_lag_main_eligible")


@query(f"WITH {LAYERS_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS activity_key, backtest, layer, layer = 'P' AS eligible_primary_P FROM lay WHERE layer IS NOT NULL")
def backtest_layers(spark, d):
    return layered_orders(spark, d).select("activity_key", "backtest", "layer", "eligible_primary_P")


@query(f"WITH {LAYERS_SQL} SELECT backtest, count(*) FILTER (layer = 'E') AS \"E\", count(*) FILTER (layer = 'R') AS \"R\", count(*) FILTER (layer = 'C') AS \"C\", count(*) FILTER (layer = 'P') AS \"P\" FROM lay WHERE layer IS NOT NULL GROUP BY backtest")
def layer_crosstab(spark, d):
    return AU.layer_crosstab(layered_orders(spark, d))


@query(f"WITH {LAYERS_SQL}, n AS (SELECT o_orderkey, count(DISTINCT backtest) AS n_backtests FROM lay WHERE layer IS NOT NULL GROUP BY 1) SELECT n_backtests, count(*) AS n_keys FROM n GROUP BY 1")
def backtest_participation(spark, d):
    return AU.participation(layered_orders(spark, d), most=3)


@query(f"WITH {LAYERS_SQL} SELECT backtest, layer, o_orderstatus AS target_accession, o_orderpriority AS assay_type, count(DISTINCT o_orderkey) AS activity_identities, count(DISTINCT o_custkey) AS unique_molecules, count(DISTINCT o_orderkey % 97) AS unique_documents FROM lay WHERE layer IS NOT NULL GROUP BY ALL")
def composition_assay_type(spark, d):
    return AU.composition(layered_orders(spark, d), "assay_type")


@query(f"WITH {LAYERS_SQL} SELECT backtest, layer, o_orderstatus AS target_accession, CAST(o_orderkey % 10 AS DOUBLE) AS confidence_score, count(DISTINCT o_orderkey) AS activity_identities, count(DISTINCT o_custkey) AS unique_molecules, count(DISTINCT o_orderkey % 97) AS unique_documents FROM lay WHERE layer IS NOT NULL AND o_orderstatus IN ('F', 'O') GROUP BY ALL")
def composition_confidence(spark, d):
    return AU.composition(layered_orders(spark, d), "confidence_score", targets=("F", "O"))


@query(f"""WITH {LAYERS_SQL}, pr AS (SELECT backtest, o_orderstatus AS t, o_custkey, o_orderpriority, arg_min(o_orderkey % 3 = 0, CAST(o_orderkey AS VARCHAR)) AS prior FROM lay WHERE layer = 'P' GROUP BY ALL)
SELECT backtest, t AS target_accession, 'IC50' AS endpoint, count(*) AS \"unique_primary_P_pairs\", CAST(sum(prior::INT) AS BIGINT) AS pairs_with_prior_other_endpoint, sum(prior::INT) / CAST(count(*) AS DOUBLE) AS prior_other_endpoint_fraction FROM pr GROUP BY ALL""")
def prior_exposure(spark, d):
    return AU.prior_exposure(layered_orders(spark, d))


@query(f"""WITH {OBS_SQL} SELECT (SELECT count(*) FROM (SELECT DISTINCT activity_key FROM keyed WHERE primary_record_eligible AND activity_key NOT IN (SELECT activity_key FROM keyed))) AS outside_broad,
(SELECT count(*) FROM (SELECT DISTINCT activity_key FROM keyed WHERE activity_key NOT IN (SELECT activity_key FROM keyed WHERE primary_record_eligible))) AS broad_only""")
def track_nesting(spark, d):
    o = observations(spark, d)
    n = lambda x, y, name: FS.not_nested(x, y).agg(F.count(F.lit(1)).alias(name))
    primary = o.filter("primary_record_eligible")
    return n(primary, o, "outside_broad").join(n(o, primary, "broad_only"))


_UNITS = "['M', 'mM', 'uM', 'nM', 'pM', 'ug/mL', 'fM'][l_linenumber]"
_MOLAR = f"CASE {_UNITS} WHEN 'M' THEN v * 1e0 WHEN 'mM' THEN v * 1e-3 WHEN 'uM' THEN v * 1e-6 WHEN 'nM' THEN v * 1e-9 WHEN 'pM' THEN v * 1e-12 WHEN 'fM' THEN v * 1e-15 END"


def _measured_lines(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("M", "mM", "uM", "nM", "pM", "ug/mL", "fM")]), F.col("l_linenumber"))
    rel = F.when(F.col("l_returnflag") == "A", "=").when(F.col("l_returnflag") == "N", "<").otherwise("~")
    return Q.measured(table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("standard_type"), F.col("l_linestatus").alias("assay_type"), "l_orderkey", "l_linenumber", "l_suppkey", rel.alias("standard_relation"), (F.col("l_quantity") - 3).alias("standard_value"), unit.alias("standard_units"),
        F.when(F.col("l_suppkey") % 10 == 0, "1").alias("potential_duplicate"), F.when(F.col("l_suppkey") % 7 == 0, "Outside typical range").alias("data_validity_comment"), F.lit("ok").alias("std_status"),
    ))


@query(f"""WITH m AS (SELECT *, l_quantity - 3 AS v FROM lineitem), x AS (SELECT *, CASE WHEN v > 0 THEN {_MOLAR} END AS molar FROM m WHERE l_returnflag IN ('A', 'N'))
SELECT l_returnflag AS standard_type, l_linestatus AS assay_type, count(*) AS relation_eligible_rows, count(molar) AS unit_convertible_rows, count(*) - count(molar) AS unit_unconvertible_rows, count(molar) / CAST(count(*) AS DOUBLE) AS unit_convertible_rate FROM x GROUP BY ALL""")
def unit_audit(spark, d):
    return AU.unit_audit(_measured_lines(spark, d))


@query(f"""WITH m AS (SELECT *, l_quantity - 3 AS v FROM lineitem), x AS (SELECT *, CASE WHEN v > 0 THEN {_MOLAR} END AS molar FROM m)
SELECT l_linenumber, count(molar) AS n, round(avg(-log10(molar)), 6) AS mean_pactivity, CAST(sum((l_suppkey % 10 <> 0 AND l_suppkey % 7 <> 0)::INT) AS BIGINT) AS quality_rows FROM x GROUP BY 1""")
def pactivity_by_unit(spark, d):
    return _measured_lines(spark, d).groupBy("l_linenumber").agg(F.count("standard_value_molar").alias("n"), F.round(F.avg("pactivity"), 6).alias("mean_pactivity"), F.sum(F.col("quality_eligible").cast("long")).alias("quality_rows"))


@query("SELECT l_extendedprice AS x, printf('%.12g', l_extendedprice * 1e-9) AS canon FROM lineitem GROUP BY ALL")
def canon_float(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x")).distinct()
    return x.select("x", X.canon_float(F.col("x") * 1e-9).alias("canon"))


@query("""WITH g AS (SELECT l_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), '|' ORDER BY CAST(l_suppkey AS VARCHAR)) AS targets, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, n AS n_targets, targets FROM g WHERE n > 1""")
def multi_target_audit(spark, d):
    return Q.multi_target_audit(table(spark, d, "lineitem"), "l_partkey", "l_suppkey").select("l_partkey", "n_targets", "targets")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) GROUP BY 1")
def multi_target_exclusion(spark, d):
    """Over every line each part has several suppliers; orders have one or several, so both outcomes occur."""
    return Q.exclude_multi_target(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")[0].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS sequence, upper(p_brand) AS organism, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS accessions, count(DISTINCT p_type) AS n_accessions,
string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS target_types, CASE WHEN count(DISTINCT p_type) = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS accession,
CASE WHEN count(DISTINCT p_type) = 1 THEN string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) END AS target_type FROM part GROUP BY ALL""")
def bridge_build(spark, d):
    return AU.build_bridge(table(spark, d, "part").select(F.col("p_name").alias("sequence"), F.col("p_brand").alias("organism"), F.col("p_type").alias("accession"), F.col("p_brand").alias("target_type")))


BRIDGE_SQL = f"""WITH {OBS_SQL},
bridge AS (SELECT DISTINCT release_label, release_order, release_date, safe_key, local_key, assay, 'RELEASE_LOCAL_ASSAY:' || local_assay AS la FROM keyed),
sf AS (SELECT safe_key, min(release_order) AS so, min(release_date) AS sd FROM bridge GROUP BY 1),
lf AS (SELECT local_key, min(release_order) AS lo, min(release_date) AS ld FROM bridge GROUP BY 1),
topo AS (SELECT DISTINCT safe_key, local_key FROM bridge),
dis AS (SELECT safe_key, min(so) AS so, count(*) AS branches, CAST(min(lo - so) AS BIGINT) AS min_shift, CAST(max(lo - so) AS BIGINT) AS max_delay, CAST(min(date_diff('day', sd, ld)) AS BIGINT) AS min_days, CAST(max(date_diff('day', sd, ld)) AS BIGINT) AS max_days FROM topo JOIN sf USING (safe_key) JOIN lf USING (local_key) GROUP BY safe_key)"""


def _bridge(spark, d):
    return CO.build_bridge(observations(spark, d))


def _displacement(spark, d):
    b, m = _bridge(spark, d), manifest(spark)
    return CO.displacement(b, CO.safe_first(b, m), CO.local_first(b, m))


@query(BRIDGE_SQL + " SELECT release_label, safe_key AS safe_activity_key, local_key AS release_local_activity_key, assay AS safe_assay_identity_key, la AS release_local_assay_identity_key FROM bridge")
def release_local_bridge(spark, d):
    return _bridge(spark, d)


@query(BRIDGE_SQL + " SELECT local_key AS activity_key, arg_min(la, la) AS assay_identity_key, 'R' || lpad(CAST(min(release_order) AS VARCHAR), 2, '0') AS first_available_release, min(release_date) AS first_available_date, min(release_order) = 0 AS first_availability_left_censored FROM (SELECT *, rank() OVER (PARTITION BY local_key ORDER BY release_order) AS r FROM bridge) WHERE r = 1 GROUP BY local_key")
def local_first(spark, d):
    return CO.local_first(_bridge(spark, d), manifest(spark)).drop("release_order")


@query(BRIDGE_SQL + " SELECT safe_key AS safe_activity_key, 'R' || lpad(CAST(so AS VARCHAR), 2, '0') AS safe_first_available_release, branches AS n_release_local_branches, min_shift AS min_shift_releases, max_delay AS max_delay_releases, min_days AS min_shift_days, max_days AS max_delay_days, min_shift <> 0 OR max_delay <> 0 AS any_f0_difference, max_delay > 0 AS has_later_branch, min_shift < 0 AS has_earlier_branch FROM dis")
def displacement(spark, d):
    long = ("min_shift_releases", "max_delay_releases", "min_shift_days", "max_delay_days")
    return _displacement(spark, d).drop("safe_first_release_ordinal").withColumns({c: F.col(c).cast("long") for c in long})


@query(BRIDGE_SQL + " SELECT local_key AS release_local_activity_key, count(*) AS n_safe_activity_keys, string_agg(safe_key, '|' ORDER BY safe_key) AS safe_activity_keys FROM topo GROUP BY 1 HAVING count(*) > 1")
def overmerge(spark, d):
    return CO.overmerge(_bridge(spark, d))


@query(BRIDGE_SQL + """, l AS (SELECT count(*) AS m, CAST(sum((n > 1)::INT) AS BIGINT) AS over FROM (SELECT local_key, count(*) AS n FROM topo GROUP BY 1)),
s AS (SELECT count(*) AS n, CAST(sum((branches > 1)::INT) AS BIGINT) AS frag, CAST(sum((min_shift <> 0 OR max_delay <> 0)::INT) AS BIGINT) AS diff, CAST(sum((max_delay > 0)::INT) AS BIGINT) AS late FROM dis)
SELECT n AS identity_safe_activities, m AS release_local_activities, m - n AS absolute_inflation, 100e0 * ((m - n)::DOUBLE / n::DOUBLE) AS inflation_percent_of_safe, frag AS fragmented_safe_activities, 100e0 * (frag::DOUBLE / n::DOUBLE) AS fragmented_percent_of_safe,
diff AS safe_activities_with_any_f0_difference, late AS safe_activities_with_later_branch, over AS overmerged_release_local_identities, 100e0 * (over::DOUBLE / m::DOUBLE) AS overmerged_percent_of_release_local FROM s, l""")
def comparator_summary(spark, d):
    return CO.comparator_summary(_bridge(spark, d), _displacement(spark, d))


@query(BRIDGE_SQL + """ SELECT count(*) AS n, CAST(min(max_delay) AS INTEGER) AS min, CAST(max(max_delay) AS INTEGER) AS max, avg(max_delay) AS mean, quantile_cont(max_delay, 0.25) AS p25, quantile_cont(max_delay, 0.5) AS p50, quantile_cont(max_delay, 0.75) AS p75, quantile_cont(max_delay, 0.9) AS p90,
quantile_cont(max_delay, 0.95) AS p95, quantile_cont(max_delay, 0.99) AS p99, 100e0 * avg((max_delay >= 3)::INT) AS share_ge_3, 100e0 * avg((max_delay >= 5)::INT) AS share_ge_5, 100e0 * avg((max_delay >= 7)::INT) AS share_ge_7, 100e0 * avg((max_delay >= 10)::INT) AS share_ge_10 FROM dis WHERE max_delay > 0""")
def delay_quantiles(spark, d):
    return CO.delay_quantiles(_displacement(spark, d))


@query(f"""WITH {OBS_SQL}, m AS (SELECT 'R' || lpad(CAST(range AS VARCHAR), 2, '0') AS release_label, CAST(DATE '2023-12-31' + CAST(range AS INTEGER) AS DATE) AS exact_release_date FROM range(31)),
o AS (SELECT release_label, count(DISTINCT local_key) AS n FROM keyed GROUP BY 1), f AS (SELECT local_key, min(release_label) AS release_label FROM keyed GROUP BY 1), w AS (SELECT release_label, count(*) AS n FROM f GROUP BY 1)
SELECT m.release_label, m.exact_release_date, coalesce(o.n, 0) AS unique_release_local_identities_observed, coalesce(w.n, 0) AS \"new_release_local_identities_at_F0\" FROM m LEFT JOIN o USING (release_label) LEFT JOIN w USING (release_label)""")
def release_audit(spark, d):
    b, m = _bridge(spark, d), manifest(spark)
    return CO.release_audit(b, CO.local_first(b, m), m)


def _attributed(spark, d):
    """Displaced keys under a literal assay policy."""
    moved = _displacement(spark, d)
    assay = _bridge(spark, d).groupBy("safe_activity_key").agg(F.min("safe_assay_identity_key").alias("assay_identity_key"))
    audit = spark.createDataFrame(
        [("A1", "TEMPORAL_RENAME", 0), ("A2", "PARTITION_QUARANTINE|TEMPORAL_RENAME", 1), ("A3", "PARTITION_DESCENDANT|PARTITION_QUARANTINE", 0), ("A4", "AMBIGUOUS_TEMPORAL_RENAME", 2), ("A5", "", 3)],
        "canonical_key string, assay_source_policy_types string, n_quarantined_weak_aliases int",
    )
    return AT.attribute_mechanisms(moved.join(assay, "safe_activity_key"), audit)


MECHANISM_SQL = BRIDGE_SQL + """, att AS (SELECT dis.*, a.assay, CASE WHEN assay IN ('A1', 'A2') THEN 'STRICT_TEMPORAL_SOURCE_ASSAY_RENAME' WHEN assay = 'A3' THEN 'PARTITION_NONINJECTIVE_PROTECTION' ELSE 'ORDINARY_DETERMINISTIC_ALIAS_BRIDGING' END AS mechanism,
assay = 'A4' AS amb, assay IN ('A2', 'A4', 'A5') AS weak FROM dis JOIN (SELECT safe_key, min(assay) AS assay FROM bridge GROUP BY 1) a USING (safe_key) WHERE max_delay > 0)"""


@query(MECHANISM_SQL + " SELECT safe_key AS safe_activity_key, mechanism, amb AS ambiguous_temporal_safeguard, weak AS weak_alias_quarantine_safeguard FROM att")
def mechanism_attribution(spark, d):
    return _attributed(spark, d).select("safe_activity_key", "mechanism", "ambiguous_temporal_safeguard", "weak_alias_quarantine_safeguard")


@query(MECHANISM_SQL + " SELECT mechanism, count(*) AS n, quantile_cont(max_delay, 0.5) AS median, avg(max_delay) AS mean, quantile_cont(max_delay, 0.9) AS p90, quantile_cont(max_delay, 0.95) AS p95, CAST(max(max_delay) AS INTEGER) AS max, 100e0 * count(*) / (SELECT count(*) FROM att) AS share_percent FROM att GROUP BY 1")
def mechanism_decomposition(spark, d):
    return AT.mechanism_decomposition(_attributed(spark, d))


@query(MECHANISM_SQL + """, fl AS (SELECT 'ambiguous_temporal_safeguard' AS flag, amb AS s, max_delay FROM att UNION ALL SELECT 'weak_alias_quarantine_safeguard', weak, max_delay FROM att)
SELECT flag, CAST(sum(s::INT) AS BIGINT) AS n, 100e0 * (sum(s::INT)::DOUBLE / (SELECT count(*) FROM att)::DOUBLE) AS share_percent, quantile_cont(max_delay, 0.5) FILTER (s) AS median_delay FROM fl GROUP BY 1""")
def nested_safeguards(spark, d):
    return AT.flag_attribution(_attributed(spark, d), ["ambiguous_temporal_safeguard", "weak_alias_quarantine_safeguard"])


@query(f"""WITH {OBS_SQL}, t AS (SELECT 'primary' AS r, count(DISTINCT activity_key) AS i, count(DISTINCT pair_key) AS p FROM keyed WHERE primary_record_eligible UNION ALL SELECT 'broad', count(DISTINCT activity_key), count(DISTINCT pair_key) FROM keyed UNION ALL SELECT 'relaxed', count(DISTINCT activity_key), count(DISTINCT pair_key) FROM keyed WHERE relaxed_record_eligible), b AS (SELECT i AS bi, p AS bp FROM t WHERE r = 'primary')
SELECT r AS reconstruction, i AS identities, p AS pairs, i - bi AS identities_delta, p - bp AS pairs_delta, 100e0 * ((i - bi)::DOUBLE / bi::DOUBLE) AS identities_delta_percent FROM t, b""")
def sensitivity_summary(spark, d):
    o = observations(spark, d)
    return AU.sensitivity_summary({"primary": o.filter("primary_record_eligible"), "broad": o, "relaxed": o.filter("relaxed_record_eligible")}, "primary")


@query(f"""WITH {ARCHIVE_SQL} SELECT CASE kind WHEN 0 THEN 'STRICT_TEMPORAL_SOURCE_ASSAY_RENAME' WHEN 1 THEN 'PARTITION_NONINJECTIVE_PROTECTION' ELSE 'ORDINARY_DETERMINISTIC_ALIAS_BRIDGING' END AS mechanism,
kind = 3 AND f IN (SELECT f FROM renamed) AS ambiguous_temporal_safeguard, kind = 1 AS weak_alias_quarantine_safeguard, count(*) AS n, CAST(sum(delay) AS BIGINT) AS delay_releases, CAST(max(delay) AS INTEGER) AS greatest_delay FROM late GROUP BY ALL""")
def archive_run(spark, d):
    """From observations to mechanisms: identities, first dates, comparator and attribution in one run."""
    run = AR.run_archive(archive_observations(spark, d), manifest(spark))
    return run.attributed.groupBy("mechanism", "ambiguous_temporal_safeguard", "weak_alias_quarantine_safeguard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("max_delay_releases").alias("delay_releases"), F.max("max_delay_releases").alias("greatest_delay")
    )


@query("SELECT conv_id, turn, role, was FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) WHERE was IS NULL OR was IS DISTINCT FROM role")
def state_compression(spark, d):
    return AU.compress_states(table(spark, d, "conversations"), "conv_id", "turn", "role")


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\.|m\.)?', ''), '[?#].*$', ''), '/+$', '') AS canonical FROM pages")
def url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", X.norm_url(F.col("url")).alias("canonical"))


def _graph(spark, d):
    """Documents as occurrences: the text's hash is a strong alias, the hash of its whole normalised form a weak one. A null text has only its document's local alias."""
    local = F.concat(F.lit("LOCAL_DOC_NULL:"), F.col("doc_id").cast("string"))
    aliases = F.array(F.concat(F.lit("DOI:"), F.sha2("text", 256)), X.sha_key("DOC_TITLE:", X.norm_text(F.col("text"))))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("occurrence_id"), F.when(F.col("text").isNull(), F.array(local)).otherwise(aliases).alias("aliases"))


_GRAPH_SQL = r"""v AS (SELECT doc_id, 'DOI:' || sha256(text) AS s, 'DOC_TITLE:' || sha256(upper(replace(regexp_replace(trim(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), 'ß', 'SS'))) AS w FROM documents WHERE text IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_GRAPH_SQL},
e AS (SELECT DISTINCT s AS x, w AS y FROM v UNION SELECT DISTINCT w, s FROM v),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
lab AS (SELECT x, min(y) AS label FROM reach GROUP BY 1 UNION ALL SELECT DISTINCT 'LOCAL_DOC_NULL:' || doc_id, 'LOCAL_DOC_NULL:' || doc_id FROM documents WHERE text IS NULL),
comp AS (SELECT label, count(*) AS n_aliases, CAST(sum((x LIKE 'DOI:%')::INT) AS INTEGER) AS n_doi, CAST(sum((x LIKE 'DOC_TITLE:%')::INT) AS INTEGER) AS n_weak, string_agg(x, chr(31) ORDER BY x) AS j FROM lab GROUP BY 1)
SELECT 'DOC_CANON:' || sha256(j) AS canonical_key, CAST(n_aliases AS INTEGER) AS n_aliases, n_doi AS n_doi_aliases, n_weak AS n_weak_aliases FROM comp""")
def alias_components(spark, d):
    return CC.components(_graph(spark, d), "document")[1].select("canonical_key", "n_aliases", "n_doi_aliases", "n_weak_aliases")


@query("""WITH RECURSIVE v AS (SELECT 'DOI:' || sha256(text) AS s, 'DOC_PAGE:' || sha256(upper(source) || chr(31) || n_chars) AS w FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL),
e AS (SELECT DISTINCT s AS x, w AS y FROM v UNION SELECT DISTINCT w, s FROM v),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
lab AS (SELECT x, min(y) AS label FROM reach GROUP BY 1), bad AS (SELECT label FROM lab WHERE x LIKE 'DOI:%' GROUP BY 1 HAVING count(*) > 1)
SELECT x AS alias, 1 AS iteration FROM lab JOIN bad USING (label) WHERE x LIKE 'DOC_PAGE:%'""")
def quarantine_weak_bridges(spark, d):
    """Documents of one source and length share a weak alias; where that joins different texts, all weak aliases go."""
    t = table(spark, d, "documents")
    strong = F.when(F.col("text").isNull(), F.concat(F.lit("LOCAL_DOC_NULL:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("DOI:"), F.sha2("text", 256)))
    weak = F.when(F.col("text").isNotNull() & F.col("source").isNotNull() & F.col("n_chars").isNotNull(), X.sha_key("DOC_PAGE:", F.upper("source"), F.col("n_chars").cast("string")))
    occ = t.select(F.col("doc_id").cast("string").alias("occurrence_id"), F.array_compact(F.array(strong, weak)).alias("aliases"), F.concat(F.lit("LOCAL_DOC_QUAR:"), F.col("doc_id").cast("string")).alias("fallback_alias"))
    return CC.protected_components(occ, "document")[2]


@query(f"""WITH {_GRAPH_SQL}, c AS (SELECT lang AS g, 'DOI:' || sha256(text) AS k, false AS loc FROM documents WHERE text IS NOT NULL UNION ALL SELECT lang, 'LOCAL_DOC_NULL:' || doc_id, true FROM documents WHERE text IS NULL),
r AS (SELECT coalesce(lang, 'UNKNOWN') AS g, count(DISTINCT source) AS releases FROM documents GROUP BY 1),
p AS (SELECT coalesce(g, 'UNKNOWN') AS g, count(DISTINCT k) AS n, count(DISTINCT k) FILTER (loc) AS b FROM c GROUP BY 1)
SELECT g AS schema_generation, n AS n_components, b AS n_release_local_only_components, b / CAST(n AS DOUBLE) AS release_local_only_fraction, releases AS n_processed_releases_in_family, releases < 2 OR b / CAST(n AS DOUBLE) <= 0.01 AS policy_pass,
n - b AS n_overmerge_denominator_components, CAST(0 AS BIGINT) AS n_weak_only_internal_multiplicity, 0e0 AS fraction FROM p JOIN r USING (g)""")
def policy_tables(spark, d):
    """Release-local and multiplicity shares of the components of texts; a language is a generation, a source a release."""
    t = table(spark, d, "documents")
    alias = F.when(F.col("text").isNull(), F.concat(F.lit("LOCAL_DOC_NULL:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("DOI:"), F.sha2("text", 256)))
    some = lambda c: F.array_compact(F.array(F.col(c)))
    occ = t.select(F.col("doc_id").cast("string").alias("occurrence_id"), F.array(alias).alias("aliases"), some("lang").alias("schema_generation"), some("source").alias("releases"), F.expr("cast(array() as array<string>)").alias("quarantined_external"))
    mapping, parts = CC.components(occ, "document")
    audit = PO.augment_components(parts, occ, mapping, "document")
    local = PO.release_local_table(audit, "document")
    many = PO.multiplicity_table(audit, "document").select("schema_generation", "n_overmerge_denominator_components", "n_weak_only_internal_multiplicity", "fraction")
    return local.join(many, "schema_generation").select("schema_generation", "n_components", "n_release_local_only_components", "release_local_only_fraction", "n_processed_releases_in_family", "policy_pass", "n_overmerge_denominator_components", "n_weak_only_internal_multiplicity", "fraction")


@query("SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN a.k IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM (SELECT DISTINCT doc_id AS k FROM documents) a FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) b USING (k) WHERE a.k IS NULL OR b.k IS NULL")
def differing_keys(spark, d):
    return CO.differing_keys(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])
