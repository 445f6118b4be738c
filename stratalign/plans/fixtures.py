"""Small inline cases, whose SQL states the expected rows; tests run them, and no query is registered of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators import attribution as AT
from stratalign.operators import audits as AU
from stratalign.operators import identity as ID
from stratalign.operators import occurrences as OC
from stratalign.operators import policy as PO
from stratalign.operators import quality as Q
from stratalign.operators import structure as ST
from stratalign.sources import releases as RE
from stratalign.sources import snapshots as SN


def normalised_ids(spark: SparkSession, _: str) -> DataFrame:
    rows = [(1, "https://doi.org/10.1/Ab"), (2, "doi: 10.1021/x  y"), (3, "24044434"), (4, " 015177484.0 "), (5, None), (6, "T_POL_12"), (7, "CHEMBL_2"), (8, "22.1"), (9, "-007")]
    t = spark.createDataFrame(rows, "i int, v string")
    return t.select("i", X.norm_text(F.col("v")).alias("norm"), X.norm_doi(F.col("v")).alias("doi"), X.norm_pmid(F.col("v")).alias("pmid"), X.norm_integer_like(F.col("v")).alias("int_like"), X.pol_base(X.norm_text(F.col("v"))).alias("base"), X.norm_release_label(F.col("v")).alias("label"), X.numeric_like(F.col("v")).alias("numeric"))


NORMALISED_SQL = """SELECT CAST(i AS INTEGER) AS i, norm, doi, pmid, int_like, base, label, "numeric" FROM (VALUES
(1, 'HTTPS://DOI.ORG/10.1/AB', '10.1/AB', '', 'HTTPS://DOI.ORG/10.1/AB', 'HTTPS://DOI.ORG/10.1/AB', '', false), (2, 'DOI: 10.1021/X Y', '', '', 'DOI: 10.1021/X Y', 'DOI: 10.1021/X Y', '', false),
(3, '24044434', '', '24044434', '24044434', '24044434', 'CHEMBL24044434', true), (4, '015177484.0', '', '15177484', '015177484', '015177484.0', 'CHEMBL15177484.0', true), (5, '', '', '', '', '', '', false),
(6, 'T_POL_12', '', '', 'T_POL_12', 'T', '', false), (7, 'CHEMBL_2', '', '', 'CHEMBL_2', 'CHEMBL_2', 'CHEMBL02', false), (8, '22.1', '', '', '22.1', '22.1', 'CHEMBL22.1', false), (9, '-007', '', '', '-7', '-007', 'CHEMBL07', true)) t(i, norm, doi, pmid, int_like, base, label, "numeric")"""


def eligibility_tracks(spark: SparkSession, _: str) -> DataFrame:
    """Generations, confidence and relationship types; 'U' is a release without relationship types."""
    rows = [
        (1, "P", "post15", None, 9.0, "B", None, True), (2, "P", "post15", None, 8.0, "B", None, True), (3, "P", "post15", None, 9.0, "F", None, True), (4, "P", "post15", None, 9.0, "B", None, False),
        (5, "L", "pre15_legacy", None, 9.0, "B", "D", True), (6, "L", "pre15_legacy", None, 8.0, "B", "H", True), (7, "L", "pre15_legacy", None, 9.0, "B", "H", True),
        (8, "E", "pre9_early", Q.EARLY, 7.0, "B", "D", True), (9, "E", "pre9_early", Q.EARLY, 7.0, "B", "H", True), (10, "U", "pre9_early", Q.EARLY, 7.0, "B", None, True),
        (11, "M", "pre9_early", Q.MODERN, 9.0, "B", "D", True), (12, "M", "pre9_early", Q.MODERN, 8.0, "B", "H", True),
    ]
    t = spark.createDataFrame(rows, "i int, release_label string, schema_generation string, early_confidence_regime string, confidence_score double, assay_type string, target_relationship_type string, unit_convertible boolean")
    t = t.withColumns({c: F.lit(True) for c in ("quality_eligible", "structure_eligible", "relation_eligible")})
    out = Q.eligibility_tracks(t)
    return out.select(
        "i", F.col("primary_record_eligible").alias("e1"), F.col("confidence8_B_record_eligible").alias("e2"), F.col("historical_high_confidence_B_sensitivity_eligible").alias("e3"), F.col("relaxed_confidence_B_record_eligible").alias("e4"),
        F.col("primary_direct_all_assay_eligible").alias("e5"), F.col("broad_prior_knowledge_eligible").alias("e6"), F.col("legacy_mapping_consistent").alias("e7"), F.col("primary_mapping_certified").alias("e8"), F.col("historical_confidence_equivalence").alias("e9"),
    )


ELIGIBILITY_SQL = """SELECT CAST(i AS INTEGER) AS i, e1, e2, e3, e4, e5, e6, e7, e8, e9 FROM (VALUES
(1, true, true, false, true, true, true, true, true, 'modern_0_9'), (2, false, true, false, true, false, true, true, false, 'modern_0_9'),
(3, false, false, false, false, true, true, true, true, 'modern_0_9'), (4, false, false, false, false, false, false, true, true, 'modern_0_9'),
(5, true, true, false, true, true, true, true, true, 'modern_0_9'), (6, false, true, false, true, false, true, true, false, 'modern_0_9'),
(7, false, true, false, true, false, true, false, false, 'modern_0_9'),
(8, true, false, true, true, true, true, true, true, 'early7+D_required_for_primary'), (9, false, false, true, true, false, true, true, false, 'early7+D_required_for_primary'),
(10, false, false, true, true, false, true, true, false, 'uncertified_no_relationship_type'),
(11, true, true, false, true, true, true, true, true, 'modern_0_9_legacy_location'), (12, false, true, false, true, false, true, true, false, 'modern_0_9_legacy_location')) t(i, e1, e2, e3, e4, e5, e6, e7, e8, e9)"""

DOCS = "release_order int, release_label string, document_doi string, document_pubmed_id string, document_chembl_id string, document_first_page string, document_title string"


def doi_collision(spark: SparkSession, _: str) -> DataFrame:
    rows = [
        (0, "R1", "10.1/A", "111", "D1", "100", "t1"), (0, "R1", "10.1/A", "222", "D2", "200", "t2"), (1, "R2", "10.1/A", "111", "D1", "100", "t1"), (0, "R1", "10.1/B", "333", "D3", "7", "same"), (0, "R1", "10.1/B", "444", "D4", "7", "same"),
        (0, "R1", "10.1/C", "555", "D5", "1", "x"), (0, "R1", "10.1/C", "666", "D5", "2", "y"), (0, "R1", "10.1/E", "777", "D7", "1", "x"), (0, "R1", "10.1/E", "888", "D8", "2", "y"), (0, "R1", "10.1/E", None, None, "3", "z"),
    ]
    return OC.shared_doi_collisions(spark.createDataFrame(rows, DOCS))


def temporal_recuration(spark: SparkSession, _: str) -> DataFrame:
    """Strict recuration, simultaneous, reverting, unreplicated and contradicting histories."""
    plans = {"D1": "aabb", "D2": "a+b", "D3": "abab", "D4": "ab", "D5": "aabb!", "D6": "aabb"}
    rows = []
    for doc, plan in plans.items():
        a, b = doc[1] + "1", doc[1] + "2"
        for i, c in enumerate(plan.replace("+", "").replace("!", "")):
            order = 0 if "+" in plan else i
            rows.append((order, doc, a if c == "a" else b, "one" if "!" not in plan or i < 2 else "two"))
    rows.append((0, "D9", "62", "nine"))  # D6's later id belongs to another document too
    df = spark.createDataFrame(rows, "release_order int, document_chembl_id string, document_pubmed_id string, document_title string")
    comps = spark.createDataFrame([(d, [f"CHEMBL_DOC:{d}", f"PMID:{d[1]}1", f"PMID:{d[1]}2"]) for d in plans] + [("D7", ["PMID:71", "PMID:72"])], "canonical_key string, aliases array<string>")
    return PO.temporal_recuration(comps, PO.recuration_context(df)).select("canonical_key", "is_recuration", "reason")


RECURATION_SQL = """SELECT * FROM (VALUES ('D1', true, ''), ('D2', false, 'EXTERNAL_IDS_SIMULTANEOUS_IN_RELEASE'), ('D3', false, 'NOT_EXACTLY_ONE_ONE_WAY_TRANSITION'), ('D4', false, 'INSUFFICIENT_REPLICATED_TEMPORAL_SUPPORT'),
('D5', false, 'BIBLIOGRAPHIC_CONTRADICTION:document_title=ONE|TWO'), ('D6', false, 'EXTERNAL_ID_USED_BY_OTHER_CHEMBL_DOCUMENT:D9'), ('D7', false, 'NOT_EXACTLY_ONE_CHEMBL_DOCUMENT')) t(canonical_key, is_recuration, reason)"""


def source_policy(spark: SparkSession, _: str) -> DataFrame:
    """Rename, ambiguous rename, partition, and a simultaneous history that gets no policy."""
    seen = [(0, "T", "A1"), (1, "T", "A1"), (2, "T_POL_1", "A1"), (3, "T_POL_1", "A1"), (0, "U", "A2"), (1, "U_POL_1", "A2"), (0, "V", "A3"), (0, "V", "A4"), (1, "V_POL_1", "A3"), (1, "V_POL_2", "A4"), (0, "W", "A5"), (0, "W_POL_1", "A5")]
    df = spark.createDataFrame([(o, "37", s, a) for o, s, a in seen], "release_order int, assay_source_id string, assay_source_assay_id string, assay_chembl_id string")
    comps = [("c1", ["T", "T_POL_1"], ["A1"]), ("c2", ["U", "U_POL_1"], ["A2"]), ("c3", ["V", "V_POL_1", "V_POL_2"], ["A3", "A4"]), ("c4", ["W", "W_POL_1"], ["A5"])]
    c = spark.createDataFrame([(k, [f"SRCASSAY:37:{s}" for s in ss] + [f"CHEMBL_ASSAY:{a}" for a in aa]) for k, ss, aa in comps], "canonical_key string, aliases array<string>")
    return PO.source_policy(c, df)


SOURCE_POLICY_SQL = """SELECT 'SRCASSAY:37:' || s AS raw_alias, action, CASE WHEN action = 'rename' THEN 'SRCASSAY:' || sha256('TEMPORAL_RENAME' || chr(31) || '37' || chr(31) || 'T') ELSE 'SRCASSAY:37:' || s END AS canonical_alias, policy_type, '37:' || left(s, 1) AS family FROM (VALUES
('T', 'rename', 'TEMPORAL_RENAME'), ('T_POL_1', 'rename', 'TEMPORAL_RENAME'), ('U', 'quarantine', 'AMBIGUOUS_TEMPORAL_RENAME'), ('U_POL_1', 'quarantine', 'AMBIGUOUS_TEMPORAL_RENAME'),
('V', 'quarantine', 'PARTITION_QUARANTINE'), ('V_POL_1', 'none', 'PARTITION_DESCENDANT'), ('V_POL_2', 'none', 'PARTITION_DESCENDANT')) t(s, action, policy_type)"""


def _audit(spark: SparkSession) -> DataFrame:
    rows = [
        ("k1", "TEMPORAL_RENAME", "37:T_1", "SRCASSAY:37:T_1=>SRCASSAY:x|SRCASSAY:37:T_1_POL_1=>SRCASSAY:x", ""),
        ("k2", "AMBIGUOUS_TEMPORAL_RENAME|PARTITION_QUARANTINE", "37:A_1|37:P_1", "", "SRCASSAY:37:A_1|SRCASSAY:37:A_1_POL_1|SRCASSAY:37:P_1"), ("k3", "PARTITION_DESCENDANT|PARTITION_QUARANTINE", "37:P_1", "", "SRCASSAY:37:P_1"),
    ]
    return spark.createDataFrame(rows, "canonical_key string, assay_source_policy_types string, assay_source_policy_families string, renamed_external_aliases string, quarantined_external_aliases string")


def family_policies(spark: SparkSession, _: str) -> DataFrame:
    return AT.family_policies(_audit(spark)).select("family_id", "policy", "policy_resolution", "n_canonical_assay_components", "n_reconciled_raw_aliases", "n_quarantined_raw_aliases")


FAMILY_SQL = """SELECT family_id, policy, policy_resolution, CAST(a AS BIGINT) AS n_canonical_assay_components, CAST(b AS BIGINT) AS n_reconciled_raw_aliases, CAST(c AS BIGINT) AS n_quarantined_raw_aliases FROM (VALUES
('37:A_1', 'AMBIGUOUS_TEMPORAL_RENAME', 'single_component_plain_plus_pol_quarantine_evidence', 1, 0, 2), ('37:P_1', 'PARTITION_QUARANTINE', 'multi_component_family_specific_partition_evidence', 2, 0, 1), ('37:T_1', 'TEMPORAL_RENAME', 'family_specific_renamed_alias_audit', 1, 2, 0)) t(family_id, policy, policy_resolution, a, b, c)"""


def policy_summary(spark: SparkSession, _: str) -> DataFrame:
    return AT.policy_summary(AT.family_policies(_audit(spark)))


def document_events(spark: SparkSession, _: str) -> DataFrame:
    rows = [
        (0, "R1", "d1", "12345", None), (1, "R2", "d1", "12345", None), (0, "R1", "d2", "10.1/S", None), (0, "R1", "d3", "10.1/S", None), (1, "R2", "d3", "10.1/S", None),
        (0, "R1", "d4", None, "11"), (1, "R2", "d4", None, "11"), (2, "R3", "d4", None, "22"), (3, "R4", "d4", None, "22"),
    ]
    df = spark.createDataFrame(rows, "release_order int, release_label string, document_identity_key string, document_doi string, document_pubmed_id string")
    return AT.document_events(df)


EVENTS_SQL = """SELECT event_type, document_identity_key, external_id_type, earlier_value, later_value, release_labels, CAST(n AS BIGINT) AS n_release_groups, decision FROM (VALUES
('MALFORMED_NUMERIC_DOI_LIKE', 'd1', 'DOI', '12345', '', 'R1', 1, 'EXCLUDE_FROM_DOI_IDENTITY_EVIDENCE'), ('MALFORMED_NUMERIC_DOI_LIKE', 'd1', 'DOI', '12345', '', 'R2', 1, 'EXCLUDE_FROM_DOI_IDENTITY_EVIDENCE'),
('SHARED_DOI_COLLISION', 'd2|d3', 'DOI', '10.1/S', '', 'R1', 1, 'QUARANTINE_SHARED_DOI_ALIAS'),
('STRICT_TEMPORAL_EXTERNAL_ID_RECURATION', 'd4', 'PMID', '11', '22', 'R1|R2|R3|R4', 4, 'ACCEPT_TEMPORAL_RECURATION')) t(event_type, document_identity_key, external_id_type, earlier_value, later_value, release_labels, n, decision)"""


def release_dates(spark: SparkSession, _: str) -> DataFrame:
    m = spark.createDataFrame([("CHEMBL02", "2"), ("CHEMBL22.1", "22.1"), ("CHEMBL30", "30")], "release_label string, release string")
    official = RE.payload_dates(spark, {"releases": [{"chembl_release": "CHEMBL_2", "creation_date": "2009-11-30T00:00:00"}, {"x": {"chembl_release": "CHEMBL_22.1", "creation_date": "2016-11-15"}}]})
    overrides = spark.createDataFrame([("CHEMBL22.1", "2016-11-18")], "release_label string, exact_release_date string")
    return RE.resolve_dates(m, official, overrides).withColumn("generation", RE.expected_generation()).select("release_label", F.col("exact_release_date").cast("string").alias("day"), "date_source", "date_conflict", "generation")


DATES_SQL = "SELECT * FROM (VALUES ('CHEMBL02', '2009-11-30', 'official', false, 'pre9_early'), ('CHEMBL22.1', '2016-11-18', 'override', true, 'post15'), ('CHEMBL30', NULL, 'unresolved', false, 'post15')) t(release_label, day, date_source, date_conflict, generation)"


def year_resolution(spark: SparkSession, _: str) -> DataFrame:
    rows = [(1, "d1", "2001"), (2, "d1", "20011"), (3, "d2", "1999"), (4, "d3", None), (5, "d4", "3000"), (6, "d4", "2004"), (7, "d4", "2005")]
    df = spark.createDataFrame(rows, "i int, document_identity_key string, document_year string")
    return AU.resolve_years(df, strict=False).select("i", "document_year", "document_year_raw", "document_year_status")


YEARS_SQL = """SELECT CAST(i AS INTEGER) AS i, CAST(y AS INTEGER) AS document_year, r AS document_year_raw, s AS document_year_status FROM (VALUES (1, 2001, '2001', 'AS_RECORDED'), (2, 2001, '20011', 'RESOLVED_FROM_DOCUMENT'), (3, 1999, '1999', 'AS_RECORDED'), (4, NULL, NULL, 'MISSING'),
(5, NULL, '3000', 'UNRESOLVED'), (6, 2004, '2004', 'AS_RECORDED'), (7, 2005, '2005', 'AS_RECORDED')) t(i, y, r, s)"""

def _snapshot(spark: SparkSession, generation: str) -> dict[str, DataFrame]:
    """One activity of one assay in a generation's own tables."""
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "docs": t([(20, 2000, "title", "10.1/A")], "doc_id int, year int, title string, doi string"),
        "activities": t([(1, 1, "IC50", "=", 1000.0, "nM"), (1, 1, "EC50", "=", 1.0, "nM")], f"assay_id int, molregno int, standard_type string, {'standard_relation' if generation == 'post15' else 'relation'} string, standard_value double, standard_units string").withColumns(
            {"data_validity_comment": F.lit(None).cast("string"), "potential_duplicate": F.lit(None).cast("string")}
        ),
    }
    if generation == "post15":
        tables["assays"] = t([(1, 10, 20, 9, "B", "A1")], "assay_id int, tid int, doc_id int, confidence_score int, assay_type string, chembl_id string")
        tables["target_dictionary"] = t([(10, "SINGLE PROTEIN", "Homo sapiens")], "tid int, target_type string, organism string")
        tables["target_components"] = t([(10, 30)], "tid int, component_id int")
        tables["component_sequences"] = t([(30, "P1")], "component_id int, accession string")
    else:
        tables["assays"] = t([(1, 20, "B", "descr")], "assay_id int, doc_id int, assay_type string, description string")
        score = "confidence_score" if generation == "pre15_legacy" else "confidence"
        tables["assay2target"] = t([(1, 10, "H", 8) if generation == "pre15_legacy" else (1, 10, "D", 7)], f"assay_id int, tid int, relationship_type string, {score} int")
        target = t([(10, "PROTEIN", "MK", "Homo sapiens", "P1")], "tid int, target_type string, protein_sequence string, organism string, protein_accession string")
        tables["target_dictionary"] = target if generation == "pre15_legacy" else target.drop("protein_accession", "target_type")
    if generation == "pre9_early":
        tables["compounds"] = t([(1, "block", "name")], "molregno int, molfile string, pref_name string")
    else:
        tables["compound_structures"] = t([(1, "CCO")], "molregno int, canonical_smiles string")
        tables["molecule_dictionary"] = t([(1, "M1", "name")], "molregno int, chembl_id string, pref_name string")
    return tables


def extract_generations(spark: SparkSession, _: str) -> DataFrame:
    """The three extraction plans, structures, units, keys and tracks over one activity each."""
    bridge = AU.build_bridge(spark.createDataFrame([("M K", "Homo sapiens", "P1", "PROTEIN")], "sequence string, organism string, accession string, target_type string"))
    out = None
    for i, generation in enumerate(Q.GENERATIONS):
        rows = SN.extract(_snapshot(spark, generation), f"R{i + 1}", bridge=bridge)
        rows = Q.eligibility_tracks(Q.measured(ST.standardize(rows, backend=ST.identity_backend)))
        rows = rows.withColumn("document_identity_key", OC.extraction_document_key(rows))
        part = rows.select("release_label", "schema_generation", "standard_type", "standard_value_molar", "target_accession", "target_identity_source", "std_input_format", "document_identity_key", "primary_record_eligible", "relaxed_confidence_B_record_eligible")
        out = part if out is None else out.unionByName(part)
    return out


EXTRACT_SQL = """SELECT r AS release_label, g AS schema_generation, 'IC50' AS standard_type, 1000e0 * 1e-9 AS standard_value_molar, 'P1' AS target_accession, s AS target_identity_source, f AS std_input_format, 'DOI:10.1/A' AS document_identity_key, p AS primary_record_eligible, true AS "relaxed_confidence_B_record_eligible"
FROM (VALUES ('R1', 'pre9_early', 'exact_sequence_bridge', 'molblock', true), ('R2', 'pre15_legacy', 'native_accession', 'smiles', false), ('R3', 'post15', 'native_accession', 'smiles', true)) t(r, g, s, f, p)"""


def identity_resolution(spark: SparkSession, _: str) -> DataFrame:
    """Two documents and a renamed source assay over four releases, resolved to identities."""
    rows = []
    for order, (doi, own) in enumerate([("10.1/A", "T"), ("https://doi.org/10.1/a", "T"), ("10.1/A", "T_POL_1"), ("10.1/A", "T_POL_1")]):
        rows.append((order, f"R{order + 1}", len(rows), "post15", doi, "D1", "37", own, "A1"))
        rows.append((order, f"R{order + 1}", len(rows), "post15", "10.1/B", "D2", "37", "Z", "A2"))
    df = spark.createDataFrame(rows, "release_order int, release_label string, row_ordinal long, schema_generation string, document_doi string, document_chembl_id string, assay_source_id string, assay_source_assay_id string, assay_chembl_id string")
    df = df.withColumns({"assay_identity_key": F.lit(None).cast("string")})
    done = ID.resolve_identities(df)
    return done.observations.select("release_label", "row_ordinal", "document_identity_key", "assay_identity_key")


IDENTITY_SQL = """WITH k AS (SELECT i, 'DOC_CANON:' || sha256('CHEMBL_DOC:D1' || chr(31) || 'DOI:10.1/A') AS d1, 'DOC_CANON:' || sha256('CHEMBL_DOC:D2' || chr(31) || 'DOI:10.1/B') AS d2,
'ASSAY_CANON:' || sha256('CHEMBL_ASSAY:A1' || chr(31) || 'SRCASSAY:' || sha256('TEMPORAL_RENAME' || chr(31) || '37' || chr(31) || 'T')) AS a1, 'ASSAY_CANON:' || sha256('CHEMBL_ASSAY:A2' || chr(31) || 'SRCASSAY:37:Z') AS a2 FROM (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT 'R' || (i + 1) AS release_label, CAST(2 * i AS BIGINT) AS row_ordinal, d1 AS document_identity_key, a1 AS assay_identity_key FROM k UNION ALL SELECT 'R' || (i + 1), CAST(2 * i + 1 AS BIGINT), d2, a2 FROM k"""

CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "normalised_ids": (normalised_ids, NORMALISED_SQL),
    "eligibility_tracks": (eligibility_tracks, ELIGIBILITY_SQL),
    "doi_collision": (doi_collision, "SELECT * FROM (VALUES ('R1', '10.1/A')) t(release_label, doi)"),
    "temporal_recuration": (temporal_recuration, RECURATION_SQL),
    "source_policy": (source_policy, SOURCE_POLICY_SQL),
    "family_policies": (family_policies, FAMILY_SQL),
    "policy_summary": (policy_summary, "SELECT CAST(1 AS BIGINT) AS rename_families, CAST(1 AS BIGINT) AS partition_families, CAST(1 AS BIGINT) AS ambiguous_families, CAST(2 AS BIGINT) AS reconciled_aliases, CAST(3 AS BIGINT) AS quarantined_aliases"),
    "document_events": (document_events, EVENTS_SQL),
    "release_dates": (release_dates, DATES_SQL),
    "year_resolution": (year_resolution, YEARS_SQL),
    "extract_generations": (extract_generations, EXTRACT_SQL),
    "identity_resolution": (identity_resolution, IDENTITY_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CASES.items()}
