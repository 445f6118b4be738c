"""Queries whose cases are generated from whole tables: every branch of a rule occurs, at the size of the table.

Each generator derives its rows from a table by arithmetic on its columns; the SQL beside it derives the same
rows, and works the rule out again by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators import attribution as AT
from stratalign.operators import audits as AU
from stratalign.operators import components as CC
from stratalign.operators import identity as ID
from stratalign.operators import occurrences as OC
from stratalign.operators import policy as PO
from stratalign.operators import quality as Q
from stratalign.operators import staged
from stratalign.operators import structure as ST
from stratalign.plans.scaled import query
from stratalign.plans.surrogates import ARCHIVE_SQL, archive_observations, manifest
from stratalign.session import table
from stratalign.sources import releases as RE
from stratalign.sources import snapshots as SN
from stratalign.storage import materialize, new_path
from stratalign.streaming.identity import IncrementalIdentity


def pick(index: str, *values, kind: str = "string"):
    """The value at a column's remainder."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.expr(index) % len(values) + 1).cast("int"))


def pick_sql(index: str, *values) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[CAST({index} AS BIGINT) % {len(values)} + 1]"


# ---------------------------------------------------------------- identifiers

_IDS = ("'https://doi.org/10.1/Ab' || c", "'doi: 10.1021/x' || c", "c", "' 0' || c || '.0 '", "NULL", "'T' || c || '_POL_' || (k % 10)", "'CHEMBL_' || (c % 40)", "'-00' || c")


def _by_kind(*values: str) -> str:
    return "CASE k % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS cs, o_custkey AS c FROM orders),
p AS (SELECT *, CASE WHEN c < 10 THEN '0' || cs ELSE cs END AS c2, CASE WHEN c % 40 < 10 THEN '0' || (c % 40) ELSE '' || (c % 40) END AS m2, 'T' || cs || '_POL_' || (k % 10) AS pol FROM o)
SELECT k AS o_orderkey, {_by_kind("'HTTPS://DOI.ORG/10.1/AB' || cs", "'DOI: 10.1021/X' || cs", "cs", "'0' || cs || '.0'", "''", "pol", "'CHEMBL_' || (c % 40)", "'-00' || cs")} AS norm,
{_by_kind("'10.1/AB' || cs", "'10.1021/X' || cs", "''", "''", "''", "''", "''", "''")} AS doi, {_by_kind("''", "''", "cs", "cs", "''", "''", "''", "''")} AS pmid,
{_by_kind("'HTTPS://DOI.ORG/10.1/AB' || cs", "'DOI: 10.1021/X' || cs", "cs", "'0' || cs", "''", "pol", "'CHEMBL_' || (c % 40)", "CASE WHEN c = 0 THEN '0' ELSE '-' || cs END")} AS int_like,
{_by_kind("'HTTPS://DOI.ORG/10.1/AB' || cs", "'DOI: 10.1021/X' || cs", "cs", "'0' || cs || '.0'", "''", "'T' || cs", "'CHEMBL_' || (c % 40)", "'-00' || cs")} AS base,
{_by_kind("''", "''", "'CHEMBL' || c2", "'CHEMBL' || c2 || '.0'", "''", "''", "'CHEMBL' || m2", "'CHEMBL' || c2")} AS label, k % 8 IN (2, 3, 7) AS "numeric" FROM p""")
def normalised_ids(spark, d):
    """Identifiers of orders in eight spellings."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("c"))
    raw = "CASE k % 8 " + " ".join(f"WHEN {i} THEN {x.replace('(c % 40)', 'cast(cast(c as bigint) % 40 as string)')}" for i, x in enumerate(_IDS)) + " END"
    v = o.select(F.col("k").alias("o_orderkey"), F.expr(raw).alias("v"))
    c = F.col("v")
    return v.select("o_orderkey", X.norm_text(c).alias("norm"), X.norm_doi(c).alias("doi"), X.norm_pmid(c).alias("pmid"), X.norm_integer_like(c).alias("int_like"), X.pol_base(X.norm_text(c)).alias("base"), X.norm_release_label(c).alias("label"), X.numeric_like(c).alias("numeric"))


# ---------------------------------------------------------------- eligibility

_RELEASES = ("P", "L", "E", "M", "U")
_KIND = {"P": "post15", "L": "pre15_legacy", "E": "pre9_early", "M": "pre9_early", "U": "pre9_early"}


@query(f"""WITH g AS (SELECT *, {pick_sql("l_orderkey", *_RELEASES)} AS rl, {pick_sql("l_orderkey", *[_KIND[r] for r in _RELEASES])} AS gen,
  CASE WHEN l_orderkey % 5 IN (1, 2, 3) THEN {pick_sql("l_linenumber", "D", "H", "", None)} END AS rel,
  CASE WHEN l_orderkey % 5 IN (2, 4) THEN {pick_sql("l_suppkey", 7, 6, None)} ELSE {pick_sql("l_suppkey", 9, 8, 7, None)} END AS conf, {pick_sql("l_partkey", "B", "F", " b ")} AS typ,
  l_quantity > 3 AND l_tax > 0 AND l_returnflag <> 'R' AND coalesce(CASE WHEN l_discount <> 0.05 THEN l_discount > 0 END, false) AS b FROM lineitem),
x AS (SELECT *, gen = 'pre9_early' AS pre9, gen = 'pre15_legacy' AS leg, rl IN ('E', 'U') AS early, bool_or(coalesce(rel, '') <> '') OVER (PARTITION BY rl) AS there, upper(trim(typ)) = 'B' AS t, coalesce(rel, '') AS r FROM g),
y AS (SELECT *, CASE WHEN pre9 THEN there AND r = 'D' WHEN leg THEN r = 'D' ELSE true END AS direct, CASE WHEN pre9 THEN NOT there OR r IN ('D', 'H') WHEN leg THEN r IN ('D', 'H') ELSE true END AS wide,
  coalesce(CASE WHEN early THEN conf = 7 ELSE conf = 9 END, false) AS top, coalesce(CASE WHEN early THEN conf = 7 ELSE conf >= 8 END, false) AS enough FROM x)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, b AND top AND direct AND t AS e1, b AND enough AND wide AND t AND NOT early AS e2, b AND enough AND wide AND t AND early AS e3, b AND enough AND wide AND t AS e4, b AND top AND direct AS e5, b AND enough AND wide AS e6,
  CASE WHEN early THEN (top AND direct) OR (enough AND wide) WHEN pre9 THEN CASE WHEN conf = 9 THEN direct ELSE enough AND wide END WHEN leg AND conf = 9 THEN r = 'D' WHEN leg AND conf = 8 THEN r = 'H' ELSE true END AS e7, top AND direct AS e8,
  CASE WHEN early THEN CASE WHEN there THEN 'early7+D_required_for_primary' ELSE 'uncertified_no_relationship_type' END WHEN pre9 THEN CASE WHEN there THEN 'modern_0_9_legacy_location' ELSE 'modern_0_9_uncertified_no_relationship_type' END ELSE 'modern_0_9' END AS e9 FROM y""")
def eligibility_tracks(spark, d):
    """Lines as records of five releases of all generations and regimes: every confidence, relationship type and failure."""
    kind = F.col("l_orderkey") % 5
    early = kind.isin(2, 4)
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", pick("l_orderkey", *_RELEASES).alias("release_label"), pick("l_orderkey", *[_KIND[r] for r in _RELEASES]).alias("schema_generation"),
        F.when(early, Q.EARLY).when(kind == 3, Q.MODERN).alias("early_confidence_regime"), F.when(kind.isin(1, 2, 3), pick("l_linenumber", "D", "H", "", None)).alias("target_relationship_type"),
        F.when(early, pick("l_suppkey", 7, 6, None, kind="double")).otherwise(pick("l_suppkey", 9, 8, 7, None, kind="double")).alias("confidence_score"), pick("l_partkey", "B", "F", " b ").alias("assay_type"),
        (F.col("l_quantity") > 3).alias("quality_eligible"), (F.col("l_tax") > 0).alias("structure_eligible"), (F.col("l_returnflag") != "R").alias("relation_eligible"), F.when(F.col("l_discount") != 0.05, F.col("l_discount") > 0).alias("unit_convertible"),
    )
    names = ("primary_record_eligible", "confidence8_B_record_eligible", "historical_high_confidence_B_sensitivity_eligible", "relaxed_confidence_B_record_eligible", "primary_direct_all_assay_eligible", "broad_prior_knowledge_eligible", "legacy_mapping_consistent", "primary_mapping_certified", "historical_confidence_equivalence")
    return Q.eligibility_tracks(t).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", *[F.col(n).alias(f"e{i + 1}") for i, n in enumerate(names)])


# ---------------------------------------------------------------- extraction

def sequence_of(key: str):
    """A sequence for a number: its digits as letters."""
    return F.concat(F.lit("m k"), F.translate(F.col(key).cast("string"), "0123456789", "ACDEFGHIKL"))


def _snapshot(spark, d: str, generation: str) -> dict[str, DataFrame]:
    """Lines as activities, suppliers as assays, nations as targets and parts as compounds, in a generation's own tables."""
    line, supp, nation, part = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "part"))
    post, early = generation == "post15", generation == "pre9_early"
    organism = F.when(F.col("n_nationkey") % 2 == 0, "Homo sapiens").otherwise("Mus musculus")
    single = F.col("n_regionkey") < 3
    out = {
        "activities": line.select(
            F.col("l_suppkey").alias("assay_id"), F.col("l_partkey").alias("molregno"), pick("ascii(l_returnflag)", "IC50", "Ki", "EC50").alias("standard_type" if not early else "activity_type"),
            F.lit("=").alias("standard_relation" if post else "relation"), F.col("l_quantity").alias("standard_value"), pick("l_linenumber", "nM", "ug/mL").alias("standard_units"), F.lit(None).cast("string").alias("data_validity_comment"), F.lit(None).cast("string").alias("potential_duplicate"),
        ),
        "docs": supp.select((F.col("s_suppkey") % 7).alias("doc_id"), F.concat(F.lit("10.1/D"), (F.col("s_suppkey") % 7).cast("string")).alias("doi"), F.lit(2000).alias("year"), F.lit("title").alias("title")).distinct(),
    }
    assay = [F.col("s_suppkey").alias("assay_id"), (F.col("s_suppkey") % 7).alias("doc_id"), pick("s_suppkey", "B", "F", "B").alias("assay_type")]
    if post:
        out["assays"] = supp.select(*assay, F.col("s_nationkey").alias("tid"), pick("s_suppkey", 9, 8, 7, kind="int").alias("confidence_score"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("chembl_id"))
        out["target_dictionary"] = nation.select(F.col("n_nationkey").alias("tid"), F.when(single, "SINGLE PROTEIN").otherwise("ORGANISM").alias("target_type"), organism.alias("organism"))
        out["target_components"] = nation.select(F.col("n_nationkey").alias("tid"), (F.col("n_nationkey") + 100).alias("component_id"))
        out["component_sequences"] = nation.select((F.col("n_nationkey") + 100).alias("component_id"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("accession"))
    else:
        level = pick("s_suppkey", 7, 6, 7, kind="int").alias("confidence") if early else pick("s_suppkey", 9, 8, 7, kind="int").alias("confidence_score")
        out["assays"] = supp.select(*assay, F.lit("text").alias("description"))
        out["assay2target"] = supp.select(F.col("s_suppkey").alias("assay_id"), F.col("s_nationkey").alias("tid"), pick("s_suppkey", "D", "H", "D", "D").alias("relationship_type"), level)
        target = nation.select(F.col("n_nationkey").alias("tid"), F.when(single, "PROTEIN").otherwise("CELL").alias("target_type"), organism.alias("organism"), sequence_of("n_nationkey").alias("protein_sequence"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("protein_accession"))
        out["target_dictionary"] = target.drop("protein_accession", "target_type") if early else target
    if early:
        out["compounds"] = part.select(F.col("p_partkey").alias("molregno"), F.concat(F.lit("block "), "p_name").alias("molfile"), F.col("p_name").alias("pref_name"))
    else:
        out["compound_structures"] = part.select(F.col("p_partkey").alias("molregno"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("canonical_smiles"))
        out["molecule_dictionary"] = part.select(F.col("p_partkey").alias("molregno"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("chembl_id"), F.col("p_name").alias("pref_name"))
    return out


@query(f"""WITH a AS (SELECT l.*, {pick_sql("ascii(l_returnflag)", "IC50", "Ki", "EC50")} AS typ, s_suppkey % 7 AS doc, {pick_sql("s_suppkey", "B", "F", "B")} AS atype, n_nationkey, s_suppkey, n_regionkey < 3 AS single, n_nationkey % 2 = 0 AS home
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
g AS (SELECT a.*, gen, {pick_sql("s_suppkey", "D", "H", "D", "D")} AS rel, CASE gen WHEN 'pre9_early' THEN {pick_sql("s_suppkey", 7, 6, 7)} ELSE {pick_sql("s_suppkey", 9, 8, 7)} END AS conf, l_linenumber % 2 = 0 AND l_quantity > 0 AS ok
  FROM a, (VALUES ('pre9_early'), ('pre15_legacy'), ('post15')) v(gen) WHERE single AND home AND typ IN ('IC50', 'Ki')),
k AS (SELECT * FROM g WHERE CASE WHEN gen = 'pre9_early' THEN conf = 7 ELSE conf >= 8 END)
SELECT CASE gen WHEN 'pre9_early' THEN 'R1' WHEN 'pre15_legacy' THEN 'R2' ELSE 'R3' END AS release_label, gen AS schema_generation, typ AS standard_type, 'P' || n_nationkey AS target_accession,
  CASE gen WHEN 'pre9_early' THEN 'exact_sequence_bridge' ELSE 'native_accession' END AS target_identity_source, CASE gen WHEN 'pre9_early' THEN 'molblock' ELSE 'smiles' END AS std_input_format, 'DOI:10.1/D' || doc AS document_identity_key,
  count(*) AS n, CAST(sum(ok::INT) AS BIGINT) AS n_convertible, CAST(sum((ok AND atype = 'B' AND CASE gen WHEN 'pre9_early' THEN rel = 'D' WHEN 'pre15_legacy' THEN conf = 9 AND rel = 'D' ELSE conf = 9 END)::INT) AS BIGINT) AS n_primary FROM k GROUP BY ALL""")
def extract_generations(spark, d):
    """The three extraction plans over whole tables: schemas, bridge of sequences, structures, units, keys and tracks."""
    nation = table(spark, d, "nation")
    bridge = AU.build_bridge(nation.select(sequence_of("n_nationkey").alias("sequence"), F.lit("Homo sapiens").alias("organism"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("accession"), F.when(F.col("n_regionkey") < 3, "PROTEIN").otherwise("CELL").alias("target_type")))
    out = None
    for i, generation in enumerate(Q.GENERATIONS):
        rows = materialize(SN.extract(_snapshot(spark, d, generation), f"R{i + 1}", bridge=bridge), "extracted")  # read for structures, types and tracks
        rows = Q.eligibility_tracks(Q.measured(ST.standardize(rows, backend=ST.identity_backend)))
        rows = rows.withColumn("document_identity_key", OC.extraction_document_key(rows))
        part = rows.groupBy("release_label", "schema_generation", "standard_type", "target_accession", "target_identity_source", "std_input_format", "document_identity_key").agg(
            F.count(F.lit(1)).alias("n"), F.count("standard_value_molar").alias("n_convertible"), F.sum(F.col("primary_record_eligible").cast("long")).alias("n_primary")
        )
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- documents

def collision_rows(spark, d: str) -> DataFrame:
    """Orders as rows of documents that share a DOI, in eight patterns (o_custkey mod 8) over three releases."""
    g, m, k = F.col("o_custkey"), F.col("o_orderkey") % 3, F.col("o_custkey") % 8
    doc = F.concat(F.lit("D"), g.cast("string"), F.lit("_"), m.cast("string"))
    one = F.concat(F.lit("D"), g.cast("string"))
    number = (g * 10 + m).cast("string")
    return table(spark, d, "orders").select(
        F.concat(F.lit("R"), pick("length(o_orderpriority)", "1", "2", "3")).alias("release_label"), F.concat(F.lit("https://doi.org/10.1/x"), g.cast("string")).alias("document_doi"),
        F.when(k == 1, one).when((k == 2) & (m == 2), None).otherwise(doc).alias("document_chembl_id"), F.when(k == 3, (g * 10).cast("string")).when((k == 2) & (m == 2), None).when(k == 4, (g * 10 + F.col("o_orderkey") % 5).cast("string")).otherwise(number).alias("document_pubmed_id"),
        F.when(k == 5, F.lit("7")).otherwise(m.cast("string")).alias("document_first_page"), F.when(k == 5, F.lit("same")).when(k == 6, F.concat(F.lit("t"), (F.col("o_orderkey") % 7).cast("string"))).otherwise(F.concat(F.lit("t"), m.cast("string"))).alias("document_title"),
    )


@query(f"""WITH r AS (SELECT DISTINCT 'R' || {pick_sql("length(o_orderpriority)", "1", "2", "3")} AS release_label, '10.1/X' || o_custkey AS doi,
  CASE WHEN o_custkey % 8 = 1 THEN 'D' || o_custkey WHEN o_custkey % 8 = 2 AND o_orderkey % 3 = 2 THEN NULL ELSE 'D' || o_custkey || '_' || (o_orderkey % 3) END AS doc,
  CASE WHEN o_custkey % 8 = 3 THEN o_custkey * 10 WHEN o_custkey % 8 = 2 AND o_orderkey % 3 = 2 THEN NULL WHEN o_custkey % 8 = 4 THEN o_custkey * 10 + o_orderkey % 5 ELSE o_custkey * 10 + o_orderkey % 3 END AS pm,
  CASE WHEN o_custkey % 8 = 5 THEN '7' ELSE '' || (o_orderkey % 3) END AS page, CASE WHEN o_custkey % 8 = 5 THEN 'same' WHEN o_custkey % 8 = 6 THEN 't' || (o_orderkey % 7) ELSE 't' || (o_orderkey % 3) END AS title FROM orders),
c AS (SELECT release_label, doi, doc, count(DISTINCT pm) AS pms, count(DISTINCT page) AS pages, count(DISTINCT title) AS titles FROM r WHERE doc IS NOT NULL GROUP BY ALL),
p AS (SELECT release_label, doi, pm, count(DISTINCT doc) AS docs FROM r WHERE pm IS NOT NULL GROUP BY ALL)
SELECT release_label, doi FROM r GROUP BY ALL HAVING count(DISTINCT doc) > 1 AND count(DISTINCT pm) > 1 AND (count(DISTINCT page) > 1 OR count(DISTINCT title) > 1) AND bool_and(doc IS NOT NULL OR pm IS NOT NULL)
INTERSECT SELECT release_label, doi FROM c GROUP BY ALL HAVING bool_and(pms = 1 AND pages <= 1 AND titles <= 1) INTERSECT SELECT release_label, doi FROM p GROUP BY ALL HAVING bool_and(docs = 1)""")
def doi_collision(spark, d):
    """DOIs that stand for several documents, told apart one to one, among patterns that fail each condition."""
    return OC.shared_doi_collisions(collision_rows(spark, d))


def history_rows(spark, d: str) -> DataFrame:
    """Events as the history of documents (user mod 40) over thirty releases, in eight plans (document mod 8)."""
    doc, day = F.col("user_id") % 40, F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    plan = doc % 8
    second = (
        F.when(plan == 1, F.col("event_id") % 2 == 0).when(plan == 2, day.between(10, 19)).when(plan == 3, day == 29).otherwise(day >= 15)
    )
    first_id, second_id = (doc * 10 + 1).cast("string"), F.when(plan == 5, ((doc + 2) * 10 + 1).cast("string")).otherwise((doc * 10 + 2).cast("string"))
    state = F.when(second, second_id).otherwise(first_id)
    title = F.when((plan == 4) & second, "two").otherwise("one")
    by_doi = plan == 6
    return table(spark, d, "events").select(
        day.alias("release_order"), F.concat(F.lit("R"), F.lpad(day.cast("string"), 2, "0")).alias("release_label"), F.concat(F.lit("D"), doc.cast("string")).alias("document_chembl_id"),
        F.when(~by_doi, state).alias("document_pubmed_id"), F.when(by_doi, F.concat(F.lit("10.1/A"), state)).when(plan == 7, F.lit("24044434.0")).alias("document_doi"), title.alias("document_title"), F.concat(F.lit("d"), doc.cast("string")).alias("document_identity_key"),
    )


_HISTORY_SQL = """h AS (SELECT user_id % 40 AS doc, user_id % 8 AS plan, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, event_id FROM (SELECT user_id % 40 AS user_id, ts, event_id FROM events)),
s AS (SELECT *, CASE plan WHEN 1 THEN event_id % 2 = 0 WHEN 2 THEN day BETWEEN 10 AND 19 WHEN 3 THEN day = 29 ELSE day >= 15 END AS snd FROM h),
v AS (SELECT DISTINCT doc, plan, day, CASE WHEN NOT snd THEN doc * 10 + 1 WHEN plan = 5 THEN (doc + 2) * 10 + 1 ELSE doc * 10 + 2 END AS id, CASE WHEN plan = 4 AND snd THEN 'TWO' ELSE 'ONE' END AS title FROM s)"""


@query(f"""WITH {_HISTORY_SQL}, two AS (SELECT doc, any_value(plan) AS plan, min(id) AS a, max(id) AS b, string_agg(DISTINCT title, '|' ORDER BY title) AS titles, count(DISTINCT title) AS nt FROM v GROUP BY doc HAVING count(DISTINCT id) = 2),
per AS (SELECT doc, day, count(DISTINCT id) AS n, min(id) AS id FROM v GROUP BY ALL), lagged AS (SELECT *, lag(id) OVER (PARTITION BY doc ORDER BY day) AS was FROM per),
g AS (SELECT doc, count(*) AS days, max(n) AS together, CAST(sum((was IS NOT NULL AND was <> id)::INT) AS BIGINT) AS changes, count(DISTINCT id) AS seen FROM lagged GROUP BY doc),
l AS (SELECT doc, min(n) AS least FROM (SELECT doc, id, count(*) AS n FROM per GROUP BY ALL) GROUP BY doc),
held AS (SELECT DISTINCT doc, id FROM v WHERE plan <> 6),
e AS (SELECT two.doc, string_agg(DISTINCT 'D' || held.doc, '|' ORDER BY 'D' || held.doc) AS other FROM two JOIN held ON held.id IN (two.a, two.b) AND held.doc <> two.doc AND two.plan <> 6 GROUP BY two.doc),
r AS (SELECT two.doc, CASE WHEN together > 1 THEN 'EXTERNAL_IDS_SIMULTANEOUS_IN_RELEASE' WHEN changes <> 1 THEN 'NOT_EXACTLY_ONE_ONE_WAY_TRANSITION' WHEN seen <> 2 THEN 'TRANSITION_DOES_NOT_COVER_BOTH_EXTERNAL_IDS' WHEN least < 2 THEN 'INSUFFICIENT_REPLICATED_TEMPORAL_SUPPORT'
  WHEN nt > 1 THEN 'BIBLIOGRAPHIC_CONTRADICTION:document_title=' || titles WHEN other IS NOT NULL THEN 'EXTERNAL_ID_USED_BY_OTHER_CHEMBL_DOCUMENT:' || other ELSE '' END AS reason FROM two JOIN g USING (doc) JOIN l USING (doc) LEFT JOIN e USING (doc))
SELECT 'D' || doc AS canonical_key, reason = '' AS is_recuration, reason FROM r""")
def temporal_recuration(spark, d):
    """Histories of documents with two ids of one authority: recurated, together, reverting, unreplicated, contradicting, shared."""
    rows = history_rows(spark, d)
    ids = rows.select("document_chembl_id", F.explode(F.array_compact(F.array(F.concat(F.lit("PMID:"), F.nullif(X.norm_pmid(F.col("document_pubmed_id")), F.lit(""))), F.concat(F.lit("DOI:"), F.nullif(X.norm_doi(F.col("document_doi")), F.lit("")))))).alias("alias"))
    comps = ids.groupBy("document_chembl_id").agg(F.collect_set("alias").alias("ids")).filter(F.size("ids") > 1)
    comps = comps.select(F.col("document_chembl_id").alias("canonical_key"), X.sorted_set(F.concat(F.array(F.concat(F.lit("CHEMBL_DOC:"), "document_chembl_id")), F.col("ids"))).alias("aliases"))
    return PO.temporal_recuration(comps, PO.recuration_context(rows)).select("canonical_key", "is_recuration", "reason")


@query(f"""WITH {_HISTORY_SQL}, lab AS (SELECT *, 'R' || CASE WHEN day < 10 THEN '0' || day ELSE '' || day END AS rel FROM v),
bad AS (SELECT DISTINCT 'MALFORMED_NUMERIC_DOI_LIKE' AS event_type, 'd' || doc AS document_identity_key, 'DOI' AS external_id_type, '24044434.0' AS earlier_value, '' AS later_value, rel AS release_labels, CAST(1 AS BIGINT) AS n_release_groups, 'EXCLUDE_FROM_DOI_IDENTITY_EVIDENCE' AS decision FROM lab WHERE plan = 7),
st AS (SELECT doc, plan, id, count(DISTINCT day) AS n, min(day) AS lo, max(day) AS hi FROM lab GROUP BY ALL),
ab AS (SELECT o.doc, o.plan, o.id AS a, w.id AS b FROM st o JOIN st w ON o.doc = w.doc AND o.hi < w.lo WHERE o.n >= 2 AND w.n >= 2),
strict AS (SELECT 'STRICT_TEMPORAL_EXTERNAL_ID_RECURATION', 'd' || ab.doc, CASE WHEN ab.plan = 6 THEN 'DOI' ELSE 'PMID' END, CASE WHEN ab.plan = 6 THEN '10.1/A' ELSE '' END || a, CASE WHEN ab.plan = 6 THEN '10.1/A' ELSE '' END || b,
  string_agg(DISTINCT rel, '|' ORDER BY rel), count(DISTINCT rel), 'ACCEPT_TEMPORAL_RECURATION' FROM ab JOIN lab ON lab.doc = ab.doc GROUP BY ab.doc, ab.plan, a, b)
SELECT * FROM bad UNION ALL SELECT * FROM strict""")
def document_events(spark, d):
    """Malformed DOIs and strict recurations among the same histories."""
    return AT.document_events(history_rows(spark, d))


@query("""WITH r AS (SELECT o_orderkey, o_custkey AS doc, CASE o_orderkey % 6 WHEN 3 THEN '20011' WHEN 4 THEN NULL WHEN 5 THEN '3000' WHEN 2 THEN '' || (1990 + (o_custkey + CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END) % 20) ELSE '' || (1990 + o_custkey % 20) END AS raw FROM orders),
k AS (SELECT doc, count(DISTINCT raw) AS n, min(CAST(raw AS INTEGER)) AS y FROM r WHERE raw NOT IN ('20011', '3000') GROUP BY doc)
SELECT o_orderkey, CASE WHEN raw NOT IN ('20011', '3000') THEN CAST(raw AS INTEGER) WHEN raw IS NOT NULL AND n = 1 THEN y END AS document_year, raw AS document_year_raw,
CASE WHEN raw IS NULL THEN 'MISSING' WHEN raw NOT IN ('20011', '3000') THEN 'AS_RECORDED' WHEN n = 1 THEN 'RESOLVED_FROM_DOCUMENT' ELSE 'UNRESOLVED' END AS document_year_status FROM r LEFT JOIN k USING (doc)""")
def year_resolution(spark, d):
    """Implausible years of orders give way to their customer's only plausible one."""
    c, kind = F.col("o_custkey"), F.col("o_orderkey") % 6
    year = (1990 + (c + F.when((kind == 2) & (c % 11 == 0), 1).otherwise(0)) % 20).cast("string")
    o = table(spark, d, "orders").select("o_orderkey", c.cast("string").alias("document_identity_key"), F.when(kind == 3, "20011").when(kind == 4, None).when(kind == 5, "3000").otherwise(year).alias("document_year"))
    return AU.resolve_years(o, strict=False).select("o_orderkey", "document_year", "document_year_raw", "document_year_status")


# ---------------------------------------------------------------- releases

@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), x AS (SELECT 2 * k AS n, k % 3 <> 2 AS dated, d FROM o UNION ALL SELECT 2 * k + 1, true, CAST(d + 1 AS DATE) FROM o),
l AS (SELECT n, dated, d, CASE WHEN n < 10 THEN '0' || n ELSE '' || n END AS p FROM x)
SELECT 'CHEMBL' || p AS release_label, CAST(CASE WHEN n % 10 = 7 THEN DATE '2000-01-01' WHEN dated THEN d END AS VARCHAR) AS day, CASE WHEN n % 10 = 7 THEN 'override' WHEN dated THEN 'official' ELSE 'unresolved' END AS date_source,
  n % 10 = 7 AND dated AND d <> DATE '2000-01-01' AS date_conflict, CASE WHEN n < 9 THEN 'pre9_early' WHEN n < 15 THEN 'pre15_legacy' ELSE 'post15' END AS generation FROM l""")
def release_dates(spark, d):
    """Dates found in nested JSON payloads, one per order, and overrides; two releases in each payload."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1), "yyyy-MM-dd").alias("d1"))
    label = lambda n: F.concat(F.lit("CHEMBL_"), n.cast("string"))
    here = F.struct(label(2 * F.col("k")).alias("chembl_release"), F.when(F.col("k") % 3 != 2, F.concat("d", F.lit("T00:00:00"))).alias("creation_date"), F.lit(5).alias("size"))
    deep = F.struct(F.array(F.struct(F.lit("x").alias("name"), F.struct((2 * F.col("k") + 1).alias("release"), F.col("d1").alias("date")).alias("inner"))).alias("more"))
    payloads = o.select(F.to_json(F.struct(F.array(here).alias("releases"), deep.alias("deep"))).alias("payload"))
    n = F.explode(F.array(2 * F.col("k"), 2 * F.col("k") + 1))
    manifest = o.select(n.alias("n")).select(F.concat(F.lit("CHEMBL"), F.when(F.col("n") < 10, F.concat(F.lit("0"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))).alias("release_label"), F.col("n").cast("string").alias("release"))
    overrides = manifest.filter("cast(release as bigint) % 10 = 7").select("release_label", F.lit("2000-01-01").alias("exact_release_date"))
    out = RE.resolve_dates(manifest, RE.dates_in(payloads), overrides).withColumn("generation", RE.expected_generation())
    return out.select("release_label", F.col("exact_release_date").cast("string").alias("day"), "date_source", "date_conflict", "generation")


# ---------------------------------------------------------------- identities

_RESOLVED: dict[tuple[str, str], ID.Resolved] = {}


def _resolved(spark, d: str) -> ID.Resolved:
    """The generated archive resolved once per application: its tables are written, so the queries share them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RESOLVED:
        rows = archive_observations(spark, d).withColumn("release_order", F.substring("release_label", 2, 2).cast("int"))
        _RESOLVED[key] = ID.resolve_identities(rows)
    return _RESOLVED[key]


_FAMILIES_SQL = """e AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS f, user_id % 2 AS half, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS o FROM events),
a AS (SELECT *, CASE f % 5 WHEN 0 THEN CASE WHEN o <= 15 THEN 'T' || f ELSE 'T' || f || '_POL_1' END WHEN 1 THEN CASE WHEN o <= 10 THEN 'T' || f ELSE 'T' || f || '_POL_' || (half + 1) END
  WHEN 2 THEN CASE WHEN o > 12 THEN 'U' || f END WHEN 3 THEN CASE WHEN o < 30 THEN 'T' || f ELSE 'T' || f || '_POL_1' END END AS src FROM e),
several AS (SELECT f FROM a WHERE src IS NOT NULL GROUP BY f HAVING count(DISTINCT src) > 1),
pol AS (SELECT DISTINCT f, src, f % 5 AS kind FROM a JOIN several USING (f) WHERE src IS NOT NULL)"""


@query(f"""WITH {_FAMILIES_SQL} SELECT 'SRCASSAY:37:' || src AS raw_alias, CASE WHEN kind = 0 THEN 'rename' WHEN kind = 3 OR src = 'T' || f THEN 'quarantine' ELSE 'none' END AS action,
CASE WHEN kind = 0 THEN 'SRCASSAY:' || sha256('TEMPORAL_RENAME' || chr(31) || '37' || chr(31) || 'T' || f) ELSE 'SRCASSAY:37:' || src END AS canonical_alias,
CASE WHEN kind = 0 THEN 'TEMPORAL_RENAME' WHEN kind = 3 THEN 'AMBIGUOUS_TEMPORAL_RENAME' WHEN src = 'T' || f THEN 'PARTITION_QUARANTINE' ELSE 'PARTITION_DESCENDANT' END AS policy_type, '37:T' || f AS family FROM pol""")
def source_policy(spark, d):
    """The policies of the source ids of ten families over thirty releases."""
    return _resolved(spark, d).policy


@query(f"""WITH {_FAMILIES_SQL} SELECT '37:T' || f AS family_id, CASE kind WHEN 0 THEN 'TEMPORAL_RENAME' WHEN 1 THEN 'PARTITION_QUARANTINE' ELSE 'AMBIGUOUS_TEMPORAL_RENAME' END AS policy,
CASE kind WHEN 0 THEN 'family_specific_renamed_alias_audit' ELSE 'unambiguous_final_audit_tag' END AS policy_resolution,
CAST(CASE kind WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS n_canonical_assay_components, CAST(CASE kind WHEN 0 THEN 2 ELSE 0 END AS BIGINT) AS n_reconciled_raw_aliases, CAST(CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS n_quarantined_raw_aliases FROM pol GROUP BY f, kind""")
def family_policies(spark, d):
    return AT.family_policies(_resolved(spark, d).assay_audit).select("family_id", "policy", "policy_resolution", "n_canonical_assay_components", "n_reconciled_raw_aliases", "n_quarantined_raw_aliases")


@query(f"""WITH {_FAMILIES_SQL}, k AS (SELECT DISTINCT f, kind FROM pol) SELECT count(*) FILTER (kind = 0) AS rename_families, count(*) FILTER (kind = 1) AS partition_families, count(*) FILTER (kind = 3) AS ambiguous_families,
2 * count(*) FILTER (kind = 0) AS reconciled_aliases, count(*) FILTER (kind = 1) + 2 * count(*) FILTER (kind = 3) AS quarantined_aliases FROM k""")
def policy_summary(spark, d):
    return AT.policy_summary(AT.family_policies(_resolved(spark, d).assay_audit))


@query(f"""WITH {_FAMILIES_SQL}, i AS (SELECT CASE WHEN f % 5 = 1 THEN f || '_' || half ELSE f || '' END AS safe, f, o, src FROM a)
SELECT count(*) AS n_rows, min(o) AS first_release, max(o) AS last_release, count(DISTINCT src) AS n_source_ids, count(DISTINCT f) AS n_documents FROM i GROUP BY safe""")
def identity_resolution(spark, d):
    """Each assay identity of the archive: rows, first and last release, and how many source ids and documents it had."""
    rows = _resolved(spark, d).observations
    return rows.groupBy("assay_identity_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.col("release_order").cast("long")).alias("first_release"), F.max(F.col("release_order").cast("long")).alias("last_release"),
        F.count_distinct("assay_source_assay_id").alias("n_source_ids"), F.count_distinct("document_identity_key").alias("n_documents"),
    ).drop("assay_identity_key")


def page_occurrences(spark, d: str) -> DataFrame:
    """Documents with the hash of their text and, where source and length are known, a weak alias of these."""
    t = table(spark, d, "documents")
    strong = F.when(F.col("text").isNull(), F.concat(F.lit("LOCAL_DOC_NULL:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("DOI:"), F.sha2("text", 256)))
    weak = F.when(F.col("text").isNotNull() & F.col("source").isNotNull() & F.col("n_chars").isNotNull(), X.sha_key("DOC_PAGE:", F.upper("source"), F.col("n_chars").cast("string")))
    return t.select(F.col("doc_id").cast("string").alias("occurrence_id"), F.array_compact(F.array(strong, weak)).alias("aliases"), CC.fallback_alias("document", "lang", "doc_id").alias("fallback_alias"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'LOCAL_DOC_NULL:' || doc_id ELSE 'DOI:' || sha256(text) END AS s,
  CASE WHEN text IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL THEN 'DOC_PAGE:' || sha256(upper(source) || chr(31) || n_chars) END AS w FROM documents),
e AS (SELECT DISTINCT s AS x, w AS y FROM d WHERE w IS NOT NULL UNION SELECT DISTINCT w, s FROM d WHERE w IS NOT NULL),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x), lab AS (SELECT x, min(y) AS label FROM reach GROUP BY 1),
bad AS (SELECT label FROM lab WHERE x LIKE 'DOI:%' GROUP BY 1 HAVING count(*) > 1), kept AS (SELECT label, string_agg(x, chr(31) ORDER BY x) AS j FROM lab WHERE label NOT IN (SELECT label FROM bad) GROUP BY label)
SELECT CAST(doc_id AS VARCHAR) AS occurrence_id, 'DOC_CANON:' || sha256(coalesce(j, s)) AS canonical_key FROM d LEFT JOIN lab ON lab.x = d.s LEFT JOIN kept USING (label)""")
def incremental_identity(spark, d):
    """Identities of documents that come in three batches, out of order: what one resolution of all of them gives."""
    rows, part = page_occurrences(spark, d), F.pmod(F.xxhash64("occurrence_id"), F.lit(3))
    inc = IncrementalIdentity(spark, new_path(spark, "identity-state"), "document")
    for n, k in enumerate((2, 0, 1)):
        inc.update(rows.filter(part == k), n)
    return inc.identities()


@query(f"""WITH {ARCHIVE_SQL}, l AS (SELECT sk, max(delay) AS delay FROM late GROUP BY sk)
SELECT 'R' || lpad(CAST(so AS VARCHAR), 2, '0') AS first_available_release, count(*) AS n_activities, count(l.sk) AS n_delayed, CAST(coalesce(sum(delay), 0) AS BIGINT) AS delay_releases FROM sf LEFT JOIN l USING (sk) GROUP BY so""")
def staged_archive(spark, d):
    """First releases of the archive's activities and their delays, from a run in stages that is begun twice."""
    obs, man, root = archive_observations(spark, d), manifest(spark), new_path(spark, "staged-archive")
    staged.run_archive_staged(spark, root, obs, man, "1")
    run = staged.run_archive_staged(spark, root, obs, man, "1")
    first = run.tables["first_dates"]["audit"].select(F.col("activity_key").alias("safe_activity_key"), "first_available_release")
    late = run.tables["attribution"]["attributed"].select("safe_activity_key", "max_delay_releases")
    return first.join(late, "safe_activity_key", "left").groupBy("first_available_release").agg(
        F.count(F.lit(1)).alias("n_activities"), F.count("max_delay_releases").alias("n_delayed"), F.coalesce(F.sum(F.col("max_delay_releases").cast("long")), F.lit(0)).alias("delay_releases")
    )
