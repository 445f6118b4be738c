"""Snapshot databases: ingest, schema binding and extraction plans of three schema generations.

Tables of a release are registered as DataFrames by name; a logical column binds to the first
candidate that its table has, or to a typed null. All dimensions join on integer ids, so
Catalyst broadcasts those that are small and prunes the columns of the rest.
"""

from __future__ import annotations

import gzip
import hashlib
import shutil
import sqlite3
import tarfile
import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators.audits import apply_bridge
from stratalign.operators.quality import EARLY, MODERN
from stratalign.storage import SnapshotError

Tables = Mapping[str, DataFrame]


def ingest_sqlite(spark: SparkSession, database: str, out: str, tables: Sequence[str] | None = None, batch: int = 50_000) -> list[str]:
    """Copy tables of a SQLite file to Parquet, a bounded batch at a time, and return their names (IO5)."""
    con = sqlite3.connect(f"file:{database}?mode=ro", uri=True)
    try:
        names = tables or [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        for name in names:
            kinds = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUME": "double"}
            info = con.execute(f'PRAGMA table_info("{name}")').fetchall()
            schema = ", ".join(f"`{c[1]}` {kinds.get((c[2] or '').upper()[:4], 'bigint' if 'INT' in (c[2] or '').upper() else 'string')}" for c in info)
            wanted = [x.split("` ")[1] for x in schema.split(", ")]
            fix = {"bigint": lambda v: None if v is None else int(v), "double": lambda v: None if v is None else float(v), "string": lambda v: None if v is None else str(v)}
            cursor, mode = con.execute(f'SELECT * FROM "{name}"'), "overwrite"
            while True:
                rows = [tuple(fix[k](v) for k, v in zip(wanted, r, strict=True)) for r in cursor.fetchmany(batch)]
                if not rows and mode == "append":
                    break
                spark.createDataFrame(rows, schema).write.mode(mode).parquet(f"{out}/{name}")
                mode = "append"
        return list(names)
    finally:
        con.close()


def load_tables(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet by its suffix, CSV with a header otherwise (IO8, IO9); give a schema to keep labels text."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True)


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Transactional Parquet sink: Spark's commit protocol renames finished files (IO10)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One CSV or JSON file of a summary (IO11)."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if fmt == "csv" else out.json(path)


MANIFEST = "release_label string, database_hash string, rows_hash string, version string"


def rows_hash(df: DataFrame) -> str:
    """A digest of a table's rows and columns, whatever their order and files."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{one['n']}|{one['s']}".encode()).hexdigest()


def commit_release(spark: SparkSession, path: str, release: str, database_hash: str, version: str, rows: DataFrame) -> bool:
    """Write a release's rows and, last, its marker (IO12).

    False, and nothing is written, if a marker of this version, database and release is there and
    the rows that are stored are still those it was written for.
    """
    at = f"{path}/release_label={release}"
    try:
        marks = spark.read.schema(MANIFEST).parquet(f"{path}_manifest")
        known = {r["rows_hash"] for r in marks.filter((F.col("release_label") == release) & (F.col("database_hash") == database_hash) & (F.col("version") == version)).collect()}
        if known and rows_hash(spark.read.parquet(at)) in known:
            return False
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    write_once(rows, at)
    mark = (release, database_hash, rows_hash(spark.read.parquet(at)), version)
    spark.createDataFrame([mark], MANIFEST).write.mode("append").parquet(f"{path}_manifest")
    return True


def collect_sidecars(parts: Sequence[DataFrame], releases: Sequence[str]) -> DataFrame:
    """Union of per-release tables; a missing release raises (IO13)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    missing = set(releases) - {r[0] for r in out.select("release_label").distinct().collect()}
    if missing:
        raise SnapshotError(f"releases without a sidecar: {sorted(missing)}")
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read by executors (IO14)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def sha256_file(path: str, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def database_candidates(folder: str) -> list[Path]:
    """Files below a folder that look like SQLite databases (IO4)."""
    return sorted(p for p in Path(folder).rglob("*") if p.suffix in (".db", ".sqlite", ".sqlite3"))


def unpack(archive: str, folder: str) -> list[Path]:
    """Unpack a tar, zip or gzip archive, members that would leave the folder refused (IO4)."""
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            root = Path(folder).resolve()
            if any(not (root / n).resolve().is_relative_to(root) for n in z.namelist()):
                raise SnapshotError("a member leaves the folder")
            z.extractall(folder)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")
    elif archive.endswith(".gz"):
        Path(folder).mkdir(parents=True, exist_ok=True)
        with gzip.open(archive, "rb") as packed, open(Path(folder) / Path(archive).name.removesuffix(".gz"), "wb") as out:
            shutil.copyfileobj(packed, out)
    else:
        raise SnapshotError(f"not an archive: {archive}")
    return database_candidates(folder)


def extract_single_database(archive: str, folder: str) -> Path:
    """The only database of an archive; none or several raise (IO3)."""
    found = unpack(archive, folder)
    if len(found) != 1:
        raise SnapshotError(f"{len(found)} databases in {archive}, wanted one")
    return found[0]


# ---------------------------------------------------------------- schema

def require_tables(tables: Tables, *names: str) -> None:
    missing = [n for n in names if n not in tables]
    if missing:
        raise SnapshotError(f"missing tables: {missing}")


def pick(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate column that is there (IO6)."""
    return next((c for c in candidates if c in df.columns), None)


def bound(df: DataFrame, out: str, *candidates: str, kind: str = "string") -> Column:
    """The column under a fixed name, or a typed null."""
    c = pick(df, *candidates)
    return (df[c].cast(kind) if c else F.lit(None).cast(kind)).alias(out)


def generation_of(tables: Tables) -> str:
    """By structure, never by release number."""
    cols = lambda t: set(tables[t].columns) if t in tables else set()
    if {"target_components", "component_sequences"} <= set(tables) and {"tid", "confidence_score"} <= cols("assays"):
        return "post15"
    if "assay2target" in tables and {"molecule_dictionary", "compound_structures"} <= set(tables):
        return "pre15_legacy"
    if {"assay2target", "compounds"} <= set(tables) and "molecule_dictionary" not in tables:
        return "pre9_early"
    raise SnapshotError(f"unknown schema generation: {sorted(tables)}")


def native_target_type(requested: str, generation: str) -> str:
    """The name that a generation gives to single proteins; other requests raise."""
    if requested != "SINGLE PROTEIN":
        raise SnapshotError(f"no historical equivalent of target type {requested!r}")
    return "SINGLE PROTEIN" if generation == "post15" else "PROTEIN"


def confidence_regime(a2t: DataFrame) -> tuple[str, str]:
    """(regime, column) of an early snapshot, by the column alone: scores in their later place, or the 0 to 7 scale."""
    column = pick(a2t, "confidence_score", "confidence")
    if column is None:
        raise SnapshotError("no confidence column")
    return (MODERN if column == "confidence_score" else EARLY), column


@dataclass(frozen=True)
class ExtractConfig:
    endpoints: tuple[str, ...] = ("IC50", "Ki")
    organism: str = "Homo sapiens"
    target_type: str = "SINGLE PROTEIN"
    least_confidence: int = 8


def _documents(tables: Tables) -> DataFrame:
    d = tables["docs"]
    fields = ("year", "title", "doi", "journal", "volume", "issue", "first_page")
    return d.select(d["doc_id"], bound(d, "document_chembl_id", "chembl_id"), bound(d, "document_pubmed_id", "pubmed_id"), *[bound(d, f"document_{f}", f) for f in fields])


def _activities(tables: Tables, cfg: ExtractConfig) -> DataFrame:
    a = tables["activities"]
    kind = pick(a, "standard_type", "activity_type")
    rows = a.filter(a[kind].isin(*cfg.endpoints))
    return rows.select(
        rows["assay_id"], rows["molregno"], bound(rows, "standard_type", "standard_type", "activity_type"), bound(rows, "standard_relation", "standard_relation", "relation"),
        bound(rows, "standard_value", "standard_value", kind="double"), bound(rows, "standard_units", "standard_units"), bound(rows, "data_validity_comment", "data_validity_comment"), bound(rows, "potential_duplicate", "potential_duplicate"),
    )


def _assays(tables: Tables, *extra: str) -> DataFrame:
    s = tables["assays"]
    return s.select(
        s["assay_id"], s["doc_id"], *[s[c] for c in extra], bound(s, "assay_chembl_id", "chembl_id", "assay_chembl_id"), bound(s, "assay_type", "assay_type"), bound(s, "assay_description", "description"),
        bound(s, "assay_source_id", "src_id"), bound(s, "assay_source_assay_id", "src_assay_id", "source_assay_id"), s["assay_id"].cast("string").alias("native_assay_id"), s["doc_id"].cast("string").alias("native_document_id"),
    )


def _merged(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join by shuffle: a file's size tells too little of its rows' to let the planner broadcast a table that grows."""
    return left.join(right.hint("merge"), key, how)


def extract(tables: Tables, release: str, cfg: ExtractConfig = ExtractConfig(), bridge: DataFrame | None = None) -> DataFrame:
    """Observations of one release before quality and keys.

    Targets, links and documents meet the assays first; activities are then shuffled by assay and by compound alone,
    however few targets or documents they share.
    """
    gen = generation_of(tables)
    require_tables(tables, "activities", "assays", "target_dictionary", "docs")
    native, home = native_target_type(cfg.target_type, gen), F.lit(cfg.organism)
    act, t = _activities(tables, cfg), tables["target_dictionary"]
    if gen == "post15":
        assays = _assays(tables, "tid", "confidence_score").filter(F.col("confidence_score") >= cfg.least_confidence)
        target = t.filter((F.upper(t["target_type"]) == native) & (t["organism"] == home)).select("tid", bound(t, "target_chembl_id", "chembl_id"))
        chain = _merged(_merged(target, tables["target_components"].select("tid", "component_id"), "tid"), tables["component_sequences"].select("component_id", F.col("accession").alias("target_accession")), "component_id")
        assays = _merged(assays, chain, "tid").withColumns({"target_relationship_type": F.lit(None).cast("string"), "target_identity_source": F.lit("native_accession"), "early_confidence_regime": F.lit(None).cast("string")})
    else:
        a2t = tables["assay2target"]
        regime, column = confidence_regime(a2t) if gen == "pre9_early" else (None, "confidence_score")
        level = a2t[column].cast("double")
        fit = level == 7 if regime == EARLY else level >= cfg.least_confidence
        links = a2t.filter(fit).select(a2t["assay_id"], a2t["tid"], level.alias("confidence_score"), bound(a2t, "target_relationship_type", "relationship_type"))
        mine = t.filter(t["organism"] == home)
        target = mine.select(
            mine["tid"], mine["organism"], bound(mine, "target_accession", "protein_accession"), bound(mine, "target_sequence", "protein_sequence"),
            bound(mine, "target_chembl_id", "chembl_id"), bound(mine, "target_type", "target_type"),
        )
        has_accession, has_type = pick(mine, "protein_accession") is not None, pick(mine, "target_type") is not None
        if not has_accession and pick(mine, "protein_sequence") is None:
            raise SnapshotError("targets have neither an accession nor a sequence")
        if has_type:
            target = target.filter(F.upper("target_type") == native)
        if gen == "pre9_early" and not (has_accession and has_type):
            if bridge is None or not bridge.limit(1).count():
                missing = [c for c, there in (("protein_accession", has_accession), ("target_type", has_type)) if not there]
                raise SnapshotError(f"targets without {missing} need a bridge of exact sequences")
            target = apply_bridge(target, bridge.hint("merge"), has_accession, has_type).filter(F.upper("target_type") == native)
        else:
            target = target.withColumn("target_identity_source", F.lit("native_accession"))
        target = target.withColumn("early_confidence_regime", F.lit(regime)).drop("target_sequence", "organism", "target_type")
        assays = _merged(_merged(_assays(tables), links, "assay_id"), target, "tid")
    assays = _merged(assays.filter(F.col("target_accession").isNotNull()), _documents(tables), "doc_id", "left")
    if gen == "pre9_early":
        c = tables["compounds"]
        if pick(c, "canonical_smiles", "molfile") is None:
            raise SnapshotError("compounds have neither canonical_smiles nor molfile")
        structure = c.select(c["molregno"], bound(c, "molecule_chembl_id", "chembl_id"), bound(c, "canonical_smiles", "canonical_smiles"), bound(c, "molfile", "molfile"), bound(c, "molecule_pref_name", "pref_name", "name"))
    else:
        s, m = tables["compound_structures"], tables["molecule_dictionary"]
        structure = _merged(s.select(s["molregno"], bound(s, "canonical_smiles", "canonical_smiles"), bound(s, "molfile", "molfile")), m.select(m["molregno"], bound(m, "molecule_chembl_id", "chembl_id"), bound(m, "molecule_pref_name", "pref_name")), "molregno")
    out = _merged(_merged(act, assays, "assay_id"), structure, "molregno")
    return out.withColumns({"release_label": F.lit(release), "schema_generation": F.lit(gen), "confidence_score": F.col("confidence_score").cast("double")})


def reference_targets(tables: Tables) -> DataFrame:
    """(sequence, organism, accession, target_type) of a reference snapshot, for ``build_bridge``."""
    t = tables["target_dictionary"]
    if generation_of(tables) == "post15":
        chain = t.join(tables["target_components"].select("tid", "component_id"), "tid").join(tables["component_sequences"].select("component_id", "accession", "sequence"), "component_id")
        return chain.select("sequence", "organism", "accession", "target_type")
    if pick(t, "protein_accession") is None or pick(t, "protein_sequence") is None:
        raise SnapshotError("a reference needs target accessions and sequences")
    return t.select(bound(t, "sequence", "protein_sequence"), "organism", bound(t, "accession", "protein_accession"), bound(t, "target_type", "target_type"))


def name_index(tables: Tables) -> DataFrame:
    """Different (molecule id, name, kind) of preferred names and synonyms."""
    m = tables["molecule_dictionary"]
    names = m.select("molregno", F.col("chembl_id").alias("molecule_chembl_id"), F.col("pref_name").alias("name"), F.lit("pref_name").alias("kind"))
    if "molecule_synonyms" in tables:
        s = tables["molecule_synonyms"]
        names = names.unionByName(s.join(m.select("molregno", "chembl_id"), "molregno").select("molregno", F.col("chembl_id").alias("molecule_chembl_id"), bound(s, "name", "synonyms", "synonym"), F.lit("synonym").alias("kind")))
    return names.filter("name IS NOT NULL").withColumn("name", X.norm_text(F.col("name"))).dropDuplicates(["molecule_chembl_id", "name"])


def linked_documents(tables: Tables) -> DataFrame:
    """Different metadata of documents that have an assay."""
    return tables["assays"].select("doc_id").distinct().join(_documents(tables), "doc_id").distinct()
