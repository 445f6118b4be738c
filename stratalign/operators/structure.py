"""Structure standardisation with a pluggable backend, different inputs once, and a Parquet cache.

The chemistry (largest organic fragment, normalisation, uncharging, canonical tautomer, keys
and scaffold) belongs to a backend: any function from one text to a result tuple. RDKit is the
default and must be installed; ``identity_backend``, which keeps the text and hashes it, is
only used where a caller asks for it, as its keys are no InChIKeys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.storage import SnapshotError, materialize, materialize_counted

FIELDS = "canonical_isomeric_smiles string, full_inchikey string, murcko_scaffold_smiles string, status string, error string"
Result = tuple[str, str, str, str, str]
Backend = Callable[[str, str], Result]


def identity_backend(text: str, fmt: str) -> Result:
    """No chemistry: trimmed text stands for itself, its hash for the key."""
    s = text.strip()
    return (s, hashlib.sha256(s.encode()).hexdigest()[:27].upper(), s, "ok", "") if s else ("", "", "", "failed", "empty structure")


@lru_cache(maxsize=1)
def _chemistry():
    """RDKit's tools. Canonical tautomers keep stereo centres and double bonds as they are drawn."""
    from rdkit import Chem
    from rdkit.Chem.MolStandardize import rdMolStandardize
    from rdkit.Chem.Scaffolds import MurckoScaffold

    tautomers = rdMolStandardize.TautomerEnumerator()
    for keep in ("SetRemoveSp3Stereo", "SetRemoveBondStereo"):
        if hasattr(tautomers, keep):
            getattr(tautomers, keep)(False)
    return Chem, rdMolStandardize, MurckoScaffold, tautomers


def rdkit_backend(text: str, fmt: str) -> Result:
    """Standard parent, canonical SMILES, InChIKey and Murcko scaffold; failures, a missing key among them, become rows."""
    Chem, S, scaffolds, tautomers = _chemistry()
    try:
        mol = Chem.MolFromSmiles(text) if fmt == "smiles" else Chem.MolFromMolBlock(text)
        if mol is None:
            raise ValueError("not a structure")
        parent = S.LargestFragmentChooser(preferOrganic=True).choose(mol)
        charged = S.Reionizer().reionize(S.Normalizer().normalize(parent))
        mol = tautomers.Canonicalize(S.Uncharger().uncharge(charged))
        Chem.SanitizeMol(mol)
        key = Chem.MolToInchiKey(mol)
        if not key:
            raise ValueError("no InChIKey")
        ring = scaffolds.GetScaffoldForMol(mol)
        return Chem.MolToSmiles(mol), key, Chem.MolToSmiles(ring) if ring.GetNumAtoms() else "", "ok", ""
    except Exception as e:  # a bad structure is a row, not the end of the job
        return "", "", "", "failed", f"{type(e).__name__}: {e}"[:200]


def default_backend() -> Backend:
    try:
        import rdkit  # noqa: F401
    except ImportError as e:
        raise SnapshotError("RDKit is not installed; pass identity_backend to do without chemistry") from e
    return rdkit_backend


def standardize_inputs(inputs: DataFrame, backend: Backend, cache: DataFrame | None = None, version: str = "1") -> DataFrame:
    """(input_sha, fmt, policy_version, input_length, result fields) of different (text, fmt); cached ones are not computed again (C1, IO18)."""
    keyed = inputs.select("text", "fmt").distinct().withColumns({"input_sha": F.sha2(F.concat_ws("\x1f", "fmt", "text"), 256), "input_length": F.length("text"), "policy_version": F.lit(version)})
    missing = keyed
    if cache is not None:
        mine = cache.filter(F.col("policy_version") == version)
        clash = keyed.join(mine.select("input_sha", F.col("input_length").alias("_n")), "input_sha").filter(F.col("_n") != F.col("input_length"))
        if clash.limit(1).count():
            raise SnapshotError("a cached structure has the hash of another text", clash)
        missing = keyed.join(mine.select("input_sha"), "input_sha", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([backend(t, f) for t, f in zip(b["text"], b["fmt"], strict=True)], columns=[x.split()[0] for x in FIELDS.split(", ")])
            yield pd.concat([b[["input_sha", "fmt", "policy_version", "input_length"]].reset_index(drop=True), made], axis=1)

    schema = f"input_sha string, fmt string, policy_version string, input_length int, {FIELDS}"
    fresh = missing.select("input_sha", "fmt", "policy_version", "input_length", "text").mapInPandas(run, schema)
    if cache is None:
        return fresh
    return fresh.unionByName(mine.join(keyed.select("input_sha"), "input_sha", "left_semi").select(*[c.split()[0] for c in schema.split(", ")]))


def refreshed_cache(spark: SparkSession, path: str, inputs: DataFrame, backend: Backend, version: str = "1") -> DataFrame:
    """Results of ``inputs`` (text, fmt); those that the Parquet cache at ``path`` lacked are appended to it (IO18)."""
    found = None
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    known = inputs.select("text", "fmt").distinct()
    if found is None:
        standardize_inputs(known, backend, None, version).write.parquet(path)
    else:
        sha = F.sha2(F.concat_ws("\x1f", "fmt", "text"), 256)
        new = known.join(found.filter(F.col("policy_version") == version).select("input_sha"), sha == F.col("input_sha"), "left_anti")
        fresh = materialize(standardize_inputs(new, backend, None, version), "structures")
        if fresh.limit(1).count():
            fresh.write.mode("append").parquet(path)
    return standardize_inputs(known, backend, spark.read.parquet(path), version)


def standardize(df: DataFrame, smiles: str = "canonical_smiles", molblock: str = "molfile", backend: Backend | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Adds the result fields (std_status, std_error, std_input_format): SMILES first, then molblock, else missing."""
    some = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) if c in df.columns else F.lit(None).cast("string")
    rows = df.withColumns({"_smi": some(smiles), "_mol": some(molblock)})
    both = rows.select(F.col("_smi").alias("text"), F.lit("smiles").alias("fmt")).unionByName(rows.select(F.col("_mol").alias("text"), F.lit("molblock").alias("fmt")))
    per = {f: F.count_if(F.col("fmt") == f) for f in ("smiles", "molblock")}
    known, n = materialize_counted(standardize_inputs(both.filter("text IS NOT NULL"), backend or default_backend(), cache), "structures", **per)
    names = [x.split()[0] for x in FIELDS.split(", ")]
    out, spread = rows, [F.col(f"`{x}`") for x, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    for fmt, c, r in (("smiles", "_smi", "_sr"), ("molblock", "_mol", "_mr")):
        result = known.filter(F.col("fmt") == fmt).select(F.col("input_sha").alias("_k"), F.struct(*names).alias(r))
        if not n[fmt]:
            out = out.withColumn(r, F.lit(None).cast(result.schema[r].dataType))
            continue
        # rows without a text meet nothing, and are spread all the same
        sha = F.when(F.col(c).isNotNull(), F.sha2(F.concat_ws("\x1f", F.lit(fmt), F.col(c)), 256)).otherwise(F.xxhash64(*spread).cast("string"))
        out = out.withColumn("_at", sha).join(result.hint("merge"), F.col("_at") == F.col("_k"), "left").drop("_at", "_k")
    chosen = F.coalesce(F.when(F.col("_sr.status") == "ok", F.col("_sr")), F.col("_mr"), F.col("_sr"))
    fmt = F.when(F.col("_sr.status") == "ok", "smiles").when(F.col("_mr").isNotNull(), "molblock").when(F.col("_sr").isNotNull(), "smiles").otherwise("missing")
    out = out.withColumns({"_r": chosen, "std_input_format": fmt})
    return out.withColumns({
        **{c: F.col(f"_r.{c}") for c in names[:3]}, "std_status": F.coalesce("_r.status", F.lit("missing")), "std_error": F.coalesce("_r.error", F.lit(""))
    }).drop("_smi", "_mol", "_sr", "_mr", "_r")
