"""Runs in stages that a lost driver doesn't undo (IO12, N1, N2).

A stage is a name, what it is built from, and a function that builds its tables. Its fingerprint is a digest of its
name, its parameters, the version of the code, and the fingerprints of what it reads: sources by
a digest of their rows, stages by their own. Its tables are written below a folder of that fingerprint, and a
marker is put there last, by a rename. A run that finds the marker reads the tables and builds nothing; one
that doesn't builds the stage again from the start, over whatever a lost run has left. A change in a source, a
parameter or the version changes the fingerprints of all that depends on it, and of nothing else.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators import attribution as AT
from stratalign.operators import comparator as CO
from stratalign.operators import firstseen as FS
from stratalign.operators.archive import TRACKS, keyed_observations
from stratalign.operators.identity import IdentityLimits, resolve_identities
from stratalign.sources.snapshots import rows_hash
from stratalign.storage import SnapshotError, assert_none

MARKER = "stage.done"


@dataclass
class StagedRun:
    """Stages below ``root``. ``built`` and ``reused`` name what this run did."""

    spark: SparkSession
    root: str
    version: str
    prints: dict[str, str] = field(default_factory=dict)
    tables: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    built: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def source(self, name: str, df: DataFrame) -> DataFrame:
        """A table that stages read; one pass over its rows."""
        self.prints[name] = hashlib.sha256(f"source|{name}|{rows_hash(df)}".encode()).hexdigest()
        return df

    def stage(self, name: str, after: Sequence[str], build: Callable[[], Mapping[str, DataFrame]], params: Any = None) -> dict[str, DataFrame]:
        """The tables of a stage, read if they are there, built and committed if not."""
        unknown = [a for a in after if a not in self.prints]
        if unknown or name in self.prints:
            raise SnapshotError(f"stage {name}: {'unknown ' + str(unknown) if unknown else 'the name is taken'}")
        told = [name, self.version, json.dumps(params, sort_keys=True, default=str), *[self.prints[a] for a in after]]
        mark = self.prints[name] = hashlib.sha256("\x1f".join(told).encode()).hexdigest()
        fs, folder = self._fs(), self._path(name, mark)
        done = self._path(name, mark, MARKER)
        if fs.exists(done):
            names = json.loads(self.spark.read.text(str(done), wholetext=True).first()[0])
            self.reused.append(name)
        else:
            fs.delete(folder, True)
            names = []
            for table, df in build().items():
                df.write.parquet(str(self._path(name, mark, table)))
                names.append(table)
            half = self._path(name, mark, f"{MARKER}.half")
            out = fs.create(half, True)
            out.write(bytearray(json.dumps(names).encode()))
            out.close()
            if not fs.rename(half, done):
                raise SnapshotError(f"stage {name} could not be committed")
            self.built.append(name)
        for other in fs.listStatus(self._path(name)):  # tables of other fingerprints
            if other.getPath().getName() != mark:
                fs.delete(other.getPath(), True)
        self.tables[name] = {t: self.spark.read.parquet(str(self._path(name, mark, t))) for t in names}
        return self.tables[name]


def run_archive_staged(spark: SparkSession, root: str, observations: DataFrame, manifest: DataFrame, version: str, limits: IdentityLimits = IdentityLimits(), tracks: Mapping[str, str] = TRACKS) -> StagedRun:
    """``archive.run_archive`` in five stages: identities, first dates, bridge, displacement, attribution."""
    run = StagedRun(spark, root, version)
    run.source("observations", observations)
    run.source("manifest", manifest)

    def identities() -> dict[str, DataFrame]:
        order = CO.release_order(manifest)
        rows = observations.drop("release_order").join(F.broadcast(order.select("release_label", "release_order")), "release_label", "left")
        assert_none(rows.filter("release_order IS NULL").select("release_label").distinct(), "releases unknown to the manifest")
        done = resolve_identities(rows, limits)
        families = AT.family_policies(done.assay_audit)
        assert_none(AT.lost_aliases(done.assay_audit, families), "aliases that no family accounts for")
        return {"keyed": keyed_observations(done.observations), "document_audit": done.document_audit, "assay_audit": done.assay_audit, "families": families, "events": AT.document_events(done.observations)}

    found = run.stage("identities", ["observations", "manifest"], identities, limits)

    def first_dates() -> dict[str, DataFrame]:
        out = {}
        for name, column in tracks.items():
            first, audit = FS.first_seen(found["keyed"], manifest, column)
            out[f"first_{name}"] = first
            if name == "primary":
                out["audit"] = audit
        return out

    firsts = run.stage("first_dates", ["identities", "manifest"], first_dates, dict(tracks))
    for name in tracks:
        if name != "primary":
            assert_none(FS.not_nested(firsts["first_primary"], firsts[f"first_{name}"]), f"primary activities that {name} lacks")

    bridge = run.stage("bridge", ["identities", "manifest"], lambda: {"bridge": CO.build_bridge(found["keyed"].filter(X.truthy(F.col(tracks["primary"]))))}, tracks["primary"])["bridge"]
    keys = firsts["first_primary"].select(F.col("activity_key").alias("safe_activity_key"))
    assert_none(CO.differing_keys(keys, bridge, ["safe_activity_key"]), "keys of the first dates or the bridge alone")

    def displacement() -> dict[str, DataFrame]:
        local = CO.local_first(bridge, manifest)
        return {"local_first": local, "displacement": CO.displacement(bridge, CO.safe_first(bridge, manifest), local), "overmerge": CO.overmerge(bridge)}

    moved = run.stage("displacement", ["bridge", "manifest"], displacement)["displacement"]
    assays = firsts["first_primary"].select(F.col("activity_key").alias("safe_activity_key"), "assay_identity_key")
    run.stage("attribution", ["displacement", "first_dates", "identities"], lambda: {"attributed": AT.attribute_mechanisms(moved.join(assays, "safe_activity_key"), found["assay_audit"])})
    return run
