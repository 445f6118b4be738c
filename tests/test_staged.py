"""Stages that a lost driver doesn't undo."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalign.operators import archive as AR
from stratalign.operators import staged
from stratalign.plans import surrogates
from stratalign.storage import SnapshotError

SF = "/root/testdata/sf0.001"


class Lost(Exception):
    """The driver is gone."""


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_fingerprints_decide_what_is_built(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    calls = []

    def go(rows, factor=2, version="1", die=None):
        run = staged.StagedRun(spark, root, version)
        a = run.source("a", spark.createDataFrame(rows, "x long"))
        other = run.source("other", spark.range(3).toDF("x"))

        def build(name, df):
            calls.append(name)
            if die == name:
                df.write.parquet(f"{root}/{name}/{run.prints[name]}/out")
                raise Lost
            return {"out": df}

        one = run.stage("one", ["a"], lambda: build("one", a.select((F.col("x") * factor).alias("x"))), {"factor": factor})["out"]
        two = run.stage("two", ["other"], lambda: build("two", other))["out"]
        run.stage("both", ["one", "two"], lambda: build("both", one.unionByName(two)))
        return run

    with pytest.raises(Lost):
        go([(1,), (2,)], die="both")
    before = files(f"{tmp_path}/run/one")
    run = go([(2,), (1,)])  # the same rows in another order
    assert (run.reused, run.built) == (["one", "two"], ["both"]) and files(f"{tmp_path}/run/one") == before
    assert sorted(r["x"] for r in run.tables["both"]["out"].collect()) == [0, 1, 2, 2, 4]
    assert go([(1,), (2,)]).built == []
    assert go([(1,), (2,)], factor=3).built == ["one", "both"]
    assert go([(1,), (9,)], factor=3).built == ["one", "both"]
    assert go([(1,), (9,)], factor=3, version="2").built == ["one", "two", "both"]
    assert len(list((tmp_path / "run" / "one").iterdir())) == 1  # tables of older fingerprints are gone
    with pytest.raises(SnapshotError):
        run.stage("late", ["nowhere"], dict)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
def test_an_archive_run_lost_after_each_stage_ends_as_an_undisturbed_one(spark, tmp_path, monkeypatch):
    obs, manifest = surrogates.archive_observations(spark, SF), surrogates.manifest(spark)
    root, real = f"file://{tmp_path}/run", staged.StagedRun.stage
    done: list[str] = []
    seen: dict[str, int] = {}
    for lost_after in ("identities", "first_dates", "bridge", "displacement", None):

        def stage(self, name, after, build, params=None):
            out = real(self, name, after, build, params)
            if name == lost_after:  # noqa: B023
                raise Lost
            return out

        monkeypatch.setattr(staged.StagedRun, "stage", stage)
        if lost_after:
            with pytest.raises(Lost):
                staged.run_archive_staged(spark, root, obs, manifest, "1")
            done.append(lost_after)
            now = files(f"{tmp_path}/run")
            assert all(now[p] == t for p, t in seen.items())  # finished stages are not written again
            seen = now
        else:
            run = staged.run_archive_staged(spark, root, obs, manifest, "1")
            assert run.reused == done and run.built == ["attribution"]
    whole = AR.run_archive(obs, manifest)
    for got, want in ((run.tables["attribution"]["attributed"], whole.attributed), (run.tables["displacement"]["displacement"], whole.displacement), (run.tables["identities"]["families"], whole.families)):
        assert Counter(map(str, got.select(*sorted(got.columns)).collect())) == Counter(map(str, want.select(*sorted(got.columns)).collect()))
