"""The pipeline against a plain composition of its stages on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalign.llm import mixing, quality
from stratalign.llm.queries import MODEL
from tests.llm.conftest import ODD
from tests.llm.test_llm_operators import brute_lines, brute_near, brute_targets

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not (Path(SF).is_dir() and Path(MODEL).exists()), reason="no test data here")
def test_pipeline_equals_plain_stages(spark):
    import sentencepiece

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.score_quality(docs, labels).filter(F.col("score") >= 0.3).orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in good]
    texts = [t for _, t in brute_lines([(i, t) for i, t, _ in rows], corpus_pipeline.MIN_DOCS)]
    label = brute_near([(r[0], t) for r, t in zip(rows, texts, strict=True)], 5, 80)
    kept = [(i, t, s) for (i, _, s), t in zip(rows, texts, strict=True) if label[i][1] == i]
    frame = spark.createDataFrame(kept, "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(frame, weight=mixing.quality_weight(frame, labels)).collect()}
    sizes, taken = Counter(), Counter()
    for i, t, s in kept:
        sizes[s] += len(t.split())
        taken[s] += copies[i] * len(t.split())
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= max(len(t.split()) for _, t, x in kept if x == s) for s in sizes)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = Counter({(i, s, tuple(lib.encode(t))): copies[i] for i, t, s in kept if copies[i]})
    got = Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected


def stored(spark, tmp_path, rows):
    """Labels by which long clean texts are good and noise is bad."""
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_of_empty_tables(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "sentencepiece"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d = stored(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() == 0, name
        assert out.columns == (["doc_id", "source", "n_ids", "ids"] if name == "sentencepiece" else docs.columns), name


@pytest.mark.skipif(not Path(MODEL).exists(), reason="no vocabulary here")
def test_stages_on_odd_rows(spark, docs_of, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns of the operators' own names."""
    common = "\n".join(f"a line that many share {i}" for i in range(2))
    rows = ODD + [(100 + i, f"{common}\nand one of its own {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "s") for i in range(12)] + [(None, None, None)]
    d = stored(spark, tmp_path, [(4, 1, 0), (100, 1, 0), (101, 1, 0), (102, None, None), (None, 1, 1), (7777, 0, 1)])
    docs = docs_of(rows, extra=True).withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns, name
            assert docs.filter("n_lines <> 'x' OR score <> 'x' OR copies <> 'x' OR label <> 'x'").count() == 0, name
    assert len(seen["quality"]) == len(rows)  # no label tells good from bad: all stay
    texts = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert len(seen["line_dedup"]) == len(rows) and all("many share" not in texts[100 + i] and f"own {i}" in texts[100 + i] for i in range(12)) and texts[1] == ""
    kept = [r["doc_id"] for r in seen["near_dedup"]]
    assert kept.count(4) == 2 and 5 not in kept and kept.count(None) == 2 and {1, 2, 3, 6, 7, 8} <= set(kept) and {100 + i for i in range(12)} <= set(kept)
    mixed = Counter(r["doc_id"] for r in seen["mix"])
    assert not {1, 2, 3} & set(mixed) and max(mixed.values()) <= 6  # two rows of id 4, three times each at most
    assert all(r["n_ids"] == len(r["ids"]) > 0 for r in seen["sentencepiece"]) and len(seen["sentencepiece"]) == len(seen["mix"])
    again = corpus_pipeline.STAGES[3][1](spark, spark.read.parquet(f"{tmp_path}/near_dedup").repartition(7), d)
    assert Counter(map(str, again.collect())) == Counter(map(str, seen["mix"]))
