"""What must not depend on row order, names of columns, size switches or what a worker did before."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalign.llm import fm, line_dedup, mixing, near_dedup, quality, queries, sentencepiece_codec, text_features, toxicity
from tests.llm.conftest import ODD
from tests.llm.test_llm_operators import MODEL, brute_lines, brute_near, planted

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
needs_model = pytest.mark.skipif(not Path(MODEL).exists(), reason="no vocabulary here")


# ---- near duplicates

def test_one_id_with_several_texts_is_one_document(spark, docs_of):
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    near = lambda x: " ".join(x[:100] + ["changed"] + x[101:])
    rows = [(1, near(words), "s"), (5, " ".join(words), "s"), (5, " ".join(other), "s"), (9, near(other), "s"), (5, "", "s"), (20, None, "s"), (21, "alone", "s"), (30, "x y", "s"), (30, "z", "s")]
    for exact in (False, True):
        got = near_dedup.near_duplicates(docs_of(rows), exact=exact).collect()
        assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter({(1, 1): 1, (5, 1): 3, (9, 1): 1, (20, 20): 1, (21, 21): 1, (30, 30): 2})
        assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 5) == [0, 196, 196]


def test_lists_of_many_unlike_members_are_tried_to_the_end(spark, docs_of):
    """One passage in many documents that are no copies, and a chain of near copies among them."""
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"u{i}x{j}" for j in range(int(rng.integers(3, 9)))), "s") for i in range(60)]
    rows += [(100 + i, passage + " " + " ".join(["t"] * i), "s") for i in range(8)]
    want = brute_near([(i, t) for i, t, _ in rows], 5, 80)
    for how in ({"k": 8, "k_lists": 4096}, {"exact": True}):
        got = near_dedup.near_duplicates(docs_of(rows), **how).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want, how


@needs_data
def test_sketches_miss_no_link_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda **how: sorted(map(tuple, near_dedup.near_duplicates(docs, width=4, **how).collect()))
    assert rows() == rows(exact=True)


# ---- line dedup

def test_lines_by_key_equal_lines_in_place(spark, docs_of, monkeypatch):
    df = docs_of(ODD + [(50 + i, f"Common\nown {i}\n common ", "s") for i in range(5)], extra=True)
    want = sorted(brute_lines([(i, t) for i, t, _ in [(r["doc_id"], r["text"], 0) for r in df.collect()]], 2))
    for keys, size in ((500_000, 0), (-1, 1 << 20), (-1, 0)):
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", keys)
        monkeypatch.setattr(line_dedup, "FILTER_BYTES", size)
        assert sorted((r["n_lines"], r["text"]) for r in line_dedup.dedup_lines(df, min_docs=2).collect()) == want, (keys, size)


def test_columns_of_any_name_stay(spark, docs_of):
    df = docs_of(ODD, extra=True).withColumns({"score": F.lit("kept"), "n_lines": F.lit("kept"), "n_dropped": F.lit("kept"), "carry": F.lit("kept"), "copies": F.lit("kept")})
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 1)], "doc_id long, quality int")
    for out in (quality.keep_good(df, labels), line_dedup.drop_common_lines(df, 2), near_dedup.keep_representatives(df), mixing.mix_documents(df)):
        assert out.columns == df.columns
        assert out.filter("score <> 'kept' OR n_lines <> 'kept' OR n_dropped <> 'kept' OR carry <> 'kept' OR copies <> 'kept'").count() == 0
        assert out.count() > 0


def test_filters_grow_with_the_keys(spark, docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    index = line_dedup.LineIndex(spark, min_docs=2)
    before = index.shards
    a = docs_of([(i, "\n".join(f"line {k}" for k in range(200)), "s") for i in range(2)])
    index.insert(a)
    assert index.shards > before and index.n_common == 200
    assert index.apply(a).filter("n_dropped = 200").count() == 2
    index.delete(docs_of([(0, "line 3\nline 4", "s")]))
    assert index.n_common == 198 and index.apply(a).filter("n_dropped = 198").count() == 2


# ---- mixing

def test_mix_of_repeated_ids_agrees_and_adds_up(spark, docs_of):
    rng = np.random.default_rng(2)
    rows = [(int(i), "w " * int(rng.integers(1, 30)), "a" if i % 3 else "b") for i in rng.integers(0, 6, 60)]
    seen = set()
    for parts in (1, 3, 7):
        df = docs_of(rows).repartition(parts, F.rand(parts))
        got = mixing.mix_sources(df).collect()
        seen.add(tuple(sorted((r["doc_id"], r["size"], r["taken"]) for r in got)))
        mixed = mixing.mix_documents(df).select(mixing.word_count(F.col("text")).alias("n"), "source").groupBy("source").agg(F.sum("n").alias("n")).collect()
        by_source = Counter()
        for r in got:
            by_source[r["source"]] += r["taken"]
        assert {r["source"]: r["n"] for r in mixed} == dict(by_source)
    assert len(seen) == 1


def test_targets_of_many_sources(spark, docs_of, monkeypatch):
    from tests.llm.test_llm_operators import brute_targets

    rng = np.random.default_rng(12)
    sizes = {f"s{i:03d}": int(x) for i, x in enumerate(rng.integers(0, 50, 60) ** 3 // 1000)} | {None: 7, "": 0, "é": 90, "😀": 1, "￿": 12}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(5)
    want = brute_targets(sizes)
    assert sum(abs(want[s] - 3 * sizes[s]) < 1e-9 for s in sizes) > 10  # many at their caps, in several turns
    for limit in (20_000, 0):  # one sort, and ranges
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(rows).collect()}
        assert {s: n for s, (n, _) in got.items()} == sizes
        assert all(abs(got[s][1] - want[s]) < 1e-6 for s in sizes), limit
        assert mixing.source_targets(rows.filter("false")).count() == 0
        mixed = mixing.mix_sources(docs_of([(i, "w " * (i % 9), f"s{i % 5}") for i in range(50)]))
        assert mixed.count() == 50


def test_quality_weights_are_learnt_and_prefer_good_texts(spark, docs_of):
    clean, dirty = "plain words stand here and say something " * 3, "### *** &&& |||| $$$ %%% !!! word " * 3
    rows = [(i, clean if i % 2 else dirty, "a" if i % 10 else "b") for i in range(400)] + [(900, None, "a"), (901, "", None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(7, 5), (None, 1), (5000, 0)], "doc_id long, quality int")
    df = docs_of(rows)
    weight = mixing.quality_weight(df, labels)
    seen = {r["text"]: r["w"] for r in df.select("text", weight.alias("w")).distinct().collect()}
    assert seen[clean] > 0.95 and seen[dirty] < 0.05 and seen[None] == seen[""] == 0.5
    got = mixing.mix_sources(df, weight=weight, cycle=(1, 20)).filter("source = 'a' AND size > 0")
    shares = {r["good"]: r["share"] for r in got.groupBy((F.col("doc_id") % 2 == 1).alias("good")).agg(F.avg((F.col("copies") > 0).cast("double")).alias("share")).collect()}
    assert shares[True] > shares[False] + 0.2, shares
    none = mixing.quality_weight(df, labels.filter("false"))
    assert df.select(none.alias("w")).filter("w <> 0.5").count() == 0


def test_word_counts(spark):
    texts = ["", " ", "a", " a ", "a b", "a  b", "\ta\x0b\x0c\r\nb \n c", "a\x01b \x02 c", "\xa0 x", "x " * 70_000, None, "日本 語"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n")).orderBy("i").collect()
    import re

    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# ---- classifiers

@needs_data
@pytest.mark.parametrize("label,module,least,recall", [("quality", quality, 0.3, (0.9, 0.99)), ("toxic", toxicity, 0.5, (0.99, 0.7))])
def test_scores_equal_plain_code_and_find_both_labels(spark, label, module, least, recall):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_classifier(docs, labels, label, module.EXTRACTOR, module.CONFIG, "doc_id", "text")
    some = docs.orderBy("doc_id").limit(300)
    features = module.EXTRACTOR()
    for r in fm.score(some, model, module.EXTRACTOR, "text").collect():
        rows = sorted(model.index[i] for i in features(r["text"] or "") if i in model.index)
        z = model.bias + sum(model.w[i] for i in rows) + sum(float(model.v[i] @ model.v[j]) for k, i in enumerate(rows) for j in rows[k + 1 :])
        assert abs(r["score"] - 1 / (1 + np.exp(-min(30, max(-30, z))))) < 1e-6
    scored = fm.score(docs, model, module.EXTRACTOR, "text").join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    rows = scored.select("score", F.col(label).alias("y")).filter("y IN (0, 1)").collect()
    for y in (0, 1):
        mine = [r["score"] >= least for r in rows if r["y"] == y]
        assert len(mine) > 50 and np.mean([x == bool(y) for x in mine]) >= recall[y], (label, y, np.mean(mine))


def test_pairs_tell_what_single_weights_do_not():
    rng = np.random.default_rng(9)
    rows = planted(rng, 3000)
    features = text_features.make_extractor((), False)()
    lists, y = [np.array(sorted(features(t)), np.int32) for _, t, _ in rows], np.array([x for _, _, x in rows])
    # 'bad' alone and 'you' alone are as frequent as the pair: only the pair counts
    loss = {}
    for rank in (0, 8):
        model = fm.fit(lists[:2000], y[:2000], fm.FMConfig(rank=rank, epochs=25))
        p = np.array([model.score([model.index[i] for i in f.tolist() if i in model.index]) for f in lists[2000:]])
        loss[rank] = -np.mean(np.log(np.where(y[2000:] == 1, p, 1 - p) + 1e-9))
    assert loss[8] < 0.5 * loss[0], loss


# ---- SentencePiece

@needs_model
def test_a_worker_keeps_vocabularies_apart():
    v = sentencepiece_codec.Vocabulary({"▁": (4, -1.0), "a": (0, -1.0), "b": (1, -1.0), "ab": (2, -3.0), "▁a": (3, -9.0)}, True, 5, unknown=0)
    u = sentencepiece_codec.Vocabulary(v.pieces, False, 5, unknown=0)
    w = sentencepiece_codec.Vocabulary(v.pieces, False, 5, unknown=0, dummy_prefix=False)
    fresh = [sentencepiece_codec.Codec(x).encode("ab ba") for x in (v, u, w)]
    assert len(set(fresh)) == 3
    assert [sentencepiece_codec.worker_codec(x.plain()).encode("ab ba") for x in (v, u, w)] == fresh
    first = sentencepiece_codec.worker_codec(v.plain())
    assert sentencepiece_codec.worker_codec(v.plain()) is first


@needs_data
@needs_model
def test_query_commits_ids_before_texts_end_and_equals_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op6_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == lib.encode(texts[r["doc_id"]] or "") and r["n_ids"] == len(r["ids"]) and r["decoded_ok"]
    long = [r for r in got if r["n_ids"] > 100]
    assert long and all(r["n_commits"] > r["n_ids"] / 10 for r in long)


@needs_data
@needs_model
def test_steps_are_those_of_a_search_without_memo_whatever_the_portions(spark):
    import re

    v = sentencepiece_codec.Vocabulary.load(MODEL)
    codec = sentencepiece_codec.Codec(v)
    others = [sentencepiece_codec.Codec(v, remember=False), *[sentencepiece_codec.Codec(v, re.compile(p)) for p in ("(?s).", "(?s).{1,7}", "(?s).+")]]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    for t in texts:
        want = codec.encode(t)
        assert all(c.encode(t) == want for c in others)
        whole = sentencepiece_codec.StreamingViterbi(v)
        assert codec._ids(whole.push("▁" + t.replace(" ", "▁")) + whole.close()) == want
    assert others[0].commits == codec.commits > 1000
    assert max(c.most_held for c in [codec, *others]) <= 12 * v.longest


def test_memo_is_bounded_and_forgetting_changes_nothing(monkeypatch):
    pieces = {p: (i, -float(i)) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "a▁", "b▁a"])}
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcx  "), int(rng.integers(1, 90)))) for _ in range(150)]
    for merges in (True, False):
        v = sentencepiece_codec.Vocabulary(pieces, merges, 11, unknown=10)
        plain = [sentencepiece_codec.Codec(v, remember=False).encode(t) for t in texts]
        assert [sentencepiece_codec.Codec(v).encode(t) for t in texts] == plain
        monkeypatch.setattr(sentencepiece_codec, "MEMO", 20)
        small = sentencepiece_codec.Codec(v)
        assert [small.encode(t) for t in texts] == plain and small.known <= 20
        monkeypatch.undo()


def test_pairs_are_told_by_the_order_of_their_merges_as_by_merging_them(monkeypatch):
    rng = random.Random(4)
    for _ in range(25):
        pieces = {c: (i, -9.0) for i, c in enumerate("abc")}
        for _ in range(14):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 6)))
            pieces[word] = (len(pieces), -float(rng.randrange(1, 5)))  # many ties, and pieces that nothing merges into
        at = sentencepiece_codec.Lattice(sentencepiece_codec.Vocabulary(pieces, True, len(pieces)))
        at.single("z")
        merge = sentencepiece_codec.merged
        with monkeypatch.context() as m:
            m.setattr(sentencepiece_codec, "merged", None)  # no pair's text is merged again
            for i, a in enumerate(at.names):
                assert at.fits(sentencepiece_codec.START, i) == (merge(a, pieces) == [a])
                for j, b in enumerate(at.names):
                    assert at.fits(i, j) == (merge(a + b, pieces) == [a, b]), (a, b, pieces)


def test_one_search_serves_all_steps_and_a_full_table_of_pairs_changes_nothing(monkeypatch):
    pieces = {p: (i, -float(i)) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "a▁", "b▁a", "ca"])}
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abcxé  "), int(rng.integers(1, 90)))) for _ in range(120)]
    for merges in (True, False):
        v = sentencepiece_codec.Vocabulary(pieces, merges, 12, unknown=11)
        want = []
        for t in texts:  # one push of the whole text, a lattice of its own
            search, codec = sentencepiece_codec.StreamingViterbi(v), sentencepiece_codec.Codec(v)
            flat = search.push("▁" + t.replace(" ", "▁")) + search.close()
            want.append(codec._joined(b"".join(search.at.ids[i] for i in flat)))
        begun = []
        with monkeypatch.context() as m:
            begin = sentencepiece_codec.StreamingViterbi.__init__
            m.setattr(sentencepiece_codec.StreamingViterbi, "__init__", lambda self, *a, **k: (begun.append(1), begin(self, *a, **k))[1])
            m.setattr(sentencepiece_codec, "PAIRS", 5)
            for remember in (True, False):
                codec = sentencepiece_codec.Codec(v, remember=remember)
                assert [codec.encode(t) for t in texts] == want
                assert len(begun) == 1, "one for the codec, however many steps are searched"
                assert sum(map(len, codec.lattice.pairs.values())) <= 5
                begun.clear()


def test_bytes_of_ids_are_put_together_in_slices_as_one_by_one(monkeypatch):
    pieces = {p: (i + 1, -float(i)) for i, p in enumerate(["▁", "a", "é日", "▁abc", "😀"])}
    v = sentencepiece_codec.Vocabulary(pieces, True, 263, byte_ids=tuple(range(6, 262)), silent=frozenset([262]))
    ids = np.random.default_rng(10).integers(0, 263, 400).astype("<i4")
    codec = sentencepiece_codec.Codec(v)
    for slice_of in (1, 3, 400, 1000):
        monkeypatch.setattr(sentencepiece_codec, "DECODED", slice_of)
        for n in (0, 1, 2, 3, 400):
            raw = b"".join(v.texts[i] for i in ids[:n])
            assert codec.decode(ids[:n].tobytes()) == raw.removeprefix(b" ").decode("utf-8", "replace")
        with pytest.raises(IndexError):
            codec.decode(np.array([1, 263], "<i4").tobytes())
