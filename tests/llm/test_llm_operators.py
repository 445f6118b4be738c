"""The corpus operators against brute force, and on odd inputs."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalign.llm import exact_dedup, fm, license_scan, line_dedup, mixing, near_dedup, quality, sentencepiece_codec, text_features, topk, toxicity, url_filter
from tests.llm.conftest import ODD

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# ---- line dedup

def brute_lines(rows, least):
    split = [(t or "").split("\n") for _, t in rows]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    counts = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    return [(len(lines), "\n".join(x for x in lines if counts.get(key(x), 0) < least)) for lines in split]


def test_line_dedup_odd_rows(spark, docs_of):
    df = docs_of(ODD, extra=True)
    got = line_dedup.dedup_lines(df, min_docs=2)
    assert set(df.columns) | {"n_dropped"} == set(got.columns)
    want = brute_lines([(i, t) for i, t, _ in ODD], 2)
    assert sorted((r["n_lines"], r["text"]) for r in got.collect()) == sorted(want)
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_line_index_is_reversible(spark, docs_of):
    a = docs_of([(i, f"shared\nown {i}", "s") for i in range(4)])
    b = docs_of([(10 + i, f"shared\nShared too\nmine {i}", "s") for i in range(4)])
    index = line_dedup.LineIndex(spark, min_docs=5, shards=4)
    index.insert(a)
    before = sorted((bytes(r["key"]), r["n_docs"]) for r in index.counts.collect())
    assert index.apply(a).agg(F.sum("n_dropped")).first()[0] == 0
    index.insert(b)
    assert index.apply(a).agg(F.sum("n_dropped")).first()[0] == 4
    index.delete(b)
    assert sorted((bytes(r["key"]), r["n_docs"]) for r in index.counts.collect()) == before
    assert index.apply(a).agg(F.sum("n_dropped")).first()[0] == 0
    with pytest.raises(ValueError):
        index.delete(b)


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    f = line_dedup.CuckooFilter.of(keys[:4000])
    as_array = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    assert f.contains(as_array[:4000]).all() and f.contains(as_array[4000:]).mean() < 0.01
    for k in keys[:2000]:
        assert f.delete(k)
    again = line_dedup.CuckooFilter.load(f.dump())
    assert again.contains(as_array[2000:4000]).all() and again.contains(as_array[:2000]).mean() < 0.01


# ---- exact dedup

def brute_exact(rows, pick):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep or keep is None, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("max", max), ("min", min)])
def test_exact_dedup(spark, docs_of, keep, pick):
    got = exact_dedup.exact_dedup(docs_of(ODD, extra=True), keep=keep)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact([(i, t) for i, t, _ in ODD], pick)


def test_exact_dedup_splits_equal_digests(spark, docs_of):
    rows = [(1, "ab", "s"), (2, "ac", "s"), (3, "ab", "s"), (4, "b", "s"), (5, "b", "s")]
    got = exact_dedup.exact_dedup(docs_of(rows), keep="max", digest=lambda t: F.substring(t, 1, 1))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact([(i, t) for i, t, _ in rows], max)
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0


def test_filters_let_pass_what_is_there_and_little_else(spark, docs_of):
    index = exact_dedup.ExactDedupIndex(spark, fanout=3)
    digests = lambda a, b: spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    assert index.insert(digests(0, 30_000)).count() == 0
    (run,) = index.runs
    assert run.shards == 2 and run.passing(digests(0, 30_000)).count() == 30_000
    assert run.passing(digests(100_000, 130_000)).count() < 1_500
    # of a second memtable, the hits are the digests that the run holds, and its own repeated ones
    again = digests(29_990, 30_010).unionByName(digests(30_005, 30_006))
    assert index.insert(again).count() == 11
    assert index.insert(digests(50_000, 50_010)).count() == 0  # the tier is full now
    assert [len(t) for t in index.tiers] == [0, 1]
    assert index.probe(digests(29_995, 30_000)).agg(F.sum("n")).first()[0] == 10


@pytest.mark.parametrize("size", [1 << 30, 0])
def test_exact_dedup_of_text_ids_with_and_without_broadcast(spark, docs_of, monkeypatch, size):
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", size)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", size)
    rows = [(f"id{i:03d}", f"text {i % 7}") for i in range(40)] + [("x", None), ("y", "")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string").withColumn("n", F.lit(1)), keep="max")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(rows, max)


def test_index_across_batches(spark, docs_of):
    index = exact_dedup.ExactDedupIndex(spark, fanout=2)
    for batch in ([(5, "a"), (6, "b")], [(3, "a")], [(9, "c"), (1, "b")]):
        index.insert(spark.createDataFrame(batch, "id long, digest string"))
    found = index.probe(spark.createDataFrame([("a",), ("z",)], "digest string")).collect()
    assert [(r["digest"], r["id"], r["n"]) for r in found] == [("a", 3, 2)]
    assert {(r["digest"], r["id"], r["n"]) for r in index.major_compact().collect()} == {("a", 3, 2), ("b", 1, 2), ("c", 9, 1)}


# ---- mixing

def brute_targets(sizes, cycle=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def test_mixing_targets_and_totals(spark, docs_of):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 60)), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d", "e"], 600, p=[0.02, 0.5, 0.4, 0.04, 0.04]).tolist())] + [(1000, "one", None), (1001, None, "a"), (1002, "", "f")]
    df = docs_of(rows, extra=True)
    got = [r.asDict() for r in mixing.mix_sources(df).collect()]
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, target, largest = brute_targets(sizes), Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-9 for s in sizes)  # a source at its cap
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(df).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(docs_of([])).count() == 0


# ---- URLs

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def test_url_rules_and_reputation(spark):
    urls = [
        (1, "https://A.Example.NET/en/x?q"), (2, "http://example.net"), (3, "http://example.net/x"), (4, "https://www.example.com/de/1"), (5, "HTTP://x.org/fr/"), (6, None), (7, "no scheme"), (8, "https://notnet/x"),
        (9, "https://example.com:80/de/"), (10, "https://bad.io/1"), (11, "https://new.bad.io/2"), (12, "http://u@h.co.uk/a#b"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(0) for c in ("host", "path", "n", "bad", "mean")})
    extra = spark.createDataFrame([(100 + i, "https://bad.io/") for i in range(40)] + [(200 + i, "https://fine.io/") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(400)] + [(1, 1), (None, 1), (999, 1)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages.select("page_id", "url").unionByName(extra), labels, RULES).collect()}
    rules = {i: got[i]["rule"] for i in range(1, 13)}
    assert rules == {1: "example.net/en/", 2: None, 3: "net/", 4: "example.com/de/", 5: "org/fr/", 6: None, 7: None, 8: None, 9: None, 10: None, 11: None, 12: None}
    assert (got[1]["host"], got[1]["path"]) == ("a.example.net", "/en/x") and (got[6]["host"], got[7]["path"]) == ("", "") and got[12]["host"] == "u@h.co.uk"
    assert [got[i]["verdict"] for i in (1, 3, 4, 5)] == ["allow", "block", "block", "allow"]
    assert got[10]["verdict"] == "block" and got[200]["verdict"] == "allow" and got[6]["verdict"] == "allow"
    assert url_filter.filter_urls(pages, None, RULES).count() == 12
    assert url_filter.filter_urls(pages.filter("false"), labels, RULES).count() == 0
    table = spark.createDataFrame([(r, v) for v, r in RULES], "rule string, verdict string")
    p = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    assert {r["page_id"]: r["rule"] for r in url_filter.match_rule_table(p, table).collect()} == rules


# ---- near duplicates

def brute_near(rows, width, per_cent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        n = min(width, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    moved |= label[a] != low or label[b] != low
                    label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_against_brute_force(spark, docs_of):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choice(vocabulary, 60))
    for i in range(12):
        base = rng.choice(vocabulary, int(rng.integers(5, 700))).tolist()
        for copy in range(6):
            words = list(base)
            for at in rng.integers(0, len(words), copy * max(1, len(words) // 60)):
                words[at] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(words).upper() if copy == 2 else " ".join(words), "s"))
    rows += [(len(rows) + k, passage + " " + " ".join(rng.choice(vocabulary, 12)), "s") for k in range(30)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "two words", "s"), (903, "Two  words\n", "s")]
    for per_cent, width in ((80, 4), (80, 5)):
        want = brute_near([(i, t) for i, t, _ in rows], width, per_cent)
        got = near_dedup.near_duplicates(docs_of(rows, extra=True), width=width, per_cent=per_cent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(spark, docs_of):
    df = docs_of(ODD, extra=True)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4} and all(r["kept"] for r in got if r["doc_id"] is None)
    kept = near_dedup.keep_representatives(df)
    assert kept.columns == df.columns and kept.filter("doc_id = 5").count() == 0
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


# ---- classifiers

def planted(rng, n):
    """Label 1 wherever 'bad' stands beside 'you': neither word tells alone."""
    rows = []
    for i in range(n):
        words = rng.choice([f"w{k}" for k in range(50)], 20).tolist()
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + ["bad"] * a + ["you"] * b), int(a and b)))
    return rows


def test_factorisation_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    rows = planted(rng, 3000)
    features = text_features.make_extractor((), False)()
    lists = [np.array(sorted(features(t)), np.int32) for _, t, _ in rows]
    y = np.array([x for _, _, x in rows])
    model = fm.fit(lists[:2000], y[:2000], fm.FMConfig(epochs=20))
    guess = [model.score([model.index[i] for i in f.tolist() if i in model.index]) >= 0.5 for f in lists[2000:]]
    assert (np.array(guess) == y[2000:]).mean() > 0.99


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    model = fm.FMModel(0.1, {}, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = [0, 3, 4, 8]
    pairs = sum(float(model.v[a] @ model.v[b]) for k, a in enumerate(rows) for b in rows[k + 1 :])
    assert abs(model.score(rows) - 1 / (1 + np.exp(-(0.1 + model.w[rows].sum() + pairs)))) < 1e-12


def test_classifiers_odd_rows(spark, docs_of):
    df = docs_of(ODD, extra=True)
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, None, 0), (None, 1, 1), (77, 1, 1), (8, 5, 0)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = score(df, labels)
        assert got.count() == len(ODD) and set(got.columns) == set(df.columns)  # score is replaced
        assert all(0 <= r["score"] <= 1 for r in got.collect())
        assert score(docs_of([]), labels).count() == 0
        assert score(df, labels.filter("false")).filter("abs(score - 0.5) > 1e-9").count() == 0
    assert quality.keep_good(df, labels).columns == df.columns


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").is_dir(), reason="no test data here")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    for name, scored, least in (("quality", quality.score_quality(docs, labels), 0.3), ("toxic", toxicity.score_toxicity(docs, labels), 0.5)):
        rows = scored.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).select("score", F.col(name).alias("y")).collect()
        right = np.mean([(r["score"] >= least) == bool(r["y"]) for r in rows])
        assert right > 0.97, (name, right)


# ---- SentencePiece

@pytest.mark.skipif(not Path(MODEL).exists(), reason="no vocabulary here")
def test_codec_equals_the_library():
    import sentencepiece

    codec, lib = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(4)
    letters = list("aabbceetthn   '\n\té日😀.,!$9Aß")
    texts = ["", " ", "a", "Hello world,  foo\n\tbar 日本 x", "word " * 3000, "ab" * 3000] + ["".join(rng.choice(letters, int(rng.integers(1, 200)))) for _ in range(400)]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<i4").tolist()
        assert ids == lib.encode(t), t[:80]
        assert codec.decode(codec.encode(t)) == t


@pytest.mark.skipif(not Path(MODEL).exists(), reason="no vocabulary here")
def test_codec_window_is_bounded_and_portions_do_not_matter():
    v = sentencepiece_codec.Vocabulary.load(MODEL)
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(["the", "ion", "x", "qu", "日"], 6000))
    whole = sentencepiece_codec.StreamingViterbi(v)
    early = list(whole.feed(text))
    assert len(early) > 1000 and whole.commits > 50 and whole.most_held <= 16 * v.longest
    parts = sentencepiece_codec.StreamingViterbi(v)
    got = [p for k in range(0, len(text), 7) for p in parts.feed(text[k : k + 7])] + parts.finish()
    assert got == early + whole.finish() and "".join(got) == text


def test_unigram_search_against_brute_force():
    rng = np.random.default_rng(7)
    pieces = {p: (i, float(-rng.random() * 5 - 1)) for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "▁", "▁a"])}
    v = sentencepiece_codec.Vocabulary(pieces, False, len(pieces), unknown=0)

    def best(text):
        table = [(0.0, [])]
        for e in range(1, len(text) + 1):
            options = []
            for b in range(max(0, e - 3), e):
                p = text[b:e]
                if p in pieces or b == e - 1:
                    options.append((table[b][0] + (pieces[p][1] if p in pieces else v.worst), table[b][1] + [p]))
            table.append(max(options, key=lambda x: x[0]))
        return table[-1]

    for _ in range(200):
        text = "".join(rng.choice(list("abcx▁"), int(rng.integers(1, 120))))
        s = sentencepiece_codec.StreamingViterbi(v)
        got = list(s.feed(text)) + s.finish()
        assert s.most_held <= 8 * v.longest + 1
        total = sum(pieces[p][1] if p in pieces else v.worst for p in got)
        assert "".join(got) == text and abs(total - best(text)[0]) < 1e-9


@pytest.mark.skipif(not Path(MODEL).exists(), reason="no vocabulary here")
def test_codec_on_frames(spark, docs_of):
    df = docs_of(ODD, extra=True)
    got = sentencepiece_codec.encode(df, MODEL, check=True)
    assert got.count() == len(ODD) and got.filter("NOT decoded_ok").count() == 0
    back = sentencepiece_codec.decode(got, MODEL)
    assert back.filter("decoded <> coalesce(text, '')").count() == 0
    assert sentencepiece_codec.encode(docs_of([]), MODEL).count() == 0


# ---- top-k

@pytest.mark.parametrize("trees,block", [(20_000, 8_192), (3, 7)])
def test_top_k_against_brute_force(spark, monkeypatch, trees, block):
    monkeypatch.setattr(topk, "TREES", trees)  # root boxes in several lots
    monkeypatch.setattr(topk, "BLOCK", block)  # queries in several blocks
    monkeypatch.setattr(topk, "DEPTH", 1 if trees == 3 else 6)  # splits in several rounds
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 6))
    base[50:90] = base[50]  # a common vector
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)] + [(400, None, 0), (401, [1.0, None] + [0.0] * 4, 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] + [0.0] * 5, 0), (None, [0.0] * 6, 0), (404, [1.0, 2.0], 0), (405, [], 0), (7, [float(x) for x in base[7]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "id": F.lit(2), "score": F.lit(3)})
    vectors = topk.quantised(df, "vec_id", "embedding")
    x = np.floor(256 * base.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 300, 10):
        scored = sorted(((-int(x[q] @ x[c]), c) for c in range(300) if c != q))[:5]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    got = topk.top_k(vectors, vectors.filter("id % 10 = 0 AND id < 300"), k=5, shard_rows=40)
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect()) == sorted(want)
    few = topk.top_k(vectors.filter("id < 3"), vectors.filter("id = 0"), k=5).collect()
    assert len(few) == 2
    assert topk.top_k(vectors.filter("false"), vectors.filter("id = 0"), k=5).count() == 0


# ---- licences

def test_license_scan(spark, docs_of):
    mit = license_scan.TEXTS["MIT"]
    variant = mit.upper().replace("<YEAR> <COPYRIGHT HOLDERS>", "2020 Somebody").replace("\n", "\n\n  ")
    rows = [(1, mit, "s"), (2, variant, "s"), (3, "Some prose.\nReleased under the MIT Licence", "s"), (4, mit + "\nand more", "s"), (5, "(c) 2020 Me", "s")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs_of(rows, extra=True)).collect()}
    assert [got[i]["license"] for i in range(1, 6)] == ["MIT", "MIT", None, None, None] and got[3]["notices"] == ["MIT"] and got[5]["n_lines"] == 0
    for i, t, _ in rows:
        assert got[i]["digest"] == license_scan.digest_of(t)
    assert license_scan.scan_licenses(docs_of(ODD)).count() == len(ODD) and license_scan.scan_licenses(docs_of([])).count() == 0
