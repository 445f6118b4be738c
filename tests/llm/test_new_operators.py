"""Sharding, fill-in-the-middle and the prefix trie against plain code, and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalign.llm import fim, prefix_trie, sharding
from tests.llm.conftest import ODD

# ---- sharding


def plain_shard(key, weights):
    word = "null" if key is None else str(key)
    unit = lambda s: (int(hashlib.md5(f"shard|{word}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    return min((-math.log(unit(s)) / w, s) for s, w in enumerate(weights) if w > 0)[1]


def test_shards_of_odd_rows(spark, docs_of):
    df = docs_of(ODD * 3, extra=True)
    rows = sharding.place(df, [1.0] * 5, grown=1.0).collect()
    assert len(rows) == 3 * len(ODD)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), plain_shard(i, [1] * 5), plain_shard(i, [1] * 6)) for i, t, _ in ODD * 3)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert all(r["grown_shard"] in (r["shard"], 5) for r in rows)
    assert sharding.place(docs_of([]), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("x"), [0.0, 0.0])


def test_slots_over_many_cells_and_repeated_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    monkeypatch.setattr(sharding, "CHUNK", 10)
    df = docs_of([(1, "same", "s")] * 45 + [(None, f"text {i % 9}", "s") for i in range(60)] + [(i, "copy", "s") for i in range(100, 160)])
    rows = sharding.place(df, [1.0, 2.0, 0.0, 1.0]).collect()
    again = sharding.place(df.repartition(3), [1.0, 2.0, 0.0, 1.0]).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == 165
    for s in (0, 1, 3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["shard"] for r in rows} <= {0, 1, 3} and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1


def test_weights_and_moves(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 3.0, 2.0]
    counts = {r["shard"]: r["count"] for r in sharding.assign_shards(keys, weights).groupBy("shard").count().collect()}
    assert all(abs(counts[s] - 4000 * w / 6) < 200 for s, w in enumerate(weights))
    grown = sharding.moved(keys, weights, [*weights, 1.0]).collect()
    assert {r["is"] for r in grown} == {3} and abs(sum(r["n"] for r in grown) - 4000 / 7) < 150
    shrunk = sharding.moved(keys, weights, [1.0, 0.0, 2.0]).collect()
    assert {r["was"] for r in shrunk} == {1}
    heavier = sharding.moved(keys, weights, [1.0, 4.0, 2.0]).collect()
    assert {r["is"] for r in heavier} == {1}


def test_written_shards_hold_every_row_once(spark, docs_of, tmp_path):
    df = docs_of(ODD + [(i, f"text {i}", "s") for i in range(50, 90)], extra=True)
    sharding.write_shards(df, str(tmp_path / "out"), [1.0, 1.0, 1.0], mean_bytes=40_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard"}
    assert Counter(map(tuple, back.select(*df.columns).collect())) == Counter(map(tuple, df.collect()))
    assert all(r["shard"] == plain_shard(r["doc_id"], [1] * 3) for r in back.select("doc_id", "shard").collect())
    with pytest.raises(ValueError):
        sharding.write_shards(back, str(tmp_path / "again"), [1.0])


# ---- fill-in-the-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(i, text, rate=50, share=80):
    t = text or ""
    units = UNIT.findall(t)
    n, digest = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    if h[3] % 100 < share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \t\n\x0b\r\x1c é🙂<PSM>")), max_size=60))
def test_unit_ends(text):
    ends, marked = fim.unit_ends(text)
    want = np.cumsum([len(u) for u in UNIT.findall(text)]).astype(int).tolist()
    assert ends.tolist() == want and marked == any(x in text for x in fim.SENTINELS)


@pytest.mark.parametrize(("rate", "share"), [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_cut_texts(spark, docs_of, rate, share):
    texts = ["", None, " ", "one", " two  words\n", "a <P> b", "x <M", "<<S>", "é🙂 ñ w <P x", "\x1c a\x0bb", "w " * 70_000, "no blanks" * 9]
    rows = ODD + [(100 + 10 * k + j, t, "s") for k, t in enumerate(texts) for j in range(4)]
    df = docs_of(rows, extra=True).withColumns({"draw0": F.lit(1), "whole": F.lit("y"), "a.b": F.lit(2)})
    out = fim.transform(df, rate=rate, spm_share=share)
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert {"draw0", "whole", "a.b", "key", *fim.MADE} <= set(out.columns)
    want = Counter((i, *plain_fim(i, t, rate, share), t or "") for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == want
    assert fim.transform(docs_of([])).count() == 0


def test_sentinels_that_could_be_confused():
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("", "a", "b"), ("< P", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim._checked(bad)


# ---- prefix trie


def plain_trie(rows, graft):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    whole = dict(turns)
    if graft:
        for c, own in turns.items():
            h = zlib.crc32(str(c).encode()) % 4
            base = c - int(math.fmod(c, 20))
            whole[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    size = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * size(p)
            leaves[p[:d]] += p not in kids
    ends = lambda p, cs: hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p)).encode()).hexdigest()
    return Counter((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], ends(p, cs)) for p, cs in members.items())


def grown_rows(seed, n=60, graft_ids=True):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        depth = int(rng.integers(0, 7))
        for d in range(depth):
            few = 2 if d < 3 else 5
            rows.append((c if graft_ids else c * 7 - 100, d, ["user", "assistant", None][d % 3], f"turn {rng.integers(0, few)} of {d} " + "w " * int(rng.integers(0, 2))))
    deep = [(900 + k, d, "user", f"deep {d}" if k < 3 else f"deep {d} {d > 20}") for k in range(4) for d in range(60)]
    odd = [(None, 0, "user", "nobody"), (5, None, "user", "null turn"), (6, 3, None, None), (6, 3, None, None), (-25, 0, "user", "below"), (-20, 1, "user", "base below"), (40, 0, "", "  ")]
    return rows + deep + odd


@pytest.mark.parametrize("graft", [False, True])
def test_trie_equals_plain_code(spark, graft, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = grown_rows(3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "depth": F.lit(2)})
    turns = prefix_trie.turns_of(df)
    got = prefix_trie.trie(prefix_trie.grafted(turns) if graft else prefix_trie.plain_plan(turns))
    assert Counter(map(tuple, got.collect())) == plain_trie(rows, graft)


def test_fingerprints_that_collide_are_split(spark):
    """Primes so small that most groups of candidates hold several prefixes."""
    rows = grown_rows(5, 40, graft_ids=False)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(prefix_trie.plain_plan(prefix_trie.turns_of(df)), primes=(7, 5))
    assert Counter(map(tuple, got.collect())) == plain_trie(rows, False)


def test_scan_carries_over_batches():
    rng = np.random.default_rng(1)
    conv = np.sort(rng.integers(0, 9, 300))
    own, skip = rng.integers(0, 2, 300), np.full(300, 2)
    order = np.lexsort((own, conv))
    conv, own, hashes = conv[order], own[order], rng.integers(-(1 << 62), 1 << 62, 300)
    whole = prefix_trie.PrefixScan().feed(conv, own, skip, hashes)
    scan = prefix_trie.PrefixScan()
    parts = [scan.feed(*(x[i : i + 17] for x in (conv, own, skip, hashes))) for i in range(0, 300, 17)]
    for k in range(5):
        assert np.array_equal(whole[k], np.concatenate([p[k] for p in parts]))


def test_trie_of_nothing_and_of_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(prefix_trie.plain_plan(prefix_trie.turns_of(spark.createDataFrame([], schema)))).count() == 0
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = prefix_trie.trie(prefix_trie.grafted(prefix_trie.turns_of(spark.createDataFrame([(lost, 0, "user", "gone")], schema)))).collect()
    assert [tuple(r) for r in got] == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]
