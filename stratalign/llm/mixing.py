"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame operations only.

Every source gets a target number of words: a share of all words by its weight, but at
most ``max_epochs`` times its own words; what the cap cuts off is shared again, by weight,
among the sources below their caps. A source whose target is r times its size is taken
floor(r) times whole, and the rest of the target is filled by a weighted sample without
replacement: document keys u**(1/w) with w its quality weight, taken from the largest key
(the smallest -ln(u)/w) on, until the prefix sum of sizes meets the rest. The document at
the boundary is taken if that brings the sum nearer to the target. Documents are whole.

The quality weight is any positive expression. ``quality_weight`` learns one from labels: the
posterior probability that a text of its structure is good. Without labels it is
``noise_weight``, which falls with the share of markup debris.

Scale: prefix sums are two-level. Keys fall into buckets whose ranges are equal on a logarithmic scale,
about sqrt(rows) for each power of e, which bounds their share of a source for all weights alike; bucket sums are aggregated on the map side and accumulated per source, and only the
one bucket per source that the boundary falls into is sorted. No task sees a whole source, nor
all sources where they are many, and documents are mixed where they are read: no text is shuffled.

Defined cases: null or empty texts have size 0 and are taken 0 times. A null source is a
source of its own, last in order. Rows are judged one by one, also if they share an identifier:
equal keys are ordered by identifier, size and a digest of the text; rows that are equal in all
of these are interchangeable. A source without words has target 0. An empty table gives an
empty result. Very long texts are counted whole, other columns pass through, whatever their
names. Reruns agree: keys are hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalign.llm._util import SPACE, discard, materialize, or_empty, unit_interval

BROADCAST_SOURCES = 20_000
BROADCAST_LABELS = 1_000_000
#: Signs of markup debris; each per cent of them in a text lowers its weight.
NOISE = "*%$#&|!"
_BLANK = r" \t\n\x0B\f\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than white space.

    Each run and the white space around it become one sign; no array of words is built.
    """
    t = or_empty(text)
    signs = F.regexp_replace(t, f"[{_BLANK}]*+[^{_BLANK}]++[{_BLANK}]*+", "x")
    return F.when(F.btrim(t, F.lit(SPACE)) == "", 0).otherwise(F.length(signs)).cast("long")


def noise_weight(text: Column) -> Column:
    """Quality weight in (0, 1]: 1 for clean text, less with the share of noise signs."""
    t = or_empty(text)
    n = F.length(t)
    noisy = n - F.length(F.regexp_replace(t, f"[{NOISE}]++", ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * noisy.cast("double") / F.greatest(n, F.lit(1)).cast("double"))


NOISE_STEPS, LENGTH_STEPS = (0.001, 0.01, 0.05), (4.0, 6.0, 9.0)


def structure_bin(text: Column) -> Column:
    """0 to 15: four steps of the share of noise signs, times four of the characters a word."""
    t = or_empty(text)
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    noisy = (F.length(t) - F.length(F.regexp_replace(t, f"[{NOISE}]++", ""))).cast("double") / n
    long = n / F.greatest(word_count(text), F.lit(1)).cast("double")
    step = lambda x, steps: sum(((x > s).cast("int") for s in steps), F.lit(0))
    return step(noisy, NOISE_STEPS) * 4 + step(long, LENGTH_STEPS)


def quality_weight(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Column:
    """The posterior probability that a text of its structure is good, from labels (id, 0/1) of some documents.

    Sixteen counts reach the driver: good and all labelled documents of each ``structure_bin``; a
    bin without any has weight one half.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label).alias("good"))
    known = known.groupBy("label_id").agg(F.max("good").alias("good"))
    small = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small, F.col("id") == F.col("label_id"))
    counts = {r["bin"]: (r["good"], r["n"]) for r in rows.groupBy(structure_bin(F.col("text")).alias("bin")).agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).collect()}
    weights = [(counts.get(b, (0, 0))[0] + 1.0) / (counts.get(b, (0, 0))[1] + 2.0) for b in range(16)]
    return F.element_at(F.array(*[F.lit(w) for w in weights]), structure_bin(F.col(text_col)) + 1)


def _ranked(per: DataFrame) -> DataFrame:
    """Adds rank, from 0 in code point order, null last: one sort while sources are few, else by ranges."""
    order = F.col("source").asc_nulls_last()
    if per.count() <= BROADCAST_SOURCES:
        return per.withColumn("rank", F.row_number().over(W.orderBy(order)) - 1)
    # each partition holds a range of the sources; how many the ranges before it hold is added
    dealt = materialize(per.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = [sum(n for p, n in sizes.items() if p < part) for part in range(max(sizes) + 1)]
    before = F.element_at(F.array(*[F.lit(x) for x in ends]), F.col("part") + 1)
    return dealt.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1 + before).drop("part")


def source_targets(sized: DataFrame, cycle: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) by water filling, from (source, size) rows.

    Weights repeat in code point order. The level of the water is the words that are left, by
    weight, to the sources below their caps; sources that it takes above theirs are capped, and the
    level of the rest is found again, until it takes none. Each turn is one aggregate over the
    sources and caps at least one more; a few turns are usual.
    """
    per = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    weighted = _ranked(per).select("source", "source_size", F.element_at(weights, (F.col("rank") % len(cycle) + 1).cast("int")).cast("long").alias("weight"))
    capped = materialize(weighted.withColumn("cap", F.col("source_size") * max_epochs), "mix-caps")
    whole = capped.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, held = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > F.col("cap") if held >= 0 else F.lit(False)
        t = capped.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("full"),
        ).first()
        if t["full"] == held or not t["weight"]:
            break
        level, held = float(whole - t["cap"]) / float(t["weight"]), t["full"]
    fill = F.lit(level) * F.col("weight")
    return capped.select("source", "source_size", F.when(fill <= F.col("cap"), fill).otherwise(F.col("cap").cast("double")).cast("double").alias("target"))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weight: Column | None) -> list[Column]:
    """id, source, size, key and mark (a digest of the text) of a row: what is decided about it depends on nothing else."""
    weight = noise_weight(F.col(text_col)) if weight is None else weight
    return [
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        (-F.ln(unit_interval(F.lit(seed), F.col(id_col).cast("string"))) / weight).alias("key"), F.xxhash64(F.col(text_col)).alias("mark"),
    ]


ORDER = ("key", "id", "size", "mark")


def _slot(buckets: int) -> Column:
    """The bucket of a key, of equal widths in the key's logarithm.

    Keys of weight w are exponential with rate w. On the logarithmic scale their density is 1/e at most, whatever
    the weight, and so is that of any mixture of weights: no bucket is expected to hold more than 1 / (e * buckets) of a source.
    """
    return F.floor(F.ln("key") * F.lit(float(buckets))).cast("long")


def _planned(sized: DataFrame, cycle: Sequence[int], max_epochs: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(plan per source, rows of ``sized`` outside the boundary buckets with copies, rows inside with copies, buckets)."""
    buckets = 1 << max(4, (max(sized.count(), 1).bit_length() + 1) // 2)
    placed = sized.withColumn("slot", _slot(buckets))
    sums = materialize(placed.groupBy("source", "slot").agg(F.sum("size").alias("size")), "mix-sums")
    targets = source_targets(sums, cycle, max_epochs)
    plan = materialize(targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("need", F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double")), "mix-targets")
    small = (lambda df: F.broadcast(df)) if plan.count() <= BROADCAST_SOURCES else (lambda df: df)
    run = W.partitionBy("source").orderBy("slot")
    upto = sums.select("source", "slot", F.col("size").alias("words"), F.sum("size").over(run).alias("upto"))
    edge = (
        upto.join(small(plan), F.col("source").eqNullSafe(F.col("s")))
        .filter(F.col("upto") >= F.col("need"))
        .groupBy("s").agg(F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
        .select("s", "edge.slot", "edge.before")
    )
    edged = materialize(
        plan.alias("p").join(edge.alias("g"), F.col("p.s").eqNullSafe(F.col("g.s")), "left")
        .select("p.*", F.col("g.slot").alias("edge_slot"), F.col("g.before").alias("edge_before")),
        "mix-plan",
    )
    discard(plan, sums)
    joined = placed.join(small(edged), F.col("source").eqNullSafe(F.col("s")))
    inside = F.coalesce(F.col("slot") == F.col("edge_slot"), F.lit(False)) & (F.col("size") > 0)
    fine = W.partitionBy("source").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    boundary = joined.filter(inside).withColumn("before", F.col("edge_before") + F.coalesce(F.sum("size").over(fine), F.lit(0)))
    near = (F.col("before") + F.col("size")).cast("double") - F.col("need") <= F.col("need") - F.col("before").cast("double")
    boundary = boundary.withColumn("extra", F.when(near, 1).otherwise(0)).drop("before")
    away = joined.filter(~inside).withColumn("extra", _extra_away())
    return edged, away, boundary, buckets


def _extra_away() -> Column:
    """Whether a row outside its source's boundary bucket is in the part epoch."""
    past = F.when(F.col("edge_slot").isNull(), F.when(F.col("need") > 0, 1).otherwise(0)).when(F.col("slot") < F.col("edge_slot"), 1).otherwise(0)
    return F.when(F.col("size") == 0, 0).otherwise(past)


def _copies() -> Column:
    return F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(0).cast("int")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix-1",
    weight: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source, source_size, target, copies, taken (= copies * size)."""
    sized = materialize(docs.select(*_narrow(docs, id_col, text_col, source_col, seed, weight)), "mix-sized")
    _, away, boundary, _ = _planned(sized, cycle, max_epochs)
    return away.unionByName(boundary).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        _copies().alias("copies"), (_copies() * F.col("size")).cast("long").alias("taken"),
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix-1",
    weight: Column | None = None,
) -> DataFrame:
    """The mix itself: every row of ``docs`` repeated as often as that row is taken, all columns kept.

    The mix is planned on narrow rows. Of each source's boundary bucket the last row taken is noted;
    then every row is decided where it is read, by comparing it with that one. Only rows that are
    equal to it, if it has equals, are shuffled, to take as many of them as the plan does.
    """
    narrow = _narrow(docs, id_col, text_col, source_col, seed, weight)
    sized = materialize(docs.select(*narrow), "mix-sized")
    edged, _, boundary, buckets = _planned(sized, cycle, max_epochs)
    boundary = materialize(boundary.select("s", "extra", F.struct(*ORDER).alias("at")), "mix-boundary")
    last = boundary.filter("extra = 1").groupBy("s").agg(F.max("at").alias("cut"))
    equal = boundary.alias("b").join(last.alias("l"), F.col("b.s").eqNullSafe(F.col("l.s")) & (F.col("b.at") == F.col("l.cut")))
    ties = equal.groupBy("l.s", "l.cut").agg(F.count(F.lit(1)).alias("equals"), F.sum("extra").alias("taken_equals"))
    plan = materialize(
        edged.alias("p").join(ties.alias("t"), F.col("p.s").eqNullSafe(F.col("t.s")), "left")
        .select("p.*", "t.cut", F.coalesce("t.equals", F.lit(0)).alias("equals"), F.coalesce("t.taken_equals", F.lit(0)).alias("taken_equals")),
        "mix-cuts",
    )
    small = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    rows = docs.select(*narrow, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carry")).withColumn("slot", _slot(buckets))
    joined = rows.join(small, F.col("source").eqNullSafe(F.col("s")))
    at = F.struct(*ORDER)
    inside = F.coalesce(F.col("slot") == F.col("edge_slot"), F.lit(False)) & (F.col("size") > 0)
    extra = F.when(inside, F.coalesce(at <= F.col("cut"), F.lit(False)).cast("int")).otherwise(_extra_away())
    torn = inside & F.coalesce(at == F.col("cut"), F.lit(False)) & (F.col("taken_equals") < F.col("equals"))
    decided = joined.withColumn("extra", extra)
    if plan.filter("taken_equals < equals").limit(1).count():
        turn = F.row_number().over(W.partitionBy("source").orderBy("mark"))
        some = joined.filter(torn).withColumn("extra", (turn <= F.col("taken_equals")).cast("int"))
        decided = decided.filter(~torn).unionByName(some)
    discard(sized, edged, boundary)
    times = decided.select("carry", _copies().alias("copies")).filter("copies > 0").select("carry", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn"))
    return times.select(*[F.col("carry").getField(c).alias(c) for c in docs.columns])
