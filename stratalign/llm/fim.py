"""Fill-in-the-middle: texts cut at two places and put together again with their middle at the end.

A unit is a word with the white space before it; white space at the end is a unit of its own. Cuts
lie between units. An Aho-Corasick automaton reports the places of the characters that change a text's
class (the six ASCII blanks) and of the sentinels, and nothing else: between two reported blanks lies one
word if the gap is longer than none, so the n-th unit's end follows from the gaps by counting, and
whatever stands between the events is never looked at from Python.

Where to cut, and in which form, is drawn from a SHA-256 of seed and identifier, so reruns agree.
Texts that are empty or hold a sentinel stay plain: what is cut can always be put together again.

Defined cases: a null text is the empty one; a null identifier is drawn for as an empty one; repeated rows
are cut alike; very long texts are cut whole, at 16 bytes per event; an empty table gives no rows.
Other columns stay, but for those that the result's own columns replace.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalign.llm._util import SPACE, in_arrow, or_empty, sliced, thrifty, unused_name

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def _checked(sentinels: Sequence[str]) -> tuple[str, ...]:
    """Sentinels that can be found again: none can begin inside another or at the end of one."""
    for a in sentinels:
        for b in sentinels:
            if not a or a != b and b in a or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))):
                raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")
    if len(set(sentinels)) != 3 or any(c in SPACE for s in sentinels for c in s):
        raise ValueError("three different sentinels without white space are needed")
    return tuple(sentinels)


@lru_cache(8)
def event_automaton(sentinels: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for c in SPACE:
        automaton.add_word(c, 0)
    for k, s in enumerate(sentinels, 1):
        automaton.add_word(s, k)
    automaton.make_automaton()
    return automaton


def unit_ends(text: str, sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, bool]:
    """The ends of a text's units in code points, and whether the text holds a sentinel."""
    events = np.fromiter(chain.from_iterable(event_automaton(sentinels).iter(text)), np.int64).reshape(-1, 2)
    blanks = events[events[:, 1] == 0, 0]
    edges = np.concatenate(([-1], blanks, [len(text)]))
    ends = edges[1:][np.diff(edges) > 1]
    if blanks.size and blanks[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, len(blanks) < len(events)


def _draws(id_col: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), or_empty(F.col(f"`{id_col}`").cast("string"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_share: int = 80, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate`` per cent of the texts are cut, ``spm_share`` per cent of those come suffix first.
    """
    marks = _checked(sentinels)
    p, s, m = marks
    columns = [c for c in docs.columns if c not in MADE]
    own = [unused_name([*docs.columns, *MADE], f"draw{k}") for k in range(4)]
    text = unused_name([*docs.columns, *MADE], "whole")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], *[d.alias(name) for d, name in zip(_draws(id_col, seed), own, strict=True)], or_empty(F.col(f"`{text_col}`")).alias(text))

    def cut(whole: str, h: tuple[int, ...]) -> tuple:
        ends, marked = unit_ends(whole, marks)
        n = len(ends)
        if not whole or marked or h[2] % 100 >= rate:
            return n, "plain", None, None, whole
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
        prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
        if h[3] % 100 < spm_share:
            return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    kept = len(columns)
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            draws = zip(*[batch.column(kept + k).to_pylist() for k in range(4)], strict=True)
            made = [cut(t, h) for t, h in zip(batch.column(kept + 4).to_pylist(), draws, strict=True)]
            values = [pa.array([x[k] for x in made], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *values], [*columns, *MADE])

    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return in_arrow(rows, thrifty(run), T.StructType([*[docs.schema[c] for c in columns], *fields]))


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    p, s, m = (F.lit(x) for x in _checked(sentinels))
    between = lambda a, b: F.split_part(F.split_part(output, a, F.lit(2)), b, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )
