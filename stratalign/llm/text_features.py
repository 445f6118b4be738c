"""Feature extractors of the factorisation machines: hashed words, word stems, structure and length.

An extractor is called once per task and returns a function from a text to the set of its
hash ids. Given the ids that a model keeps, it drops all others while a word is looked up,
so most words cost one dictionary access.

Defined cases: an empty text has its structure ids (if they are asked for) and no others; a
text is taken whole, and a word counts once however often it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from itertools import chain
from operator import eq

import xxhash

from stratalign.llm.fm import BUCKETS

MEMO = 150_000
MARKS = ".,;:!?*%&$#|\"'()[]{}<>-_=+~^/\\@"


def bucket(kind: str, value: object) -> int:
    return xxhash.xxh32_intdigest(f"{kind}:{value}") % BUCKETS


def word_ids(word: str, stems: tuple[int, ...]) -> list[int]:
    bare = word.strip(MARKS)
    if not bare:
        return [bucket("mark", word[:4])]
    return [bucket("word", bare), *(bucket(f"stem{k}", bare[:k]) for k in stems if len(bare) >= k)]


class _Words(dict):
    def __init__(self, stems: tuple[int, ...], kept: set[int] | None):
        self.stems, self.kept = stems, kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = word_ids(word, self.stems)
        out = self[word] = tuple(ids if self.kept is None else (i for i in ids if i in self.kept))
        return out


def structure(text: str, words: list[str]) -> Iterable[tuple[str, object]]:
    """Binned shares of a text's characters and words, and its length."""
    raw = text.encode("utf-8", "replace")
    n, m = max(1, len(raw)), max(1, len(words))

    def share(chars: bytes) -> float:
        return (n - len(raw.translate(None, chars))) / n if raw else 0.0

    def binned(x: float, steps: tuple[float, ...]) -> int:
        return sum(x > s for s in steps)

    fine, coarse = (0.001, 0.004, 0.01, 0.02, 0.05, 0.1, 0.2), (0.02, 0.1, 0.3, 0.5, 0.7, 0.9)
    for name, chars in (("markup", b"*%$#&"), ("bar", b"|"), ("bang", b"!"), ("digit", b"0123456789"), ("comma", b".,;:")):
        yield name, binned(share(chars), fine)
    yield "upper", binned(share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), coarse)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    yield "distinct", binned(len(counts) / m, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))
    yield "top", binned(top / m, (0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5))
    yield "stutter", binned(sum(map(eq, words, words[1:])) / m, (0.01, 0.03, 0.1, 0.2, 0.4, 0.6))
    yield "long", binned(len(raw) / m, (3, 4, 5, 6, 7, 8, 10, 14))
    yield "length", min(20, len(words).bit_length())
    yield "lines", binned((text.count("\n") + 1) / m, (0.005, 0.01, 0.02, 0.05, 0.1, 0.3))


def make_extractor(stems: tuple[int, ...], with_structure: bool) -> Callable[..., Callable[[str], set[int]]]:
    def start(kept: set[int] | None = None) -> Callable[[str], set[int]]:
        memo = _Words(stems, kept)

        def features(text: str) -> set[int]:
            words = text.lower().split()
            out = set(chain.from_iterable(map(memo.__getitem__, set(words))))
            if with_structure:
                named = (bucket(k, x) for k, x in structure(text, words))
                out.update(named if kept is None else (i for i in named if i in kept))
            if len(memo) > MEMO:
                memo.clear()
            return out

        return features

    return start
