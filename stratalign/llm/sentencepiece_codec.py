"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has a node for every position of the normalised text and an edge for every piece
that ends there (an Aho-Corasick automaton lists them), or for the single character. Only the
last ``max_piece_length`` nodes can be extended, so only they are held. Whenever the backpointer
paths of all of them meet in one boundary, the pieces before it are final: their ids are
committed and forgotten.

Unigram vocabularies keep, per node, the path of the greatest sum of scores. Byte-pair
vocabularies have no such sum; there a path may be extended by a piece exactly if merging the
last two pieces' characters alone gives back the two pieces. One path per node survives that
test, and it is the encoding that merging the whole text would give.

A node's path survives as long as what follows the node is the beginning of some piece. The text
is fed to the search in portions, whose places mean nothing to it; after each, the paths of the
surviving nodes are traced back until they meet, and the ids up to there are committed. So a
search between two portions is in a state: the text behind the last boundary and the surviving
paths over it. What a portion does to a state (ids committed, state reached) is worked out by the
search once and remembered while it is in use (``MEMO``); most texts move among few states.

The vocabulary is a model file's; it is read on the driver from a path that the caller gives
and sent to the executors, a few hundred kilobytes for usual models (``VOCABULARY_LIMIT``).

Defined cases: null and empty texts have no ids. A character outside the vocabulary becomes
its bytes if the model has byte pieces, the unknown id otherwise. The mark U+2581 in a text is
a blank. Very long texts are processed whole. Repeated rows are encoded alike. Columns named as
those that are added are replaced, others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalign.llm._util import in_arrow, sliced, thrifty

BLANK = "▁"
#: Steps from state to state that are remembered, twice over: those used lately, and those before them.
MEMO = 250_000
#: States that hold more characters than this are not remembered, and no portion is longer.
MEMO_LENGTH = 64
#: Portions end after a character that isn't part of a word: with it the paths before it have mostly met.
PORTION = re.compile(rf"(?s)\w{{0,{MEMO_LENGTH - 1}}}.")
#: Pairs of pieces whose merging is known.
PAIRS = 300_000
#: Ids whose bytes are put together at a time.
DECODED = 10_000
VOCABULARY_LIMIT = 2_000_000
#: What an unknown character costs a unigram path below the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """pieces: text to (id, score) of ordinary pieces; special ids and flags of the model."""

    pieces: dict[str, tuple[int, float]]
    merges: bool  # byte-pair model; a unigram model otherwise
    size: int
    unknown: int = 0
    byte_ids: tuple[int, ...] = ()
    dummy_prefix: bool = True
    silent: frozenset[int] = field(default_factory=frozenset)  # control ids: decoded to nothing
    digest: str = ""  # of the model file

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            raw_file = f.read()
        model.ParseFromString(raw_file)
        kind, norm = model.trainer_spec.model_type, model.normalizer_spec
        if kind not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normalisation are supported")
        if len(model.pieces) > VOCABULARY_LIMIT:
            raise ValueError("the vocabulary is too large to send to every executor")
        pieces, silent, raw, unknown = {}, set(), {}, 0
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                pieces[p.piece] = (i, p.score)
            elif p.type == 2:
                unknown = i
            elif p.type == 6:
                raw[int(p.piece[3:5], 16)] = i
            elif p.type == 3:
                silent.add(i)
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        byte_ids = tuple(raw[b] for b in range(256)) if len(raw) == 256 and model.trainer_spec.byte_fallback else ()
        return cls(pieces, kind == 2, len(model.pieces), unknown, byte_ids, norm.add_dummy_prefix, frozenset(silent), hashlib.sha256(raw_file).hexdigest())

    def plain(self) -> tuple:
        return (self.pieces, self.merges, self.size, self.unknown, self.byte_ids, self.dummy_prefix, self.silent, self.key)

    @cached_property
    def key(self) -> str:
        """The digest of the model file; of all that the vocabulary holds if it comes from none."""
        whole = (sorted(self.pieces.items()), self.merges, self.size, self.unknown, self.byte_ids, self.dummy_prefix, sorted(self.silent))
        return self.digest or hashlib.sha256(repr(whole).encode()).hexdigest()

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def worst(self) -> float:
        return min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def neighbours(self) -> frozenset[str]:
        """Pairs of characters that stand side by side in a piece; merges cross no other place."""
        return frozenset(a + b for p in self.pieces for a, b in zip(p, p[1:]))

    @cached_property
    def texts(self) -> list[bytes]:
        out = [b""] * self.size
        for p, (i, _) in self.pieces.items():
            out[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        if self.unknown < self.size:
            out[self.unknown] = " ⁇ ".encode()
        return out

    @cached_property
    def laid_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts one after another, where each begins, and its length."""
        sizes = np.array([len(b) for b in self.texts], np.int64)
        return np.frombuffer(b"".join(self.texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def merged(text: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """Byte-pair merging of a short text: the best pair first, the leftmost of equals."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            found = pieces.get(parts[i] + parts[i + 1])
            if found is not None and (best is None or found[1] > best):
                best, at = found[1], i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@dataclass(frozen=True, slots=True)
class Trace:
    """How a piece's characters merge: the score of each merge, and the first and last part before each and at the end."""

    whole: bool  # they end in the piece
    scores: tuple[float, ...]
    firsts: tuple[str, ...]
    lasts: tuple[str, ...]


def traced(text: str, pieces: dict[str, tuple[int, float]]) -> Trace:
    """``merged``, step by step."""
    parts, scores = list(text), []
    firsts, lasts = [parts[0]], [parts[-1]]
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            found = pieces.get(parts[i] + parts[i + 1])
            if found is not None and (best is None or found[1] > best):
                best, at = found[1], i
        if best is None:
            return Trace(len(parts) == 1, tuple(scores), tuple(firsts), tuple(lasts))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        scores.append(best)
        firsts.append(parts[0])
        lasts.append(parts[-1])


START = (1 << 21) - 1


class Lattice:
    """What searches of one vocabulary share: pieces by number, the automaton and the known pairs."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.names = list(vocabulary.pieces)
        self.number = {p: i for i, p in enumerate(self.names)}
        self.sizes = [len(p) for p in self.names]
        self.scores = [vocabulary.pieces[p][1] for p in self.names]
        self.ids = [array("i", [vocabulary.pieces[p][0]]).tobytes() for p in self.names]
        self.known, self.neighbours = vocabulary.pieces, vocabulary.neighbours
        self.pairs: dict[int, dict[int, bool]] = {i: {} for i in (*range(len(self.names)), START)}  # by the left piece, then by the right one
        self.n_pairs = 0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.automaton.add_word(p, (i, len(p) - 1, self.pairs[i]))
        self.automaton.make_automaton()
        self.traces: dict[int, Trace] = {}  # of pieces and of characters that texts hold

    def single(self, char: str) -> int:
        """The number of a single character, in the vocabulary or not."""
        found = self.number.get(char)
        if found is None:
            found = self.number[char] = len(self.names)
            self.pairs[found] = {}
            self.names.append(char)
            self.sizes.append(1)
            self.scores.append(self.v.worst)
            self.ids.append(array("i", [self.v.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.v.byte_ids else [self.v.unknown]).tobytes())
        return found

    def trace(self, number: int) -> Trace:
        found = self.traces.get(number)
        if found is None:
            found = self.traces[number] = traced(self.names[number], self.v.pieces)
        return found

    def fits(self, left: int, right: int) -> bool:
        """Merging the text of both pieces alone ends in these two pieces."""
        if self.n_pairs >= PAIRS:
            for known in self.pairs.values():
                known.clear()
            self.n_pairs = 0
        b = self.trace(right)
        out = self.pairs[left][right] = b.whole if left == START else self._apart(self.trace(left), b)
        self.n_pairs += 1
        return out

    def _apart(self, a: Trace, b: Trace) -> bool:
        """Both merge into themselves, and no merge ever crosses from one to the other.

        Up to a merge that crosses, each side merges as it does alone, so their steps need only be put in order: the
        greater score first, the left one of equals.
        """
        if not (a.whole and b.whole):
            return False
        pieces, i, j, n, m = self.v.pieces, 0, 0, len(a.scores), len(b.scores)
        while True:
            across = pieces.get(a.lasts[i] + b.firsts[j])
            if across is not None and (i == n or across[1] > a.scores[i]) and (j == m or across[1] >= b.scores[j]):
                return False
            if i < n and (j == m or a.scores[i] >= b.scores[j]):
                i += 1
            elif j < m:
                j += 1
            else:
                return True


class State:
    """A search between two portions, and what the portions met so far did to it."""

    __slots__ = ("text", "last", "sums", "kept", "steps", "before", "tail")

    def __init__(self, text: str, last: tuple[int, ...], sums: tuple[float, ...], kept: bool):
        self.text, self.last, self.sums, self.kept = text, last, sums, kept
        self.steps: dict[str, tuple[bytes, State]] = {}  # by portion: ids committed, state reached
        self.before: dict[str, tuple[bytes, State]] = {}  # those not used lately
        self.tail: bytes | None = None  # the ids if the text ends here


class StreamingViterbi:
    """Push normalised text in portions of any size; pieces come out as soon as they are final.

    ``text`` and the lists hold what lies behind the last boundary that was final. Entry i of
    ``last`` is the number of the piece on whose end node i stands (-1: no surviving path
    reaches it); its length is the backpointer.
    """

    def __init__(self, lattice: Lattice | Vocabulary, state: State | None = None):
        self.at = lattice if isinstance(lattice, Lattice) else Lattice(lattice)
        self.merges, self.window = self.at.v.merges, max(1, self.at.v.longest)
        self.most_held = self.commits = 0
        self.resume(state or State("", (START,), (0.0,), False))

    def resume(self, state: State) -> None:
        """Go on from a state, whatever was searched before."""
        self.text, self.last, self.sums = state.text, list(state.last), list(state.sums)

    def feed(self, portion: str) -> Iterator[str]:
        """The pieces that became final."""
        return map(self.at.names.__getitem__, self.push(portion))

    def push(self, portion: str) -> list[int]:
        """The numbers of the pieces that became final."""
        step = 4 * self.window
        if 0 < len(portion) <= step:
            return self._advance(portion)
        out = []
        for at in range(0, len(portion), step):
            out += self._advance(portion[at : at + step])
        return out

    def _advance(self, portion: str) -> list[int]:
        self.text += portion
        if self.merges:
            self._extend_merges()
        else:
            self._extend_sums()
        if len(self.last) > self.most_held:
            self.most_held = len(self.last)
        return self._settle()

    def _extend_merges(self) -> None:
        at, text, last = self.at, self.text, self.last
        rows, fits = [at.pairs[p] if p >= 0 else None for p in last], at.fits  # what is known of the pieces that may follow each node's
        reached = len(last) - 1
        for end, (piece, less, known) in at.automaton.iter(text, max(0, reached + 1 - self.window)):
            if end < reached:
                continue
            while reached < end:
                self._alone(rows)
                reached += 1
            row = rows[end - less]
            if row is not None:
                fit = row.get(piece)
                if fit or (fit is None and fits(last[end - less], piece)):
                    last.append(piece)
                    rows.append(known)
                    reached += 1
        while reached < len(text):
            self._alone(rows)
            reached += 1

    def _alone(self, rows: list[dict[int, bool] | None]) -> None:
        """Reach the next node by a character that is no piece, if a path does."""
        at, left, char = self.at, self.last[-1], self.text[len(self.last) - 1]
        if left >= 0 and char not in at.known:
            piece = at.single(char)
            fit = rows[-1].get(piece)
            if fit or (fit is None and at.fits(left, piece)):
                self.last.append(piece)
                rows.append(at.pairs[piece])
                return
        self.last.append(-1)
        rows.append(None)

    def _extend_sums(self) -> None:
        text, last, sums, scores = self.text, self.last, self.sums, self.at.scores
        need, best, chosen = len(last), None, -1

        def reach() -> None:  # node ``need``, by the best piece or the character alone
            nonlocal need, best, chosen
            if text[need - 1] not in self.at.v.pieces:
                piece = self.at.single(text[need - 1])
                if best is None or sums[need - 1] + scores[piece] > best:
                    best, chosen = sums[need - 1] + scores[piece], piece
            last.append(chosen)
            sums.append(best)
            need, best, chosen = need + 1, None, -1

        for end, (piece, less, _) in self.at.automaton.iter(text, max(0, need - self.window)):
            if end + 1 < need:
                continue
            while need <= end:
                reach()
            total = sums[end - less] + scores[piece]
            if best is None or total > best:
                best, chosen = total, piece
        while need <= len(text):
            reach()

    def _settle(self) -> list[int]:
        """Take out what all surviving paths have in common, and forget the others."""
        at, text, last, end = self.at, self.text, self.last, len(self.last) - 1
        sizes, neighbours, begins, low = at.sizes, at.neighbours, at.automaton.match, end
        if self.merges and end > 1 and last[end - 1] >= 0 and sizes[last[end]] == 1 and text[end - 2 : end] not in neighbours and begins(char := text[end - 1]):
            final, left = self._path(end - 1), last[end - 1]  # most often: one path to the last two nodes, and no other can be extended
            self.text = char
            self.last = [left if at.names[left][-1] + char in neighbours else START, last[end]]
            self.commits += 1
            return final
        if at.known:  # a piece that goes on holds only pairs of characters that pieces hold
            low = max(0, end - 1)
            while low and end - low < self.window - 1 and text[low - 1 : low + 1] in neighbours:
                low -= 1
        meet = {p for p in range(low, end) if last[p] >= 0 and begins(text[p:])}
        meet.add(end)
        on = set()
        while len(meet) > 1:  # the latest node steps back until all are one
            node = max(meet)
            meet.discard(node)
            on.add(node)
            meet.add(node - sizes[last[node]])
        return self._commit(meet.pop(), on)

    def _commit(self, boundary: int, on: set[int]) -> list[int]:
        """The pieces before the boundary; behind it the nodes ``on`` surviving paths are kept."""
        text, last, sizes, end = self.text, self.last, self.at.sizes, len(self.last) - 1
        final = self._path(boundary)
        left, self.text = last[boundary], text[boundary:]
        if boundary and (not self.merges or (self.text and self.at.names[left][-1] + self.text[0] not in self.at.v.neighbours)):
            left = START  # what stands before the boundary has no say in what follows
        self.last = [left] + [last[p] if p in on else -1 for p in range(boundary + 1, end + 1)]
        if not self.merges:
            self.sums = [0.0] * len(self.last)
            for p in range(1, len(self.last)):
                if self.last[p] >= 0:
                    self.sums[p] = self.sums[p - sizes[self.last[p]]] + self.at.scores[self.last[p]]
        self.commits += boundary > 0
        return final

    def _path(self, node: int) -> list[int]:
        out, last, sizes = [], self.last, self.at.sizes
        while node > 0:
            piece = last[node]
            out.append(piece)
            node -= sizes[piece]
        out.reverse()
        return out

    def close(self) -> list[int]:
        return self._path(len(self.last) - 1)

    def finish(self) -> list[str]:
        return [self.at.names[i] for i in self.close()]


class Codec:
    """Encoder and decoder of one vocabulary, with the memo of steps between states.

    ``commits`` counts the boundaries at which ids were committed before their text ended, and
    ``most_held`` is the most nodes that any search held. ``portion`` is the pattern that cuts
    texts into portions; without ``remember`` every step is searched.
    """

    def __init__(self, vocabulary: Vocabulary, portion: re.Pattern = PORTION, remember: bool = True):
        self.v, self.lattice = vocabulary, Lattice(vocabulary)
        self.search = StreamingViterbi(self.lattice)
        self.portions, self.remember = portion, remember
        self.commits = self.known = 0
        self.states: dict[tuple, State] = {}
        self.start = self._state("", (START,), (0.0,))

    @property
    def most_held(self) -> int:
        return self.search.most_held

    def _age(self) -> None:
        """What was not used since the last time is forgotten."""
        self.known = 0
        for key, state in list(self.states.items()):
            state.before, state.steps = state.steps, {}
            if not state.before and state is not self.start:
                state.kept = False
                del self.states[key]

    def _state(self, text: str, last: tuple[int, ...], sums: tuple[float, ...]) -> State:
        if not self.remember or len(text) > MEMO_LENGTH:
            return State(text, last, sums, False)
        key = (text, last) if self.v.merges else (text, last, sums)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(text, last, sums, True)
        return found

    def _ids(self, numbers: list[int]) -> bytes:
        return b"".join(map(self.lattice.ids.__getitem__, numbers))

    def _step(self, state: State, portion: str) -> tuple[bytes, State]:
        step = state.before.get(portion)
        if step is None:
            search = self.search
            search.resume(state)
            ids = self._ids(search.push(portion.replace(" ", BLANK)))
            step = ids, self._state(search.text, tuple(search.last), tuple(search.sums) if not self.v.merges else ())
        if state.kept and step[1].kept and len(portion) <= MEMO_LENGTH:
            if self.known >= MEMO:
                self._age()
            if state.kept:
                state.steps[portion] = step
                self.known += 1
        return step

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        flat = text.replace(BLANK, " ")  # portions are remembered with plain blanks: mostly one byte a character
        if self.v.dummy_prefix:
            flat = " " + flat
        state, out = self.start, []
        for portion in self.portions.findall(flat):
            step = state.steps.get(portion)
            if step is None:
                step = self._step(state, portion)
            out.append(step[0])
            state = step[1]
        self.commits += sum(map(bool, out))
        if state.tail is None:
            self.search.resume(state)
            state.tail = self._ids(self.search.close())
        out.append(state.tail)
        return b"".join(out) if self.v.byte_ids else self._joined(b"".join(out))

    def _joined(self, ids: bytes) -> bytes:
        """Neighbouring unknown ids are one."""
        numbers = np.frombuffer(ids, "<i4")
        again = (numbers[1:] == self.v.unknown) & (numbers[:-1] == self.v.unknown)
        return ids if not again.any() else numbers[np.concatenate(([True], ~again))].tobytes()

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<i4")
        raw = b"".join(self._bytes(numbers[at : at + DECODED]) for at in range(0, len(numbers), DECODED))
        if self.v.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def _bytes(self, numbers: np.ndarray) -> bytes:
        laid, begins, sizes = self.v.laid_out
        sizes = sizes[numbers]
        ends = np.cumsum(sizes)
        places = np.repeat(begins[numbers] - ends + sizes, sizes)
        places += np.arange(len(places))
        return laid[places].tobytes()


def worker_codec(plain: tuple) -> Codec:
    """The codec of this Python worker, which lives on from task to task with its bounded memos."""
    import sys

    held = getattr(sys, "_stratalign_codecs", None)
    if held is None or held[0] != plain[-1]:
        held = sys._stratalign_codecs = (plain[-1], Codec(Vocabulary(*plain)))  # noqa: SLF001
    return held[1]


def _int_lists(blobs: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(b) // 4 for b in blobs])
    if ends[-1] >= 1 << 31:
        raise OverflowError("a batch has too many ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def encode(docs: DataFrame, model: str, text_col: str = "text", out: str = "ids", check: bool = False) -> DataFrame:
    """``docs`` with the ids of each whole text; with ``check`` also decoded_ok, whether decoding gives the text
    back, and n_commits, the boundaries at which its ids were committed before it ended."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model).plain())
    columns = [c for c in docs.columns if c not in ((out, "decoded_ok", "n_commits") if check else (out,))]
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value)
        for batch in sliced(batches, 250):
            texts, blobs, commits = batch.column(at).to_pylist(), [], []
            for t in texts:
                before = codec.commits
                blobs.append(codec.encode(t))
                commits.append(codec.commits - before)
            made, names = [*batch.columns, _int_lists(blobs)], [*columns, out]
            if check:
                right = [codec.decode(b) == (t or "").replace(BLANK, " ") for b, t in zip(blobs, texts, strict=True)]
                made += [pa.array(right, pa.bool_()), pa.array(commits, pa.int64())]
                names += ["decoded_ok", "n_commits"]
            yield pa.RecordBatch.from_arrays(made, names)

    fields = [*[docs.schema[c] for c in columns], T.StructField(out, T.ArrayType(T.IntegerType(), False))]
    if check:
        fields += [T.StructField("decoded_ok", T.BooleanType()), T.StructField("n_commits", T.LongType())]
    return in_arrow(docs.select(*[F.col(f"`{c}`") for c in columns]), thrifty(run), T.StructType(fields))


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids; a null list gives null, ids outside the model raise."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model).plain())
    columns = [c for c in rows.columns if c != out]
    at = columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value)
        for batch in sliced(batches):
            texts = [None if x is None else codec.decode(np.array(x, "<i4").tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, out])

    return in_arrow(rows.select(*[F.col(f"`{c}`") for c in columns]), thrifty(run), T.StructType([*[rows.schema[c] for c in columns], T.StructField(out, T.StringType())]))


def count_ids(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    return encoded.withColumn("n_ids", F.size(ids_col).cast("long"))
