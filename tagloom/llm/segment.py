"""SentencePiece encoding and decoding by weighted finite-state transducers.

The compiled machine is the composition of three parts: the normaliser (spaces to the space mark, dummy prefix; a model with any
other normaliser is refused), the lexicon (a deterministic machine of pieces whose final arcs carry the piece's id and cost) and
byte fallback (an arc for any one character that says its UTF-8 bytes, taken where no piece begins). The machine so reads the text as it stands. An input is
composed with it lazily, state by state, and the shortest path in the tropical semiring (minimum over paths of the sum of costs) gives the pieces.

For a unigram model the costs are the negative log-probabilities. For a BPE model summed merge ranks would not give the
model's segmentation, so the lexicon is composed with an acceptor over pairs of neighbouring pieces, whose arcs cost
nothing if the merges would leave the pair alone and infinity otherwise: a sequence is the model's segmentation exactly if
each of its pairs is, so one path of finite cost is left, and it is the shortest. Pieces that share one priority (runs of
spaces) have no such acceptor; words that hold two neighbouring ones go through the merges themselves.

No piece reaches over the border of a pre-token, so each distinct pre-token is composed once in a worker and kept in a
cache of bounded size.

Defined cases: null and empty texts have no pieces and decode to an empty text; texts are encoded whole; repeated rows are
encoded as often as they occur; a null doc_id is passed on; other columns are ignored (or kept, in encode_column).
round_trip is whether decoding gives back the text; it doesn't for a text that itself holds the space mark.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.pieces import PAIRS_KEPT, SPACE, Vocabulary, vocabulary
from tagloom.runtime import ship, ship_file, shipped_file, small_batches

CACHE = 120_000  # pre-tokens in each of two generations
KEPT = 256  # letters of the longest pre-token that is kept
INFINITE = float("inf")
Arcs = dict[str, tuple[int, "Arcs"]]


class Machine(dict):
    """A cache from pre-token to its ids as bytes; a missing one is composed with the machine."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.old: dict[str, bytes] = {}
        self.root = compile_arcs(v)
        size = max(v.ids.values(), default=0) + 1
        self.length, self.names = [1] * size, [""] * size
        self.longest = max(map(len, v.ids), default=1)
        for p, i in v.ids.items():
            self.length[i], self.names[i] = len(p), p
        #: the pair acceptor, as far as it has been asked for: for each piece, which others may follow it
        self.after: list[dict[int, bool]] = [{} for _ in range(size)]
        self.asked = 0

    def __missing__(self, word: str) -> bytes:
        if len(word) > KEPT:
            return array("i", self.shortest_path(word)).tobytes()
        if len(self) >= CACHE:  # what isn't asked for again goes with the generation before
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = array("i", self.shortest_path(word)).tobytes()
        self[word] = out
        return out

    def shortest_path(self, word: str) -> list[int]:
        """The ids on the shortest path of the composition; word is text as it stands, the machine normalises it."""
        v = self.v
        if not v.bpe:
            path = self._cost_path(word)
        elif v.has_tied(plain := word.replace(" ", SPACE)):
            return [x for p in v.merge(plain) for x in ([v.ids[p]] if p in v.ids else v.unknown_ids(p))]
        else:
            path = self._pair_path(word)
        if min(path, default=0) >= 0:
            return path
        return [x for i in path for x in ([i] if i >= 0 else v.unknown_ids(chr(-2 - i)))]

    def _allows(self, a: int, b: int) -> bool:
        self.asked += 1
        if self.asked > PAIRS_KEPT:
            self.asked = 0
            for row in self.after:
                row.clear()
        ok = self.after[a][b] = self.v.stays(self.names[a], self.names[b])
        return ok

    def _pair_path(self, word: str) -> list[int]:
        """Composition with the pair acceptor: arcs cost nothing or are missing, so the first path that reaches the end is
        the shortest. Longer pieces are tried first; a place that led nowhere is not entered again, since at most
        one path of finite cost reaches each place. A negative id stands for the fallback arc of a character."""
        root, length, after, n, longest = self.root, self.length, self.after, len(word), self.longest
        chosen: list[int] = []
        open_: list[tuple[int, int, list[int]]] = []  # place, piece before it, arcs still to try
        dead: set[int] = set()
        place, before = 0, -1
        while place < n:
            todo, arcs = [], root
            for c in word[place : place + longest]:  # follow the lexicon from here
                step = arcs.get(c)
                if step is None:
                    break
                i, arcs = step
                if i >= 0:
                    todo.append(i)
                if not arcs:
                    break
            if not todo:
                todo.append(-2 - ord(word[place]))
            while True:
                if not todo:
                    dead.add(place)
                    place, before, todo = open_.pop()
                    chosen.pop()
                    continue
                i = todo.pop()
                end = place + length[i] if i >= 0 else place + 1
                if dead and end in dead:
                    continue
                if before >= 0 and i >= 0:
                    ok = after[before].get(i)
                    if not (self._allows(before, i) if ok is None else ok):
                        continue
                break
            open_.append((place, before, todo))
            chosen.append(i)
            place, before = end, i
        return chosen

    def _cost_path(self, word: str) -> list[int]:
        """Viterbi over places: the tropical sum of arc costs; the fallback arc costs more than any piece."""
        v, n = self.v, len(word)
        cost, names = v.cost, self.names
        worst = max(cost.values(), default=0.0) + 10.0
        best, came, start = [0.0] + [INFINITE] * n, [0] * (n + 1), [0] * (n + 1)
        for k in range(n):
            if best[k] + worst < best[k + 1]:
                best[k + 1], came[k + 1], start[k + 1] = best[k] + worst, -2 - ord(word[k]), k
            arcs = self.root
            for j in range(k, n):
                step = arcs.get(word[j])
                if step is None:
                    break
                i, arcs = step
                if i >= 0 and best[k] + cost[names[i]] < best[j + 1]:
                    best[j + 1], came[j + 1], start[j + 1] = best[k] + cost[names[i]], i, k
        out: list[int] = []
        while n:
            out.append(came[n])
            n = start[n]
        return out[::-1]


def compile_arcs(v: Vocabulary) -> Arcs:
    """Normaliser and lexicon composed, as a deterministic machine: the arcs of the start state, each of them the id of the piece
    that ends there (or -1) and the arcs that go on. What the normaliser maps to one character shares an arc's state."""
    root: Arcs = {}
    for p, i in v.ids.items():
        arcs = root
        for k, c in enumerate(p):
            old = arcs.get(c, (-1, {}))
            step = (i, old[1]) if k == len(p) - 1 else old
            for said in (c, " ") if c == SPACE else (c,):
                arcs[said] = step
            arcs = step[1]
    return root


_MACHINES: dict[str, Machine] = {}


def machine(model: str) -> Machine:
    if model not in _MACHINES:
        _MACHINES[model] = Machine(vocabulary(model))
    return _MACHINES[model]


def encode(text: str, m: Machine) -> bytes:
    """The ids of a text, as 32-bit integers."""
    return b"".join(map(m.__getitem__, m.v.cut(text)))


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text that ids say: the inverse transducer. The dummy prefix's space is dropped."""
    said = b"".join(map(v.said.__getitem__, ids)).decode("utf-8", "replace")
    return said[1:] if said[:1] == " " else said


def encode_column(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces, n_byte_pieces, ids_sha256, round_trip) of each row."""
    ship(docs.sparkSession)
    ship_file(docs.sparkSession, model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(shipped_file(model))
        byte_like = np.zeros(len(m.v.names), bool)
        if m.v.fallback:
            byte_like[m.v.bytes] = True
        for b in batches:
            parts, counts, own_bytes, digests, same = [], [0], [], [], []
            for text in b.column(1).to_pylist():
                coded = encode(text or "", m)
                ids = np.frombuffer(coded, np.int32)
                parts.append(coded)
                counts.append(len(ids))
                own_bytes.append(int(byte_like[ids].sum()))
                digests.append(hashlib.sha256(coded).hexdigest())
                same.append(decode(ids.tolist(), m.v) == (text or ""))
            n = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.Array.from_buffers(pa.int32(), int(n[-1]), [None, pa.py_buffer(b"".join(parts))]))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(counts[1:], pa.int64()), pa.array(own_bytes, pa.int64()), pa.array(digests), pa.array(same)], ["doc_id", "ids", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """All that encode_column gives of every document."""
    return encode_column(docs, model)


def decode_column(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to an empty text."""
    ship(coded.sparkSession)
    ship_file(coded.sparkSession, model)
    small_batches(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shipped_file(model))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or [], v) for x in b.column(1).to_pylist()])], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


__all__ = ["SPACE", "Machine", "decode", "decode_column", "encode", "encode_column", "encode_documents", "machine"]
