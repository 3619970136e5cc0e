"""Token counts by dynamic programming that pre-tokens share along a trie.

The distinct pre-tokens of a batch are inserted in a trie, one node for each shared prefix. A node holds the forward state of its
prefix, which its ancestors' states and the pieces that end there determine, and it is computed once, when the node is made:
for a unigram model the best score and the number of pieces on that path; for a BPE model, whose summed scores would not
give its counts, the last piece of the prefix's segmentation and the number of pieces (a piece may end a prefix if the
merges leave it and the piece before it alone, see segment). A pre-token's count is read off at its terminal node. Nodes live as
flat lists, in a trie of bounded size per worker that starts anew when it is full. A very long pre-token, which can share little, has its states computed in
the same way but only those within a piece's reach are held, so memory doesn't grow with it.

Defined cases: null and empty texts count 0; texts count whole; repeated rows count each; a null doc_id is passed on; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.pieces import Vocabulary, vocabulary
from tagloom.runtime import ship, ship_file, shipped_file, small_batches

NODES = 1_000_000
LONG = 4096  # letters of a pre-token that takes no nodes


class _Last:
    """The place of a prefix's state in lists of which the first ones are dropped."""

    dropped = 0

    def __getitem__(self, k: int) -> int:
        return k - self.dropped


class Trie:
    """children: node << 21 | character -> node. Each node knows its prefix's forward state and its terminal count."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.suffixes = {p[-n:]: -1 for p in v.ids for n in range(1, len(p))} | v.ids
        self.worst = max(v.cost.values(), default=0.0) + 10.0
        self.longest = max(map(len, v.ids), default=1)
        self.reset()

    def reset(self) -> None:
        self.children: dict[int, int] = {}
        self.last: list[str] = [""]
        self.count: list[int] = [0]
        self.score: list[float] = [0.0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The count of a pre-token, stored as its terminal's."""
        v = self.v
        if v.bpe and v.has_tied(word):
            n = sum(1 if p in v.ids else len(v.unknown_ids(p)) for p in v.merge(word))
        elif len(word) > LONG:
            return self._long(word)
        else:
            if len(self.count) > NODES:
                self.reset()
            children, node, path = self.children, 0, [0]
            for i, c in enumerate(word, 1):
                key = node << 21 | ord(c)
                node = children.get(key, -1)
                if node < 0:
                    node = children[key] = len(self.count)
                    self._state(word, i, path, self.last, self.count, self.score)
                path.append(node)
            n = self.count[node]
        if len(self.terminal) > NODES:
            self.terminal.clear()
        self.terminal[word] = n
        return n

    def _long(self, word: str) -> int:
        last, count, score, path = [""], [0], [0.0], _Last()
        for i in range(1, len(word) + 1):
            self._state(word, i, path, last, count, score)
            if len(last) > LONG + self.longest:  # what no piece reaches back to goes
                for held in (last, count, score):
                    del held[:LONG]
                path.dropped += LONG
        return count[-1]

    def _state(self, word: str, i: int, path: list[int] | _Last, last: list[str], count: list[int], score: list[float]) -> None:
        """Appends the state of word[:i], from those of its own prefixes, whose places in the lists path says."""
        v = self.v
        ids, suffixes = v.ids, self.suffixes
        found, best = None, float("inf")
        starts = []
        for k in range(i - 1, -1, -1):
            j = suffixes.get(p := word[k:i])
            if j is None:
                break
            if j >= 0:
                starts.append((k, p))
        if v.bpe:
            for k, p in reversed(starts):
                a = last[path[k]]
                if k == 0 or a not in ids or v.follows(a, p):
                    found, best = (k, p), 0.0
                    break
        else:
            for k, p in starts:
                if score[path[k]] + v.cost[p] < best:
                    found, best = (k, p), score[path[k]] + v.cost[p]
            if score[path[i - 1]] + self.worst < best:
                found, best = None, score[path[i - 1]] + self.worst
        if found is None:
            last.append(word[i - 1])
            count.append(count[path[i - 1]] + len(v.unknown_ids(word[i - 1])))
            score.append(best if best < float("inf") else score[path[i - 1]])
        else:
            last.append(found[1])
            count.append(count[path[found[0]]] + 1)
            score.append(best)


_TRIES: dict[str, Trie] = {}


def trie(model: str) -> Trie:
    if model not in _TRIES:
        _TRIES[model] = Trie(vocabulary(model))
    return _TRIES[model]


def count_tokens(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of each row."""
    ship(docs.sparkSession)
    ship_file(docs.sparkSession, model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(shipped_file(model))
        for b in batches:
            pre, tokens = [], []
            for text in b.column(1).to_pylist():
                words = t.v.pretokens(text or "")
                known = t.terminal
                pre.append(len(words))
                tokens.append(sum([known[w] if w in known else t.insert(w) for w in words]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
