"""A SentencePiece vocabulary as plain tables: pieces, costs, byte fallback, normaliser, and for BPE models the pair acceptor."""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

SPACE = "▁"  # what stands for a space inside pieces
PAIRS_KEPT = 600_000
INFINITE = float("inf")


class Vocabulary:
    """Read once in each worker from a model file, whose path is a parameter; nothing is trained."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for probe in ("Ａ ﬁ é\u0301　x", "a  b\tc\n ", "  x"):  # letters with compatibility forms, runs of spaces, leading ones
            if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError(f"{model}: its normaliser is not the identity with a dummy prefix, which alone is compiled here")
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.cost = {self.names[i]: -sp.get_score(i) for i in normal}
        self.bytes = [0] * 256
        self.fallback = False
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(self.names[i][3:5], 16)] = i
                self.fallback = True
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        # scores that are whole numbers, all different but for one, are merge ranks
        told = sorted(self.cost.values())
        self.bpe = all(float(c).is_integer() for c in told)
        several: dict[float, int] = {}
        for c in told:
            several[c] = several.get(c, 0) + 1
        #: pieces whose priority is shared: merging them depends on the place, not on the pair
        self.tied = sorted(p for p, c in self.cost.items() if several[c] > 1 and len(p) == 2)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # characters of no longer piece stand alone; a space never follows another character inside a piece
        body = "".join(map(re.escape, sorted(joined - {SPACE})))
        blank = f"[ {SPACE}]"
        self.cuts = re.compile(f"(?:{blank}|[{body}])+|." if inner else f"{blank}+[{body}]*|[{body}]+|.", re.S)
        self.joined = joined
        self._pairs: dict[int, bool] = {}
        self._edges: dict[str, tuple[list, list] | None] = {}
        # what a piece says when decoded
        self.said = [b""] * size
        for p, i in self.ids.items():
            self.said[i] = p.replace(SPACE, " ").encode()
        for value, i in enumerate(self.bytes):
            if self.fallback:
                self.said[i] = bytes([value])
        self.said[self.unknown] = " ⁇ ".encode()

    def normalise(self, text: str) -> str:
        """The identity normaliser with a dummy prefix: spaces become SPACE, and one is put in front."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def cut(self, text: str) -> list[str]:
        """Parts of the text, with the dummy prefix, over whose borders no piece can reach; spaces are still spaces."""
        return self.cuts.findall(" " + text) if text else []

    def pretokens(self, text: str) -> list[str]:
        """The same parts, normalised."""
        return self.cuts.findall(self.normalise(text))

    def has_tied(self, word: str) -> bool:
        return any(t in word for t in self.tied)

    def unknown_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def merge(self, word: str) -> list[str]:
        """The merges of a BPE model, cheapest pair first and leftmost among equals. For pairs and for words with tied pieces."""
        parts: list[str | None] = list(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        cost = self.cost
        heap = [(cost[p], i, p) for i in range(len(parts) - 1) if (p := word[i : i + 2]) in cost]
        heapify(heap)
        while heap:
            _, i, p = heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (q := p + parts[k]) in cost:
                    heappush(heap, (cost[q], i, q))
            h = before[i]
            if h >= 0 and (q := parts[h] + p) in cost:
                heappush(heap, (cost[q], h, q))
        return [p for p in parts if p is not None]

    def edges(self, p: str) -> tuple[list, list] | None:
        """How a piece's right and left edge grow while it is merged: (part, cost of the merge that ends it), from the
        single character to the whole piece, which no merge ends. None: the merges never make this piece."""
        if p not in self._edges:
            if len(p) == 1:
                self._edges[p] = ([(p, INFINITE)], [(p, INFINITE)])
            else:
                own = self.cost.pop(p)  # what is left without its last merge
                parts = self.merge(p)
                self.cost[p] = own
                halves = [self.edges(x) for x in parts] if len(parts) == 2 else [None]
                if None in halves:
                    self._edges[p] = None
                else:
                    right, left = halves[1][0], halves[0][1]
                    self._edges[p] = ([*right[:-1], (right[-1][0], own), (p, INFINITE)], [*left[:-1], (left[-1][0], own), (p, INFINITE)])
        return self._edges[p]

    def follows(self, a: str, b: str) -> bool:
        """The pair acceptor of a BPE model: whether b may follow a, that is whether merging a + b stops at the two.

        Merges happen in the order of their costs, the left one first among equals; so the two edges at the border
        grow in that order, and the pair fails if a merge over the border comes before either edge's next one.
        """
        key = self.ids[a] << 20 | self.ids[b]
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > PAIRS_KEPT:
                self._pairs.clear()
            ok = self._pairs[key] = self.stays(a, b)
        return ok

    def stays(self, a: str, b: str) -> bool:
        """What follows() keeps."""
        left, right, cost = self.edges(a), self.edges(b), self.cost
        if left is None or right is None:
            return False
        left, right = left[0], right[1]
        i = j = 0
        while True:
            (x, ends), (y, stops) = left[i], right[j]
            over = cost.get(x + y, INFINITE)
            if over < ends and over <= stops and over < INFINITE:
                return False
            if ends == stops == INFINITE:
                return True
            if ends <= stops:
                i += 1
            else:
                j += 1


@lru_cache(4)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)
