"""Filter interaction audit: what each filter of a chain removes, in every order of the chain, read off decision diagrams.

A document's failures are a mask, one bit a filter. Spark counts documents (and labelled good and toxic ones) per part and mask,
pre-aggregated in all tasks, so a part is 2^k rows at most however many documents it has. Each part's rows become an ordered decision
diagram: a level per filter, a pass and a fail child per node, equal sub-diagrams shared, and in every node the counts of all documents
below it. The orders are visited so that each differs from the one before by one swap of neighbours; a swap rebuilds only the nodes of the two
levels. Along an order's all-pass path, the fail child at a level counts what its filter removes there, the pass child what it keeps.

Filters of ``document_masks``: A too few words, B too few distinct words, C too many capitals, D a symbol, E the text of a smaller doc_id.

Defined cases: a null text is empty (and so fails A); a null part is the empty string; a null doc_id is no smaller and no larger than any other, so it
neither fails E nor makes others fail, and has no label; repeated rows count each; a document counts once as good or toxic if any of its label rows
says so; an empty table gives no rows; other columns are ignored. Texts are compared by SHA-256 and read whole, in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.runtime import checkpoint, ship, small_batches

# The filters' limits and classes of characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
PIECE = 1 << 20  # bytes that are split into words at a time
COUNTS = ("n", "n_good", "n_toxic")


def word_numbers(text: bytes) -> tuple[int, int]:
    """The number of words and of distinct words; bytes split at just the six blanks."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, begin, head = 0, set(), 0, b""
    while begin < len(text):
        piece = head + text[begin : begin + PIECE]
        begin += PIECE
        words = piece.split()
        cut = begin < len(text) and not piece[-1:].isspace()  # the last word may go on
        head = words.pop() if cut and words else b""
        n += len(words)
        seen.update(words)
    return n, len(seen)


def text_mask(text: str) -> tuple[int, bytes]:
    """The bits of A to D (1, 2, 4, 8) of a whole text, and its SHA-256."""
    raw = text.encode("utf-8", "surrogatepass")
    n, distinct = word_numbers(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    mask = (n < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT * n) + 4 * (100 * capitals > MOST_CAPITALS * len(text)) + 8 * (symbols > 0)
    return mask, hashlib.sha256(raw).digest()


def document_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents per part and failure mask of A to E."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_mask(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m for m, _ in got], pa.int32()), pa.array([h for _, h in got], pa.binary())], ["doc_id", "part", "mask", "same"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs["text"].cast("string").alias("text"))
    rows = own.mapInArrow(run, "doc_id long, part string, mask int, same binary")
    # repeated rows become one, so that no key below is hot: neither a text nor a doc_id comes twice with the other
    rows = checkpoint(rows.groupBy("doc_id", "same", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.filter("doc_id IS NOT NULL").groupBy(F.col("same").alias("f_same")).agg(F.min("doc_id").alias("f_id"))
    flag = lambda c: F.max(F.coalesce(labels[c] == 1, F.lit(False))).alias(c)
    marked = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("l_id")).agg(flag("quality"), flag("toxic"))
    known = rows.filter("doc_id IS NOT NULL")
    known = known.join(first, (F.col("doc_id") == F.col("f_id")) & (F.col("same") == F.col("f_same")), "left")
    known = known.withColumn("mask", F.col("mask") + F.when(F.col("f_id").isNull(), 16).otherwise(0)).join(marked, F.col("doc_id") == F.col("l_id"), "left")
    count = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), F.col("n")).otherwise(F.lit(0).cast("long"))
    known = known.select("part", "mask", "n", count("quality").alias("n_good"), count("toxic").alias("n_toxic"))
    unknown = rows.filter("doc_id IS NULL").select("part", "mask", "n", F.lit(0).cast("long").alias("n_good"), F.lit(0).cast("long").alias("n_toxic"))
    return known.unionByName(unknown).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


class Diagram:
    """A count-weighted ordered decision diagram of failure masks. ``order`` holds the filters' bits, first level first."""

    def __init__(self, bits: int, counts: dict[int, tuple[int, ...]]) -> None:
        self.order = list(range(bits))
        self.kids: list[tuple[int, int] | None] = []  # of each node: pass, fail; None at the leaves
        self.sums: list[tuple[int, ...]] = []
        self.tables: list[dict] = [{} for _ in range(bits + 1)]  # of each level: (pass, fail) or leaf counts -> node
        none = (0,) * len(next(iter(counts.values())))

        def build(level: int, mask: int) -> int:
            if level == bits:
                return self._leaf(level, counts.get(mask, none))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _leaf(self, level: int, sums: tuple[int, ...]) -> int:
        at = self.tables[level].setdefault(sums, len(self.kids))
        if at == len(self.kids):
            self.kids.append(None)
            self.sums.append(sums)
        return at

    def _node(self, level: int, lo: int, hi: int) -> int:
        at = self.tables[level].setdefault((lo, hi), len(self.kids))
        if at == len(self.kids):
            self.kids.append((lo, hi))
            self.sums.append(tuple(map(sum, zip(self.sums[lo], self.sums[hi], strict=True))))
        return at

    def swap(self, level: int) -> None:
        """Exchanges the filters of this level and the next. Nodes of this level stay what they count; those of the next are made anew."""
        here, self.tables[level], self.tables[level + 1] = self.tables[level], {}, {}
        for (lo, hi), node in here.items():
            (ll, lh), (hl, hh) = self.kids[lo], self.kids[hi]
            pair = self._node(level + 1, ll, hl), self._node(level + 1, lh, hh)
            self.kids[node] = pair
            self.tables[level][pair] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) of each level of the all-pass path."""
        out, node = [], self.root
        for bit in self.order:
            lo, hi = self.kids[node]
            out.append((bit, self.sums[lo], self.sums[hi]))
            node = lo
        return out


def neighbour_swaps(n: int) -> Iterator[int]:
    """Positions to swap with the next one, so that all orders of n are met, each once."""
    order, step = list(range(n)), [-1] * n
    while True:
        movable = [v for v in range(n) if 0 <= order.index(v) + step[v] < n and order[order.index(v) + step[v]] < v]
        if not movable:
            return
        v = max(movable)
        i = order.index(v)
        j = i + step[v]
        order[i], order[j] = order[j], order[i]
        for w in range(v + 1, n):
            step[w] = -step[w]
        yield min(i, j)


def audit_rows(counts: dict[int, tuple[int, int, int]], filters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    k = len(filters)
    diagram = Diagram(k, counts)
    fails = [sum(c[0] for m, c in counts.items() if m >> bit & 1) for bit in range(k)]
    alone = [counts.get(1 << bit, (0, 0, 0))[0] for bit in range(k)]
    orders, shapley = [], [0] * k
    swaps = neighbour_swaps(k)
    while True:
        name, path = "".join(filters[b] for b in diagram.order), diagram.path()
        for bit, _, removed in path:
            shapley[bit] += removed[0]
        orders.append((name, path))
        at = next(swaps, None)
        if at is None:
            break
        diagram.swap(at)
    return [
        (name, step, kept[0], removed[0], fails[bit] - removed[0], alone[bit], removed[1], removed[2], shapley[bit])
        for name, path in orders
        for step, (bit, kept, removed) in enumerate(path, 1)
    ]


def filter_audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of (part, mask, n, n_good, n_toxic) rows, unique by part and mask; bit i of a mask is the failure of the i-th filter. k filters make k! orders
    a part, so k is 8 at most."""
    if not 1 <= len(filters) <= 8:
        raise ValueError("filter_audit: between 1 and 8 filters")
    ship(masks.sparkSession)
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(a), int(b)) for m, n, a, b in zip(g["mask"], g["n"], g["n_good"], g["n_toxic"], strict=True)}
        out = pd.DataFrame(audit_rows(counts, filters), columns=columns)
        out.insert(0, "part", g["part"].iloc[0])
        return out

    return masks.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
