"""MinHash near-duplicates by DartMinHash signatures, banded joining and exact verification.

A document is its weighted set of five-word shingles. For each element, hashed darts are thrown on the plane of weight and rank
(a Poisson process of rate 1, the same for an element in every document); a dart hits if its weight coordinate is below the
element's weight. Each dart has a coordinate of the signature, and the dart of smallest rank is kept for each. Only darts up
to rank (t ln t + 2t) / total weight are thrown, so that about t ln t + 2t darts fill the t coordinates whatever the size of the
document; a signature with a gap throws again up to twice that rank. Two signatures agree in a coordinate with
probability equal to the weighted Jaccard similarity. With unit weights, the production setting, that is the Jaccard
similarity of the shingle sets, for which the threshold of 0.8 is stated.

Signatures are cut in bands; documents that agree in a band are candidates. 26 bands of 5 lose a pair of similarity 0.8 with
probability 3e-5, more similar ones far less often. Texts of equal shingle sets share one representative before that. The
candidates' graph (each document linked to the smallest of its band group) is cut in connected components; within one,
all pairs are verified exactly, by products of 0/1 matrices over the shingles that two or more documents share. A component
with many documents is split in blocks, and the pairs of blocks are dealt to many tasks; a task gives a spanning forest of
its links, never all pairs. The classes are the components of verified links.

Defined cases: words are runs of characters other than the six ASCII blanks; a text of one to four words is one shingle; null texts and
texts without words are never linked, each document a class of its own; rows of equal doc_id are one document, so their texts,
whatever they are, are of one class (drop_near_duplicates judges rows by their texts instead); a null doc_id
makes no link and keeps a null class; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.plans.components import connected_components
from tagloom.runtime import checkpoint, ship, small_batches

SHINGLE = 5
BANDS, ROWS = 26, 5
U64 = np.uint64
KNOWN = 150_000
LARGEST = 2048  # sets in a block
WORD = r"[^\x20\x09-\x0D]"


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixer, for each salt another."""
    x = (x ^ U64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(31)
    x *= U64(0x94D049BB133111EB)
    return x ^ x >> U64(29)


class Hashes(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = Hashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's word windows, one for each place."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if n == 0:
        return np.empty(0, U64)
    w = np.fromiter(map(_HASHES.__getitem__, words), U64, n)
    m = max(n - size + 1, 1)
    key = np.full(m, min(n, size), U64)
    for k in range(min(size, n)):
        key = (key ^ w[k : k + m]) * U64(0x9E3779B97F4A7C15)
        key ^= key >> U64(32)
    return key


def dart_signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """n_docs x t identities of the darts kept. doc: of each element, ascending. A document without elements has zeros."""
    out = np.zeros((n_docs, t), U64)
    total = np.bincount(doc, weights, n_docs)
    todo = total > 0
    reach = np.where(todo, (t * np.log(t) + 2 * t) / np.maximum(total, 1e-300), 0.0)
    while todo.any():
        best = np.full(n_docs * t, np.inf)
        kept = np.zeros(n_docs * t, U64)
        open_ = np.flatnonzero(todo[doc])
        slab, low, high = 0, 0.0, 1.0
        while len(open_):  # weight slabs [0, 1), [1, 2), [2, 4), ...: every element with the same edges
            at, rank, throw = open_, np.zeros(len(open_)), 0
            base = mix(elements[at], 1000 + slab)
            while len(at):
                h = mix(base + U64(throw * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF), 7)
                rank = rank - np.log(((h >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / (high - low)
                near = rank <= reach[doc[at]]
                at, rank, base, h = at[near], rank[near], base[near], h[near]
                g = mix(h, 13)
                hit = low + (high - low) * ((g >> U64(32)).astype(np.float64) * 2.0**-32) < weights[at]
                place = doc[at[hit]] * t + (g[hit] & U64(0xFFFFFFFF)).astype(np.int64) % t
                r, name = rank[hit], h[hit]
                better = np.flatnonzero(r < best[place])
                order = better[np.argsort(-r[better], kind="stable")]  # the smallest comes last and stays
                best[place[order]], kept[place[order]] = r[order], name[order]
                throw += 1
            slab += 1
            low, high = high, high * 2
            open_ = open_[weights[open_] > low]
        full = np.isfinite(best.reshape(n_docs, t)).all(1) & todo
        out[full] = kept.reshape(n_docs, t)[full]
        todo &= ~full
        reach *= 2
    return out


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text) of the rows that can be linked; t1 and t2 are 128 bits that stand for the text."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return own.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighting: str = "unit") -> DataFrame:
    """(doc_id, t1, t2, set_id, bands array<long>) of the rows with words. set_id: 128 bits of the shingle set."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sets, keys = [], [], []
            part, room = [], 0
            found = [(i, s) for i, x in enumerate(b.column(3).to_pylist()) if len(s := shingles(x))]
            for k, (i, s) in enumerate(found):
                part.append((i, *np.unique(s, return_counts=True)))
                room += len(part[-1][1])
                if room > 200_000 or k == len(found) - 1:
                    doc = np.repeat(np.arange(len(part)), [len(e) for _, e, _ in part])
                    elements = np.concatenate([e for _, e, _ in part])
                    weights = np.concatenate([c for _, _, c in part]).astype(np.float64) if weighting == "count" else np.ones(len(doc))
                    sig = dart_signatures(elements, weights, doc, len(part), t).reshape(len(part), bands, rows)
                    key = np.broadcast_to(np.arange(bands, dtype=U64), (len(part), bands)).copy()
                    for r in range(rows):
                        key = mix(key ^ sig[:, :, r], 17 + r)
                    keys.append(key.astype(np.int64))
                    at += [i for i, _, _ in part]
                    sets += [xxhash.xxh3_128_digest(e.tobytes() + c.tobytes() if weighting == "count" else e.tobytes()) for _, e, c in part]
                    part, room = [], 0
            flat = np.concatenate(keys).ravel() if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * bands, pa.int32()), pa.array(flat))
            own = [b.column(k).take(pa.array(at, pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sets, pa.binary()), lists], ["doc_id", "t1", "t2", "set_id", "bands"])

    return texts_of(docs).mapInArrow(run, "doc_id long, t1 long, t2 long, set_id binary, bands array<long>")


def _links(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """A spanning forest of the links between the sets of one pair of blocks (or within one block)."""
    ids, side = pdf["sid"].to_numpy(), pdf["side"].to_numpy()
    sets = [np.frombuffer(x, U64) for x in pdf["shingles"]]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    wide = int(code.max()) + 1 if len(code) else 0
    by_code = np.argsort(code, kind="stable")
    owner, code = owner[by_code], code[by_code]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    chunk = max(1, (1 << 25) // max(1, len(sets)))
    for lo in range(0, wide, chunk):
        a, b = np.searchsorted(code, [lo, lo + chunk])
        m = np.zeros((len(sets), min(chunk, wide - lo)), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        inter += m @ m.T
    union = sizes[:, None] + sizes[None, :] - inter
    close = inter >= least * union - 1e-6
    np.fill_diagonal(close, False)
    if side.max() > side.min():
        close &= side[:, None] != side[None, :]
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(close))), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def distinct_sets(sig: DataFrame) -> DataFrame:
    """(sid, set_id, low, bands): one row for each shingle set; low is the smallest (doc_id, t1, t2) that has it. Checkpointed, so
    that the number given to a set stays the same."""
    sets = sig.groupBy("set_id").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("low"), F.first("bands").alias("bands"))
    return checkpoint(sets).withColumn("sid", F.monotonically_increasing_id())


def verified_links(docs: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b) over the numbers of sets: a spanning forest of those pairs of a candidate component whose similarity is ``least`` or more."""
    banded = sets.select("sid", F.posexplode("bands").alias("band", "key"))
    # band groups of two or more, each set linked to the group's smallest
    first = banded.groupBy("band", "key").agg(F.min("sid").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    star = banded.join(first, ["band", "key"]).filter("sid <> first").select("sid", "first").distinct()
    groups = connected_components(star, "sid", "first").withColumnRenamed("node", "sid").withColumnRenamed("component", "grp")
    # blocks of a group, and the pairs of blocks; 32 blocks at most until a block holds LARGEST sets
    sized = groups.groupBy("grp").agg(F.count("*").alias("m"))
    size = F.least(F.greatest(F.lit(block), F.ceil(F.col("m") / 32)), F.lit(LARGEST))
    sized = sized.withColumn("blocks", F.ceil(F.col("m") / size).cast("int"))
    placed = groups.join(sized, "grp").withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    placed = placed.select("sid", "grp", "blocks", "blk").join(sets.select(F.col("sid").alias("s"), "low"), F.col("sid") == F.col("s"))
    placed = checkpoint(placed.select("sid", "grp", "blocks", "blk", F.col("low.doc_id").alias("d"), F.col("low.t1").alias("h1"), F.col("low.t2").alias("h2")))
    text = texts_of(docs)
    wanted = text.join(placed, (F.col("doc_id") == F.col("d")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")))
    wanted = wanted.select("sid", "grp", "blocks", "blk", "text").dropDuplicates(["sid"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([np.unique(shingles(x)).tobytes() for x in b.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], found], ["sid", "grp", "blocks", "blk", "shingles"])

    cuts = wanted.mapInArrow(cut, "sid long, grp long, blocks int, blk int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = cuts.withColumn("other", other).select("grp", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), F.col("blk").alias("side"), "sid", "shingles")
    return checkpoint(pairs.groupBy("grp", "bi", "bj").applyInPandas(lambda pdf: _links(pdf, least), "a long, b long"))


def _with_class(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, low, best): best is the smallest low of the set's class."""
    classes = connected_components(links, "a", "b")
    linked = sets.select("sid", "low").join(classes, F.col("sid") == F.col("node")).select("sid", "low", "component")
    best = linked.groupBy("component").agg(F.min("low").alias("best"))
    of = linked.join(best, "component").select(F.col("sid").alias("s"), "best")
    return sets.join(of, F.col("sid") == F.col("s"), "left").select("set_id", "low", F.coalesce("best", "low").alias("best"))


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, weighting: str = "unit", block: int = 128) -> DataFrame:
    """(doc_id, class_id) of every distinct doc_id; class_id is the smallest doc_id of its class.

    weighting: "unit" for sets, "count" for shingles weighted by how often they occur; verification is on the sets.
    """
    sig = checkpoint(signatures(docs, bands, rows, weighting))
    sets = distinct_sets(sig)
    links = verified_links(docs, sets, least, block)
    # rows of one doc_id are one document: their sets are linked too
    several = sig.groupBy(F.col("doc_id").alias("d")).agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).filter("x <> y").select("d")
    held = sig.select("doc_id", "set_id").join(several, F.col("doc_id") == F.col("d")).join(sets.select("set_id", "sid"), "set_id").select("doc_id", F.col("sid").alias("b"))
    same = held.join(held.groupBy(F.col("doc_id").alias("d")).agg(F.min("b").alias("a")), F.col("doc_id") == F.col("d")).filter("a <> b").select("a", "b").distinct()
    classes = _with_class(sets, links.unionByName(same)).select("set_id", F.col("best.doc_id").alias("class_id"))
    found = sig.select("doc_id", "set_id").join(classes, "set_id").groupBy(F.col("doc_id").alias("d")).agg(F.min("class_id").alias("class_id"))
    every = docs.select(docs["doc_id"].cast("long").alias("doc_id")).distinct()
    return every.join(found, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, weighting: str = "unit", block: int = 128) -> DataFrame:
    """One row of each class of near-duplicate texts, with the columns it had: that of the smallest doc_id.

    Rows are judged by their texts alone, so two texts that share a doc_id and aren't near-duplicates both stay, and no text goes
    without one of its class that stays. Equal rows of a doc_id and text leave one. Rows of null doc_id and rows without words stay.
    """
    sig = checkpoint(signatures(docs, bands, rows, weighting))
    sets = distinct_sets(sig)
    stay = _with_class(sets, verified_links(docs, sets, least, block)).filter("low = best").select(F.col("low.doc_id").alias("d"), F.col("low.t1").alias("h1"), F.col("low.t2").alias("h2"))
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    # the row travels as one value, so columns of any name pass through
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), doc_id.alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("has_words"))
    judged = packed.filter("doc_id IS NOT NULL AND has_words")
    kept = judged.join(stay, (F.col("doc_id") == F.col("d")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")), "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    return kept.select("row.*").unionByName(packed.filter("doc_id IS NULL OR NOT has_words").select("row.*"))
