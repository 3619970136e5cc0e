"""Exact repeat removal over suffix arrays of shards.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else, in this or another document. Work in
four steps:

1. Anchors. Each window of ``width`` bytes is given to the smallest hashed 32-byte gram inside it, so equal windows,
   wherever they are, belong to equal grams at equal offsets. Neighbouring windows of one gram form a context: the bytes
   from the first window's start to the last one's end. One narrow row per context is shuffled by its gram.
2. Contexts that occur twice or more are repeated in all their windows. Grams with one context alone have no other repeats.
   For all other grams one copy of each distinct context goes on, with its bytes. Grams that hold a large part of all contexts
   are counted by partial aggregation, so that no task meets them whole. Equal contexts agree in 64 bits of the context and 64 of its gram.
3. Shards. Contexts are dealt by gram, so that windows which may be equal meet; each task concatenates those of whole
   grams to shards of bounded size, builds the suffix array by induced sorting and the permuted common prefixes, and
   marks the windows whose neighbour in the array agrees in ``width`` bytes. A gram with more distinct contexts than a shard
   holds is dealt by the windows' own hashes instead, which is exact as well and splits it over all tasks.
4. Marked runs come back to their documents and are cut out.

Defined cases: a null text is empty; texts shorter than ``width`` lose nothing; repeated rows are documents of their own, so each
loses all if long enough; a null doc_id is passed on; empty tables give no rows; other columns are ignored. A text has fewer than 2^31 bytes, as
Spark's values do; the arrays of a task don't grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.suffixes import common_prefixes, suffix_array
from tagloom.runtime import checkpoint, ship, small_batches, store

WIDTH, GRAM = 200, 32
U64 = np.uint64
PIECE = 1 << 22  # bytes that one pass of arrays takes; longer documents come in parts
SHARD = 1 << 20
SHARE = 4096  # a gram with this part of all contexts is frequent
STRETCH = 1 << 21  # rows that a task counts at once
GROUP = 1 << 22  # most bytes of one gram's contexts in a shard
BASE = 0x9E3779B97F4A7C15 | 1
TABLE = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), U64).copy()


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.ones(1, U64), np.full(n, base & 0xFFFFFFFFFFFFFFFF, U64)])


def contexts(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, start, windows) of each context. data: documents one after another, ends: where each ends."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none, none
    with np.errstate(over="ignore"):
        v = TABLE[data]
        h, size, power = v, 1, BASE
        while size < gram:
            h = h[:-size] * U64(power) + h[size:]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            size *= 2
        h = (h ^ h >> U64(29)) * U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        low = h & ~U64(0xFFFFFFFF) | np.arange(len(h), dtype=U64)
        m, size, want = low, 1, width - gram + 1
        while size * 2 <= want:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < want:
            m = np.minimum(m[: len(low) - want + 1], m[want - size : want - size + len(low) - want + 1])
        doc_end = np.repeat(ends, np.diff(np.r_[0, ends]))
        at = np.flatnonzero(np.arange(len(m)) + width <= doc_end[: len(m)])
        if len(at) == 0:
            return none, none, none, none
        anchor = (m[at] & U64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first = np.r_[0, cut]
        start, windows = at[first], np.diff(np.r_[first, len(at)])
        place = _powers(n, BASE)
        sums = np.r_[np.zeros(1, U64), np.cumsum(v * place[:n])]
        stop = start + windows - 1 + width
        # moved to a common power instead of dividing
        code = (sums[stop] - sums[start]) * place[n - start]
        code = (code ^ code >> U64(31)) * U64(0x94D049BB133111EB)
        return h[anchor[first]].view(np.int64), (code ^ windows.astype(U64)).view(np.int64), start, windows


def _pieces(texts: list[str | None], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents long enough, in pieces: ordinals, where in them their parts begin, bytes, ends. A part begins PIECE bytes after the one before it
    and ends width - 1 bytes into the next, so each window is in one part. A context may be cut in two by that: its windows stay under their
    gram, where those of different contexts are compared."""
    held: list[tuple[int, int, bytes]] = []
    room = 0
    for i, t in enumerate(texts):
        x = (t or "").encode("utf-8", "surrogatepass")
        for begin in range(0, len(x) - width + 1, PIECE):
            part = x[begin : begin + PIECE + width - 1]
            if held and room + len(part) > PIECE + width:
                yield _packed(held)
                held, room = [], 0
            held.append((i, begin, part))
            room += len(part)
    if held:
        yield _packed(held)


def _packed(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.frombuffer(b"".join(x[2] for x in held), np.uint8), np.cumsum([len(x[2]) for x in held])


def mark_windows(parts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the runs of windows that also stand at another place in any of the contexts: the bytes they cover."""
    sizes = np.array([len(x) for x in parts])
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    which = np.repeat(np.arange(len(parts)), sizes)
    t = np.zeros(int(sizes.sum()) + len(parts) + 1, np.uint16)
    t[starts + sizes] = 1  # between contexts; no window reaches over it
    at = np.arange(len(which)) + which
    t[at] = np.frombuffer(b"".join(parts), np.uint8)
    t[at] += 2
    used = np.bincount(t, minlength=258) > 0
    dense = (np.cumsum(used) - 1).astype(np.uint16)[t]
    sa = suffix_array(dense, int(used.sum()), width)
    # windows alone have room for width bytes, so none but windows share them
    start = np.zeros(len(t), bool)
    start[at[at - starts[which] <= sizes[which] - width]] = True
    same = common_prefixes(dense, sa, width, start) >= width
    twice = same.copy()
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    twice[before[same]] = True
    edge = np.diff(np.r_[0, twice.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    own = np.searchsorted(starts, first, side="right") - 1
    return own, first - starts[own], last - starts[own] + width


def frequent_grams(rows: DataFrame, share: int | None = None) -> DataFrame:
    """(hot) of grams that hold about a ``share``-th of all rows or more: 2 * share at most, whatever the data.

    A task reports the grams with that part of a stretch of its own rows, so one that has it overall is reported somewhere.
    """
    share = share or SHARE

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0

        def often() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n * share >= room
            first = np.zeros(keep.sum() + 1, np.int64)
            first[0] = room
            return pa.RecordBatch.from_arrays([pa.array(np.r_[0, g[keep]]), pa.array(np.r_[0, n[keep]]), pa.array(first)], ["fp", "n", "total"])

        for b in batches:
            held.append(b.column(0).to_numpy())
            room += len(held[-1])
            if room > STRETCH:
                yield often()
                held, room = [], 0
        if room:
            yield often()

    seen = checkpoint(rows.select("fp").mapInArrow(counted, "fp long, n long, total long"))
    everything = seen.agg(F.sum("total").alias("all"))  # one row
    often = seen.groupBy("fp").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(everything)).filter(F.col("n") * (2 * share) >= F.greatest("all", F.lit(1)))
    return checkpoint(often.select(F.col("fp").alias("hot")))


def context_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences of repeated contexts, one copy of each distinct context under a gram of several), from rows of all contexts.

    Rare grams meet their rows in a window. Frequent ones are counted by partial aggregation, and their rows find the counts by a join
    that may be split, so no task sees all rows of such a gram.
    """
    hot = F.broadcast(frequent_grams(rows))  # fewer than 2 * SHARE rows
    own = ["fp", "rid", "r2", "lo", "windows"]
    group, copies = Window.partitionBy("fp"), Window.partitionBy("fp", "ctx")
    rare = rows.join(hot, F.col("fp") == F.col("hot"), "left_anti")
    rare = rare.withColumn("mixed", F.min("ctx").over(group) != F.max("ctx").over(group)).withColumn("n", F.count("*").over(copies))
    rare = rare.filter("mixed OR n > 1").withColumn("nth", F.row_number().over(copies.orderBy("rid", "r2", "lo")))
    rare = store(rare.select(*own, "mixed", "n", "nth"))
    much = rows.join(hot, F.col("fp") == F.col("hot"), "left_semi")
    kinds = checkpoint(much.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("rid", "r2", "lo", "windows")).alias("one")))
    several = kinds.groupBy(F.col("fp").alias("g")).agg(F.count("*").alias("k")).filter("k > 1").select("g")
    alone = kinds.join(F.broadcast(several), F.col("fp") == F.col("g"), "left_semi").select("fp", "one.*")
    again = kinds.filter("n > 1").select(F.col("fp").alias("g"), F.col("ctx").alias("c"))
    repeated = much.join(again, (F.col("fp") == F.col("g")) & (F.col("ctx") == F.col("c"))).select(*own)
    return rare.filter("n > 1").select(*own).unionByName(repeated), rare.filter("mixed AND nth = 1").select(*own).unionByName(alone.select(*own))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rid, r2, start, end) byte spans, which may overlap, of repeated strings. rid, r2: 96 bits of doc_id and text."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    own = keyed(docs)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, r2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for which, offset, data, ends in _pieces(b.column(2).to_pylist(), width):
                fp, ctx, start, windows = contexts(data, ends, width)
                k = np.searchsorted(ends, start, side="right")
                begin = np.r_[0, ends[:-1]][k] - offset[k]
                doc = which[k]
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(ctx), pa.array(rid[doc]), pa.array(r2[doc]), pa.array((start - begin).astype(np.int32)), pa.array(windows.astype(np.int32))], ["fp", "ctx", "rid", "r2", "lo", "windows"])

    rows = store(own.select("rid", "r2", "text").mapInArrow(anchored, "fp long, ctx long, rid long, r2 int, lo int, windows int"))
    again, alone = context_groups(rows)
    whole = again.select("rid", "r2", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") + (width - 1)).alias("end"))
    large = alone.groupBy("fp").agg(F.sum(F.col("windows") + width).alias("bytes")).filter(F.col("bytes") > GROUP).select(F.col("fp").alias("wide"))
    wanted = alone.join(large, alone["fp"] == large["wide"], "left").groupBy("rid", "r2").agg(F.collect_list(F.struct("fp", "lo", "windows", F.col("wide").isNotNull().alias("wide"))).alias("at"))
    wanted = wanted.withColumnRenamed("rid", "r").withColumnRenamed("r2", "s")
    texts = own.select("rid", "r2", "text").join(wanted, (F.col("rid") == F.col("r")) & (F.col("r2") == F.col("s"))).select("rid", "r2", "text", "at")
    # equal rows share a rid and give their contexts twice, which are repeated anyway
    found = store(_cut_out(texts, width))
    shards = found.filter("NOT wide").repartition("fp").sortWithinPartitions("fp")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        room = 0

        def emit(part: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
            own, start, end = mark_windows([x[4] for x in part], width)
            rid, r2, lo = (np.array([x[k] for x in part], np.int64)[own] for k in (1, 2, 3))
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(r2.astype(np.int32)), pa.array((lo + start).astype(np.int32)), pa.array((lo + end).astype(np.int32))], ["rid", "r2", "start", "end"])

        for b in batches:
            for fp, rid, r2, lo, x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if room > SHARD and held[-1][0] != fp:
                    yield emit(held)
                    held, room = [], 0
                held.append((fp, rid, r2, lo, x))
                room += len(x)
        if held:
            yield emit(held)

    by_shard = shards.select("fp", "rid", "r2", "lo", "bytes").mapInArrow(marked, "rid long, r2 int, start int, end int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, r2, lo, x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                n = len(x) - width + 1
                key = np.array([xxhash.xxh3_128_intdigest(x[i : i + width]).to_bytes(16, "big") for i in range(n)], object)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(np.full(n, rid)), pa.array(np.full(n, r2, np.int32)), pa.array(np.arange(lo, lo + n, dtype=np.int32))], ["key", "rid", "r2", "start"])

    exploded = found.filter("wide").select("rid", "r2", "lo", "bytes").mapInArrow(windows, "key binary, rid long, r2 int, start int")
    twice = exploded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"))
    by_hash = exploded.join(twice, F.col("key") == F.col("k")).select("rid", "r2", "start", (F.col("start") + width).alias("end"))
    return whole.unionByName(by_shard).unionByName(by_hash)


def _cut_out(texts: DataFrame, width: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            out = [(p["fp"], rid, r2, p["lo"], x[p["lo"] : p["lo"] + p["windows"] + width - 1], p["wide"]) for rid, r2, text, at in rows for x in [text.encode("utf-8", "surrogatepass")] for p in at]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["fp", "rid", "r2", "lo", "bytes", "wide"])

    return texts.mapInArrow(cut, "fp long, rid long, r2 int, lo int, bytes binary, wide boolean")


def keyed(docs: DataFrame) -> DataFrame:
    """(rid, r2, doc_id, text). Equal rows share a rid and r2, and so their spans."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    own = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    return own.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("rid"), F.hash("doc_id", "text").alias("r2"), "doc_id", "text")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spans = repeated_spans(docs, width).groupBy(F.col("rid").alias("r"), F.col("r2").alias("s")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    own = keyed(docs)
    joined = own.join(spans, (F.col("rid") == F.col("r")) & (F.col("r2") == F.col("s")), "left").select("doc_id", "text", "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = (text or "").encode("utf-8", "surrogatepass")
                cut = merge_spans([(s["start"], s["end"]) for s in found or []])
                edges = [0, *(e for s in cut for e in s), len(x)]
                kept = hashlib.sha256(b"".join(x[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))).hexdigest()
                out.append((len(x), sum(z - a for a, z in cut), len(cut), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
