"""Spelling variant grouping by Bloom-guided neighbourhoods.

Words are counted in every task before they are shuffled. The vocabulary then goes into blocked Bloom filters, sharded by word length: a key sets one bit in
each of the eight 64-bit lanes of one block, so a probe touches one cache line. Tasks make the blocks, Spark ORs them, and the filters are broadcast. Their
size is bounded by ``most_blocks`` (64 bytes each), whatever the vocabulary: beyond the bound they only let more pass.

Every word probes its edits: each deletion against the filter of the next shorter words, and each replacement by a larger letter of the vocabulary's
alphabet against that of its own length. An insertion is the deletion seen from the longer word, and a replacement by a smaller letter the one seen from the other
word, so every pair is met from one side. Hashes are sums over the letters, so an edit's hash is that of the word and one difference, in numpy over
whole batches. Only positives are shuffled, as pairs of 64-bit hashes; joins with the vocabulary on them give the words back, and comparing the edited word
removes false positives and collisions. No partner is lost, as a Bloom filter has no false negatives.

Defined cases: a null text has no words; a null doc_id is written as the empty text where a doc_id is hashed; repeated rows count each; ties go to the smaller word in
code-point order; a word of any length is read whole (its edits in pieces); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.runtime import checkpoint, ship, small_batches, store

# The letters of a run.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

FLUSH = 1 << 18  # distinct words that a task holds before it passes their counts on
CELLS = 1 << 19  # edits that are hashed at a time
LAST = 32  # the shard of all words of this length and more
BITS = 16  # of a filter, for each word, as long as the bound allows
LANES = 8
U = np.uint64


def document_words(text: str, doc_id: int | None, drop_every: int | None) -> Counter:
    """The lower-cased runs of a whole text. With drop_every, a run whose crc32 with the doc_id it divides loses one letter."""
    raw = Counter(RUN.findall(text))
    out: Counter = Counter()
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    low: Counter = Counter()
    for w, n in raw.items():
        low[w.lower() if w.isascii() else w.translate(LOWER)] += n
    for w, n in low.items():
        if drop_every:
            h = zlib.crc32(w.encode(), salt)
            if h % drop_every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
        out[w] += n
    return out


def count_words(docs: DataFrame, least_length: int = 5, least_n: int = 3, drop_every: int | None = None) -> DataFrame:
    """(word, n) of all words of at least that length that occur at least that often in all documents."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in document_words(text or "", doc_id, drop_every).items():
                    if len(w) >= least_length:
                        held[w] += n
                if len(held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def letter_hash(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U) * U(0x9E3779B97F4A7C15) + U(1))


def place_hash(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=U) + U(1 << 40)) | U(1)


def letters(words: list[str]) -> np.ndarray:
    """Code points, a row for each of the words, which have one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, code points) for each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield int(n), at, letters([words[i] for i in at])


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return (letter_hash(codes) * place_hash(codes.shape[1])).sum(axis=1, dtype=U)


class Filters:
    """Blocked Bloom filters, one shard after the other in one array of blocks."""

    def __init__(self, counts: dict[int, int], most_blocks: int) -> None:
        blocks = {s: 1 << max(0, (n * BITS - 1) // (64 * LANES)).bit_length() for s, n in sorted(counts.items())}
        while sum(blocks.values()) > most_blocks and max(blocks.values()) > 1:
            blocks = {s: max(1, n // 2) for s, n in blocks.items()}
        self.sizes, self.starts, self.total = blocks, {}, 0
        for s, n in blocks.items():
            self.starts[s] = self.total
            self.total += n
        self.bits: np.ndarray | None = None  # (blocks, lanes)

    def place(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash and the number from which its bits are read, six bits for each lane."""
        shard = min(length, LAST)
        return (mix(hashes) & U(self.sizes[shard] - 1)).astype(np.int64) + self.starts[shard], mix(hashes ^ U(0xD6E8FEB86659FD93))

    @staticmethod
    def lane(picks: np.ndarray, k: int) -> np.ndarray:
        return U(1) << ((picks >> U(6 * k)) & U(63))

    def holds(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be words of this length."""
        if min(length, LAST) not in self.sizes:
            return np.zeros(0, np.int64)
        block, picks = self.place(length, hashes)
        at = np.arange(len(hashes))
        for k in range(LANES):
            ok = (self.bits[block, k] & self.lane(picks, k)) != 0
            at, block, picks = at[ok], block[ok], picks[ok]
        return at


def edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length, in pieces: (length after, row, place, letter or 0 for a deletion, hash). A deletion within equal
    neighbours is that of the first."""
    n, size = codes.shape
    values, places = letter_hash(codes), place_hash(size)
    here = values * places
    total = here.sum(axis=1, dtype=U)
    # without letter i: what stands before it, and what stands after it one place to the left
    before = np.cumsum(here, axis=1, dtype=U) - here
    moved = values[:, 1:] * places[:-1]
    after = np.zeros_like(values)
    after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=U)[:, ::-1]
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(new)
    if size > 1:
        yield size - 1, row, place, np.zeros(len(row), np.uint32), (before + after)[row, place]
    chars = letter_hash(alphabet)
    step = max(1, CELLS // max(1, n * len(alphabet)))
    for begin in range(0, size, step):
        part = slice(begin, begin + step)
        larger = alphabet[None, None, :] > codes[:, part, None]
        keys = total[:, None, None] + (chars[None, None, :] - values[:, part, None]) * places[None, part, None]
        row, place, letter = np.nonzero(larger)
        yield size, row, place + begin, alphabet[letter], keys[larger]


def _words(batches: Iterator[pa.RecordBatch], most: int = 8192) -> Iterator[list[str]]:
    """The words of a table's batches, in lists of about that many; long words make shorter lists."""
    held: list[str] = []
    chars = 0
    for b in batches:
        for w in b.column("word").to_pylist():
            held.append(w)
            chars += len(w)
            if len(held) >= most or chars > 1 << 20:
                yield held
                held, chars = [], 0
    if held:
        yield held


def _hashed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            h = np.zeros(len(words), U)
            for _, at, codes in by_length(words):
                h[at] = word_hashes(codes)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(h.view(np.int64))], ["word", "n", "h"])

    return words.mapInArrow(run, "word string, n long, h long")


def build_filters(vocabulary: DataFrame, most_blocks: int) -> tuple[Filters, np.ndarray]:
    """The filters of (word, n, h), and the alphabet. The driver gets a row for each shard, each letter and each block that holds a word."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: Counter = Counter()
        seen: set[int] = set()
        for words in _words(batches):
            for n, at, codes in by_length(words):
                sizes[min(n, LAST)] += len(at)
                seen.update(np.unique(codes).tolist())
        rows = [(0, s, n) for s, n in sizes.items()] + [(1, c, 1) for c in seen]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["kind", "value", "n"])

    found = vocabulary.select("word").mapInArrow(survey, "kind long, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()
    filters = Filters({r["value"]: r["n"] for r in found if r["kind"] == 0}, most_blocks)
    alphabet = np.array(sorted(r["value"] for r in found if r["kind"] == 1), np.uint32)
    lanes = [f"b{k}" for k in range(LANES)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches, 1 << 16):
            at, bits = [], []
            for n, _, codes in by_length(words):
                block, picks = filters.place(n, word_hashes(codes))
                at.append(block)
                bits.append(np.stack([Filters.lane(picks, k) for k in range(LANES)], axis=1))
            at, bits = np.concatenate(at), np.concatenate(bits)
            order = np.argsort(at, kind="stable")
            at, bits = at[order], bits[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            merged = np.bitwise_or.reduceat(bits, first, axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), *(pa.array(np.ascontiguousarray(merged[:, k])) for k in range(LANES))], ["block", *lanes])

    made = vocabulary.select("word").mapInArrow(blocks, "block long, " + ", ".join(f"{c} long" for c in lanes)).groupBy("block").agg(*[F.bit_or(c).alias(c) for c in lanes]).toArrow()
    filters.bits = np.zeros((filters.total, LANES), U)
    if made.num_rows:
        filters.bits[made["block"].to_numpy()] = np.stack([made[c].to_numpy() for c in lanes], axis=1).view(U)
    return filters, alphabet


def near_words(vocabulary: DataFrame, most_blocks: int = 1 << 19) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words of (word, n, h) that differ by one letter inserted, deleted or replaced, once. a is the longer one."""
    filters, alphabet = build_filters(vocabulary, most_blocks)
    sent = vocabulary.sparkSession.sparkContext.broadcast((filters, alphabet))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, alphabet = sent.value
        for words in _words(batches):
            for _, _, codes in by_length(words):
                rows = max(1, CELLS // (codes.shape[1] * len(alphabet)))
                for begin in range(0, len(codes), rows):
                    some = codes[begin : begin + rows]
                    own = word_hashes(some).view(np.int64)
                    for length, row, place, letter, key in edits(some, alphabet):
                        at = filters.holds(length, key)
                        if len(at):
                            said = [chr(c) if c else "" for c in letter[at].tolist()]
                            yield pa.RecordBatch.from_arrays([pa.array(own[row[at]]), pa.array(key[at].view(np.int64)), pa.array(place[at].astype(np.int32)), pa.array(said, pa.string())], ["src", "key", "place", "letter"])

    met = vocabulary.select("word").mapInArrow(probe, "src long, key long, place int, letter string")
    a = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("h").alias("h_a"))
    b = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("h").alias("h_b"))
    pairs = met.join(b, F.col("key") == F.col("h_b")).join(a, F.col("src") == F.col("h_a"))
    edited = F.concat(F.substring("a", F.lit(1), F.col("place")), F.col("letter"), F.substring("a", F.col("place") + 2, F.length("a")))
    return pairs.filter(F.col("b") == edited).select("a", "n_a", "b", "n_b")


def spelling_variants(words: DataFrame, ratio: float = 2.0, most_blocks: int = 1 << 19) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of (word, n), whose words are distinct and not null. A word's form is its most frequent near word, if
    that occurs at least ``ratio`` times as often; its root is where forms lead to. Forms grow by more than the ratio's factor, so paths are short and are
    doubled in a few rounds of joins."""
    if ratio <= 1:
        raise ValueError("spelling_variants: ratio must be above 1")
    ship(words.sparkSession)
    vocabulary = store(_hashed(words.select("word", F.col("n").cast("long").alias("n"))))
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n"))
    both = near_words(vocabulary, most_blocks).select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near"))))
    per = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= F.col("n") * F.lit(float(ratio))
    per = checkpoint(per.select("word", F.when(taken, F.col("best.near")).alias("form"), "n", "n_near", F.when(taken, -F.col("best.less")).alias("form_n")))
    roots = checkpoint(per.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("w"), F.col("root").alias("next"))
        moved = checkpoint(roots.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        roots = moved.select("word", "root")
        if moved.filter("went").isEmpty():
            break
    out = per.join(roots.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
