"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts, share their lowest order. For class c, word w and history h:

    P_c(w | h) = max(n_c(h, w) - D, 0) / n_c(h) + rest_c(h) * P_c(w)
    P_c(w)     = max(N_c(. w) - D, 0) / N_c(..) + rest_c * P(w)
    P(w)       = (df(w) + 1) / (sum of df + buckets)

rest is the mass that discounts (and pruned rare entries) leave, n are counts, N numbers of distinct neighbours (continuation counts), D the class's absolute discount for the order, n1 / (n1 + 2 n2).
The shared backoff df counts, over every document of the table, the documents that hold the word: the continuation idea for
whole texts, and what smooths expressions that neither class has shown. It is gathered from the whole corpus and follows its size.

Words are lower-cased and hashed to a fixed number of buckets, which bounds the model's tables (and so what is broadcast)
whatever the corpus. The class counts come from labelled training rows: at most ``most`` documents of each class, those
first in a seeded order (a documented bound). A quarter of them is held back from the counts to calibrate: a logistic fit
maps the difference of the two length-normalised log-likelihoods to a score.

Labels are read only for rows whose crc32(doc_id as text) mod 5 is not 0; labels, lang, source and doc_id are no inputs.

Defined cases: null and empty texts have difference 0 and the score that the fit gives for it; a null doc_id is never labelled
and held_out is null; repeated rows score alike; label rows that disagree count as toxic; without a training row of
either class every score is the same and below 0.5; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.runtime import checkpoint, ship, small_batches

BITS = 21
BUCKETS = 1 << BITS
KNOWN = 150_000
MOST, MARGIN = 4.0, 2.0


class Buckets(dict):
    """word -> bucket, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        return out


_BUCKETS = Buckets()


def words_of(text: str | None) -> np.ndarray:
    """The buckets of a text's lower-cased words, stripped of punctuation at both ends."""
    if not text:
        return np.empty(0, np.int64)
    return np.fromiter(map(_BUCKETS.__getitem__, text.lower().split()), np.int64)


def sketches(words: np.ndarray) -> tuple[int, int]:
    """Two minima over hashed five-word windows: copies and most near copies of a text share one."""
    w = words.astype(np.uint64) + np.uint64(1)
    key = np.zeros(max(len(w) - 4, 1), np.uint64)
    for k in range(min(5, len(w))):
        key = (key ^ w[k : k + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    other = (key ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)
    return int(key.min()), int((other ^ other >> np.uint64(32)).min())


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in wanted, positions in the sorted keys) of what is found."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    return hit, at[hit]


@dataclass
class Model:
    """The classes ordinary (0) and toxic (1): the shared counts of all buckets, and of each class what it has established."""

    df: np.ndarray  # documents that hold each bucket
    total: float  # of df and one more for each bucket
    word: np.ndarray  # sorted established buckets
    part: np.ndarray  # 2 x words, discounted part of the unigram
    rest: np.ndarray  # 2, weight of the shared order in the unigram
    history: np.ndarray  # sorted buckets that established pairs begin with
    back: np.ndarray  # 2 x histories, weight of the unigram after each
    pairs: np.ndarray  # sorted keys h << BITS | w
    pair_p: np.ndarray  # 2 x pairs, discounted part
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def unigram(self, words: np.ndarray) -> np.ndarray:
        """2 x words, interpolated with the shared order."""
        p = self.rest[:, None] * ((self.df[words] + 1.0) / self.total)
        hit, at = _place(self.word, words)
        p[:, hit] += self.part[:, at]
        return p

    def difference(self, words: np.ndarray) -> np.ndarray:
        """For each word log P_toxic - log P_ordinary after the one before it."""
        if len(words) == 0:
            return np.empty(0)
        p = self.unigram(words)
        if len(words) > 1:
            hit, at = _place(self.history, words[:-1])
            p[:, hit + 1] *= self.back[:, at]
            hit, at = _place(self.pairs, words[:-1] << BITS | words[1:])
            p[:, hit + 1] += self.pair_p[:, at]
        return np.log(p[1]) - np.log(p[0])

    def features(self, words: np.ndarray) -> tuple[float, ...]:
        """Two values for each word on average: the difference, no word counting for more than MOST, and the logarithm of the part of it above
        MARGIN, which the word-by-word noise of ordinary texts rarely reaches."""
        d = np.clip(self.difference(words), -MOST, MOST)
        n = max(len(d), 1)
        return float(d.sum()) / n, float(np.log(float(np.maximum(d - MARGIN, 0.0).sum()) / n + 1e-3))


def discount(n1: int, n2: int) -> float:
    """The usual estimate from how many things are counted once and twice."""
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


@dataclass
class Counts:
    """What is left of the class counts after pruning, for the classes 0 and 1; all that the driver sees of them."""

    word: np.ndarray  # buckets of established words
    before: np.ndarray  # 2 x words, continuation counts
    continuations: list[tuple[int, int, int]]  # for each class: sum, words of one, words of two
    pair: np.ndarray  # sorted keys h << BITS | w of established pairs
    times: np.ndarray  # 2 x pairs
    history: np.ndarray  # 2 x pairs, how often the pair's history occurs
    once_twice: list[tuple[int, int]]  # for each class: pairs counted once, twice


def class_counts(pairs: DataFrame, holders: DataFrame, fewest: int) -> Counts:
    """From pairs (cls, h, w, n) and holders (cls, w, n: documents of the class that hold the word).

    A word's continuation count is its number of distinct histories, at most its number of documents: neither one
    document's pattern nor the copies of one document make an expression common.

    Words with fewer than ``fewest`` continuations in both classes together, pairs that hold such a word and pairs counted
    fewer times are pruned; the mass that pruning and discounts leave goes to the next lower order, so rare expressions
    are the shared backoff's alone.
    """
    of = lambda c, x: F.coalesce(F.sum(F.when(F.col("cls") == c, F.col(x))), F.lit(0))
    d = holders.select(F.col("cls").alias("dc"), F.col("w").alias("dw"), F.col("n").alias("docs"))
    words = pairs.groupBy("cls", "w").agg(F.count("*").alias("histories")).join(d, (F.col("cls") == F.col("dc")) & (F.col("w") == F.col("dw")))
    words = checkpoint(words.select("cls", "w", F.least("histories", "docs").alias("b")))
    sums = {r["cls"]: (r["s"], r["n1"], r["n2"]) for r in words.groupBy("cls").agg(F.sum("b").alias("s"), F.count_if(F.col("b") == 1).alias("n1"), F.count_if(F.col("b") == 2).alias("n2")).collect()}
    often = checkpoint(words.groupBy("w").agg(of(0, "b").alias("b0"), of(1, "b").alias("b1")).filter(F.col("b0") + F.col("b1") >= fewest))
    single = {r["cls"]: (r["n1"], r["n2"]) for r in pairs.groupBy("cls").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
    good = pairs.join(often.select("w"), "w", "left_semi").join(often.select(F.col("w").alias("h")), "h", "left_semi")
    good = good.groupBy("h", "w").agg(of(0, "n").alias("n0"), of(1, "n").alias("n1")).filter(F.col("n0") + F.col("n1") >= fewest)
    after = pairs.groupBy(F.col("h").alias("hh")).agg(of(0, "n").alias("h0"), of(1, "n").alias("h1"))
    good = good.join(after, F.col("h") == F.col("hh")).select((F.col("h") * BUCKETS + F.col("w")).alias("key"), "n0", "n1", "h0", "h1")
    w, k = often.toArrow(), good.toArrow().sort_by("key")
    get = lambda t, *names: np.stack([t.column(x).to_numpy() for x in names])
    return Counts(get(w, "w")[0], get(w, "b0", "b1"), [sums.get(c, (0, 0, 0)) for c in (0, 1)], get(k, "key")[0], get(k, "n0", "n1"), get(k, "h0", "h1"), [single.get(c, (0, 0)) for c in (0, 1)])


def fit_model(counts: Counts, df: np.ndarray) -> Model:
    """From the class counts and the shared document frequencies of all buckets."""
    order = np.argsort(counts.word)
    history = np.unique(counts.pair >> BITS)
    at = np.searchsorted(history, counts.pair >> BITS)
    part, pair_p, back = np.zeros((2, len(order))), np.zeros((2, len(counts.pair))), np.ones((2, len(history)))
    for c in (0, 1):
        total, n1, n2 = counts.continuations[c]
        part[c] = np.maximum(counts.before[c][order] - discount(n1, n2), 0) / max(total, 1)
        pair_p[c] = np.maximum(counts.times[c] - discount(*counts.once_twice[c]), 0) / np.maximum(counts.history[c], 1)
        back[c] -= np.bincount(at, pair_p[c], len(history))
    return Model(df, float(df.sum(dtype=np.float64)) + BUCKETS, counts.word[order], part, 1 - part.sum(1), history, np.maximum(back, 1e-6), counts.pair, pair_p)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of the features and a constant, by Newton steps on standardised features."""
    if len(y) == 0 or y.min() == y.max():
        share = 0.49 * float(y.mean()) if len(y) else 0.0
        return (*[0.0] * x.shape[1], float(np.log(max(share, 1e-9) / (1 - share))))
    mean, sd = x.mean(0), x.std(0) + 1e-12
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z / len(y) + ridge * np.diag([*[1.0] * x.shape[1], 0.0])
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    raw = w[:-1] / sd
    return (*map(float, raw), float(w[-1] - (raw * mean).sum()))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(bucket, df) over all documents: summed within tasks first, so a task sends at most one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    df[np.unique(words_of(text))] += 1
        at = np.flatnonzero(df)
        for lo in range(0, len(at), 1 << 18):
            part = at[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(df[part])], ["bucket", "df"])

    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").cast("float").alias("df"))


def gathered_frequencies(docs: DataFrame) -> np.ndarray:
    """The same as an array over all buckets: eight bytes for each bucket reach the driver, whatever the corpus."""
    rows = document_frequencies(docs).toArrow()
    df = np.zeros(BUCKETS, np.float32)
    for b in rows.to_batches():
        df[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return df


def training_labels(labels: DataFrame) -> DataFrame:
    """(id, toxic): one row for each labelled training document."""
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(in_training(F.col("doc_id")))
    return own.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def training_sample(docs: DataFrame, own: DataFrame, shares: dict[int, int], most: int, seed: int) -> DataFrame:
    """(text, id, toxic, calibrate) of at most ``most`` training documents of each class, and equally many, so that neither
    class's model is smoother than the other's."""
    order = F.xxhash64(F.col("id"), F.lit(seed))
    fewer = min([most, *shares.values()])
    ids = [own.filter(F.col("toxic") == c).orderBy(order, "id").limit(fewer) for c in (0, 1)]
    chosen = ids[0].unionByName(ids[1]).withColumn("calibrate", F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 1)), F.lit(4)) == 0)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.join(F.broadcast(chosen), d["doc_id"] == F.col("id")).select("text", "id", "toxic", "calibrate")  # at most 2 * most rows


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, fewest: int = 10, seed: int = 7) -> Model:
    """Counts in Spark; what reaches the driver is bounded by ``most`` and by the number of buckets."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(0).to_pylist()]
            keys = np.array([sketches(w) for w in words], np.uint64).astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([w.astype(np.int32) for w in words], pa.list_(pa.int32()))], ["id", "toxic", "calibrate", "k0", "k1", "words"])

    own = checkpoint(training_labels(labels))
    shares = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    sample = training_sample(docs, own, shares, most, seed).mapInArrow(coded, "id long, toxic int, calibrate boolean, k0 long, k1 long, words array<int>")
    for k in ("k0", "k1"):  # copies of one document tell what it tells
        sample = sample.withColumn("nth", F.row_number().over(Window.partitionBy(k).orderBy("id"))).filter("nth = 1").drop("nth")
    sample = checkpoint(sample.select("toxic", "calibrate", "words"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for toxic, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = np.asarray(words.values, np.int64) if words.is_valid else np.empty(0, np.int64)
                parts += [np.int64(toxic) << 61 | w[:-1] << BITS | w[1:], np.int64(toxic) << 61 | np.int64(1) << 60 | np.unique(w)]
            key, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    keys = sample.filter("NOT calibrate").select("toxic", "words").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    part = lambda shift, size: F.shiftright("key", shift).bitwiseAND(size - 1)
    keys = checkpoint(keys.select(F.shiftright("key", 61).cast("int").alias("cls"), (part(60, 2) == 1).alias("word"), part(BITS, BUCKETS).alias("h"), part(0, BUCKETS).alias("w"), "n"))
    counts = class_counts(keys.filter("NOT word").drop("word"), keys.filter("word").select("cls", "w", "n"), fewest)
    model = fit_model(counts, gathered_frequencies(docs))
    held = sample.filter("calibrate").select("toxic", "words")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shared.value.features(np.asarray(w.values, np.int64) if w.is_valid else np.empty(0, np.int64)) for w in b.column(1)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, k]) for k in range(2))], ["toxic", "x0", "x1"])

    points = held.mapInArrow(measured, "toxic int, x0 double, x1 double").toPandas().sort_values(["toxic", "x0", "x1"])
    shared.destroy()
    model.weights = fit_logistic(points[["x0", "x1"]].to_numpy(float).reshape(-1, 2), points["toxic"].to_numpy(float))
    if len(shares) == 2:  # the sample is balanced, the labels are not
        model.weights = (*model.weights[:-1], model.weights[-1] + float(np.log(shares[1] / shares[0])))
    return model


def apply_model(docs: DataFrame, model: Model, added: tuple[str, str] = ("__score", "__predicted")) -> DataFrame:
    """docs with the score and what it predicts added, under the names given, after all columns of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = np.array(m.weights)
        for b in batches:
            x = np.array([m.features(words_of(t)) for t in b.column(at).to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, *added])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.IntegerType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels, **params)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    scored = apply_model(own, model)
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they had."""
    longest = max(map(len, docs.columns))
    score, predicted = (f"__{x}".ljust(longest + 1, "_") for x in ("score", "predicted"))  # longer than any name that docs has
    return apply_model(docs, train(docs, labels, **params), (score, predicted)).filter(F.col(predicted) == 0).drop(score, predicted)
