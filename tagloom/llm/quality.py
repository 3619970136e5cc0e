"""Quality rules: base rules on counted statistics, then robust multivariate outliers.

Every text is read once for its statistics. For each language and source a minimum-covariance-determinant estimate is
fitted to transformed statistic vectors of all its documents that pass the base rules. From three deterministic starts (medians and scaled
MADs; mean and covariance; directions from the median) concentration steps take mean and covariance of the h nearest documents by the
distance so far, until the determinants hardly fall; of each group's three ends the one of smallest determinant is kept. A step is a count of rounded distances
and a grouped sum of moments, so a hot source is pre-aggregated in all tasks and only rows per group meet in one
place; the groups' rows are broadcast to the documents if there are few of them. Counts are exact, so verdicts don't depend on the
partitioning. A document is rejected if its squared Mahalanobis distance under the consistency-corrected estimate is above the
cut. Groups lean on the estimate of all documents by a fixed weight, and the covariance is ridged, so a group of equal documents rejects nothing by rounding.

Defined cases: a null text has no words and fails the base rules; null language and null source are groups of their own;
repeated rows count each; a table without documents gives no rows; other columns are ignored. Statistics cover whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.runtime import FEW, checkpoint, ship, small_batches

# The classes of characters and the limits of the base rules.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5

FEATURES = ("f_len", "f_word", "f_symbols", "f_lines", "f_repeats")


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at just the six blanks
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            seen: set[str] = set()
            for line in lines:
                if line in seen:
                    dup += bool(line.strip(BLANKS))
                else:
                    seen.add(line)
    repeated = 0
    if n > WINDOW:
        ids: dict[bytes, int] = {}
        codes = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.uint64, n)
        if len(ids) <= n - WINDOW:  # a window found twice repeats five words at least
            m = n - WINDOW + 1
            if len(ids) < 4096:  # exact: five codes of twelve bits
                key = codes[:m].copy()
                for k in range(1, WINDOW):
                    key = key << np.uint64(12) | codes[k : k + m]
            else:  # exact: number pairs, then pairs of pairs, then the fifth
                pair = np.unique(codes[:-1] << np.uint64(32) | codes[1:], return_inverse=True)[1].astype(np.uint64)
                four = np.unique(pair[:-2] << np.uint64(32) | pair[2:], return_inverse=True)[1].astype(np.uint64)
                key = four[:m] << np.uint64(32) | codes[WINDOW - 1 : WINDOW - 1 + m]
            order = np.sort(key)
            twice = order[1:][order[1:] == order[:-1]]
            if len(twice):
                at = np.flatnonzero(np.isin(key, twice))
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + WINDOW, -1)
                repeated = int((np.cumsum(cover) > 0).sum())
    return n, chars, symbols, dup, repeated


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of each row."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            got = np.array([(*text_counts(t or ""), (t or "").count("\n") + 1) for t in texts], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(got[:, k]) for k in range(6))], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def with_features(stats: DataFrame) -> DataFrame:
    """The transformed vector: logs of length and mean word length, square roots of the shares of symbols, lines and repeats."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "f_len": F.log1p(F.col("n_words")),
            "f_word": F.log1p(F.col("word_chars") / n),
            "f_symbols": F.sqrt(F.col("n_symbols") / n),
            "f_lines": F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
            "f_repeats": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def _distance(center: str = "center", inverse: str = "inverse") -> Column:
    """The squared Mahalanobis distance as a plain expression over the feature columns."""
    p = len(FEATURES)
    d = [F.col(f) - F.col(center)[k] for k, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col(inverse)[i * p + j] * F.lit(1.0 if i == j else 2.0)
    return total


def _quantile(df: DataFrame, keys: list[str], step: str, share: float, out: str) -> DataFrame:
    """(keys, out): the step (a whole number) below which ``share`` of each key's rows lie, the last one included.

    Rows are counted per step first, so a key's window sees its distinct steps alone, and counts don't depend on the partitioning.
    """
    per = df.groupBy(*keys, F.col(step).alias("__s")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    per = per.withColumn("__upto", F.sum("__n").over(w.orderBy("__s"))).withColumn("__all", F.sum("__n").over(w))
    return per.groupBy(*keys).agg(F.min(F.when(F.col("__upto") >= F.ceil(F.col("__all") * share), F.col("__s"))).alias(out))


#: steps of a distance: 1 / LOG_STEPS of a doubling
LOG_STEPS = 128


def _log_step(d: Column) -> Column:
    return F.floor(F.log2(F.greatest(d, F.lit(1e-12))) * LOG_STEPS).cast("int")


def _moments(df: DataFrame) -> DataFrame:
    p = len(FEATURES)
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    return df.groupBy("start", "grp").agg(F.count("*").alias("n"), *sums)


def _estimate(moments: DataFrame, ridge: float, prior: float) -> DataFrame:
    """(start, grp, center, inverse, logdet): one row per start and group, in batches.

    A group's mean and covariance are those of its own documents and, with the weight of ``prior`` documents, those of all: a
    small group leans on the whole, a large one on itself, and nothing changes at a size.
    """
    p = len(FEATURES)
    names = [c for c in moments.columns if c not in ("start", "grp")]
    pool = moments.filter("grp = ''").select(F.col("start").alias("ps"), *[F.col(c).alias(f"p_{c}") for c in names])  # one row per start
    both = moments.join(F.broadcast(pool), F.col("start") == F.col("ps"))  # three rows at most

    def own(row: dict, mark: str) -> tuple[float, np.ndarray, np.ndarray]:
        n = max(row[f"{mark}n"], 1)
        mean = np.array([row[f"{mark}s{i}"] for i in range(p)]) / n
        cov = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = row[f"{mark}s{i}_{j}"] / n - mean[i] * mean[j]
        return n, mean, cov

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                n, mean, cov = own(row, "")
                if row["grp"]:
                    _, whole, spread = own(row, "p_")
                    mean, cov = (n * mean + prior * whole) / (n + prior), (n * cov + prior * spread) / (n + prior)
                cov = cov + ridge * np.eye(p)
                out.append((row["start"], row["grp"], mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["start", "grp", "center", "inverse", "logdet"])

    return both.mapInPandas(run, "start int, grp string, center array<double>, inverse array<double>, logdet double")


def _starts(fit: DataFrame, ridge: float, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(start, grp, center, inverse): three deterministic estimates to begin from. 0: medians and scaled MADs; 1: mean and covariance of
    all; 2: medians, and the covariance of directions from them (each document one unit long in MADs), which far ones don't stretch."""
    p, grid = len(FEATURES), 512
    long = fit.select("grp", F.posexplode(F.array(*FEATURES)).alias("k", "x"))
    mid = _quantile(long.withColumn("step", F.round(F.col("x") * grid).cast("int")), ["grp", "k"], "step", 0.5, "m")
    mid = small(checkpoint(mid.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda v: v["m"] / float(grid)).alias("mid"))))
    off = fit.join(mid, "grp").select("grp", F.posexplode(F.array(*[F.abs(F.col(f) - F.col("mid")[i]) for i, f in enumerate(FEATURES)])).alias("k", "x"))
    mad = _quantile(off.withColumn("step", F.round(F.col("x") * grid).cast("int")), ["grp", "k"], "step", 0.5, "m")
    mad = mad.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda v: F.sqrt(F.pow(v["m"] / float(grid) * 1.4826, 2) + ridge)).alias("mad"))
    scale = small(checkpoint(mid.join(mad, "grp")))
    zero = F.lit(0.0)
    diagonal = scale.select(F.lit(0).alias("start"), "grp", F.col("mid").alias("center"), F.array(*[F.pow(F.col("mad")[i], -2.0) if i == j else zero for i in range(p) for j in range(p)]).alias("inverse"))
    plain = _estimate(_moments(fit.withColumn("start", F.lit(1))), ridge, 0.0).drop("logdet")
    unit = fit.join(scale, "grp").withColumn("z", F.array(*[(F.col(f) - F.col("mid")[i]) / F.col("mad")[i] for i, f in enumerate(FEATURES)]))
    unit = unit.withColumn("len", F.greatest(F.sqrt(F.aggregate("z", zero, lambda acc, v: acc + v * v)), F.lit(1e-9)))
    turned = unit.select(F.lit(2).alias("start"), "grp", *[(F.col("z")[i] / F.col("len") * F.col("mad")[i] * float(np.sqrt(p))).alias(f) for i, f in enumerate(FEATURES)])
    signs = _estimate(_moments(turned), ridge, 0.0).select("start", F.col("grp").alias("g"), "inverse")
    signs = signs.join(scale, F.col("g") == F.col("grp")).select("start", "grp", F.col("mid").alias("center"), "inverse")
    return diagonal.unionByName(plain).unionByName(signs)


def quality_verdicts(docs: DataFrame, keep_share: float = 0.75, most_steps: int = 6, settled: float = 1e-3, cut: float = 60.0, prior: float = 50.0, ridge: float = 2.5e-3) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    keep_share: h as a share of a group. most_steps: concentration steps at most; they end once the logarithms of all determinants together fall
    by less than the share ``settled`` in a step. cut: the squared
    distance above which a document goes; chi-square with five degrees of freedom has its 0.99999 quantile at 31, and skewed
    clean statistics need room above it. prior: how many documents' weight all documents have in a group's estimate. ridge: added to each variance.
    """
    p = len(FEATURES)
    stats = text_statistics(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    named = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))
    stats = with_features(stats.withColumn("base_failed", failed)).withColumn("grp", F.concat_ws("\x1f", named("lang"), named("source")))
    keyed = checkpoint(stats.drop("lang", "source"))
    # the pooled group holds every document
    fit = keyed.filter("NOT base_failed").select("grp", *FEATURES).withColumn("grp", F.explode(F.array(F.col("grp"), F.lit(""))))
    # one row for each group and start: broadcast if they are found to be few
    few = fit.select("grp").distinct().limit(FEW // 3 + 1).count() <= FEW // 3
    small = F.broadcast if few else lambda df: df
    est, logdet = small(checkpoint(_starts(fit, ridge, small))), None
    for _ in range(most_steps):
        far = fit.join(est, "grp").withColumn("step", _log_step(_distance())).select("start", "grp", "step", *FEATURES)
        near = far.join(small(_quantile(far, ["start", "grp"], "step", keep_share, "border")), ["start", "grp"]).filter("step <= border")
        est = small(checkpoint(_estimate(_moments(near), ridge, prior)))
        now = est.agg(F.sum("logdet")).first()[0]  # one row
        if now is None or logdet is not None and logdet - now < settled * abs(now):
            break
        logdet = now
    # of the starts the one that has led to the smallest determinant; then consistency: scaled so that the median distance
    # is that of a chi-square with p degrees of freedom
    best = small(checkpoint(est.groupBy("grp").agg(F.min(F.struct("logdet", "start", "center", "inverse")).alias("b")).select("grp", "b.center", "b.inverse")))
    typical = p * (1 - 2 / (9 * p)) ** 3
    half = _quantile(fit.join(best, "grp").select("grp", _log_step(_distance()).alias("step")), ["grp"], "step", 0.5, "half")
    scale = half.select("grp", F.greatest(F.pow(F.lit(2.0), F.col("half") / float(LOG_STEPS)) / F.lit(typical), F.lit(1.0)).alias("scale"))
    final = small(checkpoint(best.join(scale, "grp").select(F.col("grp").alias("g"), "center", "inverse", "scale")))
    judged = keyed.join(final, keyed["grp"] == F.col("g"), "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
