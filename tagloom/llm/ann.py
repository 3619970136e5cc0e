"""Approximate nearest neighbours by shifted space-filling curves.

Distinct vectors are put in several orders: each projects them at random to a few dimensions, shifts them at random inside a
fixed box, and sorts by the place of their cell on a Hilbert curve. Spark range-partitions and sorts every order, which gives
each vector a rank in it. A query looks at the vectors whose rank is at most W away in any order; the candidates of a block of
ranks and the queries that reach into it meet in one task, which keeps each query's nearest few; merging those over blocks and
orders gives the result. Distances are those of the original vectors, in double precision.

Blocks have a fixed number of ranks, and a block with many queries is dealt to several tasks, so no task grows with the data.

W is fitted: for a bounded sample of queries (``pilot``) the true neighbours are found by brute force, and W is
what covers a share ``aim`` of them in at least one order. Clustered vectors so get narrow windows, unstructured ones wide
windows. Every vector is indexed.

Equal vectors share one place in the orders and are expanded after the search; as no more than ``k + 1`` of them can matter,
those of smallest vec_id are kept for it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows of null vec_id;
vectors of another length than the longest common one take no part; repeated rows count once; fewer candidates than k give
fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.hilbert import hilbert_keys
from tagloom.runtime import checkpoint, ship, small_batches

BITS = 10


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as floats if they are stored so, else as doubles; adding zero makes both zeros one."""
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(vectors[id_col].cast("long").alias("id"), F.transform(vectors[vec_col], lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0.0)).distinct()


def orderings(rows: DataFrame, dims: int, curves: int, target: int, box: tuple[list, list], seed: int) -> DataFrame:
    """(curve, key, rep, v): every vector once for each order. box: the smallest and largest projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            for c in range(curves):
                p, shift = projection(dims, target, c, seed)
                low, high = np.array(box[0][c]), np.array(box[1][c])
                z = (x @ p - low) / np.maximum(high - low, 1e-300) * 0.5 + shift
                cells = np.clip(z * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                keys = hilbert_keys(cells, BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), b.column(0), b.column(1)], ["curve", "key", "rep", "v"])

    return rows.select("rep", "v").mapInArrow(run, f"curve int, key binary, rep long, v {rows.schema['v'].dataType.simpleString()}")


def projection(dims: int, target: int, curve: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed + curve)
    return r.randn(dims, target) / np.sqrt(dims), r.rand(target) * 0.5


def _box(rows: DataFrame, dims: int, curves: int, target: int, seed: int) -> tuple[list, list]:
    """Smallest and largest projection for each order and dimension: one row per task, then one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((curves, target), np.inf), np.full((curves, target), -np.inf)
        for b in batches:
            x = _matrix(b.column(0))
            for c in range(curves if len(x) else 0):
                y = x @ projection(dims, target, c, seed)[0]
                low[c], high[c] = np.minimum(low[c], y.min(0)), np.maximum(high[c], y.max(0))
        at = np.arange(curves * target)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(low.ravel()), pa.array(high.ravel())], ["at", "low", "high"])

    got = rows.select("v").mapInArrow(run, "at long, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("at")
    return got["low"].to_numpy().reshape(curves, target).tolist(), got["high"].to_numpy().reshape(curves, target).tolist()


def _ranked(ordered: DataFrame, curves: int) -> tuple[DataFrame, int]:
    """Ranks within each order, from the row numbers of range-sorted partitions; the driver sees one count per partition."""
    spark = ordered.sparkSession
    parts = max(curves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = checkpoint(ordered.repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep"))
    numbered = sorted_.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = numbered.groupBy("part").agg(F.count("*").alias("n")).toPandas().sort_values("part")
    offsets = counts["n"].cumsum() - counts["n"]
    total = int(counts["n"].sum()) // curves
    if not total:
        return numbered.withColumn("rank", F.col("row")).drop("part", "row"), 0
    before = dict(zip(counts["part"].tolist(), offsets.tolist(), strict=True))
    table = F.array(*[F.lit(int(before.get(k, 0))) for k in range(max(before) + 1)])  # by partition number
    rank = F.get(table, F.col("part")) + F.col("row") - F.col("curve") * F.lit(total)
    return numbered.withColumn("rank", rank.cast("long")).drop("part", "row"), total


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of the k smallest distances of each query, ties to smaller ids. Candidates are found by products, after a shift that
    brings the vectors around zero, and all go on that come within the rounding of the products of the k-th; their distances are by differences."""
    center = x.mean(0)
    qc, xc = q - center, x - center
    qq, xx = (qc * qc).sum(1), (xc * xc).sum(1)
    d = qq[:, None] + xx[None] - 2 * qc @ xc.T
    if allowed is not None:
        d[~allowed] = np.inf
    m = min(len(x), k)
    last = np.partition(d, m - 1, axis=1)[:, m - 1]
    slack = 1e-13 * (x.shape[1] + 8) * (qq + xx.max())
    i, j = np.nonzero((d <= (last + slack)[:, None]) & np.isfinite(d))
    exact = np.empty(len(i))
    for lo in range(0, len(i), 1 << 16):  # ties may be many
        part = slice(lo, lo + (1 << 16))
        exact[part] = np.sqrt(((q[i[part]] - x[j[part]]) ** 2).sum(1))
    order = np.lexsort((ids[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k], exact[nth < k]


def _fit_window(rows: DataFrame, ranked: DataFrame, queries: DataFrame, total: int, k: int, aim: float, pilot: int, seed: int) -> int:
    """W from a bounded sample of queries, whose true neighbours one pass over the vectors finds."""
    sample = queries.orderBy(F.xxhash64("qrep", F.lit(seed)), "qrep").limit(pilot).toPandas()
    if not len(sample):
        return 1
    q, ids = np.array(sample["qv"].tolist(), np.float64), sample["qrep"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rep = _matrix(b.column(1)), b.column(0).to_numpy()
            if len(x):
                i, j, d = _nearest(q, x, rep, None, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(rep[j]), pa.array(d)], ["qrep", "rep", "d"])

    near = rows.select("rep", "v").mapInArrow(run, "qrep long, rep long, d double").filter("qrep <> rep")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("qrep").orderBy("d", "rep"))).filter(F.col("nth") <= k)
    true = near.select("qrep", "rep").toPandas()
    if not len(true):
        return 1
    wanted = sorted({int(i) for i in [*true["qrep"], *true["rep"]]})  # at most pilot * (k + 1)
    ranks = ranked.filter(F.col("rep").isin(wanted)).select("rep", "curve", "rank").toPandas()
    both = true.merge(ranks.rename(columns={"rep": "qrep", "rank": "qrank"}), on="qrep").merge(ranks, on=["rep", "curve"])
    gap = (both["rank"] - both["qrank"]).abs().groupby([both["qrep"], both["rep"]]).min()
    return int(min(total, max(2 * k, np.ceil(gap.quantile(aim)))))


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, every: int = 100, curves: int = 16, target: int = 8, aim: float = 0.96, pilot: int = 64, seed: int = 11, block: int = 2048, asked_at_once: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    small_batches(spark)
    own = checkpoint(usable(vectors, id_col, vec_col))
    longest = own.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if longest is None:
        return spark.createDataFrame([], schema)
    dims = longest["dims"]
    own = own.filter(F.size("v") == dims)
    # equal vectors: at most k + 1 of smallest id; the limit on the row number is applied before the shuffle as well
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = own.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("v").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids"))
    members = checkpoint(members)
    reps = members.select("rep", "v")
    ranked, total = _ranked(orderings(reps, dims, curves, target, _box(reps, dims, curves, target, seed), seed), curves)
    asked = own.filter(F.col("id") % every == 0).join(members.select(F.col("v").alias("w"), "rep"), F.col("v") == F.col("w"))
    asked = checkpoint(asked.select(F.col("id").alias("query_id"), F.col("rep").alias("qrep")))
    queries = checkpoint(reps.join(asked.select(F.col("qrep").alias("rep")).distinct(), "rep").select(F.col("rep").alias("qrep"), F.col("v").alias("qv")))
    w = _fit_window(reps, ranked, queries, total, k, aim, pilot, seed)
    # the queries that reach into a block, on average, in parts of a bounded number; the block goes to each part
    asked_for = queries.count() * (2 * w + block) / max(total, 1)
    parts = max(1, -int(-asked_for // asked_at_once))
    placed = ranked.select(F.col("curve").alias("xc"), F.floor(F.col("rank") / block).cast("int").alias("xb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("xp"), F.col("rank").alias("xrank"), F.col("rep").alias("xrep"), F.col("v").alias("xv"))
    reach = ranked.select("curve", "rank", "rep").join(queries.select("qrep", "qv"), F.col("rep") == F.col("qrep")).drop("rep")
    blocks = F.sequence(F.floor((F.col("rank") - w) / block).cast("int"), F.floor((F.col("rank") + w) / block).cast("int"))
    reach = reach.select(F.col("curve").alias("c"), F.pmod(F.xxhash64("qrep"), F.lit(parts)).cast("int").alias("p"), F.col("rank").alias("qrank"), "qrep", "qv", F.explode(blocks).alias("b"))

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"qrep": [], "rep": [], "d": []})
        out = []
        xv, xr, xid = np.array(x["xv"].tolist(), np.float64), x["xrank"].to_numpy(), x["xrep"].to_numpy()
        for lo in range(0, len(q), 256):
            part = q.iloc[lo : lo + 256]
            allowed = np.abs(part["qrank"].to_numpy()[:, None] - xr[None]) <= w
            i, j, d = _nearest(np.array(part["qv"].tolist(), np.float64), xv, xid, allowed, k + 1)
            out.append(pd.DataFrame({"qrep": part["qrep"].to_numpy()[i], "rep": xid[j], "d": d}))
        return pd.concat(out)

    found = reach.groupBy("c", "b", "p").cogroup(placed.groupBy("xc", "xb", "xp")).applyInPandas(search, "qrep long, rep long, d double")
    best = found.groupBy("qrep", "rep").agg(F.min("d").alias("d"))
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("qrep").orderBy("d", "rep"))).filter(F.col("nth") <= k + 1).drop("nth")
    full = best.join(members.select("rep", "ids"), "rep").join(asked.withColumnRenamed("qrep", "r"), F.col("qrep") == F.col("r"))
    full = full.select("query_id", F.explode("ids").alias("vec_id"), F.col("d").alias("score")).filter("query_id <> vec_id")
    full = full.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return full.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
