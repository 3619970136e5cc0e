"""How many points of a key lie before a place and have a larger value, for many places and values at once, without pairs.

Points have a rank by place and one by value. Ranks are cut in blocks, and what lies before a place and above a value is a sum of three parts: whole
blocks of both kinds (a grid of counts, summed up along both sides), the place's own block, and, of the blocks before it, the value's own block. Each of
the latter two is counted inside one block, whose size is fixed for small keys and the two thirds power of a key's number of points for large ones; the grid
then has no more cells than that. Every point and every question is shuffled a few times, however many points lie in between.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.islands import BLOCK
from tagloom.runtime import checkpoint, ship

SIDE = 4096  # points of a block, at least
RANGES = 1024


def value_ranks(df: DataFrame, key: str, value: str, ties: list[str]) -> DataFrame:
    """df with above (rows of the key with a larger value) and vrank (from 0, by falling value, then ties). Counted over ranges of values."""
    x = -F.col(value).cast("double")
    edges = df.groupBy(F.col(key).alias("__ek")).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    df = df.join(edges, F.col(key) == F.col("__ek"))
    df = df.withColumn("__b", F.least(F.floor((x - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300)) * RANGES), F.lit(RANGES - 1)))
    prior = Window.partitionBy("__ck").orderBy("__cb").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows for each key at most
    counts = df.groupBy(F.col(key).alias("__ck"), F.col("__b").alias("__cb")).agg(F.count("*").alias("__n"))
    counts = counts.select("__ck", "__cb", F.coalesce(F.sum("__n").over(prior), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__b")
    df = df.withColumn("__nth", F.row_number().over(inside.orderBy(x, *ties)) - 1).withColumn("__rank", F.rank().over(inside.orderBy(x)) - 1)
    df = df.join(counts, (F.col(key) == F.col("__ck")) & (F.col("__b") == F.col("__cb")))
    out = df.withColumn("vrank", F.col("__base") + F.col("__nth")).withColumn("above", F.col("__base") + F.col("__rank"))
    return out.drop("__ek", "__lo", "__hi", "__b", "__ck", "__cb", "__base", "__nth", "__rank")


def count_below(values: np.ndarray, first: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each question, how many of the first so many values are below a number: bit by bit, as in a wavelet matrix."""
    out, lo, hi = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), first.astype(np.int64)
    top = max(int(values.max(initial=0)), int(below.max(initial=0)))
    for bit in reversed(range(top.bit_length())):
        zero = (values >> bit & 1) == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        one = (below >> bit & 1) == 1
        lo0, hi0 = zeros[lo], zeros[hi]
        out += np.where(one, hi0 - lo0, 0)
        lo, hi = np.where(one, zeros[-1] + lo - lo0, lo0), np.where(one, zeros[-1] + hi - hi0, hi0)
        values = np.concatenate([values[zero], values[~zero]])
    return out


def count_dominating(points: DataFrame, questions: DataFrame, key: str, width: int = BLOCK) -> DataFrame:
    """(key, id, before, n): for each question (key, id, x, edge, above) the number of points (key, x, vrank) of its key at places below x, or up to
    x if its edge is 2 (0 else), and how many of these have a vrank below ``above``. vrank is that of value_ranks. Ids are distinct."""
    ship(points.sparkSession)
    p = points.select(F.col(key).alias("key"), "x", F.lit(1).alias("edge"), F.col("vrank").cast("long").alias("v"), F.lit(None).cast("long").alias("id"))
    q = questions.select(F.col(key).alias("key"), "x", "edge", F.col("above").cast("long").alias("v"), F.col("id").cast("long").alias("id"))
    both = p.unionByName(q).withColumn("xb", F.floor(F.col("x") / width)).withColumn("one", F.col("id").isNull().cast("long"))
    prior = Window.partitionBy("ck").orderBy("cb").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of places
    counts = both.groupBy(F.col("key").alias("ck"), F.col("xb").alias("cb")).agg(F.sum("one").alias("n"))
    counts = counts.select("ck", "cb", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("ck")).alias("m"))
    run = Window.partitionBy("key", "xb").orderBy("x", "edge").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("k", F.coalesce(F.sum("one").over(run), F.lit(0))).join(counts, (F.col("key") == F.col("ck")) & (F.col("xb") == F.col("cb")))
    side = F.greatest(F.lit(SIDE), F.ceil(F.pow(F.col("m"), 2 / 3))).cast("long")
    both = both.select("key", "id", "one", (F.col("k") + F.col("base")).alias("k"), "v", side.alias("side"), "m")
    both = checkpoint(both.withColumn("kb", F.floor(F.col("k") / F.col("side"))).withColumn("vb", F.floor(F.col("v") / F.col("side"))))

    # whole blocks: cells before a question's on both sides
    ends = both.groupBy(F.col("key").alias("gk")).agg(F.max("kb").alias("mk"), F.max("vb").alias("mv"))
    cells = ends.select("gk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mk"))).alias("gkb"), "mv").select("gk", "gkb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mv"))).alias("gvb"))
    own = both.filter("one = 1").groupBy("key", "kb", "vb").agg(F.count("*").alias("n"))
    grid = cells.join(own, (F.col("gk") == F.col("key")) & (F.col("gkb") == F.col("kb")) & (F.col("gvb") == F.col("vb")), "left").select("gk", "gkb", "gvb", F.coalesce("n", F.lit(0)).alias("n"))
    less = lambda by, along: Window.partitionBy("gk", by).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("n", F.coalesce(F.sum("n").over(less("gvb", "gkb")), F.lit(0))).withColumn("n", F.coalesce(F.sum("n").over(less("gkb", "gvb")), F.lit(0)))
    asked = both.filter("one = 0")
    whole = asked.join(grid, (F.col("key") == F.col("gk")) & (F.col("kb") == F.col("gkb")) & (F.col("vb") == F.col("gvb"))).select("key", "id", F.col("k").alias("before"), "n")

    # a block of places: its points in order with their values; one of values: its points in order with their blocks of places
    part = lambda axis, block, at, value: F.struct(F.lit(axis).alias("axis"), F.col(block).alias("block"), (F.col(at) - F.col(block) * F.col("side")).alias("at"), F.col(value).alias("value"))
    local = both.select("key", "id", F.explode(F.array(part(0, "kb", "k", "v"), part(1, "vb", "v", "kb"))).alias("p")).select("key", "id", "p.*")

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        is_point = g["id"].isna().to_numpy()
        pts, ask = g[is_point].sort_values("at"), g[~is_point]
        if not len(ask):
            return pd.DataFrame({"key": g["key"][:0], "id": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})
        values = pts["value"].to_numpy(np.int64)
        sorted_values = np.sort(values)
        small = np.searchsorted(sorted_values, values), np.searchsorted(sorted_values, ask["value"].to_numpy(np.int64))
        n = count_below(small[0], np.minimum(ask["at"].to_numpy(np.int64), len(values)), small[1])
        return pd.DataFrame({"key": ask["key"], "id": ask["id"].astype("int64"), "n": n})

    kind = points.schema[key].dataType.simpleString()
    parts = local.groupBy("key", "axis", "block").applyInPandas(inside, f"key {kind}, id long, n long")
    every = whole.unionByName(parts.select("key", "id", F.lit(None).cast("long").alias("before"), "n"))
    return every.groupBy("key", "id").agg(F.max("before").alias("before"), F.sum("n").alias("n")).withColumnRenamed("key", key)
