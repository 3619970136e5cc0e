"""Islands of positions and intervals, numbered without a chromosome ever meeting in one task, and windows over blocks with a halo.

Coordinates are cut in blocks of a fixed width. Running ends and counts are windows inside a block; what a block hands on to the next
(the largest end so far, the number of islands so far) is one row per block, and only those rows meet per key: their
number is that of the genome's blocks, whatever the number of intervals. Rows are shuffled once, by key and block: windows and joins
share that partitioning. Keys travel as one struct, in which nulls are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.runtime import store

BLOCK = 1 << 16


def _blocked(rows: DataFrame, keys: list[str], pos: str, width: int) -> DataFrame:
    return rows.withColumn("__key", F.struct(*keys) if keys else F.struct(F.lit(0))).withColumn("__block", F.floor(F.col(pos) / width))


def _attach(df: DataFrame, table: DataFrame) -> DataFrame:
    """df with the columns of table, which has a row for each of df's keys and blocks."""
    t = table.withColumnRenamed("__key", "__tk").withColumnRenamed("__block", "__tb")
    return df.join(t, (F.col("__key") == F.col("__tk")) & (F.col("__block") == F.col("__tb"))).drop("__tk", "__tb")


def number_islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, out: str = "island", width: int = BLOCK) -> DataFrame:
    """rows with the number, from 1 in each key, of the island that they belong to: a new one begins where an interval starts more than
    gap after every end before it (in order of start and end). For points, start and end are the same column. Rows without a start are dropped."""
    df = _blocked(rows.filter(F.col(start).isNotNull()), keys, start, width)
    inside = Window.partitionBy("__key", "__block").orderBy(start, end)
    before = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    # one row per block: where its own islands start (at most one for each place of the block), and its largest end
    blocks = df.groupBy("__key", "__block").agg(F.max(end).alias("__top"), F.collect_list(F.when(F.col("__new") == 1, F.col(start))).alias("__starts"))
    prior = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__carry", F.max("__top").over(prior))
    # the block's first islands may go on with one from before
    merged = F.when(F.col("__carry").isNull(), 0).otherwise(F.size(F.filter("__starts", lambda s: s <= F.col("__carry") + gap)))
    blocks = blocks.withColumn("__merged", merged).withColumn("__base", F.coalesce(F.sum(F.size("__starts") - F.col("__merged")).over(prior), F.lit(0)))
    df = df.withColumn("__nth", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    df = _attach(df, blocks.select("__key", "__block", "__merged", "__base"))
    return df.withColumn(out, F.col("__base") + F.greatest(F.col("__nth") - F.col("__merged"), F.lit(0))).drop("__key", "__block", "__new", "__nth", "__merged", "__base")


def _in_blocks(points: DataFrame, keys: list[str], pos: str, gap: int, width: int, block: str | None) -> DataFrame:
    """points with __key, __block and the number of their island in their block (__nth)."""
    df = points.filter(F.col(pos).isNotNull())
    df = df.withColumn("__key", F.struct(*keys)).withColumn("__block", F.col(block)) if block else _blocked(df, keys, pos, width)
    inside = Window.partitionBy("__block", *keys).orderBy(pos)  # blocks first: they tell more rows apart
    before = F.lag(pos).over(inside)
    df = df.withColumn("__new", F.when(before.isNull() | (F.col(pos) > before + gap), 1).otherwise(0))
    return df.withColumn("__nth", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _bases(own: DataFrame, gap: int) -> DataFrame:
    """One row for each block of the blocks' islands (__key, __block, __nth, __start, __end, __size): those islands (__own), and what to add to their numbers (__base)."""
    blocks = own.groupBy("__key", "__block").agg(F.min("__start").alias("__from"), F.max("__end").alias("__top"), F.collect_list(F.struct("__nth", "__size")).alias("__own"))
    prior = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # only the first island of a block may go on with one from before, as the others begin more than gap after it
    blocks = blocks.withColumn("__merged", F.when(F.col("__from") <= F.max("__top").over(prior) + gap, 1).otherwise(0))
    return blocks.withColumn("__base", F.coalesce(F.sum(F.size("__own") - F.col("__merged")).over(prior), F.lit(0)) - F.col("__merged"))


def _stored(points: DataFrame, keys: list[str], pos: str, gap: int, width: int, block: str | None, size: Column) -> tuple[DataFrame, DataFrame]:
    """The stored points of _in_blocks, and one row for each island of a block."""
    df = store(_in_blocks(points, keys, pos, gap, width, block))
    return df, df.groupBy("__key", "__block", "__nth").agg(F.min(pos).alias("__start"), F.max(pos).alias("__end"), size.alias("__size"))


def _large(own: DataFrame, gap: int, least: int) -> DataFrame:
    """(__key, __block, __is): the numbers of the islands that have at least so many records."""
    each = _bases(own, gap).select("__key", "__block", "__base", F.inline("__own")).withColumn("__i", F.col("__base") + F.col("__nth"))
    each = each.withColumn("__all", F.sum("__size").over(Window.partitionBy("__key", "__i"))).filter(F.col("__all") >= least)
    return each.groupBy("__key", "__block").agg(F.map_from_entries(F.collect_list(F.struct("__nth", "__i"))).alias("__is"))


def sum_points(points: DataFrame, keys: list[str], pos: str, sums: tuple[str, ...], gap: int = 0, out: str = "island", width: int = BLOCK, block: str | None = None) -> DataFrame:
    """(keys, out, sums): the islands that number_points numbers, with the sums of columns over their points, in one row for each block that an island lies in.
    Points are summed where they lie, so only these rows are shuffled and stored."""
    df = _in_blocks(points, keys, pos, gap, width, block)
    own = df.groupBy("__block", *keys, "__nth").agg(F.min(pos).alias("__start"), F.max(pos).alias("__end"), *[F.sum(c).alias(c) for c in sums])
    own = store(own.withColumn("__key", F.struct(*keys)).withColumn("__size", F.lit(0)))
    return _attach(own, _bases(own, gap).select("__key", "__block", "__base")).select(*keys, (F.col("__base") + F.col("__nth")).alias(out), *sums)


def number_points(points: DataFrame, keys: list[str], pos: str, gap: int = 0, out: str = "island", least: int = 0, width: int = BLOCK, block: str | None = None) -> DataFrame:
    """What number_islands says of points, for inputs that are dear to compute: the points are stored once with the number of their island in their block, and all
    else is one row for each of those islands. With least, points count ``n`` records each, and islands of fewer records are dropped, their numbers with them.
    block: a column of the points with the number of their block, by which and by chromosome they may lie together already."""
    df, own = _stored(points, keys, pos, gap, width, block, F.sum("n") if least else F.lit(0))
    if not least:
        return _attach(df, _bases(own, gap).select("__key", "__block", "__base")).withColumn(out, F.col("__base") + F.col("__nth")).drop("__key", "__block", "__nth", "__base")
    return _attach(df, _large(own, gap, least)).withColumn(out, F.col("__is")[F.col("__nth")]).filter(F.col(out).isNotNull()).drop("__key", "__block", "__nth", "__is")


def points_and_islands(points: DataFrame, keys: list[str], pos: str, gap: int, least: int, block: str) -> tuple[DataFrame, DataFrame]:
    """What number_points joins, for callers that do so when the points lie by block again: the stored points with the number of their island in their block
    (__nth), and for each of keys and block a map from that number to the island's own (__is), which lacks islands of fewer records than ``least``."""
    df, own = _stored(points, keys, pos, gap, BLOCK, block, F.sum("n"))
    return df, _large(own, gap, least).select(*[F.col("__key")[k].alias(k) for k in keys], "__block", "__is")


def number_rows(rows: DataFrame, keys: list[str], pos: str, order: list[str], out: str, width: int = BLOCK) -> DataFrame:
    """rows with their row number, from 1 in each key, in the order of pos, then ``order``."""
    df = _blocked(rows, keys, pos, width).withColumn("__block", F.coalesce("__block", F.lit(-(1 << 62))))
    prior = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    counts = df.groupBy("__key", "__block").agg(F.count("*").alias("__own")).withColumn("__base", F.coalesce(F.sum("__own").over(prior), F.lit(0))).drop("__own")
    nth = F.row_number().over(Window.partitionBy("__key", "__block").orderBy(pos, *order))
    return _attach(df.withColumn("__nth", nth), counts).withColumn(out, F.col("__base") + F.col("__nth")).drop("__key", "__block", "__nth", "__base")


def number_runs(rows: DataFrame, keys: list[str], start: str, end: str, order: list[str], out: str, first: str, width: int = BLOCK) -> DataFrame:
    """rows with what number_rows says of them (out), and the number of the first row of their island (first), islands being those of number_islands."""
    df = _blocked(rows, keys, start, width).withColumn("__block", F.coalesce("__block", F.lit(-(1 << 62))))
    prior = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    inside = Window.partitionBy("__key", "__block").orderBy(start, *order)
    own = df.groupBy("__key", "__block").agg(F.count("*").alias("__own"), F.max(end).alias("__top"))
    own = own.select("__key", "__block", F.coalesce(F.sum("__own").over(prior), F.lit(0)).alias("__base"), F.max("__top").over(prior).alias("__carry"))
    df = _attach(df, own).withColumn(out, F.col("__base") + F.row_number().over(inside))
    before = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), "__carry")
    df = df.withColumn("__head", F.when(F.col(start) <= before, None).otherwise(F.col(out)))
    df = df.withColumn("__at", F.max("__head").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a block's first rows may go on with an island from before
    last = df.groupBy("__key", "__block").agg(F.max("__head").alias("__last"))
    df = _attach(df, last.select("__key", "__block", F.max("__last").over(prior).alias("__from")))
    return df.withColumn(first, F.coalesce("__at", "__from")).drop("__key", "__block", "__base", "__carry", "__head", "__at", "__from")


def count_per(rows: DataFrame, keys: list[str], pos: str, out: str, width: int = BLOCK) -> DataFrame:
    """rows with the number of rows of their keys, however many: counted per block, and handed back per block."""
    df = _blocked(rows, keys, pos, width)
    counts = df.groupBy("__key", "__block").agg(F.count("*").alias("__own"))
    counts = counts.select("__key", "__block", F.sum("__own").over(Window.partitionBy("__key")).alias(out))
    return _attach(df, counts).drop("__key", "__block")


def with_halo(rows: DataFrame, pos: str, reach: int, width: int = BLOCK) -> DataFrame:
    """Each row in its block (__block) and in those whose border it is within ``reach`` of. __own marks the row's own block: a window over a
    block that looks no further than reach is whole for those rows."""
    width = max(width, 4 * reach)
    own = F.floor(F.col(pos) / width)
    every = F.sequence(F.floor((F.col(pos) - reach) / width), F.floor((F.col(pos) + reach) / width))
    return rows.withColumn("__block", F.explode(every)).withColumn("__own", F.col("__block") == own)
