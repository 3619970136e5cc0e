"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Size of a document: its number of ``[^\\x20\\x09-\\x0D]+``. Sources in code point order (null last) weigh 3, 1, 2,
repeating, and share a multiple of all sizes. Water-filling: with the level L, each source gets weight * L, at most its
cap (epochs * size). Sorted by cap / weight, the capped sources are a prefix, so L follows from running sums.

Sampling: a source's repetition r = target / size is taken as floor(r) whole epochs of every document and one further copy
of a part of them. That part is the documents up to a running size of (r - floor(r)) * size in a seeded order (md5 of seed and
doc_id and size). The running sum has two levels: hash buckets within a source, then the one bucket in which the limit falls, so no task
orders a whole source. The document on the limit is taken if that comes nearer to the target.

Defined cases: null text has size 0; a source of size 0 has target 0; a null doc_id and repeated rows have a place in the
order like any other (rows of one doc_id and size have one place, and as many of them are taken as come nearest to the target, those of
smallest hash of the text first); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.runtime import checkpoint, few_rows

# The weights, which repeat over the ordered sources.
WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # hex digits of the order's hash that make a bucket: 4096 buckets a source


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows. The windows below see one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(by, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # the level is that of the first source, in this order, whose cap is not below it; without one, all are at their caps
    found = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(whole)
    per = per.withColumn("found", found)
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("found.level")))
    return per.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, text_col: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, source, size, tie, ord): all that the mix needs of a document; ord is its place in the seeded order, tie its text's hash."""
    size = word_count(docs[text_col])
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), F.xxhash64(docs[text_col]).alias("tie"))
    return own.withColumn("ord", seeded_order(F.col("doc_id"), F.col("size"), seed))


def seeded_order(doc_id: Column, size: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string")).cast("binary"))


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """One row per source: (source, source_size, target, whole, upto_ord, part_ord, part_take). A document is taken ``whole`` times, and
    once more if its ord is at most upto_ord, or if it is among the part_take first of several that share part_ord. rows: those of
    sized(), read several times and so best checkpointed."""
    targets = source_targets(rows, weights, share, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio).cast("long")).withColumn("limit", F.col("target") - F.col("whole") * F.col("source_size"))
    bucket = F.substring("ord", 1, DIGITS)
    buckets = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("upto", F.sum("bucket_size").over(running)).withColumn("before", F.col("upto") - F.col("bucket_size"))
    t = targets.withColumnRenamed("source", "s")
    edges = buckets.join(t, F.col("source").eqNullSafe(F.col("s"))).filter("before < limit AND limit <= upto").select("s", F.col("bucket").alias("b"), "before", "limit")
    # only the bucket in which the limit falls has to be ordered
    near = rows.join(edges, F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("b"))).groupBy("s", "b", "before", "limit", "ord").agg(F.sum("size").alias("all"), F.max("size").alias("size"), F.count("*").alias("n"))
    inside = Window.partitionBy("s").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("limit") - (F.col("before") + F.sum("all").over(inside) - F.col("all"))  # from where the first of these rows begins
    fit = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).when(room >= 0, F.col("n")).otherwise(0)
    near = near.withColumn("k", F.least(F.greatest(fit.cast("long"), F.lit(0)), F.col("n")))
    part = F.max(F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.struct("ord", "k")))
    last = near.groupBy(F.col("s").alias("edge_source")).agg(F.coalesce(F.max(F.when(F.col("k") == F.col("n"), F.col("ord"))), F.first("b")).alias("upto_ord"), part.alias("part"))
    plan = targets.join(last, F.col("source").eqNullSafe(F.col("edge_source")), "left")
    return plan.select("source", "source_size", "target", "whole", F.coalesce("upto_ord", F.lit("")).alias("upto_ord"), F.col("part.ord").alias("part_ord"), F.col("part.k").alias("part_take"))


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source, ord and tie, joined with their source's plan, which has one row per source, and __copies.

    The plan is broadcast if it is found to have few rows, so that a hot source's rows stay where they are; beyond, it is a shuffled join.
    """
    p = few_rows(plan.withColumnRenamed("source", "__source"))
    both = rows.join(p, rows["source"].cast("string").eqNullSafe(p["__source"]))
    whole = both.withColumn("__copies", F.col("whole") + (F.col("ord") <= F.col("upto_ord")).cast("long"))
    if p.filter("part_ord IS NOT NULL").isEmpty():
        return whole
    # rows of one doc_id and size on the limit: numbered in parts by their texts' hashes, the parts by a running count
    shared = F.coalesce(F.col("ord") == F.col("part_ord"), F.lit(False))
    edge = whole.filter(shared).withColumn("__part", F.pmod("tie", F.lit(1024)))
    parts = edge.groupBy(F.col("__source").alias("__s"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    running = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows for each source at most
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(running), F.lit(0)))
    edge = edge.join(parts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    nth = F.row_number().over(Window.partitionBy("__source", "__part").orderBy("tie"))
    edge = edge.withColumn("__nth", nth).withColumn("__copies", F.col("whole") + (F.col("__before") + F.col("__nth") <= F.col("part_take")).cast("long"))
    return whole.filter(~shared).unionByName(edge.select(*whole.columns))


def mix_report(docs: DataFrame, seed: int = 42, **params) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    rows = checkpoint(sized(docs, seed=seed))
    return _copies(rows, mix_plan(rows, **params)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 42, **params) -> DataFrame:
    """The documents, each repeated as often as the mix takes it and left out if that is 0; all columns are kept."""
    plan = mix_plan(checkpoint(sized(docs, seed=seed)), **params)
    order = seeded_order(docs["doc_id"].cast("long"), word_count(docs["text"]), seed)
    # the row travels as one value, so columns of any name pass through
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["source"].cast("string").alias("source"), order.alias("ord"), F.xxhash64(docs["text"]).alias("tie"))
    taken = _copies(packed, plan).filter("__copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("row.*")
