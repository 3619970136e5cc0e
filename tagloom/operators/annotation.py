"""Coding status, antisense pairs and repeat arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_coding(df: DataFrame, orf: int = 100, cpat: float = 0.38) -> DataFrame:
    """P12. co, nc or up from the match score (null: no match), the coding potential cpc, ORF length and CPAT score.

    cpc of -1 or less is nc. cpc of 1 or more is co for a match of 3 or more, else with a long ORF or a high CPAT score. In
    between the CPAT score has to agree with cpc's sign; for cpc 0 a low one is nc unless the match is good, and a high one co only without a match.
    A match score below 0 has no status.
    """
    good, none, p = F.coalesce(F.col("match_score") >= 3, F.lit(False)), F.col("match_score").isNull(), F.col("cpc")
    low, high = F.col("cpat") < cpat, F.col("cpat") > cpat
    strong = F.when(good | (F.col("orf") >= orf) | high, "co").otherwise("up")
    weak = F.when(low & ((p < 0) | (p == 0) & ~good), "nc").when(high & ((p > 0) | (p == 0) & none), "co").otherwise("up")
    return df.withColumn("status", F.when(none | (F.col("match_score") >= 0), F.when(p <= -1, "nc").when(p >= 1, strong).otherwise(weak)))


def nat_pairs(overlaps: DataFrame, status: DataFrame) -> DataFrame:
    """J28. From overlap_config rows, one row per overlapping gene: nat on the opposite strand, ns else; class 0 if one side alone is coding."""
    s = lambda name, key: status.select(F.col("name").alias(key), F.col("coding").alias(name))
    z = F.arrays_zip(F.split("genes", ",").alias("g"), F.split("confs", ",").alias("c"))
    x = overlaps.filter("genes <> 'NA'").select("trans", F.explode(z).alias("z")).select("trans", F.col("z.g").alias("gene"), F.col("z.c").alias("conf"))
    both = x.join(s("c1", "n1"), F.col("trans") == F.col("n1"), "left").join(s("c2", "n2"), F.col("gene") == F.col("n2"), "left")
    c1, c2 = F.coalesce("c1", F.lit(False)), F.coalesce("c2", F.lit(False))
    return both.select("trans", "gene", F.when(F.col("conf") == "R", "nat").otherwise("ns").alias("kind"), F.when(c1 != c2, 0).when(c1, 1).otherwise(2).alias("cls"))


def arm_flags(df: DataFrame, phase: int) -> DataFrame:
    """P26. Arm of a repeat from the overhang of its first coordinates (a5, b5) modulo the phase: 2 to 4, or the complement, A or B; else N."""
    d = F.col("b5") - F.col("a5")
    r = F.sign(d) * F.pmod(F.abs(d), F.lit(phase))
    near = lambda x: x.between(2, 4)
    flag = F.when(near(r) | near(r + phase), "A").when(near(-r) | near(phase - r), "B").otherwise("N")
    return df.withColumn("flag", flag)


def ir_consensus(tags: DataFrame) -> DataFrame:
    """A31. Abundance per position, arm flag and size class, up to the last phased position. tags: pos, flag, len, abun, phased."""
    last = tags.filter("phased").agg(F.max("pos").alias("last"))
    size = F.when(F.col("len") <= 20, "18-20").otherwise(F.col("len").cast("string"))
    return tags.crossJoin(F.broadcast(last)).filter("pos <= last").groupBy("pos", "flag", size.alias("size")).agg(F.sum("abun").alias("abun"))  # one row
