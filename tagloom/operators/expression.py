"""Expression tables and single cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.operators.islands import number_islands
from tagloom.plans.components import connected_components
from tagloom.runtime import checkpoint, few_rows, once, ship, store


def count_matrix(quant: DataFrame, read_len: int, samples: tuple[str, ...], level: str = "trans") -> DataFrame:
    """A20. ceil(cov * exon length / read length) per transcript or summed per gene, one column per sample."""
    c = quant.withColumn("cnt", F.ceil(F.col("cov") * F.col("exon_len") / read_len).cast("long"))
    return c.groupBy(level).agg(*[F.coalesce(F.sum(F.when(F.col("sample") == s, F.col("cnt"))), F.lit(0)).alias(s) for s in samples])


def cluster_transcripts(exons: DataFrame, prefix: str = "M") -> DataFrame:
    """A21. Transcripts whose exons overlap on one strand, transitively, named by the smallest transcript of the cluster."""
    placed = exons.select("trans", "chr", "strand", "xstart", "xend").filter("xstart <= xend AND chr IS NOT NULL AND strand IS NOT NULL")
    # exons that overlap, transitively, are islands: each of its transcripts has a link to the island's first one
    at = store(number_islands(placed, ["chr", "strand"], "xstart", "xend", out="__i").select("chr", "strand", "__i", F.col("trans").alias("ta")))
    first = at.groupBy(F.col("chr").alias("fc"), F.col("strand").alias("fs"), F.col("__i").alias("fi")).agg(F.min("ta").alias("tb"))
    edges = at.join(first, (F.col("chr") == F.col("fc")) & (F.col("strand") == F.col("fs")) & (F.col("__i") == F.col("fi"))).filter("ta <> tb").select("ta", "tb").distinct()
    comp = connected_components(edges, "ta", "tb")
    every = exons.select("trans").distinct()
    return every.join(comp, F.col("trans") == F.col("node"), "left").select("trans", F.concat(F.lit(prefix), F.coalesce("component", "trans")).alias("cluster"))


def rank_tracks(probes: DataFrame, order: list[tuple[str, str]] | None = None) -> DataFrame:
    """W3. Rank of each probe in its track, and its best rank over tracks. order: (column, asc or desc), by default fold change from
    the largest down; [("p", "asc"), ("fc", "desc")] ranks by p first. Equal ones are ordered by probe.

    Ranks are running counts: probes per distinct value of the order, over blocks of values, so no task holds a track.
    """
    order = order or [("fc", "desc")]
    cols = [c for c, _ in order]
    signed = F.struct(*[(F.col(c) if d == "asc" else -F.col(c)).cast("double").alias(f"o{i}") for i, (c, d) in enumerate(order)])
    df = probes.withColumn("__o", signed).withColumn("__first", F.col("__o.o0"))
    edges = df.groupBy(F.col("track").alias("__t")).agg(F.min("__first").alias("__lo"), F.max("__first").alias("__hi"))
    df = df.join(edges, F.col("track") == F.col("__t"))
    df = df.withColumn("__b", F.least(F.floor((F.col("__first") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300)) * 1024), F.lit(1023)))
    prior = Window.partitionBy("__t").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows per track at most
    counts = df.groupBy("__t", "__b").agg(F.count("*").alias("__k")).select(F.col("__t").alias("__ct"), F.col("__b").alias("__cb"), F.coalesce(F.sum("__k").over(prior), F.lit(0)).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("track", "__b").orderBy("__o", "probe"))
    r = df.join(counts, (F.col("track") == F.col("__ct")) & (F.col("__b") == F.col("__cb"))).withColumn("rank", F.col("__base") + nth)
    best = r.groupBy(F.col("probe").alias("__p")).agg(F.min("rank").alias("best"))
    return r.join(best, F.col("probe") == F.col("__p")).select("probe", "track", *cols, "rank", "best")


def cpm(counts: DataFrame) -> DataFrame:
    """S9. Counts per million of each sample's total; totals are one row per sample."""
    total = counts.groupBy(F.col("sample").alias("ts")).agg(F.sum("cnt").alias("tn"))
    return counts.join(total, F.col("sample") == F.col("ts")).withColumn("cpm", F.col("cnt") * 1e6 / F.col("tn")).drop("ts", "tn")


def filter_expressed(counts: DataFrame, least: float, samples: int) -> DataFrame:
    """S9. Genes above ``least`` cpm in enough samples, with library sizes computed anew."""
    good = cpm(counts).filter(F.col("cpm") > least).groupBy("gene").agg(F.count("*").alias("k")).filter(F.col("k") >= samples).select("gene")
    return cpm(counts.join(good, "gene", "left_semi"))


def filter_by_expr(counts: DataFrame, groups: dict[str, str], least: int = 10, least_total: int = 15, large: int = 10, share: float = 0.7) -> DataFrame:
    """S9, the filterByExpr rule. Genes whose cpm reaches ``least`` reads of a median library in as many samples as the smallest group
    has (of groups above ``large``, a share of what exceeds it), and that have ``least_total`` reads in all. groups: sample to group."""
    sizes = [list(groups.values()).count(g) for g in set(groups.values())]
    n = min(sizes)
    need = n if n <= large else large + (n - large) * share
    own = counts.filter(F.col("sample").isin(*groups))
    middle = own.groupBy("sample").agg(F.sum("cnt").alias("n")).agg(F.expr("percentile(n, 0.5)").alias("mid"))  # one row per sample, then one
    x = cpm(own).crossJoin(F.broadcast(middle)).groupBy("gene").agg(F.count_if(F.col("cpm") >= least * 1e6 / F.col("mid")).alias("k"), F.sum("cnt").alias("total"))
    good = x.filter((F.col("k") >= need - 1e-14) & (F.col("total") >= least_total - 1e-14)).select("gene")
    return cpm(counts.join(good, "gene", "left_semi"))


def quantiles(df: DataFrame, group: str, value: str, at: tuple[float, ...], out: str = "q", weight: str | None = None) -> DataFrame:
    """(group, out): linearly interpolated quantiles of each group, as an array. weight: a column that says how many rows a row stands for.

    A group's distinct values are counted first and summed over blocks of the value's order by range, so no task holds a whole group:
    each quantile looks up two order statistics in running counts.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v")).agg((F.sum(weight).cast("long") if weight else F.count("*")).alias("__k"))
    edges = per.groupBy("__g").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__k").alias("__n"))
    place = F.least(F.floor((F.col("__v") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300)) * 1024), F.lit(1023))
    per = per.join(edges.withColumnRenamed("__g", "__eg"), F.col("__g") == F.col("__eg")).drop("__eg").withColumn("__b", place)
    blocks = per.groupBy("__g", "__b").agg(F.sum("__k").alias("__bk"))
    prior = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows per group at most
    blocks = blocks.select(F.col("__g").alias("__bg"), F.col("__b").alias("__bb"), F.coalesce(F.sum("__bk").over(prior), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__g", "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    per = per.join(blocks, (F.col("__g") == F.col("__bg")) & (F.col("__b") == F.col("__bb"))).withColumn("__upto", F.col("__base") + F.sum("__k").over(inside))
    parts = []
    for k, q in enumerate(at):
        want = (F.col("__n") - 1) * q
        for name, i in (("lo", F.floor(want)), ("hi", F.ceil(want))):
            parts.append(F.min(F.when(F.col("__upto") > i, F.col("__v"))).alias(f"__{name}{k}"))
    found = per.groupBy("__g", "__n").agg(*parts)
    value_at = lambda k, q: F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * ((F.col("__n") - 1) * q - F.floor((F.col("__n") - 1) * q))
    return found.select(F.col("__g").alias(group), F.array(*[value_at(k, q) for k, q in enumerate(at)]).alias(out))


def tmm_reference(counts: DataFrame) -> DataFrame:
    """S10. One row (sample): the one whose upper quartile of counts, absent ones being zeros, over its total is nearest to the mean of these; of equally near ones
    the first."""
    sizes = counts.groupBy("sample").agg(F.sum("cnt").alias("n"), F.count("*").alias("rows"))
    genes = counts.agg(F.countDistinct("gene").alias("genes"))  # one row
    zeros = sizes.crossJoin(F.broadcast(genes)).select("sample", F.lit(0).cast("double").alias("cnt"), (F.col("genes") - F.col("rows")).alias("k")).filter("k > 0")
    every = counts.select("sample", F.col("cnt").cast("double").alias("cnt"), F.lit(1).cast("long").alias("k")).unionByName(zeros)
    q = quantiles(every, "sample", "cnt", (0.75,), weight="k").withColumnRenamed("sample", "qs").join(sizes, F.col("qs") == F.col("sample"))
    q = q.select("sample", (F.col("q")[0] / F.col("n")).alias("f"))
    far = F.abs(F.col("f") - F.avg("f").over(Window.partitionBy()))  # one row per sample
    return q.withColumn("far", far).agg(F.min(F.struct("far", "sample"))["sample"].alias("sample"))


def tmm_factors(counts: DataFrame, reference: str | None = None, log_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """S10. Trimmed mean of M-values against a reference sample, by default that of tmm_reference, scaled to geometric mean 1."""
    counts = checkpoint(counts.select("gene", "sample", "cnt"))
    reference = tmm_reference(counts).first()["sample"] if reference is None else reference
    n = counts.groupBy("sample").agg(F.sum("cnt").alias("n"))
    c = counts.filter("cnt > 0").join(few_rows(n), "sample")
    r = c.filter(F.col("sample") == reference).select(F.col("gene").alias("rg"), F.col("cnt").alias("rc"), F.col("n").alias("rn"))
    both = c.join(r, F.col("gene") == F.col("rg"))
    x, y = F.col("cnt") / F.col("n"), F.col("rc") / F.col("rn")
    m, a = F.log2(x / y), (F.log2(x) + F.log2(y)) / 2
    v = (F.col("n") - F.col("cnt")) / F.col("n") / F.col("cnt") + (F.col("rn") - F.col("rc")) / F.col("rn") / F.col("rc")
    both = checkpoint(both.select("sample", m.alias("m"), a.alias("a"), v.alias("v")))
    # both values' quantiles in one pass
    long = both.select(F.explode(F.array(F.struct(F.struct("sample", F.lit("m").alias("of")).alias("g"), F.col("m").alias("x")), F.struct(F.struct("sample", F.lit("a").alias("of")).alias("g"), F.col("a").alias("x")))).alias("l")).select("l.*")
    q = quantiles(long, "g", "x", (log_trim, 1 - log_trim, sum_trim, 1 - sum_trim)).groupBy(F.col("g.sample").alias("qs"))
    q = q.agg(F.max(F.when(F.col("g.of") == "m", F.col("q"))).alias("qm"), F.max(F.when(F.col("g.of") == "a", F.col("q"))).alias("qa"))  # one row per sample
    kept = both.join(few_rows(q), F.col("sample") == F.col("qs")).filter("m BETWEEN qm[0] AND qm[1] AND a BETWEEN qa[2] AND qa[3]")
    f = kept.groupBy("sample").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("lf"))
    return f.withColumn("factor", F.pow(F.lit(2.0), F.col("lf") - F.avg("lf").over(Window.partitionBy()))).select("sample", "factor")  # one row per sample


def bh_adjust(df: DataFrame, p: str = "p") -> DataFrame:
    """S11. Benjamini-Hochberg: the running minimum, from the largest p down, of p * n / rank. A null p has none.

    Distinct p values are counted and put in classes by their logarithm, 45,000 at most. Ranks and minima run within a class; what the classes
    before add is one row each.
    """
    per = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("k"))
    per = checkpoint(per.withColumn("__c", F.floor(-F.log(F.least(F.greatest("__p", F.lit(1e-300)), F.lit(1.0))) * 64)))
    down = Window.orderBy(F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)  # classes of smaller p
    classes = per.groupBy("__c").agg(F.sum("k").alias("k")).select(F.col("__c").alias("__d"), F.coalesce(F.sum("k").over(down), F.lit(0)).alias("__before"), F.sum("k").over(Window.partitionBy()).alias("__all"))
    up = Window.partitionBy("__c").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    per = per.join(F.broadcast(classes), F.col("__c") == F.col("__d")).drop("__d")
    per = per.withColumn("raw", F.col("__p") * F.col("__all") / (F.col("__before") + F.sum("k").over(up)))
    larger = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    least = per.groupBy("__c").agg(F.min("raw").alias("r")).select(F.col("__c").alias("__d"), F.min("r").over(larger).alias("__least"))
    back = Window.partitionBy("__c").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    fdr = F.least(F.min("raw").over(back), F.col("__least"), F.lit(1.0))
    per = per.join(F.broadcast(least), F.col("__c") == F.col("__d")).select("__p", fdr.alias("fdr"))
    return df.join(per, F.col(p) == F.col("__p"), "left").drop("__p")


def classify_fc(c: Column | str) -> Column:
    return F.when(F.col(c) >= 1, "up").when(F.col(c) <= -1, "down").otherwise("unchanged") if isinstance(c, str) else F.when(c >= 1, "up").when(c <= -1, "down").otherwise("unchanged")


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0: Stirling's series at x + 8, taken back by its recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def log_gamma_of(x: np.ndarray) -> np.ndarray:
    """log_gamma of numbers."""
    y = x + 8
    q = 1 / (y * y)
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q / 1680))) / y - np.log(product)


def estimate_dispersions(counts: DataFrame, group_a: tuple[str, ...], group_b: tuple[str, ...], prior_df: float = 10.0, low: float = 1e-4, high: float = 10.0, steps: int = 41) -> DataFrame:
    """S11. (gene, common, dispersion): negative-binomial dispersions by conditional likelihood.

    Counts are scaled to the geometric mean of the libraries' sizes. For each dispersion of a grid, even in its logarithm, a gene's likelihood given its
    groups' sums is a sum over its samples, in which absent counts have no part. The common dispersion has the largest mean over the genes; a gene's own
    the largest sum of its likelihood and that mean, weighted by prior_df over the residual degrees of freedom. Both are refined by a parabola through the
    best point of the grid and its neighbours.
    """
    samples = [*group_a, *group_b]
    sizes = counts.filter(F.col("sample").isin(*samples)).groupBy("sample").agg(F.sum("cnt").alias("n"))
    sizes = sizes.withColumn("even", F.exp(F.avg(F.log("n")).over(Window.partitionBy())) / F.col("n"))  # one row per sample
    y = counts.join(F.broadcast(sizes), "sample").select("gene", F.col("sample").isin(*group_b).alias("b"), (F.col("cnt") * F.col("even")).alias("y")).filter("y > 0")
    grid = [math.log(low) + k * (math.log(high) - math.log(low)) / (steps - 1) for k in range(steps)]
    ys = lambda of: F.collect_list(F.when(of, F.col("y")))  # noqa: E731  as many values as a group has samples
    like = y.groupBy("gene").agg(ys(~F.col("b")).alias("a"), ys(F.col("b")).alias("b"))
    rates = np.exp(-np.array(grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, steps))
            for name, size in (("a", len(group_a)), ("b", len(group_b))):
                lists = batch.column(name)
                n, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
                gene = np.repeat(np.arange(batch.num_rows), n)
                z = np.bincount(gene, flat, batch.num_rows)
                for k, r in enumerate(rates):
                    own = np.bincount(gene, log_gamma_of(flat + r), batch.num_rows) - n * math.lgamma(r)
                    out[:, k] += np.where(n > 0, own + math.lgamma(size * r) - log_gamma_of(z + size * r), 0.0)
            places = pa.array(np.arange(batch.num_rows + 1) * steps, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("gene"), pa.ListArray.from_arrays(places, pa.array(out.ravel()))], ["gene", "l"])

    ship(counts.sparkSession)
    gene_type = counts.schema["gene"].dataType.simpleString()
    like = store(like.mapInArrow(run, f"gene {gene_type}, l array<double>"))  # one row for each gene, whatever the steps
    mean = like.select(F.posexplode("l").alias("k", "l")).groupBy("k").agg(F.avg("l").alias("l"))  # one row for each step
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "l"))), lambda e: e["l"]).alias("mean"))
    weight = prior_df / max(len(samples) - 2, 1)

    def best(l: Column) -> Column:
        at = F.array_position(l, F.array_max(l)).cast("int") - 1
        a, b, c = F.get(l, at - 1), F.get(l, at), F.get(l, at + 1)
        shift = F.coalesce(F.try_divide(a - c, 2 * (a - 2 * b + c)), F.lit(0.0))  # no shift at the grid's ends
        return F.exp(F.lit(grid[0]) + (at + shift) * (grid[1] - grid[0]))

    both = once(like.crossJoin(F.broadcast(checkpoint(mean.select("mean", best(F.col("mean")).alias("common"))))), both=F.zip_with("l", "mean", lambda l, m: l + weight * m))
    return both.select("gene", "common", best(F.col("both")).alias("dispersion"))


def diff_test(counts: DataFrame, group_a: tuple[str, ...], group_b: tuple[str, ...], dispersion: float | DataFrame = 0.1) -> DataFrame:
    """S11. Per gene log2 fold change of mean cpm (+ 0.5) and the p of a negative-binomial likelihood-ratio test of a given dispersion, one for all or
    (gene, dispersion) as estimate_dispersions has them.

    The rate of a group is its reads of the gene over its libraries' sizes; likelihoods are sums over the gene's samples. A gene
    without a sample of either group has p 1.
    """
    sizes = counts.groupBy("sample").agg(F.sum("cnt").alias("n"))
    c = counts.filter(F.col("sample").isin(*group_a, *group_b)).join(sizes, "sample").withColumn("in_b", F.col("sample").isin(*group_b))
    of = lambda x, b: F.sum(F.when(F.col("in_b") == b, F.col(x)))
    share = lambda b: F.coalesce(F.sum(F.when(F.col("in_b") == b, F.col("cnt") * 1e6 / F.col("n"))), F.lit(0.0)) / len(group_b if b else group_a)
    per = c.groupBy(F.col("gene").alias("g")).agg((of("cnt", False) / of("n", False)).alias("ra"), (of("cnt", True) / of("n", True)).alias("rb"), (F.sum("cnt") / F.sum("n")).alias("r0"), share(False).alias("ma"), share(True).alias("mb"))
    if isinstance(dispersion, DataFrame):
        per = per.join(dispersion.select(F.col("gene").alias("dg"), (1 / F.col("dispersion")).alias("r")), F.col("g") == F.col("dg")).drop("dg")
    else:
        per = per.withColumn("r", F.lit(1 / dispersion))
    r = F.col("r")

    def likelihood(rate: Column) -> Column:
        mu = F.greatest(rate * F.col("n"), F.lit(1e-12))
        return F.sum(F.col("cnt") * F.log(mu / (mu + r)) + r * F.log(r / (mu + r)))

    own = F.when(F.col("in_b"), F.col("rb")).otherwise(F.col("ra"))
    fit = c.join(per, F.col("gene") == F.col("g")).groupBy("gene").agg((2 * (likelihood(own) - likelihood(F.col("r0")))).alias("lr"), F.first("ra").alias("ra"), F.first("rb").alias("rb"), F.first("ma").alias("ma"), F.first("mb").alias("mb"))
    lr = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), F.greatest("lr", F.lit(0.0))).otherwise(0.0)
    return fit.select("gene", F.log2((F.col("mb") + 0.5) / (F.col("ma") + 0.5)).alias("logfc"), normal_tail(F.sqrt(lr)).alias("p"))


def log_counts(counts: DataFrame) -> DataFrame:
    """S12. log2(x + 1) without genes of zero variance."""
    df = counts.withColumn("v", F.log2(F.col("cnt") + 1.0))
    flat = df.groupBy("gene").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo = hi").select("gene")
    return df.join(flat, "gene", "left_anti")


def pearson(values: DataFrame, feature: str = "gene", sample: str = "sample", v: str = "v") -> DataFrame:
    """S12. Correlation of each pair of samples over their common features, from grouped sums."""
    a = values.select(F.col(feature).alias("f"), F.col(sample).alias("sa"), F.col(v).alias("va"))
    b = values.select(F.col(feature).alias("g"), F.col(sample).alias("sb"), F.col(v).alias("vb"))
    return a.join(b, (F.col("f") == F.col("g")) & (F.col("sa") < F.col("sb"))).groupBy("sa", "sb").agg(F.corr("va", "vb").alias("r"), F.count("*").alias("n"))


def spearman(values: DataFrame, feature: str = "gene", sample: str = "sample", v: str = "v") -> DataFrame:
    """S12. Correlation of mid-ranks; ranks come from counts of distinct values."""
    per = values.groupBy(F.col(sample).alias("ps"), F.col(v).alias("pv")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("ps").orderBy("pv")
    per = per.withColumn("mid", F.sum("k").over(w) - (F.col("k") - 1) / 2)
    ranked = values.join(per, (F.col(sample) == F.col("ps")) & (F.col(v) == F.col("pv"))).select(feature, sample, F.col("mid").alias("rk"))
    return pearson(ranked, feature, sample, "rk")


def correlation_p(r: Column, n: Column) -> Column:
    """S12. Two-sided p of a correlation r of n pairs: the tail of Student's t with n - 2 degrees of freedom, by its finite sum.

    The sum has n / 2 terms, as coefficients that follow from one another; null below three pairs.
    """
    v, r2 = n - 2, F.least(r * r, F.lit(1.0))
    # with t = r * sqrt(v / (1 - r^2)): sin and cos of the angle whose tangent is t / sqrt(v)
    sin, cos2 = F.abs(r), 1 - r2
    odd = F.pmod(v, F.lit(2)) == 1
    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"))
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.floor((v - F.when(odd, 3).otherwise(2)) / 2), F.lit(1)).cast("long"))
    most = F.floor((v - F.when(odd, 3).otherwise(2)) / 2)
    step = lambda a, k: F.when(k > most, a).otherwise(F.struct((a["c"] * cos2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))).alias("c"), (a["s"] + a["c"] * cos2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))).alias("s")))
    total = F.aggregate(steps, start, step)["s"]
    angle = F.asin(F.least(sin, F.lit(1.0)))
    inside = F.when(v == 1, 2 / math.pi * angle).when(odd, 2 / math.pi * (angle + sin * F.sqrt(cos2) * total)).otherwise(sin * total)
    return F.when(v >= 1, F.greatest(1 - inside, F.lit(0.0)))


def pca(matrix: DataFrame, columns: tuple[str, ...], k: int, scale: bool = True) -> tuple[DataFrame, list[float], np.ndarray]:
    """S13. Scores as a column, explained variance and loadings, by Spark ML."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    df = VectorAssembler(inputCols=list(columns), outputCol="raw").transform(matrix)
    df = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=scale).fit(df).transform(df)
    model = PCA(k=k, inputCol="scaled", outputCol="pcs").fit(df)
    return model.transform(df).drop("raw", "scaled"), list(model.explainedVariance), model.pc.toArray()


def loadings(model_pc: np.ndarray, variance: list[float], columns: tuple[str, ...], spark: SparkSession) -> DataFrame:
    """S13. (column, pc, loading, explained) of a fitted PCA: as many rows as columns times components."""
    rows = [(c, k + 1, float(model_pc[i, k]), float(variance[k])) for i, c in enumerate(columns) for k in range(model_pc.shape[1])]
    return spark.createDataFrame(rows, "column string, pc int, loading double, explained double")


def sc_qc(cells: DataFrame, least_cells: int = 3, least_genes: int = 5, most_genes: int = 2500, most_mt: float = 50.0, mt: str = "g1") -> DataFrame:
    """S14. Genes in enough cells, then cells within the gene and mitochondrial limits: (cell, n_genes, total, percent_mt)."""
    genes = cells.groupBy("gene").agg(F.count("*").alias("k")).filter(F.col("k") >= least_cells).select("gene")
    agg = cells.join(genes, "gene", "left_semi").groupBy("cell").agg(F.count("*").alias("n_genes"), F.sum("cnt").alias("total"), (100.0 * F.sum(F.when(F.col("gene").startswith(mt), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("percent_mt"))
    return agg.filter((F.col("n_genes") >= least_genes) & (F.col("n_genes") < most_genes) & (F.col("percent_mt") < most_mt))


def sc_lognorm(cells: DataFrame, scale: float = 10_000.0) -> DataFrame:
    """S15. ln(1 + scale * x / cell total)."""
    return cells.withColumn("v", F.log1p(F.lit(scale) * F.col("cnt") / F.sum("cnt").over(Window.partitionBy("cell"))))


def _cell_number(cells: DataFrame) -> DataFrame:
    """One row: the number of distinct cells."""
    return cells.agg(F.countDistinct("cell").cast("double").alias("nc"))


def local_trend(x: np.ndarray, y: np.ndarray, n: np.ndarray, span: float) -> np.ndarray:
    """The local quadratic trend of y at each x, by tricube weights over the nearest points that hold a share ``span`` of all n."""
    out = np.empty(len(x))
    for i, c in enumerate(x):
        far = np.abs(x - c)
        order = np.argsort(far, kind="stable")
        reach = far[order[min(np.searchsorted(np.cumsum(n[order]), np.ceil(span * n.sum())), len(x) - 1)]]
        w = np.sqrt(n * np.clip(1 - (far / reach) ** 3, 0, None) ** 3) if reach > 0 else np.sqrt(n * (far == 0))
        d = x - c
        out[i] = np.linalg.lstsq(np.stack([np.ones(len(x)), d, d * d], 1) * w[:, None], y * w, rcond=None)[0][0]
    return out


def sc_hvg(cells: DataFrame, n: int, n_cells: int | None = None, span: float = 0.3, bins: int = 1024) -> DataFrame:
    """S16. Genes of largest variance of standardised counts: (gene, mean, var, std_var).

    A local quadratic trend of log variance over log mean gives each gene's expected deviation; its counts, less their mean and over that deviation, are
    clipped at the root of the number of cells, and std_var is their variance. The trend is fitted on the driver over the means of ``bins`` classes of log mean (so
    over the genes themselves where classes hold one each) and interpolated between them. Absent counts are zeros of n_cells cells, by default as many as the
    input has.
    """
    m = cells.groupBy("gene").agg(F.sum("cnt").cast("double").alias("s"), F.sum(F.col("cnt") * F.col("cnt")).alias("q"), F.count_if(F.col("cnt") != 0).alias("k"))
    m = m.withColumn("nc", F.lit(float(n_cells))) if n_cells else m.crossJoin(F.broadcast(_cell_number(cells)))  # one row
    m = m.withColumn("mean", F.col("s") / F.col("nc")).withColumn("var", (F.col("q") - F.col("s") * F.col("s") / F.col("nc")) / (F.col("nc") - 1)).filter("var > 0 AND mean > 0")
    m = checkpoint(m.withColumn("x", F.log10("mean")).withColumn("y", F.log10("var")))
    ends = m.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    m = m.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * bins), F.lit(bins - 1)).cast("int")).drop("lo", "hi")
    table = m.groupBy("bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")  # at most as many rows as bins
    spark = cells.sparkSession
    if not len(table):
        return m.select("gene", "mean", "var", F.lit(None).cast("double").alias("std_var"))
    xs = table["x"].to_numpy()
    fit = local_trend(xs, table["y"].to_numpy(), table["n"].to_numpy(float), span)
    rows = [(int(table["bin"].iloc[i]), *(float(v[j]) for j in (max(i - 1, 0), i, min(i + 1, len(xs) - 1)) for v in (xs, fit))) for i in range(len(xs))]
    near = spark.createDataFrame(rows, "b int, x0 double, f0 double, x1 double, f1 double, x2 double, f2 double")
    m = m.join(F.broadcast(near), F.col("bin") == F.col("b"))
    side = lambda a, f: F.coalesce(F.try_divide((F.col(f) - F.col("f1")) * (F.col("x") - F.col("x1")), F.col(a) - F.col("x1")), F.lit(0.0))
    trend = F.col("f1") + F.when(F.col("x") < F.col("x1"), side("x0", "f0")).otherwise(side("x2", "f2"))
    m = m.withColumn("sd", F.sqrt(F.pow(F.lit(10.0), trend))).select("gene", "mean", "var", "sd", "nc", "k")
    z = cells.filter("cnt <> 0").select(F.col("gene").alias("g"), "cnt").join(m, F.col("g") == F.col("gene"))
    z = z.groupBy("gene", "mean", "var", "sd", "nc", "k").agg(F.sum(F.pow(F.least((F.col("cnt") - F.col("mean")) / F.col("sd"), F.sqrt("nc")), F.lit(2))).alias("zz"))
    std = z.select("gene", "mean", "var", ((F.col("zz") + (F.col("nc") - F.col("k")) * F.pow(F.col("mean") / F.col("sd"), 2)) / (F.col("nc") - 1)).alias("std_var"))
    return std.orderBy(F.desc("std_var"), "gene").limit(n)


def sc_scale(values: DataFrame, n_cells: int | None = None) -> DataFrame:
    """S16. z-scores of each gene over n_cells cells, by default as many as the input has, absent values being zeros; for the values present."""
    m = values.groupBy(F.col("gene").alias("g")).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    m = m.withColumn("nc", F.lit(float(n_cells))) if n_cells else m.crossJoin(F.broadcast(_cell_number(values)))  # one row
    m = m.select("g", (F.col("s") / F.col("nc")).alias("mean"), F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("nc")) / (F.col("nc") - 1)).alias("sd"))
    return values.join(m, F.col("gene") == F.col("g")).select("cell", "gene", F.try_divide(F.col("v") - F.col("mean"), F.col("sd")).alias("z"))


def sc_cluster(points: DataFrame, features: str, k: int, seed: int = 1) -> DataFrame:
    """S17. k-means clusters of points in a vector column, such as cells on their principal components."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(points).transform(points)


def sc_markers(values: DataFrame, clusters: DataFrame, least_pct: float = 0.1, least_fc: float = 0.1) -> DataFrame:
    """S18. Per cluster and gene the Wilcoxon rank sum against all other cells, by mid-ranks with the zeros of absent values.

    (cluster, gene, pct1, pct2, logfc, auc, z, p), for positive genes only. values: cell, gene, v > 0; clusters: cell, cluster.
    """
    return _markers(values, clusters.withColumn("scope", F.lit("")), least_pct, least_fc).drop("scope")


def sc_markers_pairwise(values: DataFrame, clusters: DataFrame, least_pct: float = 0.1, least_fc: float = 0.1) -> DataFrame:
    """S18 within each pair of clusters: (cluster, other, and what sc_markers gives). A cell takes part in as many pairs as there are other clusters."""
    c = clusters.select("cluster").distinct()  # a few tens
    pairs = c.join(c.withColumnRenamed("cluster", "other"), F.col("cluster") != F.col("other")).select(F.col("cluster").alias("c"), F.least("cluster", "other").alias("a"), F.greatest("cluster", "other").alias("b"))
    scoped = clusters.join(pairs, F.col("cluster") == F.col("c")).select("cell", "cluster", F.struct("a", "b").alias("scope"))
    out = _markers(values, scoped, least_pct, least_fc)
    return out.select("cluster", F.when(F.col("cluster") == F.col("scope.a"), F.col("scope.b")).otherwise(F.col("scope.a")).alias("other"), *[x for x in out.columns if x not in ("scope", "cluster")])


def _markers(values: DataFrame, clusters: DataFrame, least_pct: float, least_fc: float) -> DataFrame:
    """Markers within each scope of (cell, cluster, scope)."""
    sizes = clusters.groupBy("scope", "cluster").agg(F.count("*").alias("n1"))
    total = clusters.groupBy("scope").agg(F.count("*").alias("n"))  # one row per scope
    x = values.filter("v > 0").join(clusters, "cell")
    per = x.groupBy(F.col("scope").alias("ps"), F.col("gene").alias("pg"), F.col("v").alias("pv")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("ps", "pg")
    per = per.withColumn("upto", F.sum("k").over(w.orderBy("pv"))).withColumn("nz", F.sum("k").over(w)).withColumn("ties", F.sum(F.pow("k", 3) - F.col("k")).over(w))
    x = x.join(per, (F.col("scope") == F.col("ps")) & (F.col("gene") == F.col("pg")) & (F.col("v") == F.col("pv"))).drop("ps", "pg", "pv").join(total, "scope")
    x = x.withColumn("rk", F.col("n") - F.col("nz") + F.col("upto") - (F.col("k") - 1) / 2)
    g = x.groupBy("scope", "cluster", "gene").agg(F.sum("rk").alias("rs"), F.count("*").alias("k1"), F.sum(F.expm1("v")).alias("s1"), F.first("nz").alias("nz"), F.first("n").alias("n"), F.first("ties").alias("ties"))
    whole = x.groupBy("scope", "gene").agg(F.sum(F.expm1("v")).alias("s"))
    g = g.join(sizes, ["scope", "cluster"]).join(whole, ["scope", "gene"]).withColumn("n2", F.col("n") - F.col("n1"))
    zeros = F.col("n") - F.col("nz")
    rs = F.col("rs") + (F.col("n1") - F.col("k1")) * (zeros + 1) / 2
    u = rs - F.col("n1") * (F.col("n1") + 1) / 2
    g = g.withColumn("auc", u / (F.col("n1") * F.col("n2")))
    tie = F.col("ties") + F.pow(zeros, 3) - zeros
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((F.col("n") + 1) - tie / (F.col("n") * (F.col("n") - 1))))
    z = (F.abs(u - F.col("n1") * F.col("n2") / 2.0) - 0.5) / sd
    g = g.withColumn("z", z).withColumn("pct1", F.col("k1") / F.col("n1")).withColumn("pct2", (F.col("nz") - F.col("k1")) / F.col("n2"))
    g = g.withColumn("logfc", F.log2(F.col("s1") / F.col("n1") + 1) - F.log2((F.col("s") - F.col("s1")) / F.col("n2") + 1))
    return g.filter((F.greatest("pct1", "pct2") >= least_pct) & (F.col("logfc") >= least_fc)).select("scope", "cluster", "gene", "pct1", "pct2", "logfc", "auc", "z", normal_tail(F.col("z")).alias("p"))


# The coefficients of the published approximation of the complementary error function, from the constant term on.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal (relative error below 1.2e-7)."""
    x = F.greatest(z, F.lit(0.0)) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + c
    return F.least(t * F.exp(poly - x * x), F.lit(1.0))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """S19. Quartiles and whiskers (last values within 1.5 interquartile ranges)."""
    q = quantiles(df, group, value, (0.25, 0.5, 0.75)).withColumnRenamed(group, "qg")
    both = df.join(q, F.col(group) == F.col("qg")).withColumn("iqr", F.col("q")[2] - F.col("q")[0])
    inside = lambda f: f(F.when(F.col(value).between(F.col("q")[0] - 1.5 * F.col("iqr"), F.col("q")[2] + 1.5 * F.col("iqr")), F.col(value)))
    return both.groupBy(group).agg(F.count(value).alias("n"), F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("med"), F.first(F.col("q")[2]).alias("q3"), inside(F.min).alias("low"), inside(F.max).alias("high"))


def pairwise_dist(values: DataFrame, metric: str = "manhattan", feature: str = "gene", sample: str = "sample", v: str = "cnt") -> DataFrame:
    """S20. Manhattan or 1 - r between each pair of samples over common features."""
    if metric == "correlation":
        return pearson(values, feature, sample, v).select("sa", "sb", (1 - F.col("r")).alias("dist"))
    a = values.select(F.col(feature).alias("f"), F.col(sample).alias("sa"), F.col(v).alias("va"))
    b = values.select(F.col(feature).alias("g"), F.col(sample).alias("sb"), F.col(v).alias("vb"))
    return a.join(b, (F.col("f") == F.col("g")) & (F.col("sa") < F.col("sb"))).groupBy("sa", "sb").agg(F.sum(F.abs(F.col("va") - F.col("vb"))).alias("dist"))
