"""Ranks in intervals, seeded sampling, signals and methylation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.dominance import count_dominating, value_ranks
from tagloom.operators.expression import quantiles
from tagloom.operators.intervals import point_join
from tagloom.runtime import checkpoint, few_rows


def seeded(*cols: Column | str, seed: int) -> Column:
    """32 hexadecimal digits that depend on the columns and the seed alone, so plans and retries agree: a place in a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).cast("binary"))


def uniform(*cols: Column | str, seed: int) -> Column:
    """The same as a number in [0, 1), from the first 13 digits."""
    return F.conv(F.substring(seeded(*cols, seed=seed), 1, 13), 16, 10).cast("long") / float(1 << 52)


def methylation_bins(calls: DataFrame, width: int) -> DataFrame:
    """A9. Per library, chromosome and bin 100 * methylated / total for ALL and each context, 0 where none; bins from 0 to the last one."""
    df = calls.withColumn("bin", F.floor((F.col("position") - 1) / width))
    per = df.groupBy("lib_id", "chr_id", "bin", "type").agg(F.sum("cmethylated").alias("m"), F.sum("totalc").alias("t"))
    share = lambda k: F.sum(F.when(F.col("type") == k, F.col("m")) if k else F.col("m")) * 100.0 / F.sum(F.when(F.col("type") == k, F.col("t")) if k else F.col("t"))
    wide = per.groupBy("lib_id", "chr_id", "bin").agg(share(None).alias("ALL"), *[share(k).alias(k) for k in ("CG", "CHG", "CHH")])
    dense = per.groupBy(F.col("lib_id").alias("l"), F.col("chr_id").alias("c")).agg(F.max("bin").alias("last")).select("l", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("b"))
    both = dense.join(wide, (F.col("l") == F.col("lib_id")) & (F.col("c") == F.col("chr_id")) & (F.col("b") == F.col("bin")), "left")
    return both.select(F.col("l").alias("lib_id"), F.col("c").alias("chr_id"), F.col("b").alias("bin"), *[F.coalesce(k, F.lit(0.0)).alias(k.lower()) for k in ("ALL", "CG", "CHG", "CHH")])


def probe_coords(results: DataFrame, anno: DataFrame) -> DataFrame:
    """J32. Coordinates of probes; X becomes 0, Y the last number + 1, a missing one chromosome 99."""
    last = anno.agg(F.max(F.col("chrom").try_cast("int")).alias("last"))
    a = anno.crossJoin(F.broadcast(last)).select(F.col("probe").alias("ap"), F.when(F.col("chrom") == "X", 0).when(F.col("chrom") == "Y", F.col("last") + 1).otherwise(F.col("chrom").try_cast("int")).alias("chr"), "pstart", "pend")  # one row
    return results.join(a, F.col("probe") == F.col("ap"), "left").drop("ap").withColumn("chr", F.coalesce("chr", F.lit(99)))


def interval_rank(probes: DataFrame, width: int) -> DataFrame:
    """W4. Rank by fold change among the track's probes within width of the probe's start, on coordinates laid end to end by chromosome
    and closed to a ring, so intervals at an end reach into the neighbour; rank / number.

    What lies in an interval is what lies before its end less what lies before its start, so each probe asks twice for counts of places and
    values, on each turn of the ring that its interval reaches; count_dominating answers without pairs. Rows without a track, a place or a fold change
    have no rank.
    """
    p = probes.filter("track IS NOT NULL AND chr IS NOT NULL AND pstart IS NOT NULL AND fc IS NOT NULL")
    ends = p.groupBy(F.col("chr").alias("echr")).agg((F.max("pend") + 1).alias("len"))
    ends = ends.withColumn("off", F.sum("len").over(Window.orderBy("echr")) - F.col("len")).withColumn("ring", F.sum("len").over(Window.partitionBy()))  # one row per chromosome
    p = p.join(few_rows(ends), F.col("chr") == F.col("echr")).select("probe", "track", "fc", (F.col("off") + F.col("pstart")).alias("x"), "ring")
    p = value_ranks(p, "track", "fc", ["x", "probe"])
    sizes = p.groupBy(F.col("track").alias("t")).agg(F.count("*").alias("m"))  # one row per track
    p = checkpoint(p.join(few_rows(sizes), F.col("track") == F.col("t")).drop("t"))
    turn = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("turn")
    end = lambda shift, edge, sign: F.struct((F.col("x") + shift).alias("x"), F.lit(edge).alias("edge"), F.lit(sign).alias("sign"))
    ask = p.select("track", "vrank", "above", "m", "ring", F.explode(F.array(end(-width, 0, -1), end(width, 2, 1))).alias("e"))
    ask = ask.select("track", "vrank", "above", "m", "ring", "e", turn).select("track", "vrank", "above", "m", "ring", (F.col("e.x") - F.col("turn") * F.col("ring")).alias("x"), "e.edge", "e.sign", "turn")
    # before the ring nothing lies, behind it all
    out = ask.filter("x >= ring").groupBy("track", "vrank").agg(F.sum(F.col("sign") * F.col("m")).alias("n"), F.sum(F.col("sign") * F.col("above")).alias("larger"))
    # a question's number: its probe's vrank, which is distinct in the track, its turn and its end
    real = ask.filter("x >= 0 AND x < ring").withColumn("id", F.col("vrank") * 6 + (F.col("turn") + 1) * 2 + (F.col("sign") + 1) / 2)
    got = count_dominating(p, real, "track").withColumn("sign", F.when(F.col("id") % 2 == 1, 1).otherwise(-1))
    got = got.groupBy("track", F.floor(F.col("id") / 6).alias("vrank")).agg(F.sum(F.col("sign") * F.col("before")).alias("n"), F.sum(F.col("sign") * F.col("n")).alias("larger"))
    every = out.unionByName(got).groupBy(F.col("track").alias("t"), F.col("vrank").alias("v")).agg(F.sum("n").alias("n"), F.sum("larger").alias("larger"))
    both = p.join(every, (F.col("track") == F.col("t")) & (F.col("vrank") == F.col("v")))
    return both.select("probe", "track", (F.col("larger") + 1).alias("rank"), "n").withColumn("rel", F.col("rank") / F.col("n"))


def population_rank(probes: DataFrame, n: int, seed: int) -> DataFrame:
    """W5. Rank of each probe among n sampled ones of its track and itself, divided by n + 1. The sample is n rows per track."""
    order = Window.partitionBy("track").orderBy(seeded("probe", seed=seed), "probe")
    s = probes.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).select(F.col("track").alias("st"), F.col("fc").alias("sfc"))
    lists = s.groupBy("st").agg(F.collect_list("sfc").alias("fcs"))
    both = probes.join(lists, F.col("track") == F.col("st"))
    return both.select("probe", "track", ((F.size(F.filter("fcs", lambda x: x > F.col("fc"))) + 1) / (F.size("fcs") + 1)).alias("rel"))


def fisher_combined(p: Column) -> Column:
    """Upper chi-square tail of -2 * sum of ln(p + 1e-15) over an array of p values: the closed Poisson sum for even degrees of freedom."""
    x = F.aggregate(p, F.lit(0.0), lambda a, v: a - F.log(v + 1e-15))
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.when(i < F.size(p), F.struct((a["t"] * x / i).alias("t"), (a["s"] + a["t"] * x / i).alias("s"))).otherwise(a))
    return F.greatest(F.least(F.exp(-x) * terms["s"], F.lit(1 - 1e-15)), F.lit(1e-15))


def enrichment(probes: DataFrame, width: int, weight: float, n: int, seed: int) -> DataFrame:
    """S4. Weighted interval and population ranks, empirical p against n sampled probes of the track, combined over tracks."""
    i = interval_rank(probes, width).select("probe", "track", F.col("rel").alias("ri"))
    r = population_rank(probes, 100, seed).select(F.col("probe").alias("p2"), F.col("track").alias("t2"), F.col("rel").alias("rp"))
    w = i.join(r, (F.col("probe") == F.col("p2")) & (F.col("track") == F.col("t2"))).select("probe", "track", (F.col("ri") * weight / 10 + F.col("rp") * (1 - weight / 10)).alias("score"))
    order = Window.partitionBy("track").orderBy(seeded("probe", seed=seed + 1), "probe")
    s = w.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).groupBy(F.col("track").alias("st")).agg(F.collect_list("score").alias("random"))
    e = w.join(s, F.col("track") == F.col("st")).select("probe", "track", (F.size(F.filter("random", lambda x: x <= F.col("score"))) / F.size("random")).alias("p"))
    return e.groupBy("probe").agg(fisher_combined(F.array_sort(F.collect_list("p"))).alias("p"), F.count("*").alias("n_tracks"))


def random_regions(chroms: DataFrame, features: DataFrame, iterations: int, seed: int) -> DataFrame:
    """S5. For each feature (name, flen) and iteration a random region of its length that fits a chromosome (chr, clen)."""
    it = features.select("name", "flen", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("it"))
    table = chroms.agg(F.array_sort(F.collect_list(F.struct("chr", "clen"))).alias("cs"))  # one row: a genome's chromosomes
    df = it.crossJoin(F.broadcast(table)).withColumn("fit", F.filter("cs", lambda c: c["clen"] >= F.col("flen"))).filter(F.size("fit") > 0)
    pick = F.element_at("fit", (F.floor(uniform("name", "it", seed=seed) * F.size("fit")) + 1).cast("int"))
    df = df.withColumn("c", pick).withColumn("rstart", (F.floor(uniform("name", "it", seed=seed + 1) * (F.col("c.clen") - F.col("flen") + 1)) + 1).cast("long"))
    return df.select("name", "it", "c.chr", "rstart", (F.col("rstart") + F.col("flen") - 1).alias("rend"), F.when(uniform("name", "it", seed=seed + 2) < 0.5, "w").otherwise("c").alias("strand"))


def coverage_thresholds(regions: DataFrame, points: DataFrame) -> DataFrame:
    """S6. Per iteration the 95th and 5th percentile of points inside a region, then mean and median over iterations."""
    r = regions.select("name", "it", F.col("chr").alias("rchr"), "rstart", "rend")
    n = point_join(points, r, [("chr", "rchr")], "pos", ("rstart", "rend")).groupBy(F.col("name").alias("n"), F.col("it").alias("i")).agg(F.count("*").alias("k"))
    k = r.join(n, (F.col("name") == F.col("n")) & (F.col("it") == F.col("i")), "left").select("it", F.coalesce("k", F.lit(0)).alias("k"))
    per = quantiles(k, "it", "k", (0.95, 0.05))  # then one row for each iteration
    return per.agg(F.avg(F.col("q")[0]).alias("mean95"), F.avg(F.col("q")[1]).alias("mean5"), F.expr("percentile(q[0], 0.5)").alias("med95"), F.expr("percentile(q[1], 0.5)").alias("med5"))


def conservation_p(observed: DataFrame, random: DataFrame) -> DataFrame:
    """S7. Share of iterations whose random match beats the observed identity."""
    return observed.join(random.select(F.col("name").alias("n"), F.col("ident").alias("r")), F.col("name") == F.col("n")).groupBy("name").agg(F.avg((F.col("r") > F.col("ident")).cast("double")).alias("p"))


def balanced_samples(pos: DataFrame, neg: DataFrame, size: int, samples: int, seed: int) -> DataFrame:
    """S8. For each sample size / 2 rows of either kind, by seeded order: (sample, kind, name)."""
    both = pos.select("name", F.lit("pos").alias("kind")).unionByName(neg.select("name", F.lit("neg").alias("kind")))
    df = both.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    order = Window.partitionBy("sample", "kind").orderBy(seeded("name", "sample", seed=seed), "name")
    return df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= size // 2).select("sample", "kind", "name")


def random_seqs(names: DataFrame, size: int, seed: int) -> DataFrame:
    """P13. A random sequence of a size for each distinct name: (name, seq), from digests of name and seed. Names whose sequences
    agree share one, the smallest keeps it and the others draw again from a second digest; equal ones among those are left out."""
    n = names.select("name").distinct()
    draw = lambda turn: F.substring(F.concat(*[F.translate(seeded("name", F.lit(turn), F.lit(k), seed=seed), "0123456789abcdef", "ACGTACGTACGTACGT") for k in range((size + 31) // 32)]), 1, size)
    first = n.withColumn("seq", draw(0)).withColumn("nth", F.row_number().over(Window.partitionBy("seq").orderBy("name")))
    kept = first.filter("nth = 1").select("name", "seq")
    again = first.filter("nth > 1").select("name", draw(1).alias("seq")).groupBy("seq").agg(F.min("name").alias("name")).select("name", "seq")
    return kept.unionByName(again.join(kept.select("seq"), "seq", "left_anti").select("name", "seq"))


def merge_signal(a: DataFrame, b: DataFrame, how: str = "mean") -> DataFrame:
    """A26. Arrays of (name, vals) merged place by place: mean (max) where both are present, else the one present."""
    both = a.select("name", F.col("vals").alias("x")).join(b.select(F.col("name").alias("n"), F.col("vals").alias("y")), F.col("name") == F.col("n"), "full")
    one = lambda x, y: F.coalesce((x + y) / 2 if how == "mean" else F.greatest(x, y), x, y)
    empty = F.array().cast("array<double>")
    return both.select(F.coalesce("name", "n").alias("name"), F.zip_with(F.coalesce("x", empty), F.coalesce("y", empty), one).alias("vals"))


def signal_points(df: DataFrame, how: str = "mean") -> DataFrame:
    """A26 over points (name, idx, val): one value per place."""
    return df.groupBy("name", "idx").agg((F.avg("val") if how == "mean" else F.max("val")).alias("val"))


def bin_signal(df: DataFrame, n: int, stat: str = "mean") -> DataFrame:
    """A27. Arrays of (name, vals) in n equal bins over their places; max, mean or sum of the non-zero values of a bin, 0 without any."""
    x = df.select("name", F.size("vals").alias("len"), F.posexplode("vals").alias("i", "v"))
    x = x.withColumn("bin", F.floor(F.col("i") * n / F.col("len")).cast("int") + 1)
    f = {"max": F.max, "mean": F.avg, "sum": F.sum}[stat]
    return x.groupBy("name", "bin").agg(F.coalesce(f(F.when(F.col("v") != 0, F.col("v"))), F.lit(0.0)).alias("v"))

