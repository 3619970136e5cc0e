"""Interval joins and what is built on them.

All overlap joins share bin_join: both sides are cut in bins of a fixed width, joined by equality on the keys and the bin, and a
pair is kept only in the first bin that both have, so none comes twice. Coordinates are 1-based and inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.islands import number_islands

WIDTH = 512


def _bins(df: DataFrame, start: str, end: str, width: int, side: str, reach: int = 0) -> DataFrame:
    lo, hi = (F.floor((F.col(start) - reach) / width), F.floor((F.col(end) + reach) / width))
    return df.filter(F.col(start) <= F.col(end)).withColumn(f"__first_{side}", lo).withColumn("__bin", F.explode(F.sequence(lo, hi)))


def bin_join(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], a_iv: tuple[str, str], b_iv: tuple[str, str], width: int = WIDTH, reach: int = 0) -> DataFrame:
    """Pairs whose intervals, the first side's widened by reach, share a position. Column names of the sides must differ.

    Open ends must be closed before. A dense bin is a hot key, which adaptive execution splits.
    """
    left = _bins(a, *a_iv, width, "a", reach)
    right = _bins(b, *b_iv, width, "b").withColumnRenamed("__bin", "__bin_b")
    on = [F.col(x) == F.col(y) for x, y in keys] + [F.col("__bin") == F.col("__bin_b")]
    both = left.join(right, on)
    both = both.filter((F.col(a_iv[0]) - reach <= F.col(b_iv[1])) & (F.col(b_iv[0]) <= F.col(a_iv[1]) + reach) & (F.col("__bin") == F.greatest("__first_a", "__first_b")))
    return both.drop("__bin", "__bin_b", "__first_a", "__first_b")


def point_join(points: DataFrame, intervals: DataFrame, keys: list[tuple[str, str]], pos: str, iv: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs of a point and an interval that holds it: a point has one bin, so only intervals are exploded."""
    left = points.withColumn("__bin", F.floor(F.col(pos) / width))
    right = _bins(intervals, *iv, width, "b").withColumnRenamed("__bin", "__bin_b").drop("__first_b")
    on = [F.col(x) == F.col(y) for x, y in keys] + [F.col("__bin") == F.col("__bin_b")]
    return left.join(right, on).filter(F.col(pos).between(F.col(iv[0]), F.col(iv[1]))).drop("__bin", "__bin_b")


def round_double(x: Column, places: int) -> Column:
    """x to so many places as SQL engines with binary arithmetic round it: the scaled number to the nearest whole one. F.round goes by the shortest decimal
    of x instead, so 87 / 600, which is just below 0.145, would give 0.15."""
    return F.round(x * 10.0**places) / 10.0**places


def overlap_len(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2) + 1


def _tags(tagpos: DataFrame) -> DataFrame:
    return tagpos.select("tag", "len", F.col("chr").alias("tchr"), F.col("strand").alias("tstrand"), "pos", F.col("lib").alias("tlib"), "abun")


def _in_loci(loci: DataFrame, tagpos: DataFrame, stranded: bool = False) -> DataFrame:
    own = ["strand"] if stranded else []
    return point_join(_tags(tagpos), loci.select("name", "chr", "lstart", "lend", *own), [("tchr", "chr"), *[("tstrand", c) for c in own]], "pos", ("lstart", "lend"))


def coord_abundance(loci: DataFrame, tagpos: DataFrame, libs: tuple[str, ...], main: tuple[int, ...] = (21, 22), noise: tuple[int, ...] = (20, 23, 24), stranded: bool = False) -> DataFrame:
    """A3. Per locus and library the abundance of main and noise sizes, and main / (main + noise): 0 without main, else 1 without noise.
    stranded: of the tags on the locus's own strand only (loci have a strand then)."""
    hit = _in_loci(loci, tagpos.filter(F.col("len").isin(*main, *noise)), stranded)
    size = lambda lib, sizes: F.sum(F.when((F.col("tlib") == lib) & F.col("len").isin(*sizes), F.col("abun")))
    sums = hit.groupBy(F.col("name").alias("n")).agg(*[f(lib, s).alias(f"{k}_{lib}") for lib in libs for f, k, s in ((size, "main", main), (size, "noise", noise))])
    both = loci.join(sums, F.col("name") == F.col("n"), "left").drop("n")
    m, n = (lambda lib: F.col(f"main_{lib}")), (lambda lib: F.col(f"noise_{lib}"))
    ratio = lambda lib: F.when(m(lib).isNull(), F.lit(0.0)).when(n(lib).isNull(), F.lit(1.0)).otherwise(m(lib) / (m(lib) + n(lib)))
    return both.select("name", "chr", "lstart", "lend", *[c for lib in libs for c in (f"main_{lib}", f"noise_{lib}", ratio(lib).alias(f"ratio_{lib}"))])


def coord_size_abundance(loci: DataFrame, tagpos: DataFrame, sizes: tuple[int, ...] = (20, 21, 22, 23, 24), count: bool = False) -> DataFrame:
    """A4 (A5 with count). Per locus and library the abundance (number of distinct tags) of each size, and over all sizes."""
    hit = _in_loci(loci, tagpos.filter(F.col("len").isin(*sizes)))
    of = lambda s: F.countDistinct(F.when(F.col("len") == s, F.col("tag"))) if count else F.coalesce(F.sum(F.when(F.col("len") == s, F.col("abun"))), F.lit(0))
    every = F.countDistinct("tag") if count else F.sum("abun")
    return hit.groupBy("name", F.col("tlib").alias("lib")).agg(*[of(s).alias(f"s{s}") for s in sizes], every.alias("total"))


def tag_hits(tagpos: DataFrame) -> DataFrame:
    return tagpos.groupBy(F.col("tag").alias("htag")).agg(F.countDistinct("chr", "strand", "pos").alias("hits"))


def cluster_abundance(loci: DataFrame, tagpos: DataFrame, sizes: tuple[int, ...] = (21, 22)) -> DataFrame:
    """A7. Per locus and size the abundance divided by the tag's hits, and the number of tag rows."""
    hits = tag_hits(tagpos)
    hit = _in_loci(loci, tagpos.filter(F.col("len").isin(*sizes))).join(hits, F.col("tag") == F.col("htag"))
    return hit.groupBy("name").agg(*[F.coalesce(F.sum(F.when(F.col("len") == s, F.col("abun") / F.col("hits"))), F.lit(0.0)).alias(f"norm{s}") for s in sizes], *[F.count_if(F.col("len") == s).alias(f"n{s}") for s in sizes])


def bin_counts(tagpos: DataFrame, width: int = 500, size: int = 22, least: int = 1) -> DataFrame:
    """A8. Distinct positions of tags of one size per chromosome and bin, bins with more than ``least``, numbered along each chromosome."""
    per = tagpos.filter(F.col("len") == size).select("chr", "strand", "pos").distinct()
    per = per.groupBy("chr", F.floor((F.col("pos") - 1) / width).alias("bin")).agg(F.count("*").alias("n")).filter(F.col("n") > least)
    return per.withColumn("bin_no", F.row_number().over(Window.partitionBy("chr").orderBy("bin")))


def strand_bias(loci: DataFrame, tagpos: DataFrame, main: tuple[int, ...] = (21,)) -> DataFrame:
    """A14. Main and noise sums by strand, main share, predicted strand (b if equal) and the larger strand's share of main."""
    hit = _in_loci(loci, tagpos)
    s = lambda strand, inside: F.coalesce(F.sum(F.when((F.col("tstrand") == strand) & (F.col("len").isin(*main) if inside else ~F.col("len").isin(*main)), F.col("abun"))), F.lit(0))
    agg = hit.groupBy("name").agg(s("w", True).alias("main_w"), s("c", True).alias("main_c"), s("w", False).alias("noise_w"), s("c", False).alias("noise_c"))
    main_sum, all_sum = F.col("main_w") + F.col("main_c"), F.col("main_w") + F.col("main_c") + F.col("noise_w") + F.col("noise_c")
    strand = F.when(F.col("main_w") > F.col("main_c"), "w").when(F.col("main_w") < F.col("main_c"), "c").otherwise("b")
    return agg.select("*", F.try_divide(main_sum, all_sum).alias("phasi_ratio"), strand.alias("pstrand"), F.try_divide(F.greatest("main_w", "main_c"), main_sum).alias("strand_ratio"))


def coords_to_tags(loci: DataFrame, tagpos: DataFrame, sizes: tuple[int, ...] = (21, 22), most_hits: int = 10, least_abun: int = 5) -> DataFrame:
    """J12. Tags inside a locus that pass the size, hits and abundance limits."""
    hits = tag_hits(tagpos)
    t = tagpos.filter(F.col("len").isin(*sizes) & (F.col("abun") >= least_abun))
    return _in_loci(loci, t).join(hits.filter(F.col("hits") <= most_hits), F.col("tag") == F.col("htag")).select("name", "tag", "len", F.col("tstrand").alias("strand"), "pos", F.col("tlib").alias("lib"), "abun", "hits")


def overlap_config(trans: DataFrame, genes: DataFrame) -> DataFrame:
    """J3. Per transcript the overlapping genes of other names, flags and configurations, comma-joined in name order, NA without any.

    Flags on a w transcript: 5 the gene's end lies inside, 3 its start does (swapped on c), 0 both, 8 the gene spans the
    transcript. Configuration: F same strand, R opposite.
    """
    a = trans.select("trans", F.col("gene").alias("own"), "chr", "strand", "tstart", "tend")
    b = genes.select(F.col("gene").alias("g"), F.col("chr").alias("gchr"), F.col("strand").alias("gstrand"), F.col("tstart").alias("gs"), F.col("tend").alias("ge"))
    both = bin_join(a, b, [("chr", "gchr")], ("tstart", "tend"), ("gs", "ge")).filter("own <> g")
    starts, ends = F.col("gs").between(F.col("tstart"), F.col("tend")), F.col("ge").between(F.col("tstart"), F.col("tend"))
    w = F.col("strand") == "w"
    flag = F.when(starts & ends, "0").when(~starts & ~ends, "8").when(ends, F.when(w, "5").otherwise("3")).otherwise(F.when(w, "3").otherwise("5"))
    conf = F.when(F.col("strand") == F.col("gstrand"), "F").otherwise("R")
    lists = both.groupBy(F.col("trans").alias("t")).agg(F.array_sort(F.collect_list(F.struct("g", "gs", "ge", flag.alias("f"), conf.alias("c")))).alias("l"))
    joined = lambda k: F.coalesce(F.array_join(F.transform("l", lambda x: x[k]), ","), F.lit("NA"))
    return a.join(lists, F.col("trans") == F.col("t"), "left").select("trans", joined("g").alias("genes"), joined("f").alias("flags"), joined("c").alias("confs"))


def overlap_transcripts(loci: DataFrame, trans: DataFrame) -> DataFrame:
    """J4. Pairs of a locus and a transcript that overlap, with the overlap's length."""
    t = trans.select("trans", "gene", F.col("chr").alias("tchr"), "strand", "tstart", "tend")
    both = bin_join(loci.select("name", "chr", "lstart", "lend"), t, [("chr", "tchr")], ("lstart", "lend"), ("tstart", "tend"))
    return both.select("name", "trans", "gene", "lstart", "lend", overlap_len(F.col("lstart"), F.col("lend"), F.col("tstart"), F.col("tend")).alias("nt"))


def overlap_exons(pairs: DataFrame, exons: DataFrame) -> DataFrame:
    """J5. Per locus and transcript of J4 the overlap with its exons, and the number of exons."""
    x = exons.select(F.col("trans").alias("xt"), "xstart", "xend")
    both = pairs.join(x, F.col("trans") == F.col("xt"))
    nt = F.greatest(F.lit(0), overlap_len(F.col("lstart"), F.col("lend"), F.col("xstart"), F.col("xend")))
    return both.groupBy("name", "trans").agg(F.sum(nt).cast("long").alias("exon_nt"), F.count("*").alias("n_exons"))


def annotate_loci(loci: DataFrame, trans: DataFrame, exons: DataFrame, perc: float = 0.1, nt: int = 50) -> DataFrame:
    """J6. Overlaps of enough share and length with their exon overlap; loci without one keep a single unmatched row."""
    pairs = overlap_transcripts(loci, trans).withColumn("perc", F.col("nt") / (F.col("lend") - F.col("lstart") + 1)).filter((F.col("perc") >= perc) & (F.col("nt") >= nt))
    ex = overlap_exons(pairs, exons).select(F.col("name").alias("en"), F.col("trans").alias("et"), "exon_nt", "n_exons")
    full = pairs.join(ex, (F.col("name") == F.col("en")) & (F.col("trans") == F.col("et")), "left").select(F.col("name").alias("pn"), "trans", "gene", "nt", "perc", "exon_nt", "n_exons")
    return loci.select("name", "chr").join(full, F.col("name") == F.col("pn"), "left").drop("pn")


def dice(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """2 * overlap / sum of lengths of half-open ranges."""
    return 2.0 * F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)) / ((e1 - s1) + (e2 - s2))


def dice_join(a: DataFrame, b: DataFrame, least: float = 0.45) -> DataFrame:
    """J7. Pairs (name_a, name_b, ratio) of loci of one chromosome with a Dice overlap of ``least`` or more, rounded to 2 places."""
    x = a.select(F.col("name").alias("name_a"), F.col("chr").alias("ca"), F.col("lstart").alias("sa"), F.col("lend").alias("ea"))
    y = b.select(F.col("name").alias("name_b"), F.col("chr").alias("cb"), F.col("lstart").alias("sb"), F.col("lend").alias("eb"))
    both = bin_join(x, y, [("ca", "cb")], ("sa", "ea"), ("sb", "eb")).withColumn("d", dice(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb")))
    return both.filter(F.col("d") >= least).select("name_a", "name_b", round_double(F.col("d"), 2).alias("ratio"))


def match_ends(a: DataFrame, b: DataFrame) -> DataFrame:
    """J8. Pairs (name_a, name_b, ratio) of loci of one chromosome with the same start and end."""
    y = b.select(F.col("name").alias("name_b"), F.col("chr").alias("cb"), F.col("lstart").alias("sb"), F.col("lend").alias("eb"))
    both = a.join(y, (F.col("chr") == F.col("cb")) & (F.col("lstart") == F.col("sb")) & (F.col("lend") == F.col("eb")))
    return both.select(F.col("name").alias("name_a"), "name_b", F.lit(1.0).alias("ratio"))


def match_clusters(loci: DataFrame, clusters: DataFrame, members: DataFrame, least: float | None = 0.99) -> DataFrame:
    """J8. Members of the clusters whose range matches a locus, with a Dice overlap of ``least`` (0.99 close, 0.5 fuzzy) or, for None, at both
    ends exactly. clusters: name, chr, lstart, lend; members: cluster and any columns."""
    pairs = match_ends(loci, clusters) if least is None else dice_join(loci, clusters, least)
    return pairs.join(members, F.col("name_b") == F.col("cluster")).drop("name_b")


def compare_loci(a: DataFrame, b: DataFrame, least: float = 0.25) -> DataFrame:
    """J9. Matches with the shared block's start and length; unmatched loci of both sides with nulls."""
    x = a.select(F.col("name").alias("name_a"), F.col("chr").alias("ca"), F.col("lstart").alias("sa"), F.col("lend").alias("ea"))
    y = b.select(F.col("name").alias("name_b"), F.col("chr").alias("cb"), F.col("lstart").alias("sb"), F.col("lend").alias("eb"))
    both = bin_join(x, y, [("ca", "cb")], ("sa", "ea"), ("sb", "eb")).filter(dice(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb")) >= least)
    match = both.select("name_a", "name_b", F.greatest("sa", "sb").alias("block_start"), (F.least("ea", "eb") - F.greatest("sa", "sb")).alias("block_len"))
    none = F.lit(None)
    only_a = x.join(match, "name_a", "left_anti").select("name_a", none.cast("string").alias("name_b"), none.cast("long").alias("block_start"), none.cast("long").alias("block_len"))
    only_b = y.join(match, "name_b", "left_anti").select(none.cast("string").alias("name_a"), "name_b", none.cast("long").alias("block_start"), none.cast("long").alias("block_len"))
    return match.unionByName(only_a).unionByName(only_b)


def match_loci_flank(a: DataFrame, b: DataFrame, flank: int = 50) -> DataFrame:
    """J10. Starts within the flank, else ends within it, else containment; unmatched of both sides."""
    x = a.select(F.col("name").alias("name_a"), F.col("chr").alias("ca"), F.col("lstart").alias("sa"), F.col("lend").alias("ea"))
    y = b.select(F.col("name").alias("name_b"), F.col("chr").alias("cb"), F.col("lstart").alias("sb"), F.col("lend").alias("eb"))
    kind = (
        F.when(F.abs(F.col("sa") - F.col("sb")) <= flank, "start")
        .when(F.abs(F.col("ea") - F.col("eb")) <= flank, "end")
        .when((F.col("sa") >= F.col("sb")) & (F.col("ea") <= F.col("eb")) | (F.col("sb") >= F.col("sa")) & (F.col("eb") <= F.col("ea")), "inside")
    )
    match = bin_join(x, y, [("ca", "cb")], ("sa", "ea"), ("sb", "eb"), reach=flank).withColumn("kind", kind).filter("kind IS NOT NULL").select("name_a", "name_b", "kind")
    only_a = x.join(match, "name_a", "left_anti").select("name_a", F.lit(None).cast("string").alias("name_b"), F.lit("only_a").alias("kind"))
    only_b = y.join(match, "name_b", "left_anti").select(F.lit(None).cast("string").alias("name_a"), "name_b", F.lit("only_b").alias("kind"))
    return match.unionByName(only_a).unionByName(only_b)


def loci_in_repeats(loci: DataFrame, irs: DataFrame) -> DataFrame:
    """J11. Loci inside an inverted repeat (ir, chr, s5, e3), with the flanks on both arms."""
    i = irs.select("ir", F.col("chr").alias("ichr"), "s5", "e3")
    both = bin_join(loci.select("name", "chr", "lstart", "lend"), i, [("chr", "ichr")], ("lstart", "lend"), ("s5", "e3")).filter("lstart >= s5 AND lend <= e3")
    return both.select("name", "ir", (F.col("lstart") - F.col("s5")).alias("flank5"), (F.col("e3") - F.col("lend")).alias("flank3"))


def annotate_first(loci: DataFrame, genes: DataFrame) -> DataFrame:
    """J16. The first gene (by start, then name) that holds the locus, else its start, else its end; else inter."""
    g = genes.select("gene", F.col("chr").alias("gchr"), F.col("tstart").alias("gs"), F.col("tend").alias("ge"))
    both = bin_join(loci.select("name", "chr", "lstart", "lend"), g, [("chr", "gchr")], ("lstart", "lend"), ("gs", "ge"))
    starts, ends = F.col("lstart").between(F.col("gs"), F.col("ge")), F.col("lend").between(F.col("gs"), F.col("ge"))
    kind = F.when(starts & ends, 1).when(starts, 2).when(ends, 3)
    best = both.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy(F.col("name").alias("n")).agg(F.min(F.struct("kind", "gs", "gene")).alias("b"))
    return loci.select("name").join(best, F.col("name") == F.col("n"), "left").select("name", F.coalesce("b.gene", F.lit("inter")).alias("gene"), F.coalesce("b.kind", F.lit(0)).alias("kind"))


def full_length(sites: DataFrame, trans: DataFrame, exons: DataFrame) -> DataFrame:
    """J29. Per overlapping site (name, chr, lstart, lend) and transcript whether the site lies strictly inside it and some exon."""
    t = trans.select("trans", F.col("chr").alias("tchr"), "tstart", "tend")
    x = exons.select(F.col("trans").alias("xt"), "xstart", "xend")
    both = bin_join(sites.select("name", "chr", "lstart", "lend"), t, [("chr", "tchr")], ("lstart", "lend"), ("tstart", "tend")).join(x, F.col("trans") == F.col("xt"))
    inside = (F.col("lstart") > F.col("tstart")) & (F.col("lend") < F.col("tend")) & (F.col("lstart") > F.col("xstart")) & (F.col("lend") < F.col("xend"))
    return both.groupBy("name", "trans").agg(F.when(F.bool_or(inside), "fl").otherwise("nfl").alias("status"))


def merge_annotations(genes: DataFrame, feats: DataFrame, stranded: bool = True) -> DataFrame:
    """W13. Overlapping intervals of both sets (chr, strand, tstart, tend, name) merged, by strand if stranded: (chr, strand, mstart, mend, n,
    genes, feats), strand * without; genes and feats are the members' names of either set, in order."""
    strand = F.col("strand") if stranded else F.lit("*")
    part = lambda df, kind: df.select("chr", strand.alias("strand"), "tstart", "tend", "name", F.lit(kind).alias("kind"))
    rows = number_islands(part(genes, "g").unionByName(part(feats, "f")), ["chr", "strand"], "tstart", "tend", out="__i")
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))), ",")
    return rows.groupBy("chr", "strand", "__i").agg(F.min("tstart").alias("mstart"), F.max("tend").alias("mend"), F.count("*").alias("n"), names("g").alias("genes"), names("f").alias("feats")).drop("__i")


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Maximal runs of intervals that overlap (or lie within gap of each other): keys, mstart, mend, n."""
    return number_islands(rows, keys, start, end, gap, "__i").groupBy(*keys, "__i").agg(F.min(start).alias("mstart"), F.max(end).alias("mend"), F.count("*").alias("n")).drop("__i")


def intergenic(genes: DataFrame, least: int = 25, chroms: DataFrame | None = None) -> DataFrame:
    """W14. (chr, strand, name, rstart, rend): regions between merged genes (name, chr, strand, tstart, tend) of a chromosome and strand, the
    first from 1, the last open (null end), longer than ``least``. chroms: (chr) whose strands without genes are regions as a whole.

    On w a region is named after the gene that follows, _up, and the last after its gene, _down; on c after the gene before, _up, and the
    first after its gene, _down.
    """
    m = number_islands(genes, ["chr", "strand"], "tstart", "tend", out="__i").groupBy("chr", "strand", "__i")
    m = m.agg(F.min("tstart").alias("mstart"), F.max("tend").alias("mend"), F.min(F.struct("tstart", "name"))["name"].alias("head"), F.max(F.struct("tend", "name"))["name"].alias("tail"))
    # numbers are dense: an island ends the region before it and begins the one of its own number
    left, right = F.struct("mend", "tail"), F.struct("mstart", "head")
    ends = F.array(F.struct(F.col("__i").alias("i"), left.alias("l"), F.when(F.lit(False), right).alias("r")), F.struct((F.col("__i") - 1).alias("i"), F.when(F.lit(False), left).alias("l"), right.alias("r")))
    gaps = m.select("chr", "strand", F.explode(ends).alias("e")).groupBy("chr", "strand", "e.i").agg(F.max("e.l").alias("l"), F.max("e.r").alias("r"))
    w, first, last = F.col("strand") == "w", F.col("l").isNull(), F.col("r").isNull()
    up, down, head, tail = F.lit("_up"), F.lit("_down"), F.col("r.head"), F.col("l.tail")
    name = F.when(first, F.concat(head, F.when(w, up).otherwise(down))).when(w & last, F.concat(tail, down)).when(w, F.concat(head, up)).otherwise(F.concat(tail, up))
    out = gaps.select("chr", "strand", name.alias("name"), F.coalesce(F.col("l.mend") + 1, F.lit(1).cast("long")).alias("rstart"), (F.col("r.mstart") - 1).alias("rend"))
    if chroms is not None:
        every = chroms.select("chr", F.explode(F.array(F.lit("w"), F.lit("c"))).alias("strand")).distinct()
        empty = every.join(genes.select("chr", "strand").distinct(), ["chr", "strand"], "left_anti")
        out = out.unionByName(empty.select("chr", "strand", F.col("chr").cast("string").alias("name"), F.lit(1).cast("long").alias("rstart"), F.lit(None).cast("long").alias("rend")))
    return out.filter(F.col("rend").isNull() | (F.col("rend") - F.col("rstart") + 1 > least))


def merge_mer_clusters(tagpos: DataFrame, width: int = 500, size: int = 22, gap: int = 10) -> DataFrame:
    """W15. Bins with tags of one size, trimmed to the tags' extent, adjacent ones merged when they come within gap."""
    t = tagpos.filter(F.col("len") == size)
    per = t.groupBy("chr", F.floor((F.col("pos") - 1) / width).alias("bin")).agg(F.min("pos").alias("s"), F.max(F.col("pos") + F.col("len") - 1).alias("e"))
    return islands(per, ["chr"], "s", "e", gap)


def transcripts_from_exons(exons: DataFrame) -> DataFrame:
    """A19. Start, end and exon count per transcript."""
    return exons.groupBy("chr", "strand", "trans").agg(F.min("xstart").alias("tstart"), F.max("xend").alias("tend"), F.count("*").alias("n_exons"))


def collapse_isoforms(trans: DataFrame, most_score: int = 1) -> DataFrame:
    """A22. Transcripts (gene, trans, chr, strand, tstart, tend, score, coding): per gene, chromosome, strand and coding status the overlapping
    isoforms merged, with their number, names and best score; an isoform that overlaps no other is a row of its own (kind uniq, else merged).
    What has a best match score above ``most_score`` is an annotated gene and goes, its isoforms of lower score with it. Isoforms that only touch
    don't overlap."""
    keys = ["gene", "chr", "strand", "coding"]
    rows = number_islands(trans, keys, "tstart", "tend", -1, "__i")
    out = rows.groupBy(*keys, "__i").agg(F.min("tstart").alias("mstart"), F.max("tend").alias("mend"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("trans")), ",").alias("isoforms"), F.max("score").alias("best_score"))
    return out.drop("__i").filter(F.col("best_score") <= most_score).withColumn("kind", F.when(F.col("n") > 1, "merged").otherwise("uniq"))


def gene_promoters(trans: DataFrame, length: int = 500) -> DataFrame:
    """A25. Per gene, chromosome and strand the promoter up to the outermost 5' end (unique) and to the innermost one (long)."""
    g = trans.groupBy("gene", "chr", "strand").agg(F.min("tstart").alias("s1"), F.max("tstart").alias("s2"), F.min("tend").alias("e1"), F.max("tend").alias("e2"))
    w = F.col("strand") == "w"
    return g.select(
        "gene", "chr", "strand",
        F.when(w, F.greatest(F.col("s1") - length, F.lit(1))).otherwise(F.col("e2") + 1).alias("uniq_start"),
        F.when(w, F.col("s1") - 1).otherwise(F.col("e2") + length).alias("uniq_end"),
        F.when(w, F.greatest(F.col("s1") - length, F.lit(1))).otherwise(F.col("e1") + 1).alias("long_start"),
        F.when(w, F.col("s2") - 1).otherwise(F.col("e2") + length).alias("long_end"),
    )
