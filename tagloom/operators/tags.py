"""Tag libraries: counting, comparing, summarising, joining (A1 A2 A6 J1 J2 J13 J14 J26 J27 J30 J31 P6 P7 P9 P14 SO1 to SO5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_reads(reads: DataFrame) -> DataFrame:
    """A1. (lib, tag, abun) from one row per read."""
    return reads.groupBy("lib", "tag").agg(F.count("*").alias("abun"))


def size_distribution(tags: DataFrame) -> DataFrame:
    """A2. Distinct tags and abundance per library and length."""
    return tags.groupBy("lib", F.length("tag").alias("len")).agg(F.count("*").alias("n_tags"), F.sum("abun").alias("abun"))


def size_distribution_mapped(tags: DataFrame, mapped: DataFrame) -> DataFrame:
    """A2 over all and over mapped tags, side by side."""
    m = tags.join(mapped.select("tag").distinct(), "tag", "left_semi")
    after = size_distribution(m).select(F.col("lib").alias("l"), F.col("len").alias("n"), F.col("n_tags").alias("mapped_tags"), F.col("abun").alias("mapped_abun"))
    both = size_distribution(tags).join(after, (F.col("lib") == F.col("l")) & (F.col("len") == F.col("n")), "left")
    return both.select("lib", "len", "n_tags", "abun", F.coalesce("mapped_tags", F.lit(0)).alias("mapped_tags"), F.coalesce("mapped_abun", F.lit(0)).alias("mapped_abun"))


def tag_summary(tags: DataFrame, libs: tuple[str, ...]) -> DataFrame:
    """A6. Tag by library, with length, sum and maximum."""
    return tags.groupBy("tag").agg(*[F.coalesce(F.sum(F.when(F.col("lib") == x, F.col("abun"))), F.lit(0)).alias(x) for x in libs], F.sum("abun").alias("norm_sum"), F.max("abun").alias("max_norm")).withColumn("len", F.length("tag"))


def extract_rows(master: DataFrame, query: DataFrame, key: str, query_key: str) -> tuple[DataFrame, DataFrame]:
    """J1. Master rows whose key is, and is not, among the query's keys; both without regard to case."""
    m, q = master.withColumn("__k", F.lower(key)), query.select(F.lower(query_key).alias("__k"))
    return m.join(q, "__k", "left_semi").drop("__k"), m.join(q, "__k", "left_anti").drop("__k")


def compare_libs(a: DataFrame, b: DataFrame) -> DataFrame:
    """J2. Tags of two libraries with their kind: a, b or common (a's row). Each library is read and shuffled once; a null tag equals none."""
    both = a.select("tag", "abun", F.lit("a").alias("own")).unionByName(b.select("tag", "abun", F.lit("b").alias("own")))
    of = lambda x: F.collect_list(F.when(F.col("own") == x, F.struct("abun")))
    per = both.groupBy("tag").agg(of("a").alias("a"), of("b").alias("b"))
    shared = F.col("tag").isNotNull() & (F.size("a") > 0) & (F.size("b") > 0)
    said = lambda x, kind: F.transform(x, lambda r: F.struct(r["abun"].alias("abun"), kind.alias("kind")))
    return per.select("tag", F.inline(F.concat(said("a", F.when(shared, "common").otherwise("a")), F.when(shared, F.array()).otherwise(said("b", F.lit("b"))))))


def tags_to_positions(tags: DataFrame, tagpos: DataFrame) -> DataFrame:
    """J13. All positions of the given tags, end = pos + len - 1."""
    at = tagpos.select("tag", "chr", "strand", "pos", "len").distinct()
    return at.join(tags.select("tag").distinct(), "tag").select("tag", "chr", "strand", F.col("pos").alias("pstart"), (F.col("pos") + F.col("len") - 1).alias("pend"))


def tag_abundance(tags: DataFrame, counts: DataFrame, test: str, control: str) -> DataFrame:
    """J14. Test and control abundance of each tag, and their ratio, or their difference where the control has none."""
    own = tags.select("tag").distinct()
    of = lambda lib, name: counts.filter(F.col("lib") == lib).groupBy("tag").agg(F.sum("abun").alias(name))
    both = own.join(of(test, "test"), "tag", "left").join(of(control, "ctrl"), "tag", "left").fillna(0, ["test", "ctrl"])
    return both.withColumn("ratio", F.when(F.col("ctrl") > 0, F.col("test") / F.col("ctrl")).otherwise((F.col("test") - F.col("ctrl")).cast("double")))


def crop_tags(tags: DataFrame, least: int, most: int) -> DataFrame:
    """P6. Tags of at least ``least`` characters, cropped to ``most``; cropped tags that became equal are summed."""
    return tags.filter(F.length("tag") >= least).groupBy("lib", F.substring("tag", 1, most).alias("tag")).agg(F.sum("abun").alias("abun"))


def expand_tags(tags: DataFrame) -> DataFrame:
    """P7. One numbered row per read."""
    return tags.filter("abun > 0").select("lib", "tag", F.explode(F.sequence(F.lit(1), F.col("abun").cast("int"))).alias("copy"))


def split_pair(reads: DataFrame, at: int, seq: str = "seq") -> DataFrame:
    """P9. The parts before and from a breakpoint, as rows."""
    parts = F.array(F.struct(F.lit("5p").alias("end"), F.substring(seq, 1, at).alias("part")), F.struct(F.lit("3p").alias("end"), F.substr(seq, F.lit(at + 1)).alias("part")))
    return reads.select("name", F.explode(parts).alias("p")).select("name", "p.end", "p.part")


def expand_column(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """P14. One row per item of a joined column."""
    return df.withColumn(column, F.explode(F.split(column, sep)))


def annotate_de(de: DataFrame, mirna: DataFrame, counts: DataFrame) -> DataFrame:
    """J26. Differential tags with the names of equal reference sequences (U read as T) and their counts."""
    m = mirna.select("mir", F.translate(F.upper("mirseq"), "U", "T").alias("mseq"))
    return de.join(m, F.col("tag") == F.col("mseq")).drop("mseq").join(counts, "tag")


def merge_tables(attr: DataFrame, fpkm: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """J27. Full outer merge of three tables by key."""
    return attr.join(fpkm, key, "full").join(counts, key, "full")


def annotate_results(results: DataFrame, annots: DataFrame, key: str, annot_key: str, entry: str) -> DataFrame:
    """J27. Results with their annotations, all results kept; of several rows with one entry id the first by key stays, rows without one all do."""
    both = results.join(annots, F.col(key) == F.col(annot_key), "left").drop(annot_key)
    cols = both.columns
    first = both.filter(F.col(entry).isNotNull()).groupBy(entry).agg(F.min(F.struct(key, *[c for c in cols if c not in (key, entry)])).alias("__r"))
    return first.select(*[F.col(entry) if c == entry else F.col(f"__r.{c}").alias(c) for c in cols]).unionByName(both.filter(F.col(entry).isNull()))


def merge_strands(cluster: DataFrame) -> DataFrame:
    """J30. Abundance of c tags, moved by 3, added to w tags of one name, position and size; unmatched c tags kept."""
    at = F.when(F.col("strand") == "c", F.col("pos") + 3).otherwise(F.col("pos"))
    return cluster.groupBy("name", at.alias("pos"), "len").agg(F.sum("abun").alias("abun"), F.max(F.when(F.col("strand") == "w", 1).otherwise(0)).alias("has_w"))


def merge_srna(srna: DataFrame, phasi: DataFrame, seqs: DataFrame) -> DataFrame:
    """J31. phasiRNAs and the sRNAs of a transcript that aren't among them; the latter anchored by where the transcript holds them."""
    rest = srna.join(phasi.select("trans", "seq"), ["trans", "seq"], "left_anti").join(seqs.select(F.col("trans").alias("st"), F.col("seq").alias("full")), F.col("trans") == F.col("st"))
    rest = rest.withColumn("pos", F.instr("full", F.col("seq")).cast("long")).filter("pos > 0").select("trans", "seq", "pos", "abun", F.lit("srna").alias("kind"))
    return phasi.select("trans", "seq", "pos", "abun", F.lit("phasi").alias("kind")).unionByName(rest)


def dedup_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W1. The first row of each key in a total order."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")


def max_tag(tags: DataFrame) -> DataFrame:
    """W2. Each tag's largest abundance."""
    return tags.groupBy("tag").agg(F.max("abun").alias("abun"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """W20. The first n rows of each key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("nth") <= n)
