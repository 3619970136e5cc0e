"""Readers and writers of sequence, annotation, alignment and report files, as Spark jobs (IO1 to IO25).

Records that span lines are read with their own separator, so each is one row and files split where Spark's text source can
split them. Schemas are explicit; missing values are nulls.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.runtime import checkpoint, once

Paths = str | list[str]


def _lines(spark: SparkSession, path: Paths) -> DataFrame:
    return spark.read.text(path)


def _stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]+)*$", 1)


def _records(spark: SparkSession, path: Paths) -> DataFrame:
    """Records that begin with > at a line's start, without it: > may occur within a line."""
    r = spark.read.text(path, lineSep="\n>")
    return r.withColumn("value", F.regexp_replace("value", "^>", "")).filter(F.trim("value") != "")  # the first of a file still has it


def read_fasta(spark: SparkSession, path: Paths) -> DataFrame:
    """IO1. (name, seq): first token of the header, lines joined, empty records dropped."""
    r = _records(spark, path)
    body = F.regexp_replace(F.substr("value", F.length(F.substring_index("value", "\n", 1)) + 1), r"\s", "")
    return r.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), body.alias("seq")).filter("seq <> ''")


def read_fasta_counted(spark: SparkSession, path: Paths) -> DataFrame:
    """IO1. Records and empty ones, per file."""
    r = _records(spark, path).withColumn("file", F.input_file_name())
    body = F.regexp_replace(F.substr("value", F.length(F.substring_index("value", "\n", 1)) + 1), r"\s", "")
    return r.groupBy("file").agg(F.count("*").alias("records"), F.count_if(body == "").alias("empty"))


def read_fastq(spark: SparkSession, path: Paths, blacklist: str | None = None) -> DataFrame:
    """IO2. (read_id, seq, qual, lib) of four-line records; headers that match the blacklist are dropped.

    Records are split at lines that begin with @. A quality line may begin with it too: its record then lacks one, and the next
    piece, in the file's order, is the quality. Pieces are numbered, and those few find each other by their numbers, also over the
    border of two parts of a file. A record that a file's end cuts off has no quality; pieces without a sequence are dropped.
    """
    r = spark.read.text(path, lineSep="\n@").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), _stem().alias("lib"))
    r = r.withColumn("value", F.regexp_replace("value", r"\r(?=\n|\z)", ""))
    # the first record of a file still has its @
    r = r.withColumn("p", F.split("value", "\n")).withColumn("p", F.when(F.size("p") >= 3, F.split(F.regexp_replace("value", "^@", ""), "\n")).otherwise(F.col("p"))).drop("value")
    whole = r.filter(F.size("p") >= 4).withColumn("qual", F.get("p", F.lit(3)))
    short = r.filter(F.size("p") == 3)  # header, sequence, +
    # where the rows of each part of a file begin, and the last row of the part before it: one row for each part
    ends = r.groupBy("file", "part").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    ends = ends.withColumn("prior", F.lag("last").over(Window.partitionBy("file").orderBy("part"))).select(F.col("file").alias("ef"), F.col("part").alias("ep"), "first", "prior")
    lone = r.filter(F.size("p") <= 2).join(ends, (F.col("file") == F.col("ef")) & (F.col("part") == F.col("ep")))
    lone = lone.select(F.when(F.col("id") == F.col("first"), F.col("prior")).otherwise(F.col("id") - 1).alias("of"), F.concat(F.lit("@"), F.get("p", F.lit(0))).alias("qual"))
    mended = short.join(lone, F.col("id") == F.col("of"), "left").drop("of")
    cols = ["p", "lib", "qual"]
    all_ = whole.select(*cols).unionByName(mended.select(*cols))
    out = all_.select(F.regexp_extract(F.get("p", F.lit(0)), r"^(\S+)", 1).alias("read_id"), F.get("p", F.lit(0)).alias("header"), F.get("p", F.lit(1)).alias("seq"), "qual", "lib")
    return (out.filter(~F.col("header").rlike(blacklist)) if blacklist else out).drop("header")


def read_tagcounts(spark: SparkSession, path: Paths) -> DataFrame:
    """IO3. (lib, tag, abun); lib is the file's stem."""
    return spark.read.csv(path, sep="\t", schema="tag string, abun long").filter("tag IS NOT NULL").select(_stem().alias("lib"), "tag", "abun")


def read_gff(spark: SparkSession, path: Paths) -> DataFrame:
    """IO4. Genes of a GFF3 file: (chr, strand, name, gstart, gend)."""
    g = spark.read.csv(path, sep="\t", comment="#", schema="chr string, source string, type string, gstart long, gend long, score string, strand string, phase string, attrs string")
    return g.filter("type = 'gene'").select("chr", F.translate("strand", "+-", "wc").alias("strand"), F.regexp_extract("attrs", r"^[^=;]+=([^;]+)", 1).alias("name"), "gstart", "gend")


# Where five GTF dialects keep the names of gene and transcript.
GTF_DIALECTS = {
    "ensembl": (r'gene_id "([^"]+)"', r'transcript_id "([^"]+)"'),
    "rocket": (r'gene_id "([^"]+)"', r'transcript_id "([^"]+)"'),
    "pasa": (r'gene_id "([^"]+)"', r'transcript_id "([^"]+)"'),
    "trinity": (r"Name=([^;|]+)", r"ID=([^;.]+)"),
    "pacbio": (r'gene_id "([^".]+)', r'transcript_id "([^"]+)"'),
}


def read_gtf(spark: SparkSession, path: Paths, dialect: str = "ensembl", least_score: float = 90.0) -> DataFrame:
    """IO5. Exons (gene, trans, chr, strand, xstart, xend, flag) whose score is . or above the least."""
    g = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chr string, source string, type string, xstart long, xend long, score string, strand string, phase string, attrs string")
    gene, trans = GTF_DIALECTS[dialect]
    ok = (F.col("score") == ".") | (F.col("score").try_cast("double") > least_score)
    kinds = ("exon", "cDNA_match") if dialect == "trinity" else ("exon",)
    return g.filter(F.col("type").isin(*kinds) & ok).select(F.regexp_extract("attrs", gene, 1).alias("gene"), F.regexp_extract("attrs", trans, 1).alias("trans"), "chr", F.translate("strand", "+-", "wc").alias("strand"), "xstart", "xend", F.upper(F.substring(F.lit(dialect), 1, 1)).alias("flag"))


SAM = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"


def read_sam(spark: SparkSession, path: Paths) -> tuple[DataFrame, DataFrame]:
    """IO6. (alignments with tags as a map, header lines)."""
    lines = _lines(spark, path)
    head = lines.filter(F.col("value").startswith("@"))
    f = F.split("value", "\t")
    cols = [f[i].try_cast(x.split()[1]).alias(x.split()[0]) for i, x in enumerate(SAM.split(", "))]
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substr(t, F.lit(6)))))
    return lines.filter(~F.col("value").startswith("@") & (F.size(f) >= 11)).select(*cols, tags.alias("tags")), head


def filter_sam(sam: DataFrame, include: tuple[int, ...], exclude: tuple[int, ...], least_mapq: int) -> tuple[DataFrame, DataFrame]:
    """P8. Alignments with an included flag (0 always is), no excluded one and enough quality; unmapped ones (flag 4) aside."""
    kept = sam.filter(F.col("flag").isin(0, *include) & (~F.col("flag").isin(*exclude) if exclude else F.lit(True)) & (F.col("mapq") >= least_mapq))
    return kept.filter("flag <> 4"), sam.filter("flag = 4")


def read_bed(spark: SparkSession, path: Paths) -> DataFrame:
    """IO7. BED6."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chr string, bstart long, bend long, name string, score string, strand string")


def write_bed(df: DataFrame, path: str) -> None:
    """IO7. One folder per strand."""
    cols = df.select("strand", F.concat_ws("\t", "chr", "bstart", "bend", "name", "score", "strand").alias("value"))
    cols.write.partitionBy("strand").text(path)


def read_map(spark: SparkSession, path: Paths) -> DataFrame:
    """IO8. Aligner map rows on the w strand, 1-based, hits + 1."""
    m = spark.read.csv(path, sep="\t", quote="", schema="tag string, strand string, chr string, off long, seq string, qual string, other long, mis string")
    return m.filter("strand = '+'").select("tag", "chr", F.lit("w").alias("strand"), (F.col("off") + 1).alias("pos"), "seq", (F.col("other") + 1).alias("hits"))


def read_clusters(spark: SparkSession, path: Paths) -> DataFrame:
    """IO9. Rows of phased-cluster blocks with their header's id, chromosome and range (header tokens 3, 7, 11, 13)."""
    r = _records(spark, path).withColumn("l", F.split("value", "\r?\n"))
    h = F.split(F.trim(F.col("l")[0]), r"\s+")
    r = r.select(h.alias("h"), F.posexplode(F.slice("l", F.lit(2), F.size("l"))).alias("n", "row")).filter("trim(row) <> ''")
    f = F.split("row", "\t")
    part = lambda i: F.get(F.col("h"), F.lit(i))
    names = ("mchr", "strand", "pos", "tag_id", "tag", "len", "abun", "k_n", "k_k", "hits", "best_pos", "pval")
    kinds = ("string", "string", "long", "string", "string", "int", "long", "int", "int", "int", "long", "double")
    return r.select(part(2).alias("cluster"), part(6).alias("chr"), part(10).try_cast("long").alias("cstart"), part(12).try_cast("long").alias("cend"), *[F.get(f, F.lit(i)).try_cast(k).alias(x) for i, (x, k) in enumerate(zip(names, kinds, strict=True))])


def read_phas_list(spark: SparkSession, path: Paths, most_p: float) -> DataFrame:
    """IO10. Lines ``p|phase|x = chr:start..end`` up to a p value."""
    at = lambda k: F.regexp_extract("value", r"^\s*([0-9.eE+-]+)\|(\d+)\|\S*\s*=\s*([^:]+):(\d+)\.\.(\d+)", k)
    df = _lines(spark, path).select(at(1).try_cast("double").alias("p"), at(2).try_cast("int").alias("phase"), F.trim(at(3)).alias("chr"), at(4).try_cast("long").alias("lstart"), at(5).try_cast("long").alias("lend"))
    return df.filter(F.col("p") <= most_p)


BLAST = "query string, subject string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int, slen int, sstrand string"


def read_blast_tab(spark: SparkSession, path: Paths) -> DataFrame:
    """IO11. Tabular hits."""
    return spark.read.csv(path, sep="\t", comment="#", schema=BLAST)


def annotate_hits(hits: DataFrame) -> DataFrame:
    """P11. Overhangs of the query over the subject, matches, mismatches, unaligned bases and total variance of hits, and whether they pass.

    Identity and matches are rounded, halves to the even number. Up to two bases of overhang at one end, none at the other, allow
    a total variance of 5, overhangs at both ends one of 6; all else fails.
    """
    df = hits.withColumn("hang5", F.col("qstart") - F.col("sstart")).withColumn("hang3", (F.col("qlen") - F.col("qend")) - (F.col("slen") - F.col("send")))
    df = df.withColumn("match", F.bround(F.col("length") * (F.bround("pident") / 100)).cast("int"))
    df = df.withColumn("mis", F.col("length") - F.col("match")).withColumn("unaligned", F.col("qlen") - F.col("length"))
    df = df.withColumn("total_var", F.col("mis") + F.col("unaligned"))
    one_end = (F.col("hang5") <= 2) & (F.col("hang3") == 0) | (F.col("hang3") <= 2) & (F.col("hang5") == 0)
    most = F.when(one_end, 5).when((F.col("hang5") >= 1) & (F.col("hang3") >= 1), 6)
    return df.withColumn("status", F.when(F.col("total_var") <= most, "pass").otherwise("fail"))


def read_matchannot(spark: SparkSession, path: Paths) -> DataFrame:
    """IO12. One row per blank-line block: isoform, cigar, and the last gene, transcript and result lines."""
    r = spark.read.text(path, lineSep="\n\n").withColumn("l", F.split("value", "\n"))
    line = lambda k: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter("l", lambda x: F.trim(x).startswith(f"{k}:"))), -1)
    value = lambda k: F.trim(F.regexp_replace(line(k), f"^\\s*{k}:", ""))
    return r.select(F.regexp_extract(value("isoform"), r"^(\S+)", 1).alias("isoform"), value("cigar").alias("cigar"), F.regexp_extract(value("gene"), r"^(\S+)", 1).alias("gene"), F.regexp_extract(value("tr"), r"^(\S+)", 1).alias("trans"), value("result").alias("result"), F.regexp_extract(value("result"), r"sc:\s*(\d+)", 1).try_cast("int").alias("score")).filter("isoform IS NOT NULL AND isoform <> ''")


def read_target_report(spark: SparkSession, path: Paths) -> DataFrame:
    """IO13. Six-line blocks: query, target, score and range, and the paired lines."""
    r = spark.read.text(path, lineSep="\n\n")
    g = lambda p, k=1: F.regexp_extract("value", p, k)
    return r.select(
        g(r"query=([^,\s]+)").alias("mir"), g(r"target=([^,\s]+)").alias("target"), g(r"score=([0-9.]+)").try_cast("decimal(5,1)").alias("score"), g(r"range=(\d+)-(\d+)").try_cast("long").alias("bstart"), g(r"range=(\d+)-(\d+)", 2).try_cast("long").alias("bend"),
        g(r"target\s+5'\s+(\S+)\s+3'").alias("tar_seq"), g(r"query\s+3'\s+(\S+)\s+5'").alias("mir_seq"),
    ).filter("mir <> ''")


def _shared_database(spark: SparkSession, options: dict[str, str]) -> None:
    local = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    if not local and ":memory:" in options["url"]:
        raise ValueError("a database in one process's memory is another one in each executor: name one that all reach")


def _quoted(spark: SparkSession, options: dict[str, str], column: str) -> str:
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(column)


def read_jdbc(spark: SparkSession, options: dict[str, str], predicate: str | None = None, by: str | None = None, parts: int = 8) -> DataFrame:
    """IO14. A relational table; the predicate (SQL) and the columns read are pushed down. The caller gives URL and account.

    by: a whole-number column over whose range the read is dealt to ``parts`` tasks, each with its own bounds in the database's query. The range
    is asked for by one query, under the same predicate; rows without that column's value are the first task's.
    """
    _shared_database(spark, options)
    bounds: dict[str, str] = {}
    if by is not None:
        c, own = _quoted(spark, options, by), set(_columns(spark, options))
        asked = spark.read.format("jdbc").options(**options)
        where = "" if predicate is None else " WHERE " + re.sub(r"'[^']*'|[A-Za-z_]\w*", lambda m: _quoted(spark, options, m[0]) if m[0] in own else m[0], predicate)
        ends = asked.option("dbtable", f"(SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM {options['dbtable']}{where}) ends").load().first()
        if ends[0] is not None:
            bounds = {"partitionColumn": by, "lowerBound": str(int(ends[0])), "upperBound": str(int(ends[1]) + 1), "numPartitions": str(parts)}
    df = spark.read.format("jdbc").options(**options, **bounds).load()
    return df if predicate is None else df.filter(predicate)


def _columns(spark: SparkSession, options: dict[str, str]) -> list[str]:
    return spark.read.format("jdbc").options(**options).load().columns


def write_jdbc(df: DataFrame, options: dict[str, str], mode: str = "append") -> None:
    """IO15. Append, or overwrite keeping the table's definition, all or nothing.

    Rows go to a table of their own first, numbered, so that those which a retried task writes twice can be told; one transaction then
    empties the target (overwrite), adds each numbered row once, and a failure before it leaves the target as it was. A target that isn't there is made.
    The staging table goes in the end. Text columns need a type that can be compared (createTableColumnTypes), as the database's largest type often can't.
    """
    spark = df.sparkSession
    _shared_database(spark, options)
    table, stage = options["dbtable"], f"stage_{uuid.uuid4().hex[:20]}"
    own = options | {"dbtable": stage}
    rows = checkpoint(df)  # numbers stay the same in a retry
    try:
        there = bool(_columns(spark, options))
    except Exception as e:  # noqa: BLE001  every database has its own error for a table that isn't there
        if not re.search(r"does not exist|not exist|doesn't exist|no such table|not found|unknown table|42X05|42S02|42P01", str(e), re.I):
            raise
        there = False
    if not there:
        rows.limit(0).write.format("jdbc").options(**options).mode("append").save()
    rows.withColumn("row_no", F.monotonically_increasing_id()).write.format("jdbc").options(**own).mode("append").save()
    cols = ", ".join(_quoted(spark, options, c) for c in df.columns)
    n = _quoted(spark, options, "row_no")
    adding = f"INSERT INTO {table} ({cols}) SELECT {cols} FROM (SELECT DISTINCT {cols}, {n} FROM {stage}) rows_once"
    try:
        _transaction(spark, options, [f"DELETE FROM {table}", adding] if mode == "overwrite" else [adding])
    finally:
        _transaction(spark, options, [f"DROP TABLE {stage}"])


def _transaction(spark: SparkSession, options: dict[str, str], statements: list[str]) -> None:
    jvm = spark._jvm
    if "driver" in options:
        jvm.org.apache.spark.util.Utils.classForName(options["driver"], True, False)
    props = jvm.java.util.Properties()
    for k, v in options.items():
        if k in ("user", "password"):
            props.setProperty(k, v)
    con = jvm.java.sql.DriverManager.getConnection(options["url"], props)
    try:
        con.setAutoCommit(False)
        st = con.createStatement()
        for s in statements:
            st.executeUpdate(s)
        con.commit()
    except Exception:
        con.rollback()
        raise
    finally:
        con.close()


def ingest_mirna(fasta_lines: DataFrame, organisms: DataFrame) -> DataFrame:
    """IO16. (name, accession, organism, generic, seq, len, phylum) from (header, seq) and (code, phylum)."""
    t = F.split("header", " ")
    df = fasta_lines.select(t[0].alias("name"), t[1].alias("accession"), F.concat_ws(" ", t[2], t[3]).alias("organism"), F.element_at(t, -1).alias("generic"), F.translate("seq", "U", "T").alias("seq"), F.length("seq").alias("len"), F.substring_index(t[0], "-", 1).alias("c"))
    return df.join(organisms, F.col("c") == F.col("code"), "left").drop("c", "code")


def read_signal(spark: SparkSession, path: Paths) -> DataFrame:
    """IO17. (name, chr, strand, vals array of double): NA is null, c strands reversed."""
    s = spark.read.csv(path, sep="\t", schema="chr string, bstart long, bend long, name string, score string, strand string, len int, list string")
    vals = F.transform(F.split("list", ","), lambda x: x.try_cast("double"))
    return s.select("name", "chr", "strand", F.when(F.col("strand") == "-", F.reverse(vals)).otherwise(vals).alias("vals"))


def read_clstr(spark: SparkSession, path: Paths) -> DataFrame:
    """IO18. (cluster, member, is_rep) of sequence clusters."""
    r = spark.read.text(path, lineSep=">Cluster ").filter(F.trim("value") != "").withColumn("l", F.split("value", "\n"))
    r = r.select(F.trim(F.col("l")[0]).try_cast("long").alias("cluster"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("row")).filter("trim(row) <> ''")
    return r.select("cluster", F.regexp_extract("row", r">(.+?)\.\.\.", 1).alias("member"), F.col("row").rlike(r"\*\s*$").alias("is_rep"))


def read_samples(spark: SparkSession, path: Paths, by: str = "R") -> DataFrame:
    """IO19. A sample sheet with its samples joined by replicate (R) or group (G)."""
    s = spark.read.csv(path, sep="\t", header=True)
    key = {"R": "rep", "G": "group"}[by]
    return s.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("lib_id")), ",").alias("libs"), F.count("*").alias("n"))


def read_quant_gtfs(spark: SparkSession, path: Paths) -> DataFrame:
    """IO20. (sample, gene, trans, cov) of all samples' quantification files; sample is the file's stem."""
    g = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chr string, source string, type string, tstart long, tend long, score string, strand string, phase string, attrs string")
    at = lambda k: F.regexp_extract("attrs", f'{k} "([^"]+)"', 1)
    return g.filter("type = 'transcript'").select(_stem().alias("sample"), at("gene_id").alias("gene"), at("transcript_id").alias("trans"), at("cov").try_cast("double").alias("cov"), (F.col("tend") - F.col("tstart") + 1).alias("exon_len"))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    """IO21. Two lines a record."""
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value")).write.text(path)


def write_by_len(df: DataFrame, path: str, seq: str = "mir") -> None:
    """IO22. A folder for each of the sizes 21 to 24 and one for all others; gaps don't count."""
    n = F.length(F.replace(seq, F.lit("-"), F.lit("")))
    df.withColumn("size", F.when(n.between(21, 24), n.cast("string")).otherwise("other")).write.partitionBy("size").csv(path, header=True)


def read_counts(spark: SparkSession, path: Paths) -> DataFrame:
    """IO23. A gene by sample matrix as (gene, sample, cnt)."""
    wide = spark.read.csv(path, sep="\t", header=True)
    gene, samples = wide.columns[0], wide.columns[1:]
    return wide.unpivot([gene], samples, "sample", "cnt").select(F.col(gene).alias("gene"), "sample", F.col("cnt").try_cast("long").alias("cnt"))


def numbered_lines(spark: SparkSession, path: Paths) -> DataFrame:
    """(number, value): lines numbered from 1 in the order of files' names and of places within them. Each part of a file is counted by
    itself; a running sum over the parts, one row each, says where its numbers begin, so no task holds more than a part."""
    r = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"))
    parts = r.groupBy(F.col("file").alias("pf"), F.col("part").alias("pp")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pf", "pp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = r.join(F.broadcast(parts), (F.col("file") == F.col("pf")) & (F.col("part") == F.col("pp")))
    return both.select((F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), "value")


def read_10x(spark: SparkSession, matrix: str, genes: str, cells: str) -> DataFrame:
    """IO23. A MatrixMarket matrix with its names: (cell, gene, cnt). The first line that isn't a comment gives the sizes; a name is the first
    column of the line with its number. A path may be a folder, whose files follow each other by name."""
    m = numbered_lines(spark, matrix).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    sizes = m.agg(F.min("number").alias("sizes_at"))  # one row
    f = F.split(F.trim("value"), r"\s+")
    at = lambda k: F.get(f, F.lit(k)).try_cast("long")
    body = m.crossJoin(F.broadcast(sizes)).filter("number > sizes_at").select(at(0).alias("i"), at(1).alias("j"), at(2).alias("cnt"))
    names = lambda path, out: numbered_lines(spark, path).select("number", F.split("value", "\t")[0].alias(out))
    g, c = names(genes, "gene"), names(cells, "cell")
    return body.join(g, F.col("i") == g["number"]).join(c, F.col("j") == c["number"]).select("cell", "gene", "cnt")


def union_files(spark: SparkSession, paths: list[str], sep: str = "\t") -> DataFrame:
    """IO24. Files with the same header, one after another."""
    return spark.read.csv(paths, sep=sep, header=True)


def select_runs(spark: SparkSession, path: Paths, libs: tuple[str, ...], most_p: float, phase: int) -> DataFrame:
    """IO25. Lines of phased outputs whose name (lib_p_phase.list), of a file or a folder of parts, passes."""
    f = lambda k: F.regexp_extract(F.input_file_name(), r"([^/_]+)_([0-9.e-]+)_(\d+)\.[^/]*(?:/[^/]*)?$", k)
    df = _lines(spark, path).select(f(1).alias("lib"), f(2).try_cast("double").alias("p"), f(3).try_cast("int").alias("phase"), "value")
    return df.filter(F.col("lib").isin(*libs) & (F.col("p") <= most_p) & (F.col("phase") == phase))


def adapter_start(seq: Column, adapter: str, rate: float, least: int) -> Column:
    """Where the adapter begins in a sequence, from 1, or null: the first place at which it stands whole, or its first letters, ``least`` at least, at the
    sequence's end, with mismatches in up to a share ``rate`` of its letters there.

    A fold over the sequence's letters carries, for each number of mismatches, a word whose bits are the prefixes of the adapter that end at
    the letter. An adapter has 62 letters at most.
    """
    n, most = len(adapter), int(rate * len(adapter) + 1e-9)
    if not 0 < n <= 62:
        raise ValueError("adapter_start: an adapter has 1 to 62 letters")
    masks = {c: sum(1 << i for i, x in enumerate(adapter) if x == c) for c in set(adapter)}
    full = (1 << n) - 1
    zero = lambda v: F.lit(v).cast("long")
    start = F.struct(*[zero(0).alias(f"r{d}") for d in range(most + 1)], F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit"))

    def step(a: Column, c: Column) -> Column:
        mask = zero(0)
        for x, bits in masks.items():
            mask = F.when(c == x, zero(bits)).otherwise(mask)
        words, shifted = [], None
        for d in range(most + 1):
            moved = F.shiftleft(a[f"r{d}"], 1).bitwiseOR(zero(1)).bitwiseAND(zero(full))
            # one more letter that agrees, or any letter after one mismatch less
            words.append(moved.bitwiseAND(mask) if shifted is None else moved.bitwiseAND(mask).bitwiseOR(shifted))
            shifted = moved
        whole = words[-1].bitwiseAND(zero(1 << (n - 1))) != 0
        hit = F.when(a["hit"].isNull() & whole, a["at"] - (n - 2)).otherwise(a["hit"])
        return F.struct(*[w.alias(f"r{d}") for d, w in enumerate(words)], (a["at"] + 1).alias("at"), hit.alias("hit"))

    def finish(end: Column) -> Column:
        # at the end: the longest prefix whose own mismatches are few enough
        tails = [F.when(end[f"r{int(rate * k + 1e-9)}"].bitwiseAND(zero(1 << (k - 1))) != 0, end["at"] - k + 1) for k in range(n - 1, max(least, 1) - 1, -1)]
        return F.coalesce(end["hit"], *tails)

    return F.aggregate(F.filter(F.split(seq, ""), lambda c: c != ""), start, step, finish)


def trim_reads(reads: DataFrame, adapter: str, least_q: int, crop: int, least_len: int, window: int = 4, phred: int = 33, rate: float = 0.0, least_overlap: int = 6) -> DataFrame:
    """P25. Reads cut before the adapter, where mean quality in a window falls below the least, and at ``crop``; short ones dropped.

    The adapter is found whole, or as a prefix of least_overlap characters or more at the read's end, with mismatches in a share ``rate`` of its letters.
    """
    reads = reads.select("read_id", F.col("seq").alias("__s"), F.col("qual").alias("__q"), "lib")
    reads = once(reads, seq=F.col("__s"), qual=F.col("__q"), q=F.transform(F.split("__q", ""), lambda c: F.ascii(c) - phred))
    starts = F.sequence(F.lit(1), F.greatest(F.size("q") - window + 1, F.lit(1)))
    bad = F.filter(starts, lambda i: F.aggregate(F.slice("q", i, window), F.lit(0), lambda a, x: a + x) < least_q * F.least(F.lit(window), F.size("q")))
    at = F.coalesce(adapter_start(F.col("seq"), adapter, rate, least_overlap), F.length("seq") + 1)
    df = once(reads, cut=F.least(at - 1, F.coalesce(F.get(bad, F.lit(0)) - 1, F.length("seq")), F.lit(crop)))
    return df.select("read_id", F.substring("seq", F.lit(1), F.col("cut")).alias("seq"), F.substring("qual", F.lit(1), F.col("cut")).alias("qual"), "lib").filter(F.length("seq") >= least_len)
