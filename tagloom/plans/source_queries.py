"""Queries that write a format from the tables into the shared folder and read it back, and queries on annotations.

Every file lies in the folder that the cluster shares; only Spark's own readers and writers touch it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import annotation as an
from tagloom.operators import intervals as iv
from tagloom.plans.fixtures import LIBS
from tagloom.plans.registry import Views, query
from tagloom.runtime import shared_dir, store
from tagloom.sources import formats as fm


def _path(v: Views) -> str:
    return f"{shared_dir(v.spark)}/formats-{uuid.uuid4().hex}"


def _text(df: DataFrame, v: Views) -> str:
    path = _path(v)
    df.write.text(path, compression="lz4")
    return path


def _tab(*cols) -> F.Column:
    return F.concat_ws("\t", *[(F.lit(c[1:]) if isinstance(c, str) and c[0] == "=" else F.col(c).cast("string") if isinstance(c, str) else c.cast("string")) for c in cols]).alias("value")


@query("IO1", "seqs", sql="SELECT name, seq FROM seqs WHERE seq IS NOT NULL")
def io1(v: Views) -> DataFrame:
    s = v.seqs.filter("seq IS NOT NULL")
    path = _text(s.select(F.concat(F.lit(">"), "name", F.lit(" extra\n"), F.substring("seq", 1, 50), F.lit("\n"), F.substr("seq", F.lit(51)), F.lit("\n>empty")).alias("value")), v)
    return fm.read_fasta(v.spark, path)


_Q2 = "chr(33 + (CAST(substr(name, 2) AS INT) + {i}) % 94)"


@query("IO2", "seqs", sql="SELECT name AS read_id, seq, " + " || ".join(_Q2.format(i=i) for i in range(4)) + " || repeat('@', length(seq) - 4) AS qual FROM seqs WHERE seq IS NOT NULL AND name NOT LIKE '%7'")
def io2(v: Views) -> DataFrame:
    """Qualities begin with each of the 94 letters in turn, @ and + among them."""
    s = v.seqs.filter("seq IS NOT NULL")
    letter = lambda i: F.chr(33 + (F.substr("name", F.lit(2)).cast("int") + i) % 94)
    qual = F.concat(*[letter(i) for i in range(4)], F.repeat(F.lit("@"), F.length("seq") - 4))
    path = _text(s.select(F.concat(F.lit("@"), "name", F.when(F.col("name").endswith("7"), " bad").otherwise(" ok"), F.lit("\n"), "seq", F.lit("\n+\n"), qual).alias("value")), v)
    return fm.read_fastq(v.spark, path, blacklist=" bad").drop("lib")


@query("IO3", "tag_count", sql="SELECT tag, sum(abun)::BIGINT AS abun FROM tag_count GROUP BY 1")
def io3(v: Views) -> DataFrame:
    path = _text(v.tag_count.select(_tab("tag", "abun")), v)
    return fm.read_tagcounts(v.spark, path).groupBy("tag").agg(F.sum("abun").alias("abun"))


@query("IO4", "transcript", sql="SELECT 'Chr' || CAST(chr AS STRING) AS chr, strand, trans AS name, tstart AS gstart, tend AS gend FROM transcript")
def io4(v: Views) -> DataFrame:
    row = _tab(F.concat(F.lit("Chr"), F.col("chr").cast("string")), "=src", "=gene", "tstart", "tend", "=.", F.translate("strand", "wc", "+-"), "=.", F.concat(F.lit("ID="), "trans", F.lit(";Name=x")))
    return fm.read_gff(v.spark, _text(v.transcript.select(row), v))


@query("IO5", "exon", sql="SELECT 'g' || trans AS gene, trans, CAST(chr AS STRING) AS chr, strand, xstart, xend, 'E' AS flag FROM exon WHERE exon_no <> 3")
def io5(v: Views) -> DataFrame:
    score = F.when(F.col("exon_no") == 3, "50").when(F.col("exon_no") == 2, "95").otherwise(".")
    row = _tab("chr", "=src", "=exon", "xstart", "xend", score, F.translate("strand", "wc", "+-"), "=.", F.concat(F.lit('gene_id "g'), "trans", F.lit('"; transcript_id "'), "trans", F.lit('";')))
    return fm.read_gtf(v.spark, _text(v.exon.select(row), v))


_GTF = {"ensembl": "E", "rocket": "R", "pasa": "P", "trinity": "T", "pacbio": "P"}


@query("IO5_dialects", "exon", sql=" UNION ALL ".join(f"SELECT '{d}' AS dialect, 'g' || trans AS gene, trans, xstart, '{f}' AS flag FROM exon" for d, f in _GTF.items()))
def io5_dialects(v: Views) -> DataFrame:
    """The same exons in the attributes of each dialect."""
    quoted = lambda gene: F.concat(F.lit('gene_id "'), gene, F.lit('"; transcript_id "'), "trans", F.lit('";'))
    gene = F.concat(F.lit("g"), "trans")
    attrs = {d: quoted(gene) for d in _GTF} | {"pacbio": quoted(F.concat(gene, F.lit(".7"))), "trinity": F.concat(F.lit("ID="), "trans", F.lit(".p1;Name="), gene, F.lit("|x;Target=1"))}
    parts, exons = [], store(v.exon)  # joined once for all dialects
    for d, a in attrs.items():
        row = _tab("chr", "=src", "=cDNA_match" if d == "trinity" else "=exon", "xstart", "xend", "=.", F.translate("strand", "wc", "+-"), "=.", a)
        parts.append(fm.read_gtf(v.spark, _text(exons.select(row), v), d).select(F.lit(d).alias("dialect"), "gene", "trans", "xstart", "flag"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def _sam(v: Views) -> DataFrame:
    flag = F.when(F.col("abun") % 5 == 0, 4).when(F.col("strand") == "c", 16).when(F.col("abun") % 7 == 0, 256).otherwise(0)
    row = _tab("tag", flag, "chr", "pos", "abun", F.concat(F.col("len").cast("string"), F.lit("M")), "=*", F.lit(0), F.lit(0), "tag", "=*", "=NM:i:0")
    return fm.read_sam(v.spark, _text(v.tag_position.select(row), v))[0]


_SAMFLAG = "CASE WHEN abun % 5 = 0 THEN 4 WHEN strand='c' THEN 16 WHEN abun % 7 = 0 THEN 256 ELSE 0 END"


@query("IO6", "tag_position", sql=f"SELECT tag AS qname, {_SAMFLAG} AS flag, pos, abun::INT AS mapq, '0' AS nm FROM tag_position")
def io6(v: Views) -> DataFrame:
    return _sam(v).select("qname", "flag", "pos", "mapq", F.col("tags")["NM"].alias("nm"))


@query("P8", "tag_position", sql=f"WITH s AS (SELECT tag AS qname, {_SAMFLAG} AS flag, pos, abun AS mapq FROM tag_position) SELECT qname, flag, pos, 'kept' AS part FROM s WHERE flag IN (0, 16) AND mapq >= 10 UNION ALL SELECT qname, flag, pos, 'unmapped' FROM s WHERE flag = 4")
def p8(v: Views) -> DataFrame:
    kept, un = fm.filter_sam(_sam(v), (16,), (256,), 10)
    return kept.select("qname", "flag", "pos", F.lit("kept").alias("part")).unionByName(un.select("qname", "flag", "pos", F.lit("unmapped").alias("part")))


@query("IO7", "locus", sql="SELECT CAST(chr AS STRING) AS chr, lstart AS bstart, lend AS bend, name, '0' AS score, CASE WHEN neglog_p > 3 THEN '+' ELSE '-' END AS strand FROM locus")
def io7(v: Views) -> DataFrame:
    path = _path(v)
    fm.write_bed(v.locus.select(F.col("chr").cast("string").alias("chr"), F.col("lstart").alias("bstart"), F.col("lend").alias("bend"), "name", F.lit("0").alias("score"), F.when(F.col("neglog_p") > 3, "+").otherwise("-").alias("strand")), path)
    return fm.read_bed(v.spark, f"{path}/strand=*")


@query("IO8", "tag_position", sql="SELECT tag, CAST(chr AS STRING) AS chr, 'w' AS strand, pos, tag AS seq, abun + 1 AS hits FROM tag_position WHERE strand = 'w'")
def io8(v: Views) -> DataFrame:
    row = _tab("tag", F.translate("strand", "wc", "+-"), "chr", F.col("pos") - 1, "tag", "=III", "abun", "=")
    return fm.read_map(v.spark, _text(v.tag_position.select(row), v))


@query("IO9", "transcript", "exon", sql="SELECT t.trans AS cluster, CAST(t.chr AS STRING) AS chr, tstart AS cstart, tend AS cend, x.xstart AS pos, x.exon_no AS len FROM transcript t JOIN exon x ON x.trans = t.trans")
def io9(v: Views) -> DataFrame:
    x = v.exon.select(F.col("trans").alias("xt"), "xstart", F.concat_ws("\t", F.col("chr").cast("string"), "strand", F.col("xstart").cast("string"), F.lit("id"), F.lit("ACGT"), F.col("exon_no").cast("string"), F.lit("1\t2\t3\t4\t5\t0.5")).alias("row"))
    rows = x.groupBy("xt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("xstart", "row"))), lambda p: p["row"]), "\n").alias("rows"))
    head = F.concat(F.lit(">cluster id "), "trans", F.lit(" a b chr "), F.col("chr").cast("string"), F.lit(" x y from "), F.col("tstart").cast("string"), F.lit(" to "), F.col("tend").cast("string"))
    # tokens counted from 1: id 3, chromosome 7, start 11, end 13
    path = _text(v.transcript.join(rows, F.col("trans") == F.col("xt")).select(F.concat(head, F.lit("\n"), "rows").alias("value")), v)
    return fm.read_clusters(v.spark, path).select("cluster", "chr", "cstart", "cend", "pos", "len")


@query("IO10", "locus", sql="SELECT pow(10.0, -neglog_p)::DOUBLE AS p, 21 AS phase, CAST(chr AS STRING) AS chr, lstart, lend FROM locus WHERE neglog_p >= 3")
def io10(v: Views) -> DataFrame:
    p = F.concat(F.lit("1e-"), F.col("neglog_p").cast("string"))
    path = _text(v.locus.select(F.concat(p, F.lit("|21|x = "), F.col("chr").cast("string"), F.lit(":"), F.col("lstart").cast("string"), F.lit(".."), F.col("lend").cast("string")).alias("value")), v)
    return fm.read_phas_list(v.spark, path, 1.5e-3)


def _blast(v: Views) -> DataFrame:
    row = _tab("tag", "lib", F.lit(100.0) - F.col("abun") % 20, F.col("len") - F.col("abun") % 3, F.lit(0), F.lit(0), F.lit(1) + F.col("abun") % 3, "len", F.lit(1) + F.col("len") % 2, F.col("len") - F.col("abun") % 3, F.lit(0.001), F.lit(40.0), "len", F.col("len") + F.col("abun") % 2, "=plus")
    return fm.read_blast_tab(v.spark, _text(v.tag_position.select(row), v))


@query("IO11", "tag_position", sql="SELECT tag AS query, lib AS subject, (100.0 - abun % 20)::DOUBLE AS pident, (len - abun % 3)::INT AS length, 0 AS mismatch, 0 AS gapopen, (1 + abun % 3)::INT AS qstart, len::INT AS qend, (1 + len % 2)::INT AS sstart, (len - abun % 3)::INT AS send, 0.001::DOUBLE AS evalue, 40.0::DOUBLE AS bitscore, len::INT AS qlen, (len + abun % 2)::INT AS slen, 'plus' AS sstrand FROM tag_position")
def io11(v: Views) -> DataFrame:
    return _blast(v)


_P11 = """b AS (SELECT tag AS query, lib AS subject, round_even(100.0-abun%20, 0) AS pid, len-abun%3 AS length, 1+abun%3 AS qstart, len AS qend, 1+len%2 AS sstart, len-abun%3 AS send, len AS qlen, len+abun%2 AS slen FROM tag_position),
 c AS (SELECT *, (qstart-1)-(sstart-1) AS hang5, (qlen-qend)-(slen-send) AS hang3, round_even(length*(pid/100), 0) AS m FROM b), d AS (SELECT *, length-m AS mis, qlen-length AS un, length-m+qlen-length AS tv FROM c)"""


@query("P11", "tag_position", sql=f"""WITH {_P11} SELECT query, subject, hang5::INT AS hang5, hang3::INT AS hang3, m::INT AS match, mis::INT AS mis, un::INT AS unaligned, tv::INT AS total_var,
 CASE WHEN CASE WHEN hang5<=2 AND hang3=0 THEN tv<=5 WHEN hang3<=2 AND hang5=0 THEN tv<=5 WHEN hang5>=1 AND hang3>=1 THEN tv<=6 ELSE false END THEN 'pass' ELSE 'fail' END AS status FROM d""")
def p11(v: Views) -> DataFrame:
    return fm.annotate_hits(_blast(v)).select("query", "subject", "hang5", "hang3", "match", "mis", "unaligned", "total_var", "status")


@query("IO12", "transcript", sql="SELECT trans AS isoform, '10M' AS cigar, gene, trans || '.1' AS trans, (tstart % 6)::INT AS score FROM transcript")
def io12(v: Views) -> DataFrame:
    block = F.concat(F.lit("isoform:  "), "trans", F.lit("  x\ncigar: 10M\ngene:     "), "gene", F.lit("  y\ntr:       "), "trans", F.lit(".1  z\nresult:   "), "trans", F.lit("  sc: "), (F.col("tstart") % 6).cast("string"), F.lit("\n"))
    return fm.read_matchannot(v.spark, _text(v.transcript.select(block.alias("value")), v)).select("isoform", "cigar", "gene", "trans", "score")


@query("IO13", "tag_count", sql="SELECT lib AS mir, tag AS target, (abun % 13 / 2.0)::DOUBLE AS score, abun AS bstart, abun + 20 AS bend, tag AS tar_seq FROM tag_count")
def io13(v: Views) -> DataFrame:
    block = F.concat(F.lit("query="), "lib", F.lit(", target="), "tag", F.lit(", score="), (F.col("abun") % 13 / 2.0).cast("string"), F.lit(", range="), F.col("abun").cast("string"), F.lit("-"), (F.col("abun") + 20).cast("string"), F.lit("\n\t target  5' "), "tag", F.lit(" 3'\n\t query  3' ACGU 5'\n"))
    return fm.read_target_report(v.spark, _text(v.tag_count.select(block.alias("value")), v)).select("mir", "target", F.col("score").cast("double").alias("score"), "bstart", "bend", "tar_seq")


def _jdbc(v: Views) -> dict[str, str]:
    """The embedded database that Spark brings, one for each query, in the memory of this machine."""
    return {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver", "dbtable": "tags"}


@query("IO14", "tag_position", sql="SELECT tag, chr, strand, pos, len FROM tag_position WHERE chr = 2 AND strand = 'w' AND len BETWEEN 20 AND 22 AND pos BETWEEN 1000 AND 40000")
def io14(v: Views) -> DataFrame:
    """Written to a database, then read from it with a predicate that it takes over."""
    o = _jdbc(v) | {"createTableColumnTypes": "tag VARCHAR(32), strand VARCHAR(1)"}
    fm.write_jdbc(v.tag_position.select("tag", F.col("chr").cast("int").alias("chr"), "strand", "pos", F.col("len").cast("int").alias("len")).coalesce(4), o)
    where = "chr = 2 AND strand = 'w' AND len BETWEEN 20 AND 22 AND pos BETWEEN 1000 AND 40000"
    return fm.read_jdbc(v.spark, o, where, by="pos").select("tag", "chr", "strand", "pos", "len")


@query("IO15", "tag_count", sql="SELECT lib, tag, abun FROM tag_count WHERE lib <> 'L0' UNION ALL SELECT lib, tag, abun FROM tag_count WHERE lib = 'L3'")
def io15(v: Views) -> DataFrame:
    """A first write is truncated by the second, to which a third is appended."""
    o, t = _jdbc(v) | {"createTableColumnTypes": "lib VARCHAR(8), tag VARCHAR(32)"}, v.tag_count.coalesce(4)
    fm.write_jdbc(t.filter("lib = 'L0'"), o)
    fm.write_jdbc(t.filter("lib <> 'L0'"), o, "overwrite")
    fm.write_jdbc(t.filter("lib = 'L3'"), o)
    return fm.read_jdbc(v.spark, o)


@query("IO16", "tag_count", sql="SELECT lib || '-miR' || CAST(abun AS STRING) AS name, 'MI' || tag AS accession, 'Oryza sativa' AS organism, 'miR' || CAST(abun AS STRING) AS generic, tag AS seq, length(tag) AS len, CASE WHEN lib <> 'L3' THEN 'plant' || lib END AS phylum FROM tag_count")
def io16(v: Views) -> DataFrame:
    mir = F.concat(F.lit("miR"), F.col("abun").cast("string"))
    lines = v.tag_count.select(F.concat_ws(" ", F.concat_ws("-", "lib", mir), F.concat(F.lit("MI"), "tag"), F.lit("Oryza sativa"), mir).alias("header"), F.translate("tag", "T", "U").alias("seq"))
    orgs = v.tag_count.filter("lib <> 'L3'").select(F.col("lib").alias("code"), F.concat(F.lit("plant"), "lib").alias("phylum")).distinct()
    return fm.ingest_mirna(lines, orgs)


@query("IO17", "signal", sql="SELECT name, array_to_string(list(coalesce(CAST(round(val*1000) AS BIGINT), -1) ORDER BY CASE WHEN name < 'U5' THEN idx ELSE -idx END), ',') AS vals FROM signal GROUP BY 1")
def io17(v: Views) -> DataFrame:
    lists = v.signal.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "val"))), lambda p: F.coalesce(p["val"].cast("string"), F.lit("NA"))), ",").alias("list"))
    row = _tab("=1", F.lit(0), F.lit(10), "name", "=0", F.when(F.col("name") < "U5", "+").otherwise("-"), F.lit(10), "list")
    s = fm.read_signal(v.spark, _text(lists.select(row), v))
    return s.select("name", F.array_join(F.transform("vals", lambda x: F.coalesce(F.round(x * 1000).cast("long"), F.lit(-1)).cast("string")), ",").alias("vals"))


@query("IO18", "transcript", sql="SELECT o AS cluster, trans AS member, trans = first AS is_rep FROM (SELECT *, CAST(substr(gene, 2) AS BIGINT) AS o, min(trans) OVER (PARTITION BY gene) AS first FROM transcript)")
def io18(v: Views) -> DataFrame:
    g = v.transcript.groupBy("gene").agg(F.array_sort(F.collect_list("trans")).alias("t"))
    rows = F.array_join(F.transform("t", lambda x, i: F.concat(i.cast("string"), F.lit("\t96nt, >"), x, F.lit("... "), F.when(i == 0, "*").otherwise("at 99%"))), "\n")
    path = _text(g.select(F.concat(F.lit(">Cluster "), F.substr("gene", F.lit(2)), F.lit("\n"), rows).alias("value")), v)
    return fm.read_clstr(v.spark, path)


def _csv(df: DataFrame, v: Views) -> str:
    path = _path(v)
    df.write.csv(path, sep="\t", header=True)
    return path


@query("IO19", "expr", sql="SELECT CAST(CAST(substr(gene,2) AS BIGINT) % 4 AS STRING) AS rep, string_agg(sample || gene, ',' ORDER BY sample || gene) AS libs, count(*) AS n FROM expr GROUP BY 1")
def io19(v: Views) -> DataFrame:
    sheet = v.expr.select(F.concat("sample", "gene").alias("lib_id"), (F.substr("gene", F.lit(2)).cast("long") % 4).cast("string").alias("rep"), F.lit("g").alias("group"))
    return fm.read_samples(v.spark, _csv(sheet, v))


@query("IO20", "transcript", sql="SELECT gene, trans, (tend % 17 + 0.5)::DOUBLE AS cov, tend - tstart + 1 AS exon_len FROM transcript")
def io20(v: Views) -> DataFrame:
    row = _tab("chr", "=src", "=transcript", "tstart", "tend", "=.", F.translate("strand", "wc", "+-"), "=.", F.concat(F.lit('gene_id "'), "gene", F.lit('"; transcript_id "'), "trans", F.lit('"; cov "'), (F.col("tend") % 17 + 0.5).cast("string"), F.lit('";')))
    return fm.read_quant_gtfs(v.spark, _text(v.transcript.select(row), v)).drop("sample")


@query("IO21", "seqs", sql="SELECT name, seq FROM seqs WHERE seq IS NOT NULL")
def io21(v: Views) -> DataFrame:
    path = _path(v)
    fm.write_fasta(v.seqs.filter("seq IS NOT NULL"), path)
    return fm.read_fasta(v.spark, path)


@query("IO22", "tag_count", sql="SELECT CASE WHEN length(tag) BETWEEN 21 AND 24 THEN CAST(length(tag) AS STRING) ELSE 'other' END AS size, count(*) AS n, sum(abun)::BIGINT AS abun FROM tag_count GROUP BY 1")
def io22(v: Views) -> DataFrame:
    path = _path(v)
    fm.write_by_len(v.tag_count.select(F.concat(F.substring("tag", 1, 5), F.lit("-"), F.substr("tag", F.lit(6))).alias("mir"), "abun"), path)
    got = v.spark.read.option("basePath", path).schema("mir string, abun long, size string").csv(f"{path}/size=*", header=True)
    return got.groupBy("size").agg(F.count("*").alias("n"), F.sum("abun").alias("abun"))


@query("IO23", "expr", sql="WITH w AS (SELECT gene, " + ", ".join(f"coalesce(sum(cnt) FILTER (sample='S{k}'),0)::BIGINT AS \"S{k}\"" for k in range(6)) + " FROM expr GROUP BY 1) SELECT gene, sample, cnt FROM (UNPIVOT w ON " + ", ".join(f'"S{k}"' for k in range(6)) + " INTO NAME sample VALUE cnt)")
def io23(v: Views) -> DataFrame:
    wide = v.expr.groupBy("gene").agg(*[F.coalesce(F.sum(F.when(F.col("sample") == f"S{k}", F.col("cnt"))), F.lit(0)).alias(f"S{k}") for k in range(6)])
    return fm.read_counts(v.spark, _csv(wide, v))


@query("IO23_10x", "cell", sql="SELECT CAST(cell AS STRING) AS cell, gene, cnt FROM cell")
def io23_10x(v: Views) -> DataFrame:
    """A sparse matrix with its files of names, numbered in their order."""
    c = store(v.cell.select(F.col("cell").cast("string").alias("cell"), "gene", "cnt"))
    names = lambda col: _text(c.select(F.col(col).alias("value")).distinct().orderBy("value"), v)  # noqa: E731  a sorted file is numbered by its parts
    genes, cells = names("gene"), names("cell")
    at = lambda path, no: fm.numbered_lines(v.spark, path).select(F.col("value").alias(f"name_{no}"), F.col("number").alias(no))
    g, n = at(genes, "i"), at(cells, "j")
    body = c.join(g, F.col("gene") == F.col("name_i")).join(n, F.col("cell") == F.col("name_j"))
    sizes = v.spark.range(1).select(F.concat_ws(" ", F.lit(g.count()), F.lit(n.count()), F.lit(c.count())).alias("value"))
    head = v.spark.range(1).select(F.lit("%%MatrixMarket matrix coordinate integer general").alias("value"))
    m = _text(head.coalesce(1).unionByName(sizes.coalesce(1)).unionByName(body.select(F.concat_ws(" ", "i", "j", "cnt").alias("value"))), v)
    return fm.read_10x(v.spark, m, genes, cells)


@query("IO24", "tag_count", sql="SELECT lib, tag, CAST(abun AS STRING) AS abun FROM tag_count")
def io24(v: Views) -> DataFrame:
    return fm.union_files(v.spark, [_csv(v.tag_count.filter(F.col("lib") == x), v) for x in LIBS])


@query("IO25", "locus", sql="SELECT lib, 0.001::DOUBLE AS p, 21 AS phase, name AS value FROM locus WHERE lib IN ('click','view')")
def io25(v: Views) -> DataFrame:
    base = _path(v)
    folders = []
    for lib in ("click", "view", "error"):
        folders.append(f"{base}/{lib}_0.001_21.list")
        v.locus.filter(F.col("lib") == lib).select(F.col("name").alias("value")).write.text(folders[-1])
    # Spark writes folders: the run's name is the folder's
    return fm.select_runs(v.spark, folders, ("click", "view"), 0.01, 21)


_P25 = """k AS (SELECT name, substr(seq, 2, 1) AS kind, seq FROM seqs WHERE seq IS NOT NULL), r AS (SELECT name, kind, CASE kind WHEN 'G' THEN substr(seq,1,20) || 'TGGAATTC' WHEN 'T' THEN substr(seq,1,10) || 'TGGAATTCTCGGG' ELSE substr(seq,1,40) || 'TGGAATTCTCGGG' END AS seq FROM k),
 q AS (SELECT name, seq, CASE WHEN kind='A' THEN repeat('I',30) || repeat('!',23) ELSE repeat('I', length(seq)) END AS qual, kind, strpos(seq, 'TGGAATTCTCGGG') AS found FROM r),
 c AS (SELECT *, least(CASE WHEN found > 0 THEN found-1 WHEN kind='G' THEN 20 ELSE length(seq) END, CASE WHEN kind='A' THEN 29 ELSE length(seq) END, 35) AS cut FROM q)"""


_ADP = "TGGAATTCTCGGG"
# a mismatch within the whole adapter, two, one in ten letters at the end, none in six
_P25M = """k AS (SELECT name, substr(seq, 2, 1) AS kind, substr(translate(seq, 'T', 'A'), 1, 40) AS s FROM seqs WHERE seq IS NOT NULL), r AS (SELECT name, kind, s || CASE kind WHEN 'A' THEN 'TGGAATACTCGGGA' WHEN 'C' THEN 'TGGCATACTCGGGA' WHEN 'G' THEN 'TGGATTTCTC' ELSE 'TGGAAT' END AS seq FROM k)"""


@query("P25_mismatches", "seqs", sql=f"WITH {_P25M} SELECT name AS read_id, CASE WHEN kind = 'C' THEN seq ELSE substr(seq, 1, 40) END AS seq FROM r")
def p25_mismatches(v: Views) -> DataFrame:
    s = v.seqs.filter("seq IS NOT NULL")
    kind = F.substring("seq", 2, 1)
    end = F.when(kind == "A", "TGGAATACTCGGGA").when(kind == "C", "TGGCATACTCGGGA").when(kind == "G", "TGGATTTCTC").otherwise("TGGAAT")
    read = F.concat(F.substring(F.translate("seq", "T", "A"), 1, 40), end)
    r = s.select(F.col("name").alias("read_id"), read.alias("seq"), F.lit("L").alias("lib")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    return fm.trim_reads(r, _ADP, 20, 60, 18, rate=0.1).select("read_id", "seq")


@query("P25", "seqs", sql=f"WITH {_P25} SELECT name AS read_id, substr(seq,1,cut) AS seq, substr(qual,1,cut) AS qual, 'L' AS lib FROM c WHERE cut >= 18")
def p25(v: Views) -> DataFrame:
    """Reads with a low tail (A), good ones (C), an adapter that is cut off at the read's end (G) and short ones (T), by a letter."""
    s, kind = v.seqs.filter("seq IS NOT NULL"), F.substring("seq", 2, 1)
    read = F.when(kind == "G", F.concat(F.substring("seq", 1, 20), F.lit("TGGAATTC"))).when(kind == "T", F.concat(F.substring("seq", 1, 10), F.lit("TGGAATTCTCGGG"))).otherwise(F.concat(F.substring("seq", 1, 40), F.lit("TGGAATTCTCGGG")))
    r = s.select(F.col("name").alias("read_id"), kind.alias("kind"), read.alias("seq"), F.lit("L").alias("lib"))
    r = r.withColumn("qual", F.when(F.col("kind") == "A", F.concat(F.repeat(F.lit("I"), F.lit(30)), F.repeat(F.lit("!"), F.lit(23)))).otherwise(F.repeat(F.lit("I"), F.length("seq"))))
    return fm.trim_reads(r, "TGGAATTCTCGGG", 20, 35, 18)


@query("J28", "transcript", sql="""WITH p AS (SELECT a.trans, b.gene, CASE WHEN a.strand=b.strand THEN 'ns' ELSE 'nat' END AS kind, CAST(substr(a.trans,2) AS BIGINT) % 3 = 0 AS c1, CAST(substr(b.gene,2) AS BIGINT) % 2 = 0 AS c2
 FROM transcript a JOIN transcript b ON a.chr=b.chr AND a.tstart<=b.tend AND b.tstart<=a.tend AND a.gene<>b.gene) SELECT trans, gene, kind, CASE WHEN c1<>c2 THEN 0 WHEN c1 THEN 1 ELSE 2 END AS cls FROM p""")
def j28(v: Views) -> DataFrame:
    t = v.transcript
    s = t.select(F.col("trans").alias("name"), (F.substr("trans", F.lit(2)).cast("long") % 3 == 0).alias("coding")).unionByName(t.select(F.col("gene").alias("name"), (F.substr("gene", F.lit(2)).cast("long") % 2 == 0).alias("coding")).distinct())
    return an.nat_pairs(iv.overlap_config(t, t), s)


_P12 = """x AS (SELECT trans, CASE WHEN tstart % 4 = 0 THEN NULL ELSE tend % 6 END AS m, (tend % 9 - 4) / 2.0::DOUBLE AS cpc, tend % 200 AS orf, (tstart % 7) * 0.19::DOUBLE / 2 AS cpat FROM transcript)"""


@query("P12", "transcript", sql=f"""WITH {_P12} SELECT trans, CASE WHEN cpc <= -1 THEN 'nc'
 WHEN m IS NULL THEN CASE WHEN cpc >= 1 THEN CASE WHEN orf >= 100 OR cpat > 0.38 THEN 'co' ELSE 'up' END WHEN cpc <= 0 AND cpat < 0.38 THEN 'nc' WHEN cpc >= 0 AND cpat > 0.38 THEN 'co' ELSE 'up' END
 WHEN m >= 3 THEN CASE WHEN cpc >= 1 THEN 'co' WHEN cpc > 0 AND cpat > 0.38 THEN 'co' WHEN cpc < 0 AND cpat < 0.38 THEN 'nc' ELSE 'up' END
 WHEN cpc >= 1 THEN CASE WHEN orf >= 100 OR cpat > 0.38 THEN 'co' ELSE 'up' END WHEN cpc <= 0 AND cpat < 0.38 THEN 'nc' WHEN cpc > 0 AND cpat > 0.38 THEN 'co' ELSE 'up' END AS status FROM x""")
def p12(v: Views) -> DataFrame:
    x = v.transcript.select("trans", F.when(F.col("tstart") % 4 != 0, F.col("tend") % 6).alias("match_score"), ((F.col("tend") % 9 - 4) / 2.0).alias("cpc"), (F.col("tend") % 200).alias("orf"), (F.col("tstart") % 7 * 0.19 / 2).alias("cpat"))
    return an.classify_coding(x).select("trans", "status")


@query("P26", "locus", sql="WITH x AS (SELECT name, (neglog_p*7 + lend - 13*CAST(substr(name,3) AS BIGINT) - lstart) % 97 - 48 AS d FROM locus), y AS (SELECT *, sign(d) * (abs(d) % 21) AS r FROM x) SELECT name, CASE WHEN r BETWEEN 2 AND 4 OR r+21 BETWEEN 2 AND 4 THEN 'A' WHEN -r BETWEEN 2 AND 4 OR 21-r BETWEEN 2 AND 4 THEN 'B' ELSE 'N' END AS flag FROM y")
def p26(v: Views) -> DataFrame:
    d = (F.col("neglog_p") * 7 + F.col("lend") - F.substr("name", F.lit(3)).cast("long") * 13 - F.col("lstart")) % 97 - 48
    return an.arm_flags(v.locus.select("name", F.lit(0).cast("long").alias("a5"), d.alias("b5")), 21).select("name", "flag")


@query("A31", "tag_position", sql="WITH t AS (SELECT pos % 500 AS pos, strand AS flag, len, abun, abun > 48 AND pos % 500 < 400 AS phased FROM tag_position), l AS (SELECT max(pos) AS last FROM t WHERE phased) SELECT pos, flag, CASE WHEN len<=20 THEN '18-20' ELSE CAST(len AS STRING) END AS size, sum(abun)::BIGINT AS abun FROM t, l WHERE pos <= last GROUP BY 1, 2, 3")
def a31(v: Views) -> DataFrame:
    pos = F.col("pos") % 500
    return an.ir_consensus(v.tag_position.select(pos.alias("pos"), F.col("strand").alias("flag"), "len", "abun", ((F.col("abun") > 48) & (pos < 400)).alias("phased")))
