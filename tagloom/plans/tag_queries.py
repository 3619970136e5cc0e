"""Queries over tag libraries, sequences and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import seq
from tagloom.operators import tags as tg
from tagloom.plans.fixtures import LIBS
from tagloom.plans.registry import Views, query


@query("A1", "tag_position", sql="SELECT lib, tag, count(*) AS abun FROM tag_position GROUP BY 1, 2")
def a1(v: Views) -> DataFrame:
    return tg.dedup_reads(v.tag_position)


_A2 = "SELECT lib, length(tag) AS len, count(*) AS n_tags, sum(abun)::BIGINT AS abun FROM {} GROUP BY 1, 2"


@query("A2", "tag_count", "transcript", sql=f"WITH m AS (SELECT * FROM tag_count WHERE tag IN (SELECT p.tag FROM tag_position p WHERE p.strand = 'w')), a AS ({_A2.format('tag_count')}), b AS ({_A2.format('m')}) SELECT a.*, coalesce(b.n_tags,0) AS mapped_tags, coalesce(b.abun,0) AS mapped_abun FROM a LEFT JOIN b ON a.lib=b.lib AND a.len=b.len")
def a2(v: Views) -> DataFrame:
    return tg.size_distribution_mapped(v.tag_count, v.tag_position.filter("strand = 'w'"))


@query("A6", "tag_count", sql="SELECT tag, " + ", ".join(f"coalesce(sum(CASE WHEN lib='{x}' THEN abun END),0)::BIGINT AS \"{x}\"" for x in LIBS) + ", sum(abun)::BIGINT AS norm_sum, max(abun) AS max_norm, length(tag) AS len FROM tag_count GROUP BY tag")
def a6(v: Views) -> DataFrame:
    return tg.tag_summary(v.tag_count, LIBS)


@query("J1", "locus", "transcript", sql="SELECT gene, trans, CASE WHEN lower(gene) IN (SELECT lower('g' || substr(name, 3)) FROM locus) THEN 'hit' ELSE 'miss' END AS part FROM transcript")
def j1(v: Views) -> DataFrame:
    hit, miss = tg.extract_rows(v.transcript.select("gene", "trans"), v.locus.select(F.concat(F.lit("g"), F.substr("name", F.lit(3))).alias("q")), "gene", "q")
    return hit.withColumn("part", F.lit("hit")).unionByName(miss.withColumn("part", F.lit("miss")))


@query("J2", "tag_count", sql="WITH a AS (SELECT tag, abun FROM tag_count WHERE lib='L0'), b AS (SELECT tag, abun FROM tag_count WHERE lib='L1') SELECT tag, abun, 'a' AS kind FROM a WHERE tag NOT IN (SELECT tag FROM b) UNION ALL SELECT tag, abun, 'b' FROM b WHERE tag NOT IN (SELECT tag FROM a) UNION ALL SELECT tag, abun, 'common' FROM a WHERE tag IN (SELECT tag FROM b)")
def j2(v: Views) -> DataFrame:
    c = v.tag_count
    return tg.compare_libs(c.filter("lib = 'L0'").select("tag", "abun"), c.filter("lib = 'L1'").select("tag", "abun"))


@query("J13", "tag_count", sql="SELECT DISTINCT tag, chr, strand, pos AS pstart, pos+len-1 AS pend FROM tag_position WHERE tag IN (SELECT c.tag FROM tag_count c)")
def j13(v: Views) -> DataFrame:
    return tg.tags_to_positions(v.tag_count, v.tag_position)


@query("J14", "tag_count", sql="WITH t AS (SELECT DISTINCT tag FROM tag_count), x AS (SELECT t.tag, coalesce(a.abun,0) AS test, coalesce(b.abun,0) AS ctrl FROM t LEFT JOIN tag_count a ON a.tag=t.tag AND a.lib='L0' LEFT JOIN tag_count b ON b.tag=t.tag AND b.lib='L1') SELECT *, CASE WHEN ctrl>0 THEN test::DOUBLE/ctrl ELSE (test-ctrl)::DOUBLE END AS ratio FROM x")
def j14(v: Views) -> DataFrame:
    return tg.tag_abundance(v.tag_count, v.tag_count, "L0", "L1")


@query("J15", "transcript", sql="WITH f AS (SELECT gene, count(*) AS models, min(trans) AS title FROM transcript GROUP BY 1) SELECT t.trans, f.gene, f.models, f.title FROM transcript t JOIN f ON f.gene=t.gene")
def j15(v: Views) -> DataFrame:
    f = v.transcript.groupBy("gene").agg(F.count("*").alias("models"), F.min("trans").alias("title"))
    return v.transcript.select("trans", "gene").join(f, "gene")


_MIR = "SELECT 'mir' || substr(tag,1,4) AS mir, translate(tag,'T','U') AS mirseq FROM tag_count WHERE lib='L3'"


@query("J26", "tag_count", sql=f"WITH m AS ({_MIR}) SELECT d.tag, d.abun AS de, m.mir, c.abun FROM tag_count d JOIN m ON translate(m.mirseq,'U','T')=d.tag JOIN tag_count c ON c.tag=d.tag AND c.lib='L1' WHERE d.lib='L0'")
def j26(v: Views) -> DataFrame:
    c = v.tag_count
    m = c.filter("lib = 'L3'").select(F.concat(F.lit("mir"), F.substring("tag", 1, 4)).alias("mir"), F.translate("tag", "T", "U").alias("mirseq"))
    return tg.annotate_de(c.filter("lib = 'L0'").select("tag", F.col("abun").alias("de")), m, c.filter("lib = 'L1'").select("tag", "abun"))


@query("J27", "expr", sql="WITH s AS (SELECT gene, cnt AS c0 FROM expr WHERE sample='S0'), t AS (SELECT gene, cnt AS c1 FROM expr WHERE sample='S1'), u AS (SELECT gene, cnt AS c2 FROM expr WHERE sample='S2') SELECT coalesce(x.gene, u.gene) AS gene, c0, c1, c2 FROM (SELECT coalesce(s.gene, t.gene) AS gene, c0, c1 FROM s FULL JOIN t ON s.gene=t.gene) x FULL JOIN u ON u.gene=x.gene")
def j27(v: Views) -> DataFrame:
    of = lambda k: v.expr.filter(F.col("sample") == f"S{k}").select("gene", F.col("cnt").alias(f"c{k}"))
    return tg.merge_tables(of(0), of(1), of(2), "gene")


@query("J27_left", "expr", "transcript", sql="WITH r AS (SELECT gene, cnt FROM expr WHERE sample='S0'), a AS (SELECT DISTINCT 'G' || CAST(CAST(substr(trans,2) AS BIGINT) % 300 AS STRING) AS ens, CAST(substr(trans,2) AS BIGINT) % 170 AS entrez FROM transcript), m AS (SELECT r.*, a.entrez FROM r LEFT JOIN a ON a.ens=r.gene) SELECT gene, cnt, entrez FROM (SELECT *, row_number() OVER (PARTITION BY entrez ORDER BY gene, cnt) AS nth FROM m WHERE entrez IS NOT NULL) WHERE nth=1 UNION ALL SELECT * FROM m WHERE entrez IS NULL")
def j27_left(v: Views) -> DataFrame:
    n = F.substr("trans", F.lit(2)).cast("long")
    a = v.transcript.select(F.concat(F.lit("G"), (n % 300).cast("string")).alias("ens"), (n % 170).alias("entrez")).distinct()
    return tg.annotate_results(v.expr.filter("sample = 'S0'").select("gene", "cnt"), a, "gene", "ens", "entrez")


@query("J30", "tag_position", sql="SELECT lib AS name, pos + CASE WHEN strand='c' THEN 3 ELSE 0 END AS pos, len, sum(abun)::BIGINT AS abun, max(CASE WHEN strand='w' THEN 1 ELSE 0 END) AS has_w FROM tag_position GROUP BY 1, 2, 3")
def j30(v: Views) -> DataFrame:
    return tg.merge_strands(v.tag_position.withColumnRenamed("lib", "name"))


_SR = "SELECT name AS trans, substr(seq, 1+k*9, 21) AS seq, 1+k*9 AS pos, 10-k AS abun FROM seqs CROSS JOIN (SELECT unnest([0,1,2,3]) AS k)"


@query("J31", "seqs", sql=f"WITH s AS ({_SR}), p AS (SELECT * FROM s WHERE pos IN (1, 19)) SELECT trans, seq, pos::BIGINT AS pos, abun, 'phasi' AS kind FROM p UNION ALL SELECT s.trans, s.seq, instr(q.seq, s.seq)::BIGINT, s.abun, 'srna' FROM s JOIN seqs q ON q.name=s.trans WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.trans=s.trans AND p.seq=s.seq) AND instr(q.seq, s.seq) > 0")
def j31(v: Views) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    s = v.seqs.filter("seq IS NOT NULL").select("name", "seq", k.alias("k")).select(F.col("name").alias("trans"), F.substr("seq", 1 + F.col("k") * 9, F.lit(21)).alias("seq"), (1 + F.col("k") * 9).cast("long").alias("pos"), (10 - F.col("k")).alias("abun"))
    return tg.merge_srna(s, s.filter("pos IN (1, 19)"), v.seqs.withColumnRenamed("name", "trans"))


@query("P1", "seqs", sql="SELECT name, upper(trim(seq)) AS clean, reverse(seq) AS reverse, translate(seq,'ATGC','TACG') AS complement, reverse(translate(seq,'ATGC','TACG')) AS reverse_complement, translate(seq,'T','U') AS rna, seq AS dna FROM seqs")
def p1(v: Views) -> DataFrame:
    return v.seqs.select("name", *[seq.seq_transform("seq", m).alias(m) for m in seq.MODES])


@query("P2", "tag_count", sql="SELECT lib, tag, tag AS norm FROM tag_count")
def p2(v: Views) -> DataFrame:
    raw = F.concat(F.lower(F.translate("tag", "T", "U")), F.lit("--"))
    return v.tag_count.select("lib", "tag", seq.norm_tag(raw).alias("norm"))


@query("P3", "transcript", sql="SELECT trans, gene AS head FROM transcript")
def p3(v: Views) -> DataFrame:
    return v.transcript.select("trans", seq.clean_header(F.concat(F.lit(">"), "gene", F.lit("|"), "trans", F.lit(" extra words"))).alias("head"))


@query("P4", "seqs", sql="SELECT name, length(seq) AS len FROM seqs")
def p4(v: Views) -> DataFrame:
    return v.seqs.select("name", F.length("seq").alias("len"))


@query("P5", "seqs", sql="SELECT '>' || name || chr(10) || seq AS record FROM seqs")
def p5(v: Views) -> DataFrame:
    return v.seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("record"))


@query("P6", "tag_count", sql="SELECT lib, substr(tag,1,20) AS tag, sum(abun)::BIGINT AS abun FROM tag_count WHERE length(tag) >= 19 GROUP BY 1, 2")
def p6(v: Views) -> DataFrame:
    return tg.crop_tags(v.tag_count, 19, 20)


@query("P7", "tag_count", sql="SELECT lib, tag, unnest(generate_series(1, abun))::INT AS copy FROM tag_count")
def p7(v: Views) -> DataFrame:
    return tg.expand_tags(v.tag_count)


@query("P9", "seqs", sql="SELECT name, '5p' AS \"end\", substr(seq,1,40) AS part FROM seqs UNION ALL SELECT name, '3p', substr(seq,41) FROM seqs")
def p9(v: Views) -> DataFrame:
    return tg.split_pair(v.seqs, 40)


@query("P14", "tag_position", sql="SELECT DISTINCT lib, chr, tag FROM tag_position")
def p14(v: Views) -> DataFrame:
    fused = v.tag_position.groupBy("lib", "chr").agg(F.array_join(F.collect_set("tag"), ",").alias("tag"))
    return tg.expand_column(fused, "tag")


@query("P15", "locus", sql="SELECT name, CAST(chr AS STRING) || '_w_' || CAST(lstart AS STRING) || '_' || CAST(lend AS STRING) AS k1, 'osa.' || CAST(chr AS STRING) || '.' || CAST(lstart AS STRING) || '.' || CAST(lend AS STRING) AS k2 FROM locus")
def p15(v: Views) -> DataFrame:
    return v.locus.select("name", seq.locus_key(F.col("chr"), F.lit("w"), F.col("lstart"), F.col("lend")).alias("k1"), F.concat_ws(".", F.lit("osa"), F.col("chr").cast("string"), F.col("lstart").cast("string"), F.col("lend").cast("string")).alias("k2"))


@query("P16", "locus", sql="SELECT name, 'c' AS strand, CAST(chr AS STRING) AS chr, lstart AS start_, lend AS end_ FROM locus")
def p16(v: Views) -> DataFrame:
    made = v.locus.select(F.concat(F.col("name"), F.lit("_c_"), F.concat_ws(":", F.col("chr").cast("string"), F.col("lstart").cast("string"), F.col("lend").cast("string"))).alias("id"))
    return made.select(seq.parse_locus_id("id").alias("p")).select("p.name", "p.strand", "p.chr", F.col("p.start").alias("start_"), F.col("p.end").alias("end_"))


@query("P17", "transcript", sql="SELECT trans, CASE strand WHEN 'w' THEN '+' ELSE '-' END AS strand, CAST(chr AS STRING) AS chr FROM transcript")
def p17(v: Views) -> DataFrame:
    return v.transcript.select("trans", seq.norm_strand("strand").alias("strand"), seq.norm_chr(F.concat(F.lit("Chr"), F.col("chr").cast("string"))).alias("chr"))


@query("P23", "seqs", sql="SELECT sum(length(replace(replace(seq,'A','N'),'N','')))::BIGINT AS whole, sum(length(replace(replace(substr(seq,21,56),'A','N'),'N','')))::BIGINT AS inner_ FROM seqs")
def p23(v: Views) -> DataFrame:
    masked = F.translate("seq", "A", "N")
    return v.seqs.agg(F.sum(seq.base_count(masked)).alias("whole"), F.sum(seq.base_count(masked, 20)).alias("inner_"))


@query("P24", "seqs", sql="SELECT name, m AS seq FROM (SELECT name, CASE WHEN seq < 'C' THEN repeat('N', 96) ELSE seq END AS m FROM seqs) WHERE replace(m,'N','') <> ''")
def p24(v: Views) -> DataFrame:
    m = v.seqs.select("name", F.when(F.col("seq") < "C", F.repeat(F.lit("N"), F.lit(96))).otherwise(F.col("seq")).alias("seq"))
    return m.filter(seq.base_count("seq") > 0)


@query("W1", "tag_position", sql="SELECT tag, chr, strand, pos, lib, abun FROM (SELECT *, row_number() OVER (PARTITION BY tag, chr ORDER BY abun DESC, pos, strand, lib) AS r FROM tag_position) WHERE r = 1")
def w1(v: Views) -> DataFrame:
    return tg.dedup_best(v.tag_position, ["tag", "chr"], [F.desc("abun"), F.col("pos"), F.col("strand"), F.col("lib")]).select("tag", "chr", "strand", "pos", "lib", "abun")


@query("W2", "tag_count", sql="SELECT tag, max(abun) AS abun FROM tag_count GROUP BY 1")
def w2(v: Views) -> DataFrame:
    return tg.max_tag(v.tag_count).orderBy(F.desc("abun"), "tag")


@query("W20", "cell", sql="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY cnt DESC, gene) AS nth FROM cell) WHERE nth <= 2")
def w20(v: Views) -> DataFrame:
    return tg.top_n(v.cell, ["cell"], [F.desc("cnt"), F.col("gene")], 2)


@query("SO1", "tag_count", "expr", sql="SELECT lib AS src, tag AS name, abun FROM tag_count UNION ALL SELECT sample, gene, cnt FROM expr")
def so1(v: Views) -> DataFrame:
    return v.tag_count.select(F.col("lib").alias("src"), F.col("tag").alias("name"), "abun").unionByName(v.expr.select(F.col("sample").alias("src"), F.col("gene").alias("name"), F.col("cnt").alias("abun")))


@query("SO2", "locus", "transcript", sql="SELECT chr FROM locus UNION SELECT chr FROM transcript")
def so2(v: Views) -> DataFrame:
    return v.locus.select("chr").union(v.transcript.select("chr")).distinct()


@query("SO3", "tag_count", sql="SELECT tag FROM tag_count WHERE lib='L0' EXCEPT SELECT tag FROM tag_count WHERE lib='L1'")
def so3(v: Views) -> DataFrame:
    return v.tag_count.filter("lib = 'L0'").select("tag").subtract(v.tag_count.filter("lib = 'L1'").select("tag"))


@query("SO4", "tag_count", sql="SELECT tag FROM tag_count WHERE lib='L0' INTERSECT SELECT tag FROM tag_count WHERE lib='L1'")
def so4(v: Views) -> DataFrame:
    return v.tag_count.filter("lib = 'L0'").select("tag").intersect(v.tag_count.filter("lib = 'L1'").select("tag"))


@query("SO5", "transcript", sql="SELECT DISTINCT gene FROM transcript")
def so5(v: Views) -> DataFrame:
    versioned = F.concat("gene", F.lit("."), (F.length("trans") % 3).cast("string"))
    return v.transcript.select(F.substring_index(versioned, ".", 1).alias("gene")).dropDuplicates()
