"""Queries over intervals and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import intervals as iv
from tagloom.plans.fixtures import LIBS
from tagloom.plans.registry import Views, query

_A3 = ", ".join(
    f"sum(CASE WHEN t.lib='{x}' AND len IN (21,22) THEN abun END)::BIGINT AS main_{x}, sum(CASE WHEN t.lib='{x}' AND len IN (20,23,24) THEN abun END)::BIGINT AS noise_{x}" for x in LIBS
)
_A3R = ", ".join(f"main_{x}, noise_{x}, CASE WHEN main_{x} IS NULL THEN 0.0 WHEN noise_{x} IS NULL THEN 1.0 ELSE main_{x}::DOUBLE / (main_{x} + noise_{x}) END::DOUBLE AS ratio_{x}" for x in LIBS)


@query("A3", "tag_position", "locus", sql=f"WITH s AS (SELECT l.name, {_A3} FROM locus l JOIN tag_position t ON t.chr = l.chr AND t.pos BETWEEN lstart AND lend WHERE len BETWEEN 20 AND 24 GROUP BY l.name) SELECT l.name, l.chr, lstart, lend, {_A3R} FROM locus l LEFT JOIN s ON s.name = l.name")
def a3(v: Views) -> DataFrame:
    return iv.coord_abundance(v.locus, v.tag_position, LIBS)


@query("A3_stranded", "tag_position", "transcript", sql=f"WITH s AS (SELECT l.trans, {_A3} FROM transcript l JOIN tag_position t ON t.chr = l.chr AND t.strand = l.strand AND t.pos BETWEEN tstart AND tend WHERE len BETWEEN 20 AND 24 GROUP BY l.trans) SELECT l.trans AS name, l.chr, tstart AS lstart, tend AS lend, {_A3R} FROM transcript l LEFT JOIN s ON s.trans = l.trans")
def a3_stranded(v: Views) -> DataFrame:
    loci = v.transcript.select(F.col("trans").alias("name"), "chr", "strand", F.col("tstart").alias("lstart"), F.col("tend").alias("lend"))
    return iv.coord_abundance(loci, v.tag_position, LIBS, stranded=True)


_SIZES = (20, 21, 22, 23, 24)
_JOIN = "FROM locus l JOIN tag_position t ON t.chr = l.chr AND t.pos BETWEEN lstart AND lend"


@query("A4", "tag_position", "locus", sql="SELECT l.name, t.lib, " + ", ".join(f"coalesce(sum(CASE WHEN len={s} THEN abun END),0)::BIGINT AS s{s}" for s in _SIZES) + f", sum(abun)::BIGINT AS total {_JOIN} WHERE len BETWEEN 20 AND 24 GROUP BY 1, 2")
def a4(v: Views) -> DataFrame:
    return iv.coord_size_abundance(v.locus, v.tag_position)


@query("A5", "tag_position", "locus", sql="SELECT l.name, t.lib, " + ", ".join(f"count(DISTINCT CASE WHEN len={s} THEN tag END) AS s{s}" for s in _SIZES) + f", count(DISTINCT tag) AS total {_JOIN} WHERE len BETWEEN 20 AND 24 GROUP BY 1, 2")
def a5(v: Views) -> DataFrame:
    return iv.coord_size_abundance(v.locus, v.tag_position, count=True)


_HITS = "h AS (SELECT tag, count(DISTINCT (chr, strand, pos)) AS hits FROM tag_position GROUP BY tag)"


@query("A7", "tag_position", "locus", sql=f"WITH {_HITS} SELECT l.name, round(coalesce(sum(CASE WHEN len=21 THEN abun::DOUBLE/hits END),0), 6) AS norm21, round(coalesce(sum(CASE WHEN len=22 THEN abun::DOUBLE/hits END),0), 6) AS norm22, count(*) FILTER (len=21) AS n21, count(*) FILTER (len=22) AS n22 {_JOIN} JOIN h ON h.tag = t.tag WHERE len IN (21,22) GROUP BY 1")
def a7(v: Views) -> DataFrame:
    return iv.cluster_abundance(v.locus, v.tag_position).withColumns({c: F.round(c, 6) for c in ("norm21", "norm22")})


@query("A8", "tag_position", sql="WITH d AS (SELECT DISTINCT chr, strand, pos FROM tag_position WHERE len = 22), b AS (SELECT chr, CAST(floor((pos-1)/500.0) AS BIGINT) AS bin, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) > 1) SELECT *, row_number() OVER (PARTITION BY chr ORDER BY bin) AS bin_no FROM b")
def a8(v: Views) -> DataFrame:
    return iv.bin_counts(v.tag_position)


@query("A14", "tag_position", "locus", sql=f"WITH s AS (SELECT l.name, coalesce(sum(CASE WHEN t.strand='w' AND len=21 THEN abun END),0)::BIGINT AS main_w, coalesce(sum(CASE WHEN t.strand='c' AND len=21 THEN abun END),0)::BIGINT AS main_c, coalesce(sum(CASE WHEN t.strand='w' AND len<>21 THEN abun END),0)::BIGINT AS noise_w, coalesce(sum(CASE WHEN t.strand='c' AND len<>21 THEN abun END),0)::BIGINT AS noise_c {_JOIN} GROUP BY 1) SELECT *, (main_w+main_c)::DOUBLE/nullif(main_w+main_c+noise_w+noise_c,0) AS phasi_ratio, CASE WHEN main_w>main_c THEN 'w' WHEN main_w<main_c THEN 'c' ELSE 'b' END AS pstrand, greatest(main_w,main_c)::DOUBLE/nullif(main_w+main_c,0) AS strand_ratio FROM s")
def a14(v: Views) -> DataFrame:
    return iv.strand_bias(v.locus, v.tag_position)


@query("J12", "tag_position", "locus", sql=f"WITH {_HITS} SELECT l.name, t.tag, t.len, t.strand, t.pos, t.lib, t.abun, h.hits {_JOIN} JOIN h ON h.tag = t.tag WHERE len IN (21,22) AND abun >= 5 AND hits <= 10")
def j12(v: Views) -> DataFrame:
    return iv.coords_to_tags(v.locus, v.tag_position)


_FLAG = "CASE WHEN si AND ei THEN '0' WHEN NOT si AND NOT ei THEN '8' WHEN ei THEN CASE WHEN strand='w' THEN '5' ELSE '3' END ELSE CASE WHEN strand='w' THEN '3' ELSE '5' END END"


@query("J3", "transcript", sql=f"""WITH p AS (SELECT a.trans, a.strand, b.gene, b.tstart AS gs, b.tend AS ge, b.tstart BETWEEN a.tstart AND a.tend AS si, b.tend BETWEEN a.tstart AND a.tend AS ei, CASE WHEN a.strand=b.strand THEN 'F' ELSE 'R' END AS c
 FROM transcript a JOIN transcript b ON a.chr=b.chr AND a.tstart<=b.tend AND b.tstart<=a.tend AND a.gene<>b.gene),
 f AS (SELECT *, {_FLAG} AS f FROM p), s AS (SELECT trans, string_agg(gene, ',' ORDER BY gene, gs, ge, f, c) AS genes, string_agg(f, ',' ORDER BY gene, gs, ge, f, c) AS flags, string_agg(c, ',' ORDER BY gene, gs, ge, f, c) AS confs FROM f GROUP BY trans)
 SELECT t.trans, coalesce(genes,'NA') AS genes, coalesce(flags,'NA') AS flags, coalesce(confs,'NA') AS confs FROM transcript t LEFT JOIN s ON s.trans=t.trans""")
def j3(v: Views) -> DataFrame:
    return iv.overlap_config(v.transcript, v.transcript)


_J4 = "SELECT l.name, t.trans, t.gene, l.lstart, l.lend, least(lend,tend)-greatest(lstart,tstart)+1 AS nt FROM locus l JOIN transcript t ON l.chr=t.chr AND lstart<=tend AND tstart<=lend"


@query("J4", "transcript", "locus", sql=_J4)
def j4(v: Views) -> DataFrame:
    return iv.overlap_transcripts(v.locus, v.transcript)


_J5 = "SELECT p.name, p.trans, sum(greatest(0, least(lend,xend)-greatest(lstart,xstart)+1))::BIGINT AS exon_nt, count(*) AS n_exons FROM p JOIN exon x ON x.trans=p.trans GROUP BY 1, 2"


@query("J5", "transcript", "exon", "locus", sql=f"WITH p AS ({_J4}) {_J5}")
def j5(v: Views) -> DataFrame:
    return iv.overlap_exons(iv.overlap_transcripts(v.locus, v.transcript), v.exon)


@query("J6", "transcript", "exon", "locus", sql=f"WITH q AS ({_J4}), p AS (SELECT *, nt::DOUBLE/(lend-lstart+1) AS perc FROM q WHERE nt::DOUBLE/(lend-lstart+1) >= 0.1 AND nt >= 50), e AS ({_J5}) SELECT l.name, l.chr, p.trans, p.gene, p.nt, p.perc, e.exon_nt, e.n_exons FROM locus l LEFT JOIN p ON p.name=l.name LEFT JOIN e ON e.name=p.name AND e.trans=p.trans")
def j6(v: Views) -> DataFrame:
    return iv.annotate_loci(v.locus, v.transcript, v.exon)


_DICE = "2.0::DOUBLE*greatest(0, least(a.lend,b.lend)-greatest(a.lstart,b.lstart))/((a.lend-a.lstart)+(b.lend-b.lstart))"
_AB = "FROM a JOIN b ON a.chr=b.chr AND a.lstart<=b.lend AND b.lstart<=a.lend"
_SIDES = "a AS (SELECT * FROM locus WHERE lib='click'), b AS (SELECT * FROM locus WHERE lib<>'click')"


def _sides(v: Views) -> tuple[DataFrame, DataFrame]:
    return v.locus.filter("lib = 'click'"), v.locus.filter("lib <> 'click'")


@query("J7", "locus", sql=f"WITH {_SIDES} SELECT a.name AS name_a, b.name AS name_b, round({_DICE}, 2) AS ratio {_AB} WHERE {_DICE} >= 0.45")
def j7(v: Views) -> DataFrame:
    return iv.dice_join(*_sides(v))


_MEM = "m AS (SELECT 'PH' || CAST(pos % 10000 AS STRING) AS cluster, tag, pos FROM tag_position)"


@query("J8", "locus", "tag_position", sql=f"WITH {_SIDES}, {_MEM} SELECT a.name AS name_a, round({_DICE}, 2) AS ratio, m.cluster, m.tag, m.pos {_AB} JOIN m ON m.cluster = b.name WHERE {_DICE} >= 0.5")
def j8(v: Views) -> DataFrame:
    return iv.match_clusters(*_sides(v), _cluster_members(v), 0.5)


def _cluster_members(v: Views) -> DataFrame:
    return v.tag_position.select(F.concat(F.lit("PH"), (F.col("pos") % 10000).cast("string")).alias("cluster"), "tag", "pos")


@query("J8_exact", "locus", "tag_position", sql=f"WITH {_SIDES}, {_MEM} SELECT a.name AS name_a, 1.0::DOUBLE AS ratio, m.cluster, m.tag, m.pos FROM a JOIN (SELECT name, chr, lstart, lend FROM locus) b ON b.chr=a.chr AND b.lstart=a.lstart AND b.lend=a.lend JOIN m ON m.cluster = b.name")
def j8_exact(v: Views) -> DataFrame:
    return iv.match_clusters(_sides(v)[0], v.locus, _cluster_members(v), None)


@query("J9", "locus", sql=f"WITH {_SIDES}, m AS (SELECT a.name AS name_a, b.name AS name_b, greatest(a.lstart,b.lstart) AS block_start, least(a.lend,b.lend)-greatest(a.lstart,b.lstart) AS block_len {_AB} WHERE {_DICE} >= 0.25) SELECT * FROM m UNION ALL SELECT name, NULL, NULL, NULL FROM a WHERE name NOT IN (SELECT name_a FROM m) UNION ALL SELECT NULL, name, NULL, NULL FROM b WHERE name NOT IN (SELECT name_b FROM m)")
def j9(v: Views) -> DataFrame:
    return iv.compare_loci(*_sides(v))


@query("J10", "locus", sql=f"WITH {_SIDES}, k AS (SELECT a.name AS name_a, b.name AS name_b, CASE WHEN abs(a.lstart-b.lstart)<=50 THEN 'start' WHEN abs(a.lend-b.lend)<=50 THEN 'end' WHEN a.lstart>=b.lstart AND a.lend<=b.lend OR b.lstart>=a.lstart AND b.lend<=a.lend THEN 'inside' END AS kind FROM a JOIN b ON a.chr=b.chr AND a.lstart-50<=b.lend AND b.lstart<=a.lend+50), m AS (SELECT * FROM k WHERE kind IS NOT NULL) SELECT * FROM m UNION ALL SELECT name, NULL, 'only_a' FROM a WHERE name NOT IN (SELECT name_a FROM m) UNION ALL SELECT NULL, name, 'only_b' FROM b WHERE name NOT IN (SELECT name_b FROM m)")
def j10(v: Views) -> DataFrame:
    return iv.match_loci_flank(*_sides(v))


@query("J11", "locus", "transcript", sql="SELECT l.name, t.trans AS ir, lstart-tstart AS flank5, tend-lend AS flank3 FROM locus l JOIN transcript t ON l.chr=t.chr AND lstart>=tstart AND lend<=tend")
def j11(v: Views) -> DataFrame:
    return iv.loci_in_repeats(v.locus, v.transcript.select(F.col("trans").alias("ir"), "chr", F.col("tstart").alias("s5"), F.col("tend").alias("e3")))


@query("J16", "locus", "transcript", sql="WITH k AS (SELECT l.name, t.gene, t.tstart AS gs, CASE WHEN lstart BETWEEN tstart AND tend AND lend BETWEEN tstart AND tend THEN 1 WHEN lstart BETWEEN tstart AND tend THEN 2 WHEN lend BETWEEN tstart AND tend THEN 3 END AS kind FROM locus l JOIN transcript t ON l.chr=t.chr AND lstart<=tend AND tstart<=lend), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, gs, gene) AS r FROM k WHERE kind IS NOT NULL) SELECT l.name, coalesce(b.gene,'inter') AS gene, coalesce(b.kind,0) AS kind FROM locus l LEFT JOIN b ON b.name=l.name AND r=1")
def j16(v: Views) -> DataFrame:
    return iv.annotate_first(v.locus, v.transcript)


@query("J29", "locus", "transcript", "exon", sql="SELECT l.name, t.trans, CASE WHEN bool_or(lstart>tstart AND lstart+9<tend AND lstart>xstart AND lstart+9<xend) THEN 'fl' ELSE 'nfl' END AS status FROM locus l JOIN transcript t ON l.chr=t.chr AND lstart<=tend AND tstart<=lstart+9 JOIN exon x ON x.trans=t.trans GROUP BY 1, 2")
def j29(v: Views) -> DataFrame:
    return iv.full_length(v.locus.withColumn("lend", F.col("lstart") + 9), v.transcript, v.exon)


def _islands(src: str, keys: str, s: str, e: str, gap: int = 0) -> str:
    return f"x AS ({src}), y AS (SELECT *, CASE WHEN {s} <= max({e}) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + ({gap}) THEN 0 ELSE 1 END AS nw FROM x), z AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS i FROM y), isl AS (SELECT {keys}, min({s}) AS mstart, max({e}) AS mend, count(*) AS n FROM z GROUP BY {keys}, i)"


_FEATS = "SELECT chr, strand, tstart, tend, trans AS name, 'g' AS kind FROM transcript UNION ALL SELECT chr, CASE WHEN neglog_p > 3 THEN 'w' ELSE 'c' END, lstart, lend, name, 'f' FROM locus"


def _feats(v: Views) -> DataFrame:
    return v.locus.select("chr", F.when(F.col("neglog_p") > 3, "w").otherwise("c").alias("strand"), F.col("lstart").alias("tstart"), F.col("lend").alias("tend"), "name")


def _merged(src: str, keys: str) -> str:
    """Islands with the members' names."""
    names = ", ".join(f"coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind='{k}'), '') AS {c}" for k, c in (("g", "genes"), ("f", "feats")))
    return f"{_islands(src, keys, 'tstart', 'tend')}, mrg AS (SELECT {keys}, min(tstart) AS mstart, max(tend) AS mend, count(*) AS n, {names} FROM z GROUP BY {keys}, i)"


def _named(v: Views) -> DataFrame:
    return v.transcript.withColumn("name", F.col("trans"))


@query("W13", "transcript", "locus", sql=f"WITH {_merged(_FEATS, 'chr, strand')} SELECT chr, strand, mstart, mend, n, genes, feats FROM mrg")
def w13(v: Views) -> DataFrame:
    return iv.merge_annotations(_named(v), _feats(v))


@query("W13_unstranded", "transcript", "locus", sql=f"WITH w13 AS ({_FEATS}), {_merged('SELECT chr, tstart, tend, name, kind FROM w13', 'chr')} SELECT chr, '*' AS strand, mstart, mend, n, genes, feats FROM mrg")
def w13u(v: Views) -> DataFrame:
    return iv.merge_annotations(_named(v), _feats(v), stranded=False)


_W14 = f"""WITH {_islands("SELECT chr, strand, tstart, tend, trans AS name FROM transcript WHERE NOT (chr = 3 AND strand = 'w')", 'chr, strand', 'tstart', 'tend')},
 m AS (SELECT chr, strand, i, min(tstart) AS s, max(tend) AS e, arg_min(name, (tstart, name)) AS head, arg_max(name, (tend, name)) AS tail FROM z GROUP BY 1, 2, 3),
 l AS (SELECT *, lead(s) OVER o AS ns, lead(head) OVER o AS nh FROM m WINDOW o AS (PARTITION BY chr, strand ORDER BY i)),
 r AS (SELECT chr, strand, CASE WHEN strand='w' AND ns IS NULL THEN tail || '_down' WHEN strand='w' THEN nh || '_up' ELSE tail || '_up' END AS name, e+1 AS rstart, ns-1 AS rend FROM l
  UNION ALL SELECT chr, strand, head || CASE WHEN strand='w' THEN '_up' ELSE '_down' END, 1, s-1 FROM m WHERE i=1
  UNION ALL SELECT chr, strand, CAST(chr AS STRING), 1, NULL FROM (SELECT DISTINCT chr FROM transcript), (SELECT unnest(['w','c']) AS strand) WHERE (chr, strand) NOT IN (SELECT (chr, strand) FROM m))
 SELECT * FROM r WHERE rend IS NULL OR rend-rstart+1 > 25"""


@query("W14", "transcript", sql=_W14)
def w14(v: Views) -> DataFrame:
    """Genes of all chromosomes and strands but one strand, which so is a region as a whole."""
    return iv.intergenic(_named(v).filter("NOT (chr = 3 AND strand = 'w')"), chroms=v.transcript.select("chr").distinct())


_W15 = "SELECT chr, min(pos) AS s, max(pos+len-1) AS e FROM tag_position WHERE len = 22 GROUP BY chr, floor((pos-1)/500.0)"


@query("W15", "tag_position", sql=f"WITH {_islands(_W15, 'chr', 's', 'e', 10)} SELECT * FROM isl")
def w15(v: Views) -> DataFrame:
    return iv.merge_mer_clusters(v.tag_position)


@query("A19", "exon", sql="SELECT chr, strand, trans, min(xstart) AS tstart, max(xend) AS tend, count(*) AS n_exons FROM exon GROUP BY 1, 2, 3")
def a19(v: Views) -> DataFrame:
    return iv.transcripts_from_exons(v.exon)


_ISO = "SELECT 'G' || CAST(CAST(floor(tstart/5000.0) AS BIGINT) AS STRING) AS gene, trans, chr, strand, tstart, tend, tend % 5 AS score, tstart % 3 > 0 AS coding FROM transcript"


def _iso(v: Views) -> DataFrame:
    return v.transcript.withColumn("gene", F.concat(F.lit("G"), F.floor(F.col("tstart") / 5000).cast("string"))).withColumn("score", F.col("tend") % 5).withColumn("coding", F.col("tstart") % 3 > 0)


@query("A22", "transcript", sql=f"WITH {_islands(_ISO, 'gene, chr, strand, coding', 'tstart', 'tend', -1)} SELECT gene, chr, strand, coding, min(tstart) AS mstart, max(tend) AS mend, count(*) AS n, string_agg(trans, ',' ORDER BY trans) AS isoforms, max(score) AS best_score, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'uniq' END AS kind FROM z GROUP BY gene, chr, strand, coding, i HAVING max(score) <= 1")
def a22(v: Views) -> DataFrame:
    return iv.collapse_isoforms(_iso(v))


@query("A25", "transcript", sql="WITH g AS (SELECT gene, chr, strand, min(tstart) AS s1, max(tstart) AS s2, min(tend) AS e1, max(tend) AS e2 FROM transcript GROUP BY 1, 2, 3) SELECT gene, chr, strand, CASE WHEN strand='w' THEN greatest(s1-500,1) ELSE e2+1 END AS uniq_start, CASE WHEN strand='w' THEN s1-1 ELSE e2+500 END AS uniq_end, CASE WHEN strand='w' THEN greatest(s1-500,1) ELSE e1+1 END AS long_start, CASE WHEN strand='w' THEN s2-1 ELSE e2+500 END AS long_end FROM g")
def a25(v: Views) -> DataFrame:
    return iv.gene_promoters(v.transcript)
