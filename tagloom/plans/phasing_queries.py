"""Queries over phased loci: clusters, registers, p values, merging, triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tagloom.operators import loci as lc
from tagloom.operators import phasing as ph
from tagloom.plans.fixtures import LIBS
from tagloom.plans.registry import Views, query

RL = 21
_W6 = "g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos, strand, tag, lib) <= 400 THEN 0 ELSE 1 END AS nw FROM tag_position), i AS (SELECT *, sum(nw) OVER (PARTITION BY chr ORDER BY pos RANGE UNBOUNDED PRECEDING) AS cluster FROM g), c AS (SELECT *, count(*) OVER (PARTITION BY chr, cluster) AS sz FROM i), w6 AS (SELECT * FROM c WHERE sz >= 9)"
_W8 = f"""o AS (SELECT DISTINCT chr, cluster, strand, pos, pos + CASE WHEN strand='c' THEN 3 ELSE 0 END AS reg FROM w6),
 w8 AS (SELECT a.chr, a.cluster, a.strand, a.pos, a.reg,
  count(CASE WHEN a.strand='w' AND (b.strand='w' AND b.pos BETWEEN a.pos AND a.pos+{11 * RL - 1} OR b.strand='c' AND b.pos BETWEEN a.pos-2 AND a.pos+{11 * RL - 3})
               OR a.strand='c' AND (b.strand='w' AND b.pos BETWEEN a.pos-{11 * RL - 1} AND a.pos OR b.strand='c' AND b.pos > 2 AND b.pos BETWEEN a.pos-{11 * RL - 3} AND a.pos+2) THEN 1 END) AS n,
  count(CASE WHEN (a.reg-b.reg) % {RL} = 0 AND (a.strand='w' AND (b.strand='w' AND b.reg BETWEEN a.reg AND a.reg+{10 * RL} OR b.strand='c' AND b.reg BETWEEN a.reg+{RL} AND a.reg+{11 * RL})
               OR a.strand='c' AND (b.strand='c' AND b.reg BETWEEN a.reg-{10 * RL} AND a.reg OR b.strand='w' AND b.reg BETWEEN a.reg-{11 * RL} AND a.reg-{RL})) THEN 1 END) AS k
 FROM o a JOIN o b ON a.chr=b.chr AND a.cluster=b.cluster GROUP BY 1, 2, 3, 4, 5)"""
_S1 = f"""m AS (SELECT {22 * RL} AS m), q AS (SELECT n, k, exp(lgamma(23)-lgamma(k+1)-lgamma(23-k) + lgamma(m-21)-lgamma(n-k+1)-lgamma(m-21-n+k) - lgamma(m+1)+lgamma(n+1)+lgamma(m-n+1)) AS pmf
   FROM m, (SELECT unnest(generate_series(1, {22 * RL})) AS n), (SELECT unnest(generate_series(0, 22)) AS k) WHERE k <= n AND n-k <= m-22),
 s1 AS (SELECT n, k, least(sum(pmf) OVER (PARTITION BY n ORDER BY k DESC), 1.0) AS p FROM q)"""


@query("W6", "tag_position", sql=f"WITH {_W6} SELECT tag, len, chr, strand, pos, lib, abun, cluster FROM w6")
def w6(v: Views) -> DataFrame:
    return ph.presplit(v.tag_position)


@query("W8", "tag_position", sql=f"WITH {_W6}, {_W8} SELECT * FROM w8")
def w8(v: Views) -> DataFrame:
    return ph.register_counts(ph.occupied_clusters(v.tag_position), RL)


@query("S1", "tag_position", sql=f"WITH {_W6}, {_W8}, {_S1} SELECT w8.*, round(coalesce(s1.p, 1.0), 9) AS p FROM w8 LEFT JOIN s1 ON s1.n=w8.n AND s1.k=w8.k")
def s1(v: Views) -> DataFrame:
    return ph.phasing_p(ph.register_counts(ph.occupied_clusters(v.tag_position), RL), RL).withColumn("p", F.round("p", 9))


def _best(v: Views) -> DataFrame:
    return ph.best_registers(ph.occupied_clusters(v.tag_position), RL)


def _best_sums(v: Views) -> DataFrame:
    return ph.best_of_positions(ph.tag_positions(v.tag_position, RL), RL)


_W9 = f"""s AS (SELECT w8.*, round(coalesce(s1.p, 1.0), 9) AS p FROM w8 LEFT JOIN s1 ON s1.n=w8.n AND s1.k=w8.k),
 j AS (SELECT t.chr, t.cluster, t.strand, t.pos, t.reg, a.p AS best_p, a.pos AS best_pos, a.strand AS best_strand, a.n, a.k,
   row_number() OVER (PARTITION BY t.chr, t.cluster, t.strand, t.pos ORDER BY a.p, a.pos, a.strand) AS r
  FROM s t JOIN s a ON t.chr=a.chr AND t.cluster=a.cluster AND (t.reg-a.reg) % {RL} = 0 AND (
   t.strand='w' AND (a.strand='w' AND a.reg BETWEEN t.reg-{10 * RL} AND t.reg OR a.strand='c' AND a.reg BETWEEN t.reg+{RL} AND t.reg+{11 * RL})
   OR t.strand='c' AND (a.strand='w' AND a.reg BETWEEN t.reg-{11 * RL} AND t.reg-{RL} OR a.strand='c' AND a.reg BETWEEN t.reg AND t.reg+{10 * RL})))"""


@query("W9", "tag_position", sql=f"WITH {_W6}, {_W8}, {_S1}, {_W9} SELECT chr, cluster, strand, pos, reg, best_p, best_pos, best_strand, n, k FROM j WHERE r = 1")
def w9(v: Views) -> DataFrame:
    return _best(v)


CUTS = (0.9, 0.5, 0.2)
#: W7's cutoffs: the scripts' ten, and the three looser ones of the other queries.
CUTOFFS = (*CUTS, 5e-3, 1e-3, 5e-4, 1e-4, 5e-5, 1e-5, 5e-6, 1e-6, 5e-7, 1e-7)


def _w7(cuts: str) -> str:
    return f"b AS (SELECT * FROM j WHERE r = 1), f AS (SELECT CAST(cut AS DOUBLE) AS cut, chr, strand, pos, best_p, n, k FROM b, (SELECT unnest([{cuts}]) AS cut) WHERE best_p <= CAST(cut AS DOUBLE)), f2 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY cut, chr ORDER BY pos, strand) <= 300 THEN 0 ELSE 1 END AS nw FROM f), w7 AS (SELECT *, sum(nw) OVER (PARTITION BY cut, chr ORDER BY pos RANGE UNBOUNDED PRECEDING) AS cl FROM f2)"


_W7 = _w7("0.9, 0.5, 0.2")
_TO_W9 = f"{_W6}, {_W8}, {_S1}, {_W9}"
_EVERY = ", ".join(f"{c!r}::DOUBLE" for c in CUTOFFS)
_ALL7 = f"{_W6}, {_W8}, {_S1}, {_W9}, {_W7}"


@query("W7", "tag_position", sql=f"WITH {_TO_W9}, {_w7(_EVERY)} SELECT cut, chr, strand, pos, best_p, n, k, cl FROM w7")
def w7(v: Views) -> DataFrame:
    return ph.phased_clusters(ph.best_registers(ph.occupied_clusters(v.tag_position), RL, also=("__block",)), CUTOFFS)


_HITS = "h AS (SELECT tag, count(DISTINCT (chr, strand, pos)) AS hits FROM tag_position GROUP BY tag), m7 AS (SELECT w7.cut, w7.chr, w7.cl, t.len, t.abun, h.hits FROM w7 JOIN tag_position t ON t.chr=w7.chr AND t.strand=w7.strand AND t.pos=w7.pos JOIN h ON h.tag=t.tag)"


@query("A15", "tag_position", sql=f"WITH {_ALL7}, {_HITS}, a AS (SELECT cut, chr, cl, 100.0::DOUBLE*sum(CASE WHEN len=21 THEN abun ELSE 0 END)/sum(abun) AS share, avg(hits) AS mean_hits, count(*) AS n_rows FROM m7 GROUP BY 1, 2, 3) SELECT * FROM a WHERE share >= 15 AND mean_hits <= 10")
def a15(v: Views) -> DataFrame:
    return ph.accept_positions(ph.phased_sums(_best_sums(v), CUTS), share=15.0)


_A16 = f"a16 AS (SELECT cut, chr, cl, arg_min(pos - CASE WHEN strand='c' THEN {RL - 3} ELSE 0 END, pos*2 + CASE WHEN strand='c' THEN 0 ELSE 1 END) AS cstart, arg_max(pos + CASE WHEN strand='c' THEN 2 ELSE {RL - 1} END, pos*2 + CASE WHEN strand='c' THEN 0 ELSE 1 END) AS cend, min(best_p) AS p, max(k) AS k FROM w7 GROUP BY 1, 2, 3)"


@query("A16", "tag_position", sql=f"WITH {_ALL7}, {_A16} SELECT * FROM a16")
def a16(v: Views) -> DataFrame:
    return ph.cluster_bounds(ph.phased_clusters(_best(v), CUTS), RL)


@query("A34", "tag_position", sql="SELECT chr, strand, pos, sum(abun)::BIGINT AS abun, arg_min(tag, (-length(tag), tag)) AS tag FROM tag_position GROUP BY 1, 2, 3")
def a34(v: Views) -> DataFrame:
    return ph.degradome_sites(v.tag_position)


_A35 = f"""each AS (SELECT cut, chr, cl, 100.0::DOUBLE*sum(CASE WHEN len={RL} THEN abun ELSE 0 END)/sum(abun) AS share, avg(hits) AS mean_hits, sum(abun::DOUBLE/hits) AS norm FROM m7 GROUP BY 1, 2, 3),
 per AS (SELECT cut, count(*) AS n_clusters, sum(norm) AS norm FROM each WHERE share >= 15 AND mean_hits <= 10 GROUP BY 1), library AS (SELECT sum(t.abun::DOUBLE/h.hits) AS total FROM tag_position t JOIN h ON h.tag=t.tag)"""


@query("A35", "tag_position", sql=f"WITH {_TO_W9}, {_w7(_EVERY)}, {_HITS}, {_A35} SELECT e.cut, {RL} AS rl, coalesce(n_clusters, 0) AS n_clusters, round(coalesce(norm, 0), 2) AS n_phased, coalesce(CAST(floor(round(coalesce(norm, 0)*10000000/total, 2)) AS BIGINT), 0) AS scaled FROM (SELECT unnest([{_EVERY}]) AS cut) e LEFT JOIN per ON per.cut=e.cut, library")
def a35(v: Views) -> DataFrame:
    """The library's total, in which each read counts once, is summed up while the positions are stored."""
    library, also = Observation(), (*ph.SUMS, "norm")
    at = ph.tag_positions(v.tag_position, RL).observe(library, F.sum("norm").alias("total"))
    sums = ph.phased_sums(ph.best_of_positions(at, RL, also), CUTOFFS, also)
    return ph.run_summary(sums, CUTOFFS, RL, library.get["total"], share=15.0)


_J33 = f"""b AS (SELECT name, chr, lstart AS cstart, lend AS cend FROM locus), s AS (SELECT chr, strand, pos, sum(abun)::BIGINT AS abun FROM tag_position GROUP BY 1, 2, 3),
 x AS (SELECT b.name, b.cstart, b.cend, s.strand, s.pos, s.abun, s.pos <= cstart+{RL + 2} AS five, s.pos >= cend-{RL + 2} AS three, row_number() OVER (PARTITION BY b.name ORDER BY s.abun DESC, s.pos, s.strand) AS top
   FROM b JOIN s ON s.chr=b.chr AND s.pos BETWEEN cstart-{4 * RL + 2} AND cend+{4 * RL + 2}),
 y AS (SELECT *, five AND top<=3 AND abs(pos + CASE WHEN strand='c' THEN 3 ELSE 0 END - cstart) % {RL} = 0 AS good5, three AND top<=3 AND abs(pos + CASE WHEN strand='c' THEN 3 ELSE 0 END - cend) % {RL} = 0 AS good3 FROM x),
 a AS (SELECT name, sum(abun)::BIGINT AS whole, coalesce(sum(CASE WHEN five THEN abun END),0) AS z5, coalesce(sum(CASE WHEN three THEN abun END),0) AS z3, coalesce(arg_min(good5, top) FILTER (five), false) AS g5, arg_min(pos, top) FILTER (five) AS p5, coalesce(arg_min(good3, top) FILTER (three), false) AS g3, arg_min(pos, top) FILTER (three) AS p3 FROM y GROUP BY 1),
 k AS (SELECT b.name, b.cstart, b.cend, p5, p3, coalesce(whole,0) AS whole, CASE WHEN whole IS NULL THEN 'tlt10' WHEN z5<6 AND z3<6 THEN 'lt6' WHEN z5=z3 THEN 'UC' WHEN g5 AND g3 THEN 'h2' WHEN g5 THEN 'ups' WHEN g3 THEN 'dws' ELSE 'tpon' END AS support FROM b LEFT JOIN a ON a.name=b.name)"""


@query("J33", "tag_position", "locus", sql=f"WITH {_J33} SELECT name, support, CASE WHEN support='ups' THEN p5 ELSE cstart END AS cstart, CASE WHEN support='dws' THEN p3 ELSE cend END AS cend, whole FROM k")
def j33(v: Views) -> DataFrame:
    b = v.locus.select("name", "chr", F.col("lstart").alias("cstart"), F.col("lend").alias("cend"))
    s = v.tag_position.groupBy("chr", "strand", "pos").agg(F.sum("abun").alias("abun"))
    return ph.degradome_support(b, s, RL)


@query("A35_support", "tag_position", "locus", sql=f"WITH {_J33} SELECT l.neglog_p AS cut, count(*) FILTER (k.support IN ('h2','ups','dws')) AS supported, count(*) FILTER (k.support NOT IN ('h2','ups','dws')) AS unsupported FROM locus l JOIN k ON k.name=l.name GROUP BY 1")
def a35_support(v: Views) -> DataFrame:
    b = v.locus.select("name", "chr", F.col("lstart").alias("cstart"), F.col("lend").alias("cend"))
    s = v.tag_position.groupBy("chr", "strand", "pos").agg(F.sum("abun").alias("abun"))
    return ph.support_summary(v.locus.select(F.col("neglog_p").alias("cut"), "name"), ph.degradome_support(b, s, RL).select("name", "support"))


@query("W10", "locus", "tag_position", sql="WITH c AS (SELECT l.name, t.lib AS cluster, count(DISTINCT t.pos) AS k, sum(t.abun)::BIGINT AS abun FROM locus l JOIN tag_position t ON t.chr=l.chr AND t.pos BETWEEN lstart AND lend GROUP BY 1, 2) SELECT name, cluster, k, abun FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k DESC, abun DESC, cluster) AS r FROM c) WHERE r = 1")
def w10(v: Views) -> DataFrame:
    return lc.best_cluster(_members(v).groupBy("name", F.col("tlib").alias("cluster")).agg(F.countDistinct("pos").alias("k"), F.sum("abun").alias("abun")))


def _members(v: Views) -> DataFrame:
    from tagloom.operators.intervals import _in_loci

    return _in_loci(v.locus, v.tag_position)


# rounds: what has no better one left is chosen, and what it rules out goes
@query("W11", "locus", sql="WITH RECURSIVE n AS (SELECT *, row_number() OVER (ORDER BY neglog_p DESC, lstart - lend, lstart, name) AS o FROM locus), b AS (SELECT *, unnest(generate_series(lstart // 512, lend // 512)) AS bin FROM n), c AS MATERIALIZED (SELECT DISTINCT x.o AS worse, y.o AS better FROM b x JOIN b y ON x.lib=y.lib AND x.chr=y.chr AND x.bin=y.bin AND y.o < x.o AND 2.0::DOUBLE * greatest(0, least(x.lend, y.lend) - greatest(x.lstart, y.lstart)) / (x.lend - x.lstart + y.lend - y.lstart) > 0.45), r AS (SELECT 0 AS turn, o, false AS won FROM n UNION ALL SELECT turn + 1, o, NOT waits FROM (WITH keep AS (SELECT turn, o FROM r WHERE NOT won AND o NOT IN (SELECT c.worse FROM c JOIN r w ON w.o = c.better WHERE w.won)) SELECT k.turn, k.o, k.o IN (SELECT c.worse FROM c JOIN keep k2 ON k2.o = c.better) AS waits FROM keep k)) SELECT name, neglog_p, chr, lstart, lend, lib FROM n WHERE o IN (SELECT o FROM r WHERE won)")
def w11(v: Views) -> DataFrame:
    return lc.self_merge(v.locus)


@query("W12", "locus")
def w12(v: Views) -> DataFrame:
    return lc.merge_libraries(v.locus)


_BINNED = "(SELECT *, unnest(generate_series(lstart // 512, lend // 512)) AS bin FROM locus) l JOIN tag_position t ON t.chr=l.chr AND t.pos // 512 = l.bin AND t.pos BETWEEN lstart AND lend"


@query("A17", "tag_count", "locus", sql=f"WITH mk AS MATERIALIZED (SELECT l.name, t.tag, max(t.abun % 23) AS k FROM {_BINNED} GROUP BY 1, 2), tc AS MATERIALIZED (SELECT tag, lib, abun FROM tag_count), j AS MATERIALIZED (SELECT mk.name, tc.lib, tc.tag, tc.abun FROM mk JOIN tc ON tc.tag=mk.tag), p AS (SELECT name, tag, sum(abun)::BIGINT AS abun FROM j GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY abun DESC, tag) AS nth FROM p), s AS (SELECT name, " + ", ".join(f"coalesce(sum(CASE WHEN lib='{x}' THEN abun END),0)::BIGINT AS \"{x}\"" for x in LIBS) + ", sum(abun)::BIGINT AS total, coalesce(sum(CASE WHEN length(tag)=21 THEN abun END),0)::BIGINT AS phased FROM j GROUP BY 1), bk AS (SELECT name, max(k) AS best_k FROM mk GROUP BY 1), o AS (SELECT s.name, " + ", ".join(f'"{x}"' for x in LIBS) + ", total, round(phased::DOUBLE/total, 2) AS size_ratio, a.abun::DOUBLE/total AS max_tag_ratio, a.tag AS tag1, b.tag AS tag2, best_k FROM s JOIN bk ON bk.name=s.name JOIN r a ON a.name=s.name AND a.nth=1 LEFT JOIN r b ON b.name=s.name AND b.nth=2) SELECT * FROM o WHERE max_tag_ratio <= 0.9 AND best_k >= 8 AND total >= 30")
def a17(v: Views) -> DataFrame:
    return lc.summarize_loci(_members(v).select("name", "tag", (F.col("abun") % 23).alias("k")), v.tag_count, LIBS, RL, safe=(0.9, 8, 30))


@query("A18", "tag_position", "transcript", sql="WITH p AS (SELECT x.trans AS name, t.tag, sum(t.abun)::BIGINT AS abun FROM transcript x JOIN tag_position t ON t.chr=x.chr AND t.pos BETWEEN tstart AND tend GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY abun DESC, tag) AS nth FROM p) SELECT name, sum(abun)::BIGINT AS total, sum(CASE WHEN nth=1 THEN abun END)::DOUBLE/sum(abun) AS ratio1, sum(CASE WHEN nth<=2 THEN abun END)::DOUBLE/sum(abun) AS ratio2 FROM r GROUP BY 1")
def a18(v: Views) -> DataFrame:
    return lc.precursor_ratio(v.transcript.select(F.col("trans").alias("name"), "chr", F.col("tstart").alias("lstart"), F.col("tend").alias("lend")), v.tag_position)


@query("A18_arms", "tag_position", "transcript", sql="WITH x AS (SELECT trans, chr, tstart AS s, tstart+20+tstart%60 AS e FROM transcript UNION ALL SELECT trans, chr, tend-20-tend%60 AS s, tend AS e FROM transcript), p AS (SELECT x.trans AS name, t.tag, sum(t.abun)::BIGINT AS abun FROM x JOIN tag_position t ON t.chr=x.chr AND t.pos BETWEEN s AND e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY abun DESC, tag) AS nth FROM p) SELECT name, sum(abun)::BIGINT AS total, sum(CASE WHEN nth=1 THEN abun END)::DOUBLE/sum(abun) AS ratio1, sum(CASE WHEN nth<=2 THEN abun END)::DOUBLE/sum(abun) AS ratio2 FROM r GROUP BY 1")
def a18_arms(v: Views) -> DataFrame:
    size = F.col("tend") - F.col("tstart")
    p = v.transcript.select(F.col("trans").alias("name"), "chr", F.col("tstart").alias("pstart"), F.lit(0).alias("start5"), (20 + F.col("tstart") % 60).alias("end5"), (size - 20 - F.col("tend") % 60).alias("start3"), size.alias("end3"))
    return lc.precursor_ratio(lc.precursor_arms(p), v.tag_position)


@query("A32", "locus", sql="WITH m AS (SELECT lstart // 3000 AS cluster, name AS member, lib AS species FROM locus), p AS (SELECT cluster, species, min(member) AS member FROM m GROUP BY 1, 2), n AS (SELECT cluster, count(*) AS n_species FROM p GROUP BY 1 HAVING count(*) > 1) SELECT p.*, n_species FROM p JOIN n USING (cluster)")
def a32(v: Views) -> DataFrame:
    return lc.cross_species_clusters(v.locus.select(F.floor(F.col("lstart") / 3000).alias("cluster"), F.col("name").alias("member"), F.col("lib").alias("species")))


@query("A33", "transcript", sql="WITH p AS (SELECT trans AS a, 'T' || CAST(CAST(substr(trans,2) AS BIGINT)+1 AS STRING) AS b FROM transcript WHERE CAST(substr(trans,2) AS BIGINT) % 10 = 0), x AS (SELECT a AS name FROM p UNION SELECT b FROM p), g AS (SELECT DISTINCT gene FROM transcript WHERE trans IN (SELECT name FROM x)) SELECT trans AS name, CASE WHEN trans IN (SELECT name FROM x) THEN 'paired' WHEN gene IN (SELECT gene FROM g) THEN 'isoform' ELSE 'neither' END AS kind FROM transcript")
def a33(v: Views) -> DataFrame:
    n = F.substr("trans", F.lit(2)).cast("long")
    pairs = v.transcript.filter(n % 10 == 0).select(F.col("trans").alias("a"), F.concat(F.lit("T"), (n + 1).cast("string")).alias("b"))
    t = v.transcript.select(F.col("trans").alias("name"), "gene")
    return lc.classify_pairs(t.select("name"), pairs, t)


_J18 = f"""s AS (SELECT DISTINCT lib || '_' || CAST(pos AS STRING) || '_' || strand || CAST(chr AS STRING) AS site, chr, strand, pos FROM tag_position), e AS (SELECT name, chr, 'w' AS ls, lstart AS head FROM locus UNION ALL SELECT name, chr, 'c' AS ls, lend AS head FROM locus),
 al AS (SELECT name, chr, ls, idx, o, head + idx*{RL} + o AS p FROM e, (SELECT unnest([0,-1,1,-2,2]) AS o), (SELECT unnest(generate_series(-5,7)) AS idx)),
 c AS (SELECT s.site, al.name, abs(o) AS cls, idx, row_number() OVER (PARTITION BY s.site, al.name ORDER BY abs(o), abs(idx), idx) AS r FROM s JOIN al ON s.chr=al.chr AND s.strand=al.ls AND s.pos=al.p)"""


@query("J18", "tag_position", "locus", sql=f"WITH {_J18} SELECT site, name, cls, idx FROM c WHERE r = 1")
def j18(v: Views) -> DataFrame:
    return lc.find_triggers(_sites(v), v.locus, RL)


def _sites(v: Views) -> DataFrame:
    site = F.concat(F.col("lib"), F.lit("_"), F.col("pos").cast("string"), F.lit("_"), F.col("strand"), F.col("chr").cast("string"))
    return v.tag_position.select(site.alias("site"), "chr", "strand", "pos").distinct()


@query("W17", "tag_position", "locus", sql=f"WITH {_J18}, f AS (SELECT *, substr(site,1,2) AS family FROM c WHERE r=1 AND abs(idx)<=3), g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN family='L1' THEN 0 ELSE 1 END, abs(idx), site, idx) AS q FROM f) SELECT name, site, family, idx FROM g WHERE q=1")
def w17(v: Views) -> DataFrame:
    return lc.best_trigger(lc.find_triggers(_sites(v), v.locus, RL).withColumn("family", F.substring("site", 1, 2)), ("L1",))


def _matching(pairs: str) -> str:
    """Rounds over pairs (a, b, o), numbered in order: the best of both its members is chosen, and its members' other pairs go."""
    return f"""{pairs}, r AS (SELECT 0 AS turn, a, b, o, false AS won FROM p UNION ALL SELECT turn + 1, a, b, o, o = best_a AND o = best_b FROM (
   WITH keep AS (SELECT turn, a, b, o FROM r WHERE NOT won AND a NOT IN (SELECT a FROM r WHERE won UNION ALL SELECT b FROM r WHERE won) AND b NOT IN (SELECT a FROM r WHERE won UNION ALL SELECT b FROM r WHERE won)),
     best AS (SELECT m, min(o) AS o FROM (SELECT a AS m, o FROM keep UNION ALL SELECT b, o FROM keep) GROUP BY 1)
   SELECT k.*, x.o AS best_a, y.o AS best_b FROM keep k JOIN best x ON x.m = k.a JOIN best y ON y.m = k.b))"""


_P16 = "s AS (SELECT trans AS name, CAST(substr(trans,2) AS BIGINT) AS n, unnest([0,1,2]) AS k FROM transcript), p AS (SELECT 'n:' || name AS a, 'p:p' || CAST((n*7 + k*13) % 997 AS STRING) AS b, row_number() OVER (ORDER BY n, name, k, 'p' || CAST((n*7 + k*13) % 997 AS STRING)) AS o FROM s)"
_P18 = "t AS (SELECT trans, CAST(substr(trans,2) AS BIGINT) AS n, tend - tstart AS size FROM transcript), s AS (SELECT trans AS a, n, size AS alen, unnest([1,3,5]) AS k FROM t), q AS (SELECT a, alen, 'T' || CAST((n*k + 11*k) % 1500 AS STRING) AS b, (n*37*k) % 500 AS bitscore, (80 + (n*k) % 20)::DOUBLE AS pident, 150 + (n*13*k) % 400 AS length FROM s), p AS (SELECT q.*, t.size AS blen, row_number() OVER (ORDER BY bitscore DESC, a, b, length, pident) AS o FROM q JOIN t ON t.trans = q.b WHERE length >= 180 AND pident >= 85 AND length >= 0.7::DOUBLE * least(alen, t.size))"


@query("W16", "transcript", sql=f"WITH RECURSIVE {_matching(_P16)} SELECT substr(a, 3) AS name, substr(b, 3) AS place FROM r WHERE won")
def w16(v: Views) -> DataFrame:
    n = F.substr("trans", F.lit(2)).cast("long")
    names = v.transcript.select(F.col("trans").alias("name"), n.alias("ord"))
    places = v.transcript.select(F.col("trans").alias("name"), F.explode(F.array(*[F.struct(F.concat(F.lit("p"), ((n * 7 + k * 13) % 997).cast("string")).alias("place"), F.lit(k).alias("pord")) for k in range(3)])).alias("x")).select("name", "x.place", "x.pord")
    return lc.unique_placement(names, places)


@query("W18", "transcript", sql=f"WITH RECURSIVE {_matching(_P18)} SELECT p.a, alen, p.b, bitscore, pident, length, blen FROM p JOIN r ON r.o = p.o WHERE won")
def w18(v: Views) -> DataFrame:
    n, size = F.substr("trans", F.lit(2)).cast("long"), F.col("tend") - F.col("tstart")
    partner = lambda k: F.struct(F.concat(F.lit("T"), ((n * k + 11 * k) % 1500).cast("string")).alias("b"), ((n * 37 * k) % 500).alias("bitscore"), (80 + (n * k) % 20).cast("double").alias("pident"), (150 + (n * 13 * k) % 400).alias("length"))
    pairs = v.transcript.select(F.col("trans").alias("a"), size.alias("alen"), F.explode(F.array(*[partner(k) for k in (1, 3, 5)])).alias("x")).select("a", "alen", "x.b", "x.bitscore", "x.pident", "x.length")
    own = v.transcript.select(F.col("trans").alias("b_"), size.alias("blen"))
    return lc.inverted_repeats(pairs.join(own, F.col("b") == F.col("b_")).drop("b_"), least_len=180)


@query("W21", "locus", sql="SELECT name, 'Phas-' || CAST(row_number() OVER (ORDER BY lpad(CAST(chr AS STRING), 8, '0'), lstart, name) AS STRING) AS phas_id, lpad(CAST(chr AS STRING), 8, '0') AS ckey, lstart FROM locus")
def w21(v: Views) -> DataFrame:
    return lc.enumerate_loci(v.locus)


@query("W22", "locus", sql="SELECT lib, min(CASE WHEN neglog_p >= 4 THEN neglog_p END) AS cutoff, quantile_disc(neglog_p, 0.25) AS nearest FROM locus GROUP BY 1")
def w22(v: Views) -> DataFrame:
    return lc.pick_cutoff(v.locus, 4)
