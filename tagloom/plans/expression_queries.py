"""Queries over expression tables, single cells, ranks, signals and methylation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import enrichment as en
from tagloom.operators import expression as ex
from tagloom.operators.islands import number_rows
from tagloom.plans.registry import Views, query
from tagloom.runtime import checkpoint, store

SAMPLES = tuple(f"S{k}" for k in range(6))


@query("A20", "transcript", sql="WITH q AS (SELECT gene, trans, 'S' || CAST(tstart % 3 AS STRING) AS sample, CAST(ceil((tend % 17 + 0.5::DOUBLE) * (tend-tstart) / 75) AS BIGINT) AS cnt FROM transcript) SELECT gene, " + ", ".join(f"coalesce(sum(CASE WHEN sample='S{k}' THEN cnt END),0)::BIGINT AS \"S{k}\"" for k in range(3)) + " FROM q GROUP BY 1")
def a20(v: Views) -> DataFrame:
    q = v.transcript.select("gene", "trans", F.concat(F.lit("S"), (F.col("tstart") % 3).cast("string")).alias("sample"), (F.col("tend") % 17 + 0.5).alias("cov"), (F.col("tend") - F.col("tstart")).alias("exon_len"))
    return ex.count_matrix(q, 75, SAMPLES[:3], "gene")


_A21 = """x AS (SELECT *, unnest(generate_series(xstart // 64, xend // 64)) AS bin FROM exon), e AS (SELECT DISTINCT a.trans AS a, b.trans AS b FROM x a JOIN x b ON a.chr=b.chr AND a.strand=b.strand AND a.bin=b.bin AND a.xstart<=b.xend AND b.xstart<=a.xend AND a.trans<>b.trans),
 r AS (SELECT DISTINCT trans AS node, trans AS m FROM exon UNION SELECT e.b, r.m FROM r JOIN e ON e.a=r.node WHERE r.m < e.b)"""


@query("A21", "exon", sql=f"WITH RECURSIVE {_A21} SELECT node AS trans, 'M' || min(m) AS cluster FROM r GROUP BY 1")
def a21(v: Views) -> DataFrame:
    return ex.cluster_transcripts(v.exon)


_A26 = "s AS (SELECT name, val, row_number() OVER (PARTITION BY name ORDER BY idx) AS i, count(*) OVER (PARTITION BY name) AS n FROM signal), a AS (SELECT name, i, val FROM s), b AS (SELECT name, n + 1 - i AS i, val FROM s WHERE name < 'U5')"


@query("A26", "signal", sql=f"WITH {_A26}, j AS (SELECT a.name, a.i, CASE WHEN a.val IS NULL OR b.val IS NULL THEN coalesce(a.val, b.val) ELSE (a.val + b.val) / 2 END AS mean, CASE WHEN a.val IS NULL OR b.val IS NULL THEN coalesce(a.val, b.val) ELSE greatest(a.val, b.val) END AS top FROM a LEFT JOIN b ON b.name=a.name AND b.i=a.i) SELECT name, i AS idx, mean, top FROM j")
def a26(v: Views) -> DataFrame:
    """Signals merged with those of the other strand, which runs backwards and is absent for a part of the names."""
    a = _arrays(v)
    b = a.filter("name < 'U5'").select("name", F.reverse("vals").alias("vals"))
    mean, top = en.merge_signal(a, b), en.merge_signal(a, b, "max").select(F.col("name").alias("n"), F.col("vals").alias("tops"))
    both = mean.join(top, F.col("name") == F.col("n")).select("name", F.posexplode(F.arrays_zip("vals", "tops")).alias("i", "x"))
    return both.select("name", (F.col("i") + 1).alias("idx"), F.col("x.vals").alias("mean"), F.col("x.tops").alias("top"))


@query("A26_points", "signal", sql="WITH u AS (SELECT * FROM signal UNION ALL SELECT name, idx // 2 AS idx, val FROM signal) SELECT name, idx, avg(val) AS mean, max(val) AS top FROM u GROUP BY 1, 2")
def a26_points(v: Views) -> DataFrame:
    u = v.signal.unionByName(v.signal.select("name", F.floor(F.col("idx") / 2).alias("idx"), "val"))
    top = en.signal_points(u, "max").select(F.col("name").alias("n"), F.col("idx").alias("i"), F.col("val").alias("top"))
    return en.signal_points(u).join(top, (F.col("name") == F.col("n")) & (F.col("idx") == F.col("i"))).select("name", "idx", F.col("val").alias("mean"), "top")


def _arrays(v: Views) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("idx", "val")))
    return v.signal.groupBy("name").agg(F.transform(pairs, lambda p: p["val"]).alias("vals"))


@query("A27", "signal", sql="WITH x AS (SELECT name, val, row_number() OVER (PARTITION BY name ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY name) AS len FROM signal), y AS (SELECT name, CAST(floor(i*5.0::DOUBLE/len) AS INT)+1 AS bin, val FROM x) SELECT name, bin, coalesce(max(val) FILTER (val<>0), 0.0) AS v FROM y GROUP BY 1, 2")
def a27(v: Views) -> DataFrame:
    return en.bin_signal(_arrays(v), 5, "max")


@query("A9", "meth", sql="WITH b AS (SELECT *, (position-1)//500 AS bin FROM meth), p AS (SELECT lib_id, chr_id, bin, sum(cmethylated)*100.0::DOUBLE/sum(totalc) AS a, sum(cmethylated) FILTER (type='CG')*100.0::DOUBLE/sum(totalc) FILTER (type='CG') AS cg, sum(cmethylated) FILTER (type='CHG')*100.0::DOUBLE/sum(totalc) FILTER (type='CHG') AS chg, sum(cmethylated) FILTER (type='CHH')*100.0::DOUBLE/sum(totalc) FILTER (type='CHH') AS chh FROM b GROUP BY 1, 2, 3), d AS (SELECT lib_id, chr_id, unnest(generate_series(0, max(bin))) AS bin FROM b GROUP BY 1, 2) SELECT d.*, coalesce(a,0) AS \"all\", coalesce(cg,0) AS cg, coalesce(chg,0) AS chg, coalesce(chh,0) AS chh FROM d LEFT JOIN p USING (lib_id, chr_id, bin)")
def a9(v: Views) -> DataFrame:
    return en.methylation_bins(v.meth, 500)


@query("J32", "probe", sql="WITH a AS (SELECT probe AS ap, CASE chr WHEN 5 THEN 'X' WHEN 4 THEN 'Y' ELSE CAST(chr AS STRING) END AS chrom, pstart, pend FROM probe WHERE pstart % 9 <> 0), l AS (SELECT max(TRY_CAST(chrom AS INT)) AS last FROM a) SELECT p.probe, p.fc, a.pstart, a.pend, coalesce(CASE WHEN chrom='X' THEN 0 WHEN chrom='Y' THEN last+1 ELSE TRY_CAST(chrom AS INT) END, 99) AS chr FROM probe p LEFT JOIN a ON a.ap=p.probe CROSS JOIN l")
def j32(v: Views) -> DataFrame:
    anno = v.probe.filter("pstart % 9 <> 0").select("probe", F.when(F.col("chr") == 5, "X").when(F.col("chr") == 4, "Y").otherwise(F.col("chr").cast("string")).alias("chrom"), "pstart", "pend")
    return en.probe_coords(v.probe.select("probe", "fc"), anno)


@query("W3", "probe", sql="SELECT probe, track, fc, rank, min(rank) OVER (PARTITION BY probe) AS best FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY fc DESC, probe) AS rank FROM probe)")
def w3(v: Views) -> DataFrame:
    return ex.rank_tracks(v.probe)


@query("W3_fc", "probe", sql="WITH x AS (SELECT *, (pstart % 23) / 23.0::DOUBLE AS p FROM probe) SELECT probe, track, p, fc, rank, min(rank) OVER (PARTITION BY probe) AS best FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY p, fc DESC, probe) AS rank FROM x)")
def w3_fc(v: Views) -> DataFrame:
    return ex.rank_tracks(v.probe.withColumn("p", F.col("pstart") % 23 / 23.0), [("p", "asc"), ("fc", "desc")])


@query("W4", "probe", sql="WITH e AS (SELECT chr, max(pend)+1 AS len FROM probe GROUP BY 1), o AS (SELECT chr, sum(len) OVER (ORDER BY chr)-len AS off, sum(len) OVER () AS ring FROM e), p AS (SELECT probe.*, off+pstart AS at_, ring FROM probe JOIN o USING (chr)), q AS (SELECT track, fc, at_+ring*t AS at_ FROM p, (SELECT unnest([-1,0,1]) AS t)), r AS (SELECT a.probe, a.track, count(*) FILTER (b.fc>a.fc)+1 AS rank, count(*) AS n FROM p a JOIN q b ON a.track=b.track AND b.at_ BETWEEN a.at_-200000 AND a.at_+200000 GROUP BY 1, 2) SELECT *, rank::DOUBLE/n AS rel FROM r")
def w4(v: Views) -> DataFrame:
    return en.interval_rank(v.probe, 200_000)


@query("W5", "probe", sql="WITH s AS (SELECT track, fc FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY md5('5:' || probe), probe) AS nth FROM probe) WHERE nth <= 100) SELECT p.probe, p.track, (count(*) FILTER (s.fc > p.fc) + 1)::DOUBLE / (count(*) + 1) AS rel FROM probe p JOIN s ON s.track=p.track GROUP BY p.probe, p.track, p.fc")
def w5(v: Views) -> DataFrame:
    return en.population_rank(v.probe, 100, 5)


_S4 = """q AS (SELECT 'Q' || CAST(row_number() OVER (PARTITION BY track ORDER BY pstart, probe) AS STRING) AS probe, track, chr, pstart, pend, fc FROM probe),
 e AS (SELECT chr, max(pend)+1 AS len FROM q GROUP BY 1), o AS (SELECT chr, sum(len) OVER (ORDER BY chr)-len AS off, sum(len) OVER () AS ring FROM e), p AS (SELECT q.*, off+pstart AS at_, ring FROM q JOIN o USING (chr)), t AS (SELECT track, fc, at_+ring*t AS at_ FROM p, (SELECT unnest([-1,0,1]) AS t)),
 ri AS (SELECT a.probe, a.track, (count(*) FILTER (b.fc>a.fc)+1)::DOUBLE/count(*) AS ri FROM p a JOIN t b ON a.track=b.track AND b.at_ BETWEEN a.at_-5000000 AND a.at_+5000000 GROUP BY 1, 2),
 s AS (SELECT track, fc FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY md5('3:' || probe), probe) AS nth FROM q) WHERE nth <= 100), rp AS (SELECT q.probe, q.track, (count(*) FILTER (s.fc > q.fc) + 1)::DOUBLE / (count(*) + 1) AS rp FROM q JOIN s ON s.track=q.track GROUP BY q.probe, q.track, q.fc),
 w AS (SELECT probe, track, ri * 5.0::DOUBLE / 10 + rp * 0.5::DOUBLE AS score FROM ri JOIN rp USING (probe, track)), r AS (SELECT track, score FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY md5('4:' || probe), probe) AS nth FROM w) WHERE nth <= 500),
 ep AS (SELECT w.probe, w.track, count(*) FILTER (r.score <= w.score)::DOUBLE / count(*) AS p FROM w JOIN r ON r.track=w.track GROUP BY 1, 2), x AS (SELECT probe, -sum(ln(p + 1e-15)) AS x, count(*) AS k FROM ep GROUP BY 1),
 c AS (SELECT probe, k, exp(-x) * (1 + coalesce((SELECT sum(exp(i * ln(greatest(x, 1e-300)) - lgamma(i + 1))) FROM (SELECT unnest(generate_series(1, k - 1)) AS i)), 0)) AS f FROM x)"""


@query("S4", "probe", sql=f"WITH {_S4} SELECT probe, round(greatest(least(f, 1 - 1e-15), 1e-15), 7) AS p, k AS n_tracks FROM c")
def s4(v: Views) -> DataFrame:
    """The k-th probe of each track, by place, is the shared probe Qk: every row is kept, once in its track."""
    shared = number_rows(v.probe, ["track"], "pstart", ["probe"], "nth").withColumn("probe", F.concat(F.lit("Q"), F.col("nth").cast("string"))).drop("nth")
    return en.enrichment(shared, 5_000_000, 5.0, 500, 3).withColumn("p", F.round("p", 7))


def _chroms(v: Views) -> DataFrame:
    return v.transcript.groupBy("chr").agg(F.max("tend").alias("clen"))


def _features(v: Views) -> DataFrame:
    return v.locus.select("name", (F.col("lend") - F.col("lstart") + 1).alias("flen"))


def _u(seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || name || ':' || CAST(it AS STRING)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_S5 = f"""cs AS (SELECT list({{'chr': chr, 'clen': clen}} ORDER BY chr, clen) AS cs FROM (SELECT chr, max(tend) AS clen FROM transcript GROUP BY 1)), f AS (SELECT name, lend - lstart + 1 AS flen, unnest(generate_series(1, 5)) AS it FROM locus),
 g AS (SELECT f.*, list_filter(cs, lambda c: c.clen >= flen) AS fit FROM f, cs), h AS (SELECT *, fit[CAST(floor({_u(17)} * len(fit)) AS BIGINT) + 1] AS c FROM g WHERE len(fit) > 0), i AS (SELECT *, CAST(floor({_u(18)} * (c.clen - flen + 1)) AS BIGINT) + 1 AS rstart FROM h)"""


@query("S5", "locus", "transcript", sql=f"WITH {_S5} SELECT name, it, c.chr AS chr, rstart, rstart + flen - 1 AS rend, CASE WHEN {_u(19)} < 0.5 THEN 'w' ELSE 'c' END AS strand FROM i")
def s5(v: Views) -> DataFrame:
    return en.random_regions(_chroms(v), _features(v), 5, 17)


@query("S6", "locus", "tag_position", sql="WITH r AS (SELECT name, neglog_p AS it, chr, lstart AS rstart, lend AS rend FROM locus), k AS (SELECT r.name, r.it, count(t.pos) AS k FROM r LEFT JOIN tag_position t ON t.chr=r.chr AND t.pos BETWEEN rstart AND rend GROUP BY 1, 2), q AS (SELECT it, quantile_cont(k, 0.95) AS a, quantile_cont(k, 0.05) AS b FROM k GROUP BY 1) SELECT round(avg(a), 6) AS mean95, round(avg(b), 6) AS mean5, round(quantile_cont(a, 0.5), 6) AS med95, round(quantile_cont(b, 0.5), 6) AS med5 FROM q")
def s6(v: Views) -> DataFrame:
    r = v.locus.select("name", F.col("neglog_p").alias("it"), "chr", F.col("lstart").alias("rstart"), F.col("lend").alias("rend"))
    t = en.coverage_thresholds(r, v.tag_position.select("chr", "pos"))
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


@query("S7", "locus", "signal", sql="WITH o AS (SELECT 'U' || substr(name, 3) AS name, neglog_p * 10.0::DOUBLE AS ident FROM locus), r AS (SELECT name, val FROM signal WHERE val IS NOT NULL) SELECT o.name, avg(CASE WHEN r.val > o.ident THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM o JOIN r ON r.name=o.name GROUP BY 1")
def s7(v: Views) -> DataFrame:
    o = v.locus.select(F.concat(F.lit("U"), F.substr("name", F.lit(3))).alias("name"), (F.col("neglog_p") * 10.0).alias("ident"))
    return en.conservation_p(o, v.signal.filter("val IS NOT NULL").select("name", F.col("val").alias("ident")))


@query("S8", "locus", sql="WITH b AS (SELECT name, CASE WHEN neglog_p > 4 THEN 'pos' ELSE 'neg' END AS kind, unnest(generate_series(1, 4)) AS sample FROM locus) SELECT sample, kind, name FROM (SELECT *, row_number() OVER (PARTITION BY sample, kind ORDER BY md5('23:' || name || ':' || CAST(sample AS STRING)), name) AS nth FROM b) WHERE nth <= 50")
def s8(v: Views) -> DataFrame:
    return en.balanced_samples(v.locus.filter("neglog_p > 4"), v.locus.filter("neglog_p <= 4"), 100, 4, 23)


@query("S9", "expr", sql="WITH c AS (SELECT *, cnt*1e6::DOUBLE/sum(cnt) OVER (PARTITION BY sample) AS cpm FROM expr), g AS (SELECT gene FROM c WHERE cpm > 100 GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT * FROM expr WHERE gene IN (SELECT gene FROM g)) SELECT *, cnt*1e6::DOUBLE/sum(cnt) OVER (PARTITION BY sample) AS cpm FROM k")
def s9(v: Views) -> DataFrame:
    return ex.filter_expressed(v.expr, 100.0, 3)


@query("S10", "expr", sql="WITH n AS (SELECT sample, sum(cnt)::DOUBLE AS n FROM expr GROUP BY 1), b AS (SELECT c.sample, c.cnt::DOUBLE AS c, n.n, r.cnt::DOUBLE AS rc, rn.n AS rn FROM expr c JOIN n USING (sample) JOIN expr r ON r.gene=c.gene AND r.sample='S0' AND r.cnt>0 JOIN n rn ON rn.sample='S0' WHERE c.cnt>0), m AS (SELECT *, log2((c/n)/(rc/rn)) AS m, (log2(c/n)+log2(rc/rn))/2 AS a, (n-c)/n/c+(rn-rc)/rn/rc AS v FROM b), q AS (SELECT sample, quantile_cont(m, [0.3,0.7]) AS qm, quantile_cont(a, [0.05,0.95]) AS qa FROM m GROUP BY 1), k AS (SELECT m.* FROM m JOIN q USING (sample) WHERE m BETWEEN qm[1] AND qm[2] AND a BETWEEN qa[1] AND qa[2]), f AS (SELECT sample, sum(m/v)/sum(1/v) AS lf FROM k GROUP BY 1) SELECT sample, round(pow(2.0, lf - avg(lf) OVER ()), 6) AS factor FROM f")
def s10(v: Views) -> DataFrame:
    return ex.tmm_factors(v.expr, "S0").withColumn("factor", F.round("factor", 6))


def _tail(z: str) -> str:
    """The operator's approximation of the two-sided normal tail."""
    x = f"(greatest({z}, 0) / sqrt(2.0::DOUBLE))"
    t, poly = f"(1 / (1 + 0.5::DOUBLE * {x}))", f"{ex.ERFC[-1]}::DOUBLE"
    for c in ex.ERFC[-2::-1]:
        poly = f"({poly} * {t} + ({c}::DOUBLE))"
    return f"least({t} * exp({poly} - {x} * {x}), 1.0::DOUBLE)"


_LIK = "sum(cnt * ln(greatest({r}*n, 1e-12)/(greatest({r}*n, 1e-12)+10)) + 10 * ln(10/(greatest({r}*n, 1e-12)+10)))"


def _s11() -> str:
    own = "(CASE WHEN b THEN rb ELSE ra END)"
    return f"""n AS (SELECT sample, sum(cnt)::DOUBLE AS n FROM expr GROUP BY 1), c AS (SELECT gene, expr.sample, cnt::DOUBLE AS cnt, n, expr.sample IN ('S3','S4','S5') AS b FROM expr JOIN n ON n.sample=expr.sample),
 p AS (SELECT gene, sum(cnt) FILTER (NOT b)/sum(n) FILTER (NOT b) AS ra, sum(cnt) FILTER (b)/sum(n) FILTER (b) AS rb, sum(cnt)/sum(n) AS r0, coalesce(sum(cnt*1e6/n) FILTER (NOT b), 0)/3 AS ma, coalesce(sum(cnt*1e6/n) FILTER (b), 0)/3 AS mb FROM c GROUP BY 1),
 f AS (SELECT c.gene, 2*({_LIK.format(r=own)} - {_LIK.format(r="r0")}) AS lr FROM c JOIN p ON p.gene=c.gene GROUP BY 1),
 g AS (SELECT p.gene, log2((mb+0.5)/(ma+0.5)) AS logfc, sqrt(CASE WHEN ra IS NULL OR rb IS NULL THEN 0 ELSE greatest(lr, 0) END) AS z FROM p JOIN f ON f.gene=p.gene),
 h AS (SELECT gene, logfc, {_tail("z")} AS p FROM g), k AS (SELECT p, count(*) AS k FROM h GROUP BY 1), w AS (SELECT p, p * sum(k) OVER () / sum(k) OVER (ORDER BY p) AS raw FROM k), q AS (SELECT p, least(min(raw) OVER (ORDER BY p DESC), 1.0) AS fdr FROM w)"""


@query("S11", "expr", sql=f"WITH {_s11()} SELECT gene, round(logfc, 6) AS logfc, round(h.p, 5) AS p, round(fdr, 5) AS fdr, CASE WHEN round(logfc, 6) >= 1 THEN 'up' WHEN round(logfc, 6) <= -1 THEN 'down' ELSE 'unchanged' END AS change FROM h JOIN q ON q.p=h.p")
def s11(v: Views) -> DataFrame:
    t = checkpoint(ex.diff_test(v.expr, SAMPLES[:3], SAMPLES[3:]).withColumn("logfc", F.round("logfc", 6)))  # joined by p: computed once
    return ex.bh_adjust(t).withColumns({"p": F.round("p", 5), "fdr": F.round("fdr", 5)}).withColumn("change", ex.classify_fc("logfc"))


_DISP = """n AS (SELECT sample, sum(cnt)::DOUBLE AS n FROM expr GROUP BY 1), e AS (SELECT sample, exp(avg(ln(n)) OVER ())/n AS even FROM n), y AS (SELECT gene, expr.sample IN ('S3','S4','S5') AS b, cnt*even AS y FROM expr JOIN e ON e.sample=expr.sample WHERE cnt > 0),
 gr AS (SELECT k, exp(-(ln(0.0001::DOUBLE) + k*(ln(10.0::DOUBLE)-ln(0.0001::DOUBLE))/40)) AS r FROM (SELECT unnest(generate_series(0,40)) AS k)), o AS (SELECT gene, b, k, r, sum(lgamma(y+r)-lgamma(r)) AS own, sum(y) AS z FROM y, gr GROUP BY 1, 2, 3, 4),
 l AS (SELECT gene, k, sum(own + lgamma(3*r) - lgamma(z+3*r)) AS l FROM o GROUP BY 1, 2), m AS (SELECT k, avg(l) AS mean FROM l GROUP BY 1), w AS (SELECT gene, list(l + 2.5::DOUBLE*mean ORDER BY k) AS ls FROM l JOIN m USING (k) GROUP BY 1),
 a AS (SELECT gene, ls, list_position(ls, list_max(ls)) AS i FROM w), c AS (SELECT ls, list_position(ls, list_max(ls)) AS i FROM (SELECT list(mean ORDER BY k) AS ls FROM m))"""
_PEAK = "exp(ln(0.0001::DOUBLE) + (i - 1 + CASE WHEN i BETWEEN 2 AND 40 THEN coalesce((ls[i-1]-ls[i+1])/nullif(2*(ls[i-1]-2*ls[i]+ls[i+1]), 0), 0) ELSE 0 END)*(ln(10.0::DOUBLE)-ln(0.0001::DOUBLE))/40)"


@query("S11_dispersions", "expr", sql=f"WITH {_DISP}, k AS (SELECT {_PEAK} AS common FROM c) SELECT gene, round(common, 4) AS common, round({_PEAK}, 4) AS dispersion FROM a, k")
def s11_dispersions(v: Views) -> DataFrame:
    return ex.estimate_dispersions(v.expr, SAMPLES[:3], SAMPLES[3:]).withColumns({c: F.round(c, 4) for c in ("common", "dispersion")})


@query("S9_by_expr", "expr", sql="WITH t AS (SELECT sample, sum(cnt)::DOUBLE AS n FROM expr GROUP BY 1), m AS (SELECT median(n) AS mid FROM t), c AS (SELECT e.*, cnt*1e6::DOUBLE/n AS cpm FROM expr e JOIN t ON t.sample=e.sample), g AS (SELECT gene FROM c, m GROUP BY 1 HAVING count(*) FILTER (cpm >= 10*1e6/mid) >= 3 AND sum(cnt) >= 15), k AS (SELECT * FROM expr WHERE gene IN (SELECT gene FROM g)) SELECT *, cnt*1e6::DOUBLE/sum(cnt) OVER (PARTITION BY sample) AS cpm FROM k")
def s9_by_expr(v: Views) -> DataFrame:
    return ex.filter_by_expr(v.expr, {s: "a" if k < 3 else "b" for k, s in enumerate(SAMPLES)})


_V = "l AS (SELECT gene, sample, log2(cnt+1.0::DOUBLE) AS v FROM expr), z AS (SELECT gene FROM l GROUP BY 1 HAVING min(v) < max(v)), v AS (SELECT * FROM l WHERE gene IN (SELECT gene FROM z))"


def _t_tail(r: str, n: str) -> str:
    """The finite sum for Student's tail: its terms are products of ratios, as sums of logarithms."""
    term = "exp(k * ln(greatest(1-{r}*{r}, 1e-300)) + CASE WHEN ({n}-2)%2=1 THEN (lgamma(k+1)-lgamma(k+1.5)+lgamma(1.5)) ELSE (lgamma(k+0.5)-lgamma(0.5)-lgamma(k+1)) END)".format(r=r, n=n)
    total = f"(SELECT sum({term}) FROM (SELECT unnest(generate_series(0, greatest(0, CAST(floor(({n}-2-CASE WHEN ({n}-2)%2=1 THEN 3 ELSE 2 END)/2.0) AS BIGINT)))) AS k))"
    return f"CASE WHEN {n}<3 THEN NULL WHEN {n}=3 THEN greatest(1-2/pi()*asin(abs({r})), 0) WHEN ({n}-2)%2=1 THEN greatest(1-2/pi()*(asin(abs({r}))+abs({r})*sqrt(1-{r}*{r})*{total}), 0) ELSE greatest(1-abs({r})*{total}, 0) END"


@query("S12", "expr", sql=f"WITH {_V}, s AS (SELECT *, (rank() OVER (PARTITION BY sample ORDER BY v) + (count(*) OVER (PARTITION BY sample, v) - 1) / 2.0)::DOUBLE AS rk FROM v), c AS (SELECT a.sample AS sa, b.sample AS sb, round(corr(a.v, b.v), 6) AS r, count(*) AS n, round(corr(a.rk, b.rk), 6) AS rho FROM s a JOIN s b ON a.gene=b.gene AND a.sample<b.sample GROUP BY 1, 2) SELECT *, round({_t_tail('r', 'n')}, 7) AS p, round({_t_tail('rho', 'n')}, 7) AS p_rho FROM c")
def s12(v: Views) -> DataFrame:
    x = ex.log_counts(v.expr)
    rho = ex.spearman(x).select(F.col("sa").alias("a"), F.col("sb").alias("b"), F.round("r", 6).alias("rho"))
    both = ex.pearson(x).join(rho, (F.col("sa") == F.col("a")) & (F.col("sb") == F.col("b"))).select("sa", "sb", F.round("r", 6).alias("r"), "n", "rho")
    return both.withColumn("p", F.round(ex.correlation_p(F.col("r"), F.col("n")), 7)).withColumn("p_rho", F.round(ex.correlation_p(F.col("rho"), F.col("n")), 7))


def _wide(v: Views) -> DataFrame:
    return v.expr.groupBy("gene").agg(*[F.coalesce(F.sum(F.when(F.col("sample") == s, F.col("cnt"))), F.lit(0)).cast("double").alias(s) for s in SAMPLES])


@query("S13", "expr")
def s13(v: Views) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scores, _, _ = ex.pca(_wide(v), SAMPLES, 2)
    return scores.select("gene", *[F.round(F.abs(vector_to_array("pcs")[k]), 6).alias(f"pc{k + 1}") for k in range(2)])


@query("S13_loadings", "expr")
def s13_loadings(v: Views) -> DataFrame:
    _, variance, pc = ex.pca(_wide(v), SAMPLES, 2)
    return ex.loadings(pc, variance, SAMPLES, v.spark).withColumn("loading", F.round(F.abs("loading"), 6)).withColumn("explained", F.round("explained", 6))


@query("S14", "cell", sql="WITH g AS (SELECT gene FROM cell GROUP BY 1 HAVING count(*) >= 3), a AS (SELECT cell, count(*) AS n_genes, sum(cnt)::BIGINT AS total, 100.0::DOUBLE*sum(CASE WHEN gene LIKE 'g1%' THEN cnt ELSE 0 END)/sum(cnt) AS percent_mt FROM cell WHERE gene IN (SELECT gene FROM g) GROUP BY 1) SELECT * FROM a WHERE n_genes >= 5 AND n_genes < 2500 AND percent_mt < 50")
def s14(v: Views) -> DataFrame:
    return ex.sc_qc(v.cell)


@query("S15", "cell", sql="SELECT cell, gene, cnt, round(ln(1 + 10000.0::DOUBLE*cnt/sum(cnt) OVER (PARTITION BY cell)), 9) AS v FROM cell")
def s15(v: Views) -> DataFrame:
    return ex.sc_lognorm(v.cell).withColumn("v", F.round("v", 9))


@query("S16", "cell", sql="WITH x AS (SELECT *, ln(1 + 10000.0::DOUBLE*cnt/sum(cnt) OVER (PARTITION BY cell)) AS v FROM cell), c AS (SELECT count(DISTINCT cell)::DOUBLE AS nc FROM cell), m AS (SELECT gene, sum(v)/nc AS mean, sqrt((sum(v*v)-sum(v)*sum(v)/nc)/(nc-1)) AS sd FROM x, c GROUP BY gene, nc) SELECT cell, x.gene, round((v-mean)/nullif(sd,0), 6) AS z FROM x JOIN m ON m.gene=x.gene")
def s16(v: Views) -> DataFrame:
    return ex.sc_scale(ex.sc_lognorm(v.cell)).withColumn("z", F.round("z", 6))


@query("S16_hvg", "cell")
def s16h(v: Views) -> DataFrame:
    return ex.sc_hvg(v.cell, 20).select("gene", F.round("std_var", 6).alias("std_var"))


def _clusters(v: Views) -> DataFrame:
    return v.cell.select("cell", (F.col("cell") % 3).alias("cluster")).distinct()


def _components(v: Views) -> DataFrame:
    """Cells with the first ten principal components of their variable genes."""
    cells = store(v.cell)
    genes = tuple(r["gene"] for r in ex.sc_hvg(cells, 2000).select("gene").orderBy("gene").collect())  # a bounded list: the columns of the matrix
    wide = ex.sc_lognorm(cells).groupBy("cell").agg(*[F.coalesce(F.sum(F.when(F.col("gene") == g, F.col("v"))), F.lit(0.0)).alias(g) for g in genes])
    return ex.pca(store(wide), genes, 10, scale=False)[0]


@query("S17", "cell")
def s17(v: Views) -> DataFrame:
    """Cells clustered on principal components by k-means."""
    return ex.sc_cluster(store(_components(v).select("cell", "pcs")), "pcs", 4).select("cell", "cluster")


def _s18(pairs: bool) -> str:
    scope = "cl AS (SELECT cell, cluster, least(cluster, other) || '|' || greatest(cluster, other) AS scope FROM c0 JOIN (SELECT unnest([0,1,2]) AS other) ON other<>cluster)" if pairs else "cl AS (SELECT *, '' AS scope FROM c0)"
    return f"""x AS (SELECT *, ln(1 + 10000.0::DOUBLE*cnt/sum(cnt) OVER (PARTITION BY cell)) AS v FROM cell), c0 AS (SELECT DISTINCT cell, cell % 3 AS cluster FROM cell), {scope}, ge AS (SELECT DISTINCT gene FROM x),
 f AS (SELECT cl.scope, ge.gene, cl.cell, cl.cluster, coalesce(x.v, 0) AS v FROM ge CROSS JOIN cl LEFT JOIN x ON x.gene=ge.gene AND x.cell=cl.cell),
 r AS (SELECT *, (rank() OVER (PARTITION BY scope, gene ORDER BY v) + (count(*) OVER (PARTITION BY scope, gene, v) - 1)/2.0)::DOUBLE AS rk, count(*) OVER (PARTITION BY scope, gene) AS n FROM f),
 t AS (SELECT scope, gene, sum(exp(v)-1) AS s, count(*) FILTER (v>0) AS nz FROM f GROUP BY 1, 2), ti AS (SELECT scope, gene, sum(k*k*k-k)::DOUBLE AS ties FROM (SELECT scope, gene, count(*)::DOUBLE AS k FROM f GROUP BY scope, gene, v) GROUP BY 1, 2),
 g AS (SELECT scope, cluster, gene, count(*) AS n1, max(n) AS n, sum(rk) AS rs, count(*) FILTER (v>0) AS k1, sum(exp(v)-1) AS s1 FROM r GROUP BY 1, 2, 3)
 SELECT cluster, {"CASE WHEN CAST(cluster AS STRING)=split_part(scope, '|', 1) THEN split_part(scope, '|', 2) ELSE split_part(scope, '|', 1) END::BIGINT AS other, " if pairs else ""}gene, k1::DOUBLE/n1 AS pct1, (nz-k1)::DOUBLE/(n-n1) AS pct2, round(log2(s1/n1+1)-log2((s-s1)/(n-n1)+1), 6) AS logfc, round((rs-n1*(n1+1)/2.0)/(n1*(n-n1)), 6) AS auc,
 round((abs(rs-n1*(n1+1)/2.0-n1*(n-n1)/2.0)-0.5)/sqrt(n1*(n-n1)/12.0::DOUBLE*((n+1)-ties/(n*(n-1)::DOUBLE))), 5) AS z FROM g JOIN t USING (scope, gene) JOIN ti USING (scope, gene)
 WHERE k1 > 0 AND greatest(k1::DOUBLE/n1, (nz-k1)::DOUBLE/(n-n1)) >= 0.1 AND log2(s1/n1+1)-log2((s-s1)/(n-n1)+1) >= 0.1"""


def _rounded(markers: DataFrame) -> DataFrame:
    return markers.withColumns({"logfc": F.round("logfc", 6), "auc": F.round("auc", 6), "z": F.round("z", 5)}).withColumn("p", F.round(ex.normal_tail(F.col("z")), 5))


@query("S18", "cell", sql=f"SELECT *, round({_tail('z')}, 5) AS p FROM (WITH {_s18(False)})")
def s18(v: Views) -> DataFrame:
    return _rounded(ex.sc_markers(ex.sc_lognorm(v.cell), _clusters(v)))


@query("S18_pairs", "cell", sql=f"SELECT *, round({_tail('z')}, 5) AS p FROM (WITH {_s18(True)})")
def s18_pairs(v: Views) -> DataFrame:
    return _rounded(ex.sc_markers_pairwise(ex.sc_lognorm(v.cell), _clusters(v)))


@query("S19", "expr", sql="WITH q AS (SELECT sample, quantile_cont(cnt, 0.25) AS q1, quantile_cont(cnt, 0.5) AS med, quantile_cont(cnt, 0.75) AS q3, count(*) AS n FROM expr GROUP BY 1) SELECT e.sample, n, q1, med, q3, min(cnt) AS low, max(cnt) AS high FROM expr e JOIN q USING (sample) WHERE cnt BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) GROUP BY 1, 2, 3, 4, 5")
def s19(v: Views) -> DataFrame:
    return ex.box_stats(v.expr, "sample", "cnt")


@query("S20", "expr", sql="SELECT a.sample AS sa, b.sample AS sb, sum(abs(a.cnt-b.cnt))::BIGINT AS dist FROM expr a JOIN expr b ON a.gene=b.gene AND a.sample<b.sample GROUP BY 1, 2")
def s20(v: Views) -> DataFrame:
    return ex.pairwise_dist(v.expr)


_D13 = "substr(translate(md5('29:' || trans || ':{t}:0'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 21)"


@query("P13", "transcript", sql=f"WITH f AS (SELECT trans, {_D13.format(t=0)} AS seq FROM (SELECT DISTINCT trans FROM transcript)), k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY trans) AS nth FROM f), g AS (SELECT min(trans) AS trans, seq FROM (SELECT trans, {_D13.format(t=1)} AS seq FROM k WHERE nth > 1) GROUP BY seq) SELECT trans AS name, seq FROM k WHERE nth = 1 UNION ALL SELECT trans, seq FROM g WHERE seq NOT IN (SELECT seq FROM k WHERE nth = 1)")
def p13(v: Views) -> DataFrame:
    """A random background sequence for each transcript."""
    return en.random_seqs(v.transcript.select(F.col("trans").alias("name")), 21, 29)
