"""Operators on small literal tables, and against plain loops."""

import itertools
import math
import os
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom import runtime
from tagloom.functions import seq
from tagloom.operators import annotation, dominance, enrichment, expression, intervals, islands, loci, phasing, seeds, tags, targets
from tagloom.plans import registry, target_queries
from tagloom.plans.components import connected_components
from tagloom.sources import formats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def most_rows(df):
    """The most rows that a step of the plan gave out, after running it."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        m = node.metrics().get("numOutputRows")
        return max([m.get().value() if m.isDefined() else 0, *[walk(node.children().apply(i)) for i in range(node.children().size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in parent}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bin_join_against_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: [(i, rng.randrange(2), s := rng.randrange(3000), s + rng.randrange(1200)) for i in range(n)]
    a, b = make(60), make(70)
    left, right = spark.createDataFrame(a, "ia long, ca long, sa long, ea long"), spark.createDataFrame(b, "ib long, cb long, sb long, eb long")
    got = rows(intervals.bin_join(left, right, [("ca", "cb")], ("sa", "ea"), ("sb", "eb")).select("ia", "ib"))
    assert got == sorted((x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])


def test_dice_is_the_set_formula(spark):
    for (s1, e1), (s2, e2) in [((0, 10), (5, 15)), ((0, 10), (10, 20)), ((3, 9), (3, 9)), ((0, 100), (40, 45))]:
        df = spark.createDataFrame([(s1, e1, s2, e2)], "a long, b long, c long, d long")
        got = df.select(intervals.dice(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("r")).first()["r"]
        x, y = set(range(s1, e1)), set(range(s2, e2))
        assert got == pytest.approx(2 * len(x & y) / (len(x) + len(y)))


def test_intergenic_and_genes_cover_the_chromosome(spark):
    genes = spark.createDataFrame([("1", "w", 100, 200), ("1", "w", 150, 400), ("1", "c", 1000, 1100)], "chr string, strand string, tstart long, tend long")
    genes = genes.withColumn("name", F.concat(F.lit("g"), F.col("tstart").cast("string")))
    more = spark.createDataFrame([("1",), ("2",)], "chr string")
    got = rows(intervals.intergenic(genes, 0, more).fillna(-1))
    assert got == [("1", "c", "g1000_down", 1, 999), ("1", "c", "g1000_up", 1101, -1), ("1", "w", "g100_up", 1, 99), ("1", "w", "g150_down", 401, -1), ("2", "c", "2", 1, -1), ("2", "w", "2", 1, -1)]


def test_reverse_complement_is_its_own_inverse(spark):
    df = spark.createDataFrame([("ACGTTGCA",), ("GGGCAT",)], "s string")
    assert df.filter(seq.seq_transform(seq.seq_transform("s", "reverse_complement"), "reverse_complement") != F.col("s")).count() == 0


def test_phasing_p_sums_to_one(spark):
    t = phasing.phasing_table(spark, 21)
    assert t.filter("k = 0 AND abs(p - 1) > 1e-9").count() == 0
    m, n, k = 22 * 21, 40, 9
    want = sum(math.comb(22, i) * math.comb(m - 22, n - i) / math.comb(m, n) for i in range(k, 23))
    assert t.filter(f"n = {n} AND k = {k}").first()["p"] == pytest.approx(want, rel=1e-9)


def test_perfect_register(spark):
    rl, at = 21, 5000
    pos = [(1, "w", at + i * rl) for i in range(11)] + [(1, "c", at + i * rl - 3) for i in range(1, 12)]
    df = spark.createDataFrame([("t", 21, c, s, p, "L0", 5) for c, s, p in pos], "tag string, len int, chr int, strand string, pos long, lib string, abun long")
    best = phasing.register_counts(phasing.occupied(phasing.presplit(df)), rl).filter(f"strand = 'w' AND pos = {at}").first()
    assert (best["n"], best["k"]) == (22, 22)


def register_loop(occupied, rl):
    """n, k and the best anchor of each position by going through the places of its cycles."""
    here = {(c, st, p) for c, st, p in occupied}
    scored, out = {}, {}
    for c, st, p in occupied:
        if st == "w":
            n = sum((c, "w", i) in here for i in range(p, p + 11 * rl)) + sum((c, "c", i) in here for i in range(p - 2, p + 11 * rl - 2))
            k = sum((c, "w", p + j * rl) in here for j in range(11)) + sum((c, "c", p - 3 + j * rl) in here for j in range(1, 12))
            members = [(c, "w", p + j * rl) for j in range(11)] + [(c, "c", p - 3 + j * rl) for j in range(1, 12)]
        else:
            first = max(1, p - 11 * rl + 1)  # no cycle begins before the chromosome
            n = sum((c, "w", i) in here for i in range(first, p + 1)) + sum((c, "c", i) in here for i in range(first + 2, p + 3))
            k = sum((c, "c", p - j * rl) in here for j in range(11)) + sum((c, "w", p + 3 - j * rl) in here for j in range(1, 12))
            members = [(c, "c", p - j * rl) for j in range(11)] + [(c, "w", p + 3 - j * rl) for j in range(1, 12)]
        scored[c, st, p] = (n, k)
        for m in members:
            if m in here:
                out.setdefault(m, []).append(((n * 7 + k * 3) % 11 / 10, p, st, n, k))
    return scored, {m: min(v) for m, v in out.items()}


@pytest.mark.parametrize("rl", [21, 24])
def test_registers_against_loops_in_dense_clusters(spark, rl):
    rng = random.Random(rl)
    sites = {(c, rng.choice("wc"), rng.randrange(1, 300)) for c in (1, 2) for _ in range(120)} | {(1, s, 9000 + rl * rng.randrange(400) + rng.choice((0, 0, 0, -3, 5))) for s in "wc" for _ in range(300)}
    sites = sorted(sites | {(2, "c", 1), (2, "c", 2), (2, "c", 3), (2, "w", 1)})
    df = spark.createDataFrame([("t", rl, c, s, p, "L0", 5) for c, s, p in sites], "tag string, len int, chr int, strand string, pos long, lib string, abun long")
    occ = phasing.occupied(phasing.presplit(df))
    counts, best = register_loop([(r["chr"], r["strand"], r["pos"]) for r in occ.collect()], rl)
    for width in (1200, 1 << 16):  # clusters that are longer than a block, and shorter
        got = phasing.register_counts(occ, rl, width)
        assert {(r["chr"], r["strand"], r["pos"]): (r["n"], r["k"]) for r in got.collect()} == counts
        scored = got.withColumn("p", F.pmod(F.col("n") * 7 + F.col("k") * 3, F.lit(11)) / 10)
        mine = {(r["chr"], r["strand"], r["pos"]): (r["best_p"], r["best_pos"], r["best_strand"], r["n"], r["k"]) for r in phasing.assign_best_p(scored, rl, width).collect()}
        assert mine == best
    assert "cluster" not in str(phasing.register_counts(occ, rl)._jdf.queryExecution().analyzed()).split("Window [")[1].split("]")[1]


def test_first_places_of_a_chromosome(spark):
    rl = 21
    occ = spark.createDataFrame([(1, 1, "c", p, p + 3) for p in (1, 2, 3, 200, 231, 400)] + [(1, 1, "w", p, p) for p in (1, 2)], "chr int, cluster int, strand string, pos long, reg long")
    n = {(r["strand"], r["pos"]): r["n"] for r in phasing.register_counts(occ, rl).collect()}
    # from 200 and 231 the cycles would begin before the chromosome or at its first place, so that c places 1 and 2 lie before them
    assert n["c", 200] == 4 and n["c", 231] == 5 and n["c", 3] == 3 and n["c", 1] == 2 and n["w", 1] == 6


def test_counts_of_keys_that_span_blocks(spark):
    df = spark.createDataFrame([(None if k % 3 else "x", k * 50) for k in range(100)], "key string, pos long")
    assert {(r["key"], r["n"]) for r in islands.count_per(df, ["key"], "pos", "n", width=256).collect()} == {(None, 66), ("x", 34)}


def test_categories(spark):
    d = spark.createDataFrame([("g", i, h) for i, h in enumerate([1, 2, 3, 4, 9])] + [("h", 0, 5), ("h", 1, 5), ("h", 2, 2)], "gene string, loc long, hits long")
    got = {(r["gene"], r["loc"]): r["category"] for r in targets.categorize_genic(d).collect()}
    assert got == {("g", 0): 4, ("g", 1): 3, ("g", 2): 3, ("g", 3): 2, ("g", 4): 0, ("h", 0): 3, ("h", 1): 3, ("h", 2): 3}
    d = spark.createDataFrame([("one", 0, 5), ("two", 0, 4), ("two", 1, 4), ("tied", 0, 2), ("tied", 1, 3), ("tied", 2, 2), ("tied", 3, 9), ("tied", 4, 9)], "gene string, loc long, hits long")
    got = {(r["gene"], r["loc"]): r["category"] for r in targets.categorize_genic(d).collect()}
    assert got == {("one", 0): 3, ("two", 0): 3, ("two", 1): 3, ("tied", 0): 3, ("tied", 1): 3, ("tied", 2): 3, ("tied", 3): 1, ("tied", 4): 1}


def test_pair_profile_gaps_and_scores(spark):
    df = spark.createDataFrame([("ok", "ACGTACGTACGTACGTACGTA", "ACGTACGTACGTACGTACGTA"), ("midgap", "ACGTACGTA-GTACGTACGTA", "ACGTACGTACGTACGTACGTA"), ("joint", "ACGTACGTAAATACGTACGTA", "ACGTACGTACCTACGTACGTA"), ("wob", "ACGGTCGTACGTACGTACGTA", "ACGAACGTACGTACGTACGTA")], "id string, mir string, tar string")
    got = {r["id"]: r for r in targets.score_pairs(targets.pair_profile(df)).collect()}
    assert got["ok"]["score"] == 0 and got["ok"]["valid"]
    assert not got["midgap"]["valid"]
    assert got["joint"]["score"] == 2.5
    assert got["wob"]["wob"] == [4] and got["wob"]["mis"] == [5] and got["wob"]["score"] == 2.5


def test_profiles_and_trims_are_computed_once(spark):
    """The optimizer copies an expression to each use; the alignment's columns and a read's cut are of one step."""
    pairs = spark.createDataFrame([("a", "ACGT", "ACGA")], "id string, mir string, tar string").withColumn("mir", F.concat("mir", F.lit("ACGT")))
    text = targets.pair_profile(pairs.withColumn("tar", F.concat("tar", F.lit("ACGA"))))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("arrays_zip") + text.count("zip_with") == 1 and text.count("concat(mir") == 1
    reads = spark.createDataFrame([("r", "ACGTTGGAATTC", "IIIIIIIIIIII", "L")], "read_id string, seq string, qual string, lib string")
    df = formats.trim_reads(reads, "TGGAATTCTCGGG", 20, 35, 2)
    assert rows(df) == [("r", "ACGT", "IIII", "L")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # the qualities, the adapter's fold


def test_pair_positions_are_the_mirnas_own(spark):
    m, gap5 = "ACGTACGTACGTACGTACGTA", "ACGTA-CGTACGTACGTACGTA"
    changed = lambda s, *at: "".join({"A": "C", "C": "A", "G": "C", "T": "G", "-": "-"}[c] if k in at else c for k, c in enumerate(s))
    pairs = [("after_gap", gap5, changed("ACGTATCGTACGTACGTACGTA", 11)), ("seeded", m, changed(m, 9, 10)), ("target8", m, m[:7] + "-" + m[8:]), ("target11", m, m[:10] + "-" + m[11:]), ("end", m, changed(m, 0, 13)), ("gaps", m[:4] + "-" + m[4:], m[:4] + "A" + m[4:])]
    prof = targets.pair_profile(spark.createDataFrame(pairs, "id string, mir string, tar string"))
    got = {r["id"]: r for r in prof.collect()}
    assert got["after_gap"]["mis"] == [11] and got["after_gap"]["mgap"] == [6]
    assert not got["target8"]["valid"] and got["target11"]["valid"] and got["target11"]["tgap"] == [11]
    seeded = {r["id"]: r["score"] for r in targets.score_pairs(prof, seeded=True).collect()}
    assert (seeded["seeded"], seeded["end"], seeded["gaps"]) == (4.0, 2.0, 2.0)


def test_coding_status_by_table(spark):
    rows_ = [("a", None, -1.0, 500, 0.9, "nc"), ("b", None, 1.0, 100, 0.1, "co"), ("c", None, 1.5, 10, 0.5, "co"), ("d", None, 1.0, 10, 0.1, "up"), ("e", None, 0.0, 10, 0.1, "nc"), ("f", None, 0.0, 10, 0.5, "co"), ("g", None, 0.5, 10, 0.1, "up")]
    rows_ += [("h", 3, 1.0, 10, 0.1, "co"), ("i", 3, -1.0, 500, 0.9, "nc"), ("j", 4, 0.0, 500, 0.9, "up"), ("k", 4, 0.0, 10, 0.1, "up"), ("l", 3, -0.5, 10, 0.1, "nc"), ("m", 3, 0.5, 10, 0.9, "co")]
    rows_ += [("n", 2, 1.0, 10, 0.1, "up"), ("o", 0, 0.0, 10, 0.9, "up"), ("p", 1, 0.0, 10, 0.1, "nc"), ("q", 2, 0.5, 10, 0.9, "co"), ("r", 0, -2.0, 900, 0.9, "nc"), ("s", 3, 0.5, 10, 0.38, "up")]
    df = spark.createDataFrame([r[:5] for r in rows_], "trans string, match_score int, cpc double, orf int, cpat double")
    assert {r["trans"]: r["status"] for r in annotation.classify_coding(df).collect()} == {r[0]: r[5] for r in rows_}


def test_islands_over_block_borders(spark):
    rng = random.Random(8)
    pts = [(rng.choice("ab"), a := rng.randrange(3000), a + rng.choice((0, 5, 40, 700))) for _ in range(120)]
    df = spark.createDataFrame(pts, "chr string, s long, e long")
    for gap in (-1, 0, 30):
        want = set()
        for c in "ab":
            top, n = None, 0
            for s, e in sorted(p[1:] for p in pts if p[0] == c):
                n += top is None or s > top + gap
                top = e if top is None else max(top, e)
                want.add((c, s, e, n))
        for width in (64, 1 << 16):
            assert {tuple(r) for r in islands.number_islands(df, ["chr"], "s", "e", gap, width=width).select("chr", "s", "e", "island").collect()} == want
    nulls = df.withColumn("chr", F.when(F.col("chr") == "a", F.col("chr")))  # a null key is a key
    same = lambda d: sorted((r["s"], r["e"], r["island"]) for r in islands.number_islands(d, ["chr"], "s", "e", width=64).collect())
    assert same(nulls) == same(df)
    got = islands.number_rows(df, ["chr"], "s", ["e"], "n", width=100).collect()
    for c in "ab":
        assert [(r["s"], r["e"]) for r in sorted((r for r in got if r["chr"] == c), key=lambda r: r["n"])] == sorted(p[1:] for p in pts if p[0] == c)


def test_quantiles_are_exact(spark):
    r = random.Random(2)
    vals = [(g, float(r.choice((r.randrange(9), r.randrange(10**6), r.random())))) for g in "xy" for _ in range(150)] + [("one", 3.0)]
    got = {x["g"]: x["q"] for x in expression.quantiles(spark.createDataFrame(vals, "g string, v double"), "g", "v", (0.0, 0.05, 0.3, 0.5, 1.0)).collect()}
    for g in ("x", "y", "one"):
        assert got[g] == pytest.approx(np.quantile([v for k, v in vals if k == g], (0.0, 0.05, 0.3, 0.5, 1.0)))


def test_normal_tail(spark):
    z = [0.0, 0.3, 1.0, 2.5, 5.0, 12.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(expression.normal_tail(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z], rel=2e-7)


def test_rebuild_alignment(spark):
    df = spark.createDataFrame([("a", "ACGTAC", "2M1I3M", "ACTAC"), ("b", "ACTAC", "2M1D3M", "ACGTAC")], "id string, seq string, cigar string, target string")
    assert rows(targets.rebuild_alignment(df)) == [("a", "ACGTAC", "AC-TAC"), ("b", "AC-TAC", "ACGTAC")]


def test_predict_targets_finds_planted_site(spark):
    mir = "TGACAGAAGAGAGTGAGCAC"
    site = mir.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    changed = site[:3] + ("A" if site[3] != "A" else "C") + site[4:]
    seqs = spark.createDataFrame([("s1", "CC" + changed + "GG"), ("s2", "A" * 60)], "name string, seq string")
    got = targets.predict_targets(spark.createDataFrame([("m", mir)], "name string, mseq string"), seqs).collect()
    assert [(r["name"], r["at"]) for r in got] == [("s1", 3)]


def test_predict_targets_of_all_lengths_against_all_places(spark):
    """Sites of six non-matches, dealt one to each three letters, which leave short miRNAs no whole piece of three."""
    rng, comp = random.Random(4), str.maketrans("ACGT", "TGCA")
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    mirs, seqs = [], []
    for n in (5, 7, *range(15, 25)):
        mir = some(n - 4) + "GTGT"
        mirs.append((f"m{n}", mir))
        for k in range(6):
            tar = list(mir)
            for at in (rng.randrange(i, min(i + 3, n - 4)) for i in range(0, min(n - 4, 15), 3)):
                tar[at] = rng.choice("ACGT".replace(mir[at], ""))
            tar[n - 2 - k % 3] = {"G": "A", "T": "C"}[mir[n - 2 - k % 3]]
            seqs.append((f"s{n}_{k}", some(k) + "".join(tar).translate(comp)[::-1] + some(5 - k)))
    want = set()
    for (mn, mir), (sn, seq_) in itertools.product(mirs, seqs):
        for at in range(len(seq_) - len(mir) + 1):
            pairs = [p for p in zip(mir, seq_[at : at + len(mir)][::-1].translate(comp), strict=True) if p[0] != p[1]]
            if len(pairs) <= 6 and sum(p not in (("G", "A"), ("T", "C")) for p in pairs) <= 5:
                want.add((mn, sn, at + 1))
    assert {f"m{n}" for n in (18, 19, 20)} <= {m for m, _, _ in want}
    got = [(r["mir"], r["name"], r["at"]) for r in targets.predict_targets(spark.createDataFrame(mirs, "name string, mseq string"), spark.createDataFrame(seqs, "name string, seq string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_candidates_are_as_wide_as_a_site(spark):
    """Rows of candidates hold the letters around a place, not the sequence."""
    rng = random.Random(9)
    long = "".join(rng.choice("ACGT") for _ in range(20000))
    site = long[300:320]
    mirs = spark.createDataFrame([("m", site.translate(str.maketrans("ACGT", "TGCA"))[::-1])], "name string, mseq string")
    hits = targets._seed_hits(mirs, spark.createDataFrame([("s", long)], "name string, seq string"), 0, True)
    assert max(len(x) for r in hits.collect() for x in r if isinstance(x, str)) < 80
    assert [(r["name"], r["at"]) for r in targets.predict_targets(mirs, spark.createDataFrame([("s", long)], "name string, seq string")).filter("score = 0").collect()] == [("s", 301)]


def test_a_search_makes_no_table_of_words(spark):
    """40 miRNAs have 346,400 words with up to three changes, which were rows, small enough when compressed to be broadcast through the driver."""
    rng = random.Random(10)
    seqs = spark.createDataFrame([(f"s{i}", "".join(rng.choice("ACGT") for _ in range(60))) for i in range(40)], "name string, seq string")
    mirs = seqs.select("name", F.reverse(F.translate(F.substring("seq", 11, 20), "ACGT", "TGCA")).alias("mseq"))
    for search in (targets.predict_targets, targets.predict_gapped_targets):
        assert most_rows(search(mirs, seqs)) < 5000
    assert {(r["mir"], r["at"]) for r in targets.predict_targets(mirs, seqs).filter("score = 0").collect()} >= {(f"s{i}", 11) for i in range(40)}


@pytest.mark.parametrize("search", [targets.predict_targets, targets.predict_gapped_targets])
def test_blocks_and_parts_of_a_search_dont_show(spark, monkeypatch, search):
    """Sites across the parts' borders, in blocks of two miRNAs and of few letters, with a fixed number of hits at once."""
    rng = random.Random(12)
    long = "".join(rng.choice("ACGT") for _ in range(700))
    seqs = spark.createDataFrame([("a", long), ("b", long[:30]), ("c", "ACG"), ("d", None), ("a", long)], "name string, seq string")
    site = lambda i, n: long[i : i + n].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    mirs = [(f"m{i}", site(i, n)[:8] + site(i, n)[9:]) for i, n in ((0, 21), (25, 22), (36, 21), (38, 25), (61, 21), (75, 40), (679, 21))] + [("e", ""), ("n", None)]
    mirs = spark.createDataFrame(mirs, "name string, mseq string")
    whole = rows(search(mirs, seqs))
    for name, n in (("BLOCK_MIRS", 2), ("BLOCK_LETTERS", 100), ("LEAST_MIRS", 2), ("LEAST_LETTERS", 100), ("PART", 40)):
        monkeypatch.setattr(targets, name, n)
    assert rows(search(mirs, seqs)) == whole and whole


def test_hits_come_a_fixed_number_at_once(monkeypatch):
    block = seeds.Block(["AC" * 30, "ACGT"], 40)
    monkeypatch.setattr(seeds, "HITS", 7)
    got = list(block.places(2, np.array([1, 4, 0, 1]), np.array([5, 6, 7, 8])))  # AC, CA, AA, AC
    assert max(len(p) for _, p in got) == 7
    want = [(r, 40 + i) for r in (5, 8) for i in (*range(0, 60, 2), 60)] + [(6, 40 + i) for i in range(1, 59, 2)]
    assert sorted((r, p) for x, y in got for r, p in zip(x.tolist(), y.tolist(), strict=True)) == sorted(want)


def test_searches_take_the_documents_divisible_by_100(spark, tmp_path):
    docs = spark.range(0, 1001).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["name"] for r in target_queries._mirs(registry.Views(spark, str(tmp_path))).collect()) == sorted(f"mS{i}" for i in range(0, 1001, 100))


def test_the_search_with_gaps_takes_every_document(spark, tmp_path):
    docs = spark.range(1, 31).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), "id").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["J22_gapped"](spark, str(tmp_path)).collect()
    assert {(f"mS{i}", f"S{i}") for i in range(1, 31)} <= {(r["mir"], r["name"]) for r in got}


def test_best_cleavage_once_for_each_end(spark):
    """Targets that share an end are no rows of their own until the end; an id of several ends keeps its best."""
    rng = random.Random(2)
    cats = [(g, loc, rng.randrange(1, 9), rng.randrange(5)) for g in "ab" for loc in rng.sample(range(60), 40)]
    own = [(f"t{i // 2}", rng.choice("ab"), rng.randrange(10, 60), rng.choice([None, 21, 23])) for i in range(3000)]
    want = {}
    for name, g, end, n in own:
        for o in (9, 10, 11, 12) if n == 23 else (9, 10, 11):
            for cg, loc, hits, cat in cats:
                if cg == g and loc == end - o:
                    win = sum(h for c2, l2, h, _ in cats if c2 == g and abs(l2 - loc) <= 5)
                    want[name] = min(want.get(name, (9,)), (cat, -hits, loc, g, win))
    df = targets.best_cleave(spark.createDataFrame(own, "id string, gene string, tend int, mlen int"), spark.createDataFrame(cats, "gene string, loc int, hits int, category int"))
    got = {r["id"]: (r["category"], -r["site_hits"], r["site"], r["gene"], r["window"]) for r in df.collect()}
    assert got == want and most_rows(df) <= 3000


def test_cleavage_p_shuffles_its_targets_once(spark):
    own = [("m", s / 2, s % 2) for s in range(8)] + [("m", None, 0)]
    df = targets.cleavage_p(spark.createDataFrame(own, "mir string, score double, category int"), spark.createDataFrame([(0, 0.5), (1, 0.1)], "category int, fraction double"))
    assert sorted((-1 if r["score"] is None else r["score"], r["n"]) for r in df.collect()) == [(-1, 1), *[(s / 2, 2 if s % 2 else 1) for s in range(8)]]
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("hashpartitioning(mir") == 1


def test_tags_of_several_sizes_against_all_places(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("AC") for _ in range(n))
    seqs = [(f"s{k}", some(rng.choice((2, 5, 30)))) for k in range(30)] + [("none", None), ("empty", "")]
    tags = [(some(n),) for n in (4, 5, 5, 7, 7, 9, 11) for _ in range(6)] + [(None,)]
    want = {(t, n, i + 1) for (t,) in tags for n, x in seqs if t and x and len(t) in (5, 7, 9) for i in range(len(x)) if x.startswith(t, i)}
    df = targets.map_tags_exact(spark.createDataFrame(tags, "tag string"), spark.createDataFrame(seqs, "name string, seq string"), (9, 5, 7))
    assert rows(df) == sorted(want) and want


def gapped_sites(mir, seq_):
    """at, length -> the least cost over all ways to place the gaps that are allowed, by trying each."""
    n, comp, out = len(mir), str.maketrans("ACGT", "TGCA"), {}
    own = [i for i in range(4, n - 3) if not 9 <= i + 1 <= 11]
    lacks = [None, *(i for i in range(4, n - 4) if not 9 <= i + 2 <= 11)]
    for gm in (0, 1, 2):
        for places in itertools.combinations_with_replacement(own, gm):
            for lack in lacks:
                size = n + gm - (lack is not None)
                if gm == 0 and lack is None:
                    continue
                cost = {0: 0, 1: 14, 2: 18 if len(set(places)) == 1 else 28}[gm] + (0 if lack is None else 18)
                columns = []  # of the miRNA, None for a gap in it
                for i in range(n):
                    columns += [None] * places.count(i) + ([] if i == lack else [mir[i]])
                columns += [None] * places.count(n)
                for at in range(len(seq_) - size + 1):
                    tar = seq_[at : at + size][::-1].translate(comp)
                    c = cost + 5 * sum(m is not None and m != x for m, x in zip(columns, tar, strict=True))
                    if c <= min(24 + n / 2, 35.5):
                        out[at + 1, size] = min(c, out.get((at + 1, size), 99))
    return out


def test_gapped_targets_against_all_alignments(spark):
    """Planted sites of every class of gaps, with as many mismatches as its cost leaves room for, and their neighbourhoods."""
    rng, comp = random.Random(11), str.maketrans("ACGT", "TGCA")
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    mirs, seqs = [(f"m{n}", some(n)) for n in (19, 20, 21, 22, 24)], []
    for mn, mir in mirs:
        for k, (gaps, lack, mis) in enumerate([((5,), False, 4), ((14,), False, 4), ((6, 6), False, 3), ((5, 13), False, 1), ((13, 14), False, 1), ((), True, 3), ((6,), True, 0), ((14,), True, 0), ((), True, 2), ((5,), False, 3)] * 2):
            tar = list(mir)
            for at in rng.sample(range(len(mir)), mis):
                tar[at] = rng.choice("ACGT".replace(mir[at], ""))
            if lack:
                del tar[13 if k % 2 else 5]
            for g in sorted(gaps, reverse=True):
                tar.insert(g, rng.choice("ACGT"))
            seqs.append((f"{mn}_{k}", some(k % 4) + "".join(tar).translate(comp)[::-1] + some(5 - k % 5)))
    got = targets.predict_gapped_targets(spark.createDataFrame(mirs, "name string, mseq string"), spark.createDataFrame(seqs, "name string, seq string")).collect()
    mine = {(r["mir"], r["name"], r["at"], len(r["site"])): r for r in got}
    assert len(mine) == len(got)
    want = {(mn, sn, *k): c for (mn, mir), (sn, x) in itertools.product(mirs, seqs) for k, c in gapped_sites(mir, x).items()}
    assert len(want) >= 80 and set(mine) == set(want)
    words = dict(mirs)
    for key, r in mine.items():  # the strings are an alignment of that cost
        m, t = r["mir_aln"], r["tar_aln"]
        assert len(m) == len(t) and m.replace("-", "") == words[r["mir"]] and t.replace("-", "").translate(comp)[::-1] == r["site"]
        assert dict(seqs)[r["name"]][r["at"] - 1 :].startswith(r["site"])
        runs = [len(x) for x in "".join("-" if c == "-" else "x" for c in m).split("x") if x]
        assert sum(10 + 4 * k for k in runs) + 18 * t.count("-") + 5 * sum(a != b for a, b in zip(m, t, strict=True) if "-" not in (a, b)) == want[key]


def test_greedy_matching_against_loop(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.randrange(1000)) for _ in range(150)]
    pairs = sorted({(a, b): s for a, b, s in pairs if a != b}.items())
    pairs = [(a, b, s) for (a, b), s in pairs]
    got = rows(loci.greedy_matching(spark.createDataFrame(pairs, "a string, b string, s long"), [(-F.col("s")).alias("o"), F.col("a"), F.col("b")]))
    used, want = set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    assert got == sorted(want)


def test_unique_placement(spark):
    names = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "name string, ord long")
    places = spark.createDataFrame([("x", "p", 0), ("y", "p", 0), ("y", "q", 1), ("z", "p", 0), ("z", "q", 1)], "name string, place string, pord long")
    assert rows(loci.unique_placement(names, places)) == [("x", "p"), ("y", "q")]


def test_unique_placement_of_a_long_chain(spark):
    """Each name's first place is the second one of the name before it, so a choice waits for all before it."""
    n = 230
    names = spark.createDataFrame([(f"n{i}", i) for i in range(n)], "name string, ord long")
    places = spark.createDataFrame([(f"n{i}", f"p{max(i - 1 + k, 0)}", k) for i in range(n) for k in (0, 1) if i or k], "name string, place string, pord long")
    assert rows(loci.unique_placement(names, places)) == sorted((f"n{i}", f"p{i}") for i in range(n))


@pytest.mark.parametrize("kind", ["tree", "dense", "self", "star"])
def test_greedy_matching_of_other_shapes(spark, kind):
    rng = random.Random(6)
    pairs = {
        "tree": [(f"n{i}", f"n{rng.randrange(i)}", rng.randrange(50)) for i in range(1, 80)],
        "dense": [(f"n{i}", f"n{j}", rng.randrange(5)) for i in range(12) for j in range(12) if i != j],
        "self": [(f"n{i}", f"n{rng.choice((i, i + 1))}", rng.randrange(9)) for i in range(60)],
        "star": [("hub", f"n{i}", rng.randrange(99)) for i in range(60)] + [(f"n{i}", f"m{i}", rng.randrange(99)) for i in range(60)],
    }[kind]
    used, want = set(), []
    for a, b, s in sorted(set(pairs), key=lambda p: (-p[2], p[0], p[1])):
        if not used & {a, b}:
            used |= {a, b}
            want.append((a, b, s))
    df = spark.createDataFrame(pairs, "a string, b string, s long")
    order = [(-F.col("s")).alias("o"), F.col("a"), F.col("b")]
    assert rows(loci.greedy_matching(df, order)) == sorted(want)
    assert loci.greedy_matching(df.limit(0), order).count() == 0


def test_a_chain_of_a_hundred_thousand_choices(spark, monkeypatch):
    """Pairs (i, i + 1) in order of i: every second one is chosen, after all before it. Counted: the copies that rounds and doublings write."""
    n, written = 100_000, []
    monkeypatch.setattr(loci, "checkpoint", lambda df: written.append(1) or runtime.checkpoint(df))
    pairs = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = loci.greedy_matching(pairs, [F.col("a")]).agg(F.count("*"), F.sum("a"), F.max(F.col("a") % 2)).first()
    assert tuple(got) == (n // 2, sum(range(0, n, 2)), 0)
    assert len(written) < 40


def test_blocks_end_where_islands_end(spark, monkeypatch):
    """Islands of a few loci each are in one block, over borders of coordinate blocks too, so loci aren't joined with each other; a long one is cut at every SHARE."""
    monkeypatch.setattr(loci, "SHARE", 10)
    rng = random.Random(3)
    short = [(f"n{k:03d}", rng.randrange(1, 8), 1, 10000 * (k // 7) + 100 * (k % 7) + rng.randrange(60), 10000 * (k // 7) + 100 * (k % 7) + 250, "ab"[k % 2]) for k in range(140)]
    long = [(f"m{k:03d}", 1, 2, 65500 + 40 * k, 65600 + 40 * k, "a") for k in range(35)]
    df = spark.createDataFrame(short + long, MERGED)
    got = {r["name"]: (r["chr"], r["near"], r["isle"], r["block"]) for r in loci._numbered(df, ["name"]).collect()}
    assert len(got) == 175
    assert all(got[r[0]][1] == i + 1 and got[r[0]][2] == i - i % 7 + 1 for i, r in enumerate(sorted(short, key=lambda r: r[3])))
    assert [got[r[0]][1:] for r in long] == [(k + 1, 1, 0 if k < 10 else 2 * ((k + 1) // 10) + 1) for k in range(35)]
    sizes = Counter((c, b) for c, _, _, b in got.values())
    assert max(sizes.values()) < 20
    assert len({(i, b) for c, _, i, b in got.values() if c == 1}) == 20  # an island, a block

    def none(*_):
        raise AssertionError("no island lies in several blocks")

    monkeypatch.setattr(loci, "_conflicts", none)
    df = spark.createDataFrame(short, MERGED)
    kept, merged = merges_by_loop(short)
    assert rows(loci.self_merge(df)) == kept
    assert rows(loci.merge_libraries(df)) == merged


def test_components_raise_if_unfinished(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), max_rounds=1)


def test_self_merge_and_library_merge(spark):
    schema = "name string, neglog_p long, chr long, lstart long, lend long, lib string"
    df = spark.createDataFrame([("a", 5, 1, 100, 300, "x"), ("b", 7, 1, 120, 310, "x"), ("c", 2, 1, 5000, 5100, "x")], schema)
    assert [r["name"] for r in loci.self_merge(df).orderBy("name").collect()] == ["b", "c"]
    df = spark.createDataFrame([("a", 5, 1, 100, 300, "x"), ("b", 7, 1, 90, 320, "y"), ("c", 2, 1, 310, 500, "y")], schema)
    assert [r["name"] for r in loci.merge_libraries(df).orderBy("name").collect()] == ["b", "c"]


def test_extract_rows_ignores_case_on_both_sides(spark):
    m = spark.createDataFrame([("AbC",), ("def",)], "k string")
    hit, miss = tags.extract_rows(m, spark.createDataFrame([("aBc",)], "q string"), "k", "q")
    assert rows(hit) == [("AbC",)] and rows(miss) == [("def",)]


def test_ratio_without_control_is_zero_filled(spark):
    c = spark.createDataFrame([("T", "t1", 6), ("C", "t1", 3), ("T", "t2", 4)], "lib string, tag string, abun long")
    got = {r["tag"]: r["ratio"] for r in tags.tag_abundance(c, c, "T", "C").collect()}
    assert got == {"t1": 2.0, "t2": 4.0}


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04]
    got = [r["fdr"] for r in expression.bh_adjust(spark.createDataFrame(list(enumerate(p)), "i long, p double")).orderBy("i").collect()]
    want, order = [0.0] * 6, sorted(range(6), key=lambda i: -p[i])
    low = 1.0
    for k, i in enumerate(order):
        low = min(low, p[i] * 6 / (6 - k))
        want[i] = low
    assert got == pytest.approx(want)


def test_cluster_transcripts_is_transitive(spark):
    e = spark.createDataFrame([("t1", 1, "w", 10, 50), ("t2", 1, "w", 40, 90), ("t3", 1, "w", 80, 120), ("t4", 1, "c", 80, 120)], "trans string, chr long, strand string, xstart long, xend long")
    assert rows(expression.cluster_transcripts(e)) == [("t1", "Mt1"), ("t2", "Mt1"), ("t3", "Mt1"), ("t4", "Mt4")]


def test_cells_are_counted(spark):
    """More cells than 2000, and fewer: means and deviations over the cells there are."""
    for n in (30, 3000):
        counts = {(c, f"g{g}"): c * (g + 3) % 7 + g + 1 for c in range(n) for g in range(6) if (c + g) % (g + 2) == 0 or g == 0}
        per = {g: [counts.get((c, g), 0) for c in range(n)] for g in {k[1] for k in counts}}
        stat = {g: (statistics.fmean(x), statistics.variance(x)) for g, x in per.items()}
        df = spark.createDataFrame([(*k, v) for k, v in counts.items()], "cell long, gene string, cnt long")
        got = {r["gene"]: r for r in expression.sc_hvg(df, 6).collect()}
        assert len(got) == 6 and all(r["std_var"] > 0 for r in got.values())
        z = expression.sc_scale(df.withColumn("v", F.col("cnt").cast("double"))).collect()
        assert len(z) == len(counts)
        assert all(r["z"] == pytest.approx((counts[r["cell"], r["gene"]] - stat[r["gene"]][0]) / stat[r["gene"]][1] ** 0.5) for r in z)


def test_arm_flags(spark):
    df = spark.createDataFrame([(0, 3), (0, -3), (0, 10), (0, 24)], "a5 long, b5 long")
    assert [r["flag"] for r in annotation.arm_flags(df, 21).collect()] == ["A", "B", "N", "A"]


def test_fasta_and_sam_edges(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACG\nTT\n>empty\n>y\nGG\n")
    assert rows(formats.read_fasta(spark, str(tmp_path / "a.fa"))) == [("x", "ACGTT"), ("y", "GG")]
    assert rows(formats.read_fasta_counted(spark, str(tmp_path / "a.fa")).drop("file")) == [(3, 1)]
    line = lambda f: "\t".join(["q", str(f), "c", "5", "30", "3M", "*", "0", "0", "ACG", "III", "NM:i:1"])
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + "\n".join(map(line, (0, 4, 16, 256))) + "\n")
    sam, head = formats.read_sam(spark, str(tmp_path / "a.sam"))
    kept, un = formats.filter_sam(sam, (16,), (256,), 20)
    assert head.count() == 1 and sorted(r["flag"] for r in kept.collect()) == [0, 16] and un.count() == 1


def test_records_are_cut_at_a_line_start(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">s1 a>b x\r\nACG\r\n>s2\nG>T\nC\n")
    assert rows(formats.read_fasta(spark, str(tmp_path / "a.fa"))) == [("s1", "ACG"), ("s2", "G>TC")]
    (tmp_path / "c.txt").write_text(">cluster id c>1 a b chr 2 x y from 5 to 9\n2\tw\t6\tt\tAC\t21\t3\t1\t2\t4\t5\t0.5\n")
    assert [(r["cluster"], r["chr"], r["cend"], r["pos"]) for r in formats.read_clusters(spark, str(tmp_path / "c.txt")).collect()] == [("c>1", "2", 9, 6)]


def test_fastq_with_carriage_returns(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(b"@r1 x\r\nACGT\r\n+\r\nIIII\r\n@r2\r\nGG\r\n+\r\n@I\r\n")
    assert rows(formats.read_fastq(spark, str(tmp_path / "a.fq")).select("read_id", "seq", "qual")) == [("r1", "ACGT", "IIII"), ("r2", "GG", "@I")]


def test_ratios_round_as_binary_numbers(spark):
    members = spark.createDataFrame([("p", "A" * 21, 3), ("p", "C" * 22, 2)], "name string, tag string, k int")
    tags = spark.createDataFrame([("L0", "A" * 21, 87), ("L1", "C" * 22, 513)], "lib string, tag string, abun long")
    assert [r["size_ratio"] for r in loci.summarize_loci(members, tags, ("L0", "L1")).collect()] == [0.14]  # 87 / 600 is below 0.145
    df = spark.range(1, 2000).select("id", intervals.round_double(F.col("id") / 600, 2).alias("r"))
    assert all(r["r"] == math.floor(r["id"] / 600 * 100 + 0.5) / 100 for r in df.collect())


def test_10x_entry_like_the_sizes_line(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%\n2 2 2\n1 1 5\n2 2 2\n")
    (tmp_path / "g.tsv").write_text("ga\tGene A\ngb\tGene B\n")
    (tmp_path / "c.tsv").write_text("c1\nc2\n")
    assert rows(formats.read_10x(spark, *(str(tmp_path / x) for x in ("m.mtx", "g.tsv", "c.tsv")))) == [("c1", "ga", 5), ("c2", "gb", 2)]


def test_lines_keep_their_order_over_many_parts(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"n{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = formats.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        assert [r["value"] for r in lines.orderBy("number").collect()] == [f"{k}-{i}" for k in range(3) for i in range(2000)]
        assert rows(lines.agg(F.min("number"), F.max("number"), F.countDistinct("number"))) == [(1, 6000, 6000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_annotated_gene_goes_with_all_its_isoforms(spark):
    t = [("g", "t1", 1, "w", 10, 90, 5, True), ("g", "t2", 1, "w", 50, 120, 0, True), ("g", "t3", 1, "w", 500, 600, 1, True), ("h", "t4", 1, "w", 10, 90, 1, True), ("h", "t5", 1, "w", 80, 95, -1, True), ("h", "t6", 1, "w", 95, 99, 2, False)]
    got = intervals.collapse_isoforms(spark.createDataFrame(t, "gene string, trans string, chr int, strand string, tstart long, tend long, score int, coding boolean"))
    assert rows(got.select("gene", "isoforms", "mstart", "mend", "best_score", "kind")) == [("g", "t3", 500, 600, 1, "uniq"), ("h", "t4,t5", 10, 95, 1, "merged")]


def test_triggers_up_to_seven_cycles_in(spark):
    locus = spark.createDataFrame([("p", 1, 1000, 3000)], "name string, chr int, lstart long, lend long")
    sites = spark.createDataFrame([(f"w{i}", 1, "w", 1000 + 21 * i) for i in (-6, -5, 7, 8)] + [("c7", 1, "c", 3000 + 147), ("dicer", 1, "w", 1000 + 21 * 6 - 1), ("strand", 1, "c", 3000 - 21 + 2)], "site string, chr int, strand string, pos long")
    assert rows(loci.find_triggers(sites, locus, 21).select("site", "cls", "idx")) == [("c7", 0, 7), ("dicer", 1, 6), ("strand", 2, -1), ("w-5", 0, -5), ("w7", 0, 7)]


@pytest.mark.parametrize("phase", [3, 21])
def test_triggers_against_all_positions_in_few_rows(spark, phase):
    rng = random.Random(phase)
    own = [(f"p{i}", 1 + i % 2, s := rng.randrange(1, 5000), s + rng.randrange(50, 400)) for i in range(40)]
    at = sorted({(1 + i % 2, rng.choice("wc"), rng.randrange(1, 6000)) for i in range(400)})
    want = set()
    for (c, strand, pos), (name, lchr, start, end) in itertools.product(at, own):
        ways = [(abs(o), abs(i), i) for i in range(-5, 8) for o in range(-2, 3) if pos == (start if strand == "w" else end) + i * phase + o]
        if c == lchr and ways:
            want.add((f"{c}{strand}{pos}", name, min(ways)[0], min(ways)[2]))
    sites = spark.createDataFrame([(f"{c}{s}{p}", c, s, p) for c, s, p in at], "site string, chr int, strand string, pos long")
    df = loci.find_triggers(sites, spark.createDataFrame(own, "name string, chr int, lstart long, lend long"), phase)
    assert set(rows(df)) == want and want
    assert most_rows(df) < 40 * 2 * 65  # not a row for each position


def test_clips_take_read_bases_but_no_place(spark):
    df = spark.createDataFrame([("a", "TTACGTACGG", "3H2S2M1I3M2S", "ACTAC"), ("b", "ACTACGG", "2M1D3M5N2S1P", "ACGTAC")], "id string, seq string, cigar string, target string")
    assert rows(targets.rebuild_alignment(df)) == [("a", "ACGTAC", "AC-TAC"), ("b", "AC-TAC", "ACGTAC")]


def test_precursor_counts_both_arms(spark):
    p = spark.createDataFrame([("m", 1, 100, 0, 20, 60, 80), ("none", 1, 100, None, None, None, None)], "name string, chr int, pstart long, start5 long, end5 long, start3 long, end3 long")
    t = spark.createDataFrame([("a", 1, 110, 6), ("b", 1, 165, 3), ("loop", 1, 140, 50), ("c", 1, 180, 1)], "tag string, chr int, pos long, abun long")
    assert rows(loci.precursor_ratio(loci.precursor_arms(p), t)) == [("m", 10, 0.6, 0.9)]


def test_10x(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n3 2 3\n1 1 5\n3 1 2\n2 2 1\n")
    (tmp_path / "g.tsv").write_text("ga\ngb\ngc\n")
    (tmp_path / "c.tsv").write_text("c1\nc2\n")
    got = rows(formats.read_10x(spark, *(str(tmp_path / x) for x in ("m.mtx", "g.tsv", "c.tsv"))))
    assert got == [("c1", "ga", 5), ("c1", "gc", 2), ("c2", "gb", 1)]


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc_round_trip(spark, tmp_path):
    o = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "dbtable": "tags", "driver": DERBY, "createTableColumnTypes": "tag VARCHAR(9)"}
    df = spark.createDataFrame([(f"t{k % 90}", k % 70) for k in range(500)] + [("null", None)], "tag string, abun long").repartition(3)
    try:
        formats.write_jdbc(df, o)
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no database on this machine: {type(e).__name__}")
    assert rows(formats.read_jdbc(spark, o)) == rows(df)
    part = formats.read_jdbc(spark, o, "abun > 20 AND tag <> 't5'", by="abun", parts=5)
    assert part.rdd.getNumPartitions() == 5
    assert rows(part.select("tag")) == rows(df.filter("abun > 20 AND tag <> 't5'").select("tag"))
    assert "PushedFilters: [*IsNotNull(abun)" in part._jdf.queryExecution().executedPlan().toString()
    formats.write_jdbc(df.limit(2), o)
    assert formats.read_jdbc(spark, o).count() == 503
    formats.write_jdbc(df.filter("abun = 3"), o, "overwrite")
    assert rows(formats.read_jdbc(spark, o, by="abun")) == rows(df.filter("abun = 3"))


def test_a_write_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    """Also one of which a task wrote its rows twice: each comes once."""
    o = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "dbtable": "tags", "driver": DERBY, "createTableColumnTypes": "tag VARCHAR(9)"}
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "tag string, abun long")
    real, seen = formats._transaction, []
    try:
        formats.write_jdbc(df, o)
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no database on this machine: {type(e).__name__}")

    def broken(spark_, options, statements):
        seen.append(statements)
        if statements[0].startswith("DELETE"):
            statements = [*statements, "INSERT INTO nowhere VALUES (1)"]
        real(spark_, options, statements)

    monkeypatch.setattr(formats, "_transaction", broken)
    with pytest.raises(Exception, match="NOWHERE"):
        formats.write_jdbc(df.filter("abun = 2"), o, "overwrite")
    assert rows(formats.read_jdbc(spark, o)) == [("a", 1), ("a", 1), ("b", 2)] and "DROP TABLE stage_" in seen[-1][0]

    def twice(spark_, options, statements):
        if statements[0].startswith("INSERT"):
            stage = statements[0].split(" FROM ")[2].split(")")[0]
            real(spark_, options, [f"INSERT INTO {stage} SELECT * FROM {stage}"])
        real(spark_, options, statements)

    monkeypatch.setattr(formats, "_transaction", twice)
    formats.write_jdbc(df, o)
    assert rows(formats.read_jdbc(spark, o)) == [("a", 1)] * 4 + [("b", 2)] * 2


def test_a_database_in_memory_is_refused_off_one_machine(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="each executor"):
        formats.read_jdbc(spark, {"url": "jdbc:derby:memory:x", "dbtable": "t"})


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.25])
def test_adapters_against_all_offsets(spark, rate):
    rng = random.Random(3)
    adapter = "ACGGTACCTGATT"
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 9))) + "".join(c if rng.random() > rate / 2 else rng.choice("ACGT") for c in adapter)[: rng.randrange(3, 14)] + "".join(rng.choice("ACGTN") for _ in range(rng.choice((0, 0, 5)))) for _ in range(400)] + ["", adapter, adapter * 2, "A"]

    def first(read):
        for o in range(len(read)):
            k = min(len(adapter), len(read) - o)
            if (k == len(adapter) or k >= 4) and sum(a != b for a, b in zip(adapter, read[o:], strict=False)) <= int(rate * k + 1e-9):
                return o + 1
        return None

    df = spark.createDataFrame([(k, r) for k, r in enumerate(reads)], "k int, seq string")
    got = dict(df.select("k", formats.adapter_start(F.col("seq"), adapter, rate, 4)).collect())
    assert got == {k: first(r) for k, r in enumerate(reads)} and sum(v is not None for v in got.values()) > 100


def test_streamed_counts(spark, tmp_path):
    from tagloom.streaming.counts import stream_tagcounts

    (tmp_path / "L0.txt").write_text("ACG\t3\nTTT\t1\n")
    (tmp_path / "L1.txt").write_text("ACG\t4\n")
    q = stream_tagcounts(spark, str(tmp_path)).writeStream.format("memory").queryName("tagcounts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("SELECT lib, tag, abun FROM tagcounts")) == [("L0", "ACG", 3), ("L0", "TTT", 1), ("L1", "ACG", 4)]


def _dice(a, b):
    return 2 * max(0, min(a[4], b[4]) - max(a[3], b[3])) / (a[4] - a[3] + b[4] - b[3])


def merges_by_loop(loci_):
    kept = []
    for r in sorted(loci_, key=lambda r: (r[5], r[2], -r[1], r[3] - r[4], r[3], r[0])):
        if all(k[5] != r[5] or k[2] != r[2] or _dice(r, k) <= 0.45 for k in kept[-200:]):
            kept.append(r)
    merged = []
    for c in sorted({r[2] for r in loci_}):
        mine: list = []
        for r in sorted((r for r in loci_ if r[2] == c), key=lambda r: (r[5], r[3], r[4], r[0])):
            best = max(range(len(mine)), key=lambda i: (_dice(r, mine[i]), -i), default=-1)
            if best < 0 or _dice(r, mine[best]) <= 0.25:
                mine.append(r)
            elif r[4] - r[3] > mine[best][4] - mine[best][3]:
                mine[best] = r
        merged += mine
    return sorted(kept), sorted(merged)


MERGED = "name string, neglog_p long, chr long, lstart long, lend long, lib string"


@pytest.mark.parametrize("share", [5, 16, 4096])
def test_locus_merges_against_plain_loops(spark, monkeypatch, share):
    """Chains of loci that overlap their neighbours only, with equal and different p, in random order, in blocks of several sizes."""
    monkeypatch.setattr(loci, "SHARE", share)
    rng = random.Random(6)
    loci_ = []
    for k in range(90):
        at = 1000 * (k // 6) + rng.randrange(3000) if k % 2 else 70 * k
        loci_.append((f"n{k}", rng.randrange(1, 4), rng.randrange(1, 3), at, at + rng.choice((100, 120, 150, 400)), rng.choice("ab")))
    kept, merged = merges_by_loop(loci_)
    df = spark.createDataFrame(loci_, MERGED)
    assert rows(loci.self_merge(df)) == kept
    assert rows(loci.merge_libraries(df)) == merged


def test_one_island_over_many_blocks(spark, monkeypatch):
    """A single island in which each locus waits for the one before it, cut into ten blocks."""
    monkeypatch.setattr(loci, "SHARE", 60)
    rng = random.Random(9)
    loci_ = [(f"n{k:04d}", 1000 - k, 1, 40 * k, 40 * k + 100 + rng.randrange(3), "ab"[k % 7 == 0]) for k in range(600)]
    df = spark.createDataFrame(loci_, MERGED)
    best = sorted(loci_, key=lambda r: (r[5], -r[1]))
    kept: list = []
    for r in best:
        if all(k[5] != r[5] or _dice(r, k) <= 0.45 for k in kept[-5:]):
            kept.append(r)
    assert rows(loci.self_merge(df)) == sorted(kept) and 150 < len(kept) < 450
    assert rows(loci.merge_libraries(df)) == merges_by_loop(loci_)[1]


def test_counts_of_values_by_bits():
    rng = np.random.default_rng(4)
    for n, m in ((0, 3), (1, 5), (70, 200), (257, 300)):
        values, first, below = rng.integers(0, max(n, 1), n), rng.integers(0, n + 1, m), rng.integers(0, n + 3, m)
        assert dominance.count_below(values, first, below).tolist() == [int((values[:k] < v).sum()) for k, v in zip(first, below, strict=True)]


@pytest.mark.parametrize("side", [3, 16, 4096])
@pytest.mark.parametrize("width", [30, 900, 5000])
def test_interval_ranks_against_loops(spark, monkeypatch, side, width):
    """Tied fold changes and places, one track of many probes, intervals that reach around the ring, in blocks of several sizes."""
    monkeypatch.setattr(dominance, "SIDE", side)
    rng = random.Random(side)
    probes = [(f"p{k}", rng.choice("aaaab"), c := rng.randrange(1, 4), a := rng.randrange(1, 400 * c), a + 5, rng.choice((rng.random(), 0.5))) for k in range(150)] + [("one", "c", 1, 7, 9, 1.0)]
    lens = {c: max(p[4] for p in probes if p[2] == c) + 1 for c in (1, 2, 3)}
    off, ring = {1: 0, 2: lens[1], 3: lens[1] + lens[2]}, sum(lens.values())
    want = []
    for p in probes:
        x = off[p[2]] + p[3]
        near = [q for q in probes if q[1] == p[1] for t in (-1, 0, 1) if abs(off[q[2]] + q[3] + t * ring - x) <= width]
        want.append((p[0], p[1], sum(q[5] > p[5] for q in near) + 1, len(near)))
    df = spark.createDataFrame(probes, "probe string, track string, chr int, pstart long, pend long, fc double")
    assert rows(enrichment.interval_rank(df, width).select("probe", "track", "rank", "n")) == sorted(want)


def test_correlation_p(spark):
    """Against the numerical integral of Student's density."""

    def tail(r, n):
        v = n - 2
        t, c = abs(r) * math.sqrt(v / (1 - r * r)), math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        x = np.linspace(0, t, 200001)
        y = c * (1 + x * x / v) ** (-(v + 1) / 2)
        return 1 - 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())

    cases = [(0.5, 10), (-0.3, 3), (0.2, 4), (0.2, 5), (0.05, 400), (-0.1, 301), (0.9, 6)]
    df = spark.createDataFrame(cases, "r double, n long")
    got = {(r["r"], r["n"]): r["p"] for r in df.withColumn("p", expression.correlation_p(F.col("r"), F.col("n"))).collect()}
    for r, n in cases:
        assert got[(r, n)] == pytest.approx(tail(r, n), abs=1e-7), (r, n)


@pytest.mark.parametrize("size", ["60", "97", "4m"])
def test_fastq_qualities_that_begin_with_at(spark, tmp_path, size):
    rng = random.Random(3)
    want, text = [], []
    for k in range(120):
        n = rng.randrange(1, 30)
        read, qual = "".join(rng.choices("ACGT", k=n)), rng.choice("@+AI") + "".join(chr(33 + rng.randrange(94)) for _ in range(n - 1))
        want.append((f"r{k}", read, qual))
        text.append(f"@r{k} x\n{read}\n+\n{qual}\n")
    (tmp_path / "lib7.fastq").write_text("".join(text) + "@cut off\nACGT")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = rows(formats.read_fastq(spark, str(tmp_path / "lib7.fastq")).select("read_id", "seq", "qual"))
        trimmed = formats.trim_reads(formats.read_fastq(spark, str(tmp_path)), "TTTTTTTT", 2, 100, 1).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(want) and trimmed > 0


def test_principal_components_and_clusters(spark):
    r = np.random.RandomState(1)
    centers = np.array([[9.0, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0]])
    x = np.vstack([c + r.randn(30, 4) for c in centers])
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "cell int, g0 double, g1 double, g2 double, g3 double")
    scored, variance, pc = expression.pca(df, ("g0", "g1", "g2", "g3"), 2, scale=False)
    u, d, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert variance == pytest.approx((d**2 / (d**2).sum())[:2]) and abs(pc) == pytest.approx(abs(vt[:2].T), abs=1e-9)
    rows_ = sorted(scored.collect(), key=lambda r: r["cell"])
    assert np.abs([r["pcs"].toArray() for r in rows_]) == pytest.approx(np.abs(u[:, :2] * d[:2]), abs=1e-9)
    table = expression.loadings(pc, variance, ("g0", "g1", "g2", "g3"), spark)
    assert table.count() == 8 and table.filter("pc = 1").agg(F.sum(F.col("loading") * F.col("loading"))).first()[0] == pytest.approx(1)
    got = {r["cell"]: r["cluster"] for r in expression.sc_cluster(scored, "pcs", 3).collect()}
    assert [len({got[i] for i in range(30 * k, 30 * k + 30)}) for k in range(3)] == [1, 1, 1] and len(set(got.values())) == 3


def test_variable_genes_against_a_local_fit(spark):
    """Each gene in a class of its own: the trend is the local regression over the genes, and counts are clipped at the root of the number of cells."""
    r = np.random.default_rng(5)
    x = r.negative_binomial(2, 2 / (2 + np.exp(r.normal(0, 1.5, 40)))[:, None], (40, 120))
    x[7, 3] = 4000
    x[11] = 0
    df = spark.createDataFrame([(k, f"g{j}", int(x[j, k])) for j in range(40) for k in range(120) if x[j, k]], "cell int, gene string, cnt long")
    keep = [j for j in range(40) if x[j].any()]
    lm, lv = np.log10(x[keep].mean(1)), np.log10(x[keep].var(1, ddof=1))
    want = {}
    for i, j in enumerate(keep):
        far = np.abs(lm - lm[i])
        reach = np.sort(far)[math.ceil(0.3 * len(keep)) - 1]
        w = np.where(far < reach, (1 - (far / reach) ** 3) ** 3, 0)
        d = lm - lm[i]
        fit = np.polyfit(d, lv, 2, w=np.sqrt(w))[-1]
        z = np.minimum((x[j] - x[j].mean()) / math.sqrt(10**fit), math.sqrt(120))
        want[f"g{j}"] = (z**2).sum() / 119
    got = expression.sc_hvg(df, 100, 120, bins=1 << 20).collect()
    assert {r_["gene"] for r_ in got} == set(want)
    assert all(r_["std_var"] == pytest.approx(want[r_["gene"]], rel=1e-6) for r_ in got)
    assert [r_["gene"] for r_ in got] == sorted(want, key=lambda g: -want[g])
    rough = {r_["gene"]: r_["std_var"] for r_ in expression.sc_hvg(df, 100, 120, bins=64).collect()}
    assert np.corrcoef([rough[g] for g in want], [want[g] for g in want])[0, 1] > 0.99


def test_log_gamma(spark):
    at = [1e-3, 0.1, 0.5, 1.0, 2.5, 10.0, 333.3, 1e5, 1e8]
    got = spark.createDataFrame([(x,) for x in at], "x double").select("x", expression.log_gamma(F.col("x")).alias("l")).collect()
    assert all(r["l"] == pytest.approx(math.lgamma(r["x"]), rel=1e-11, abs=1e-11) for r in got)


def test_dispersions_against_a_loop(spark):
    r = np.random.default_rng(8)
    phi = np.exp(r.normal(-1.5, 0.5, 60))
    x = r.negative_binomial((1 / phi)[:, None], 1 / (1 + phi[:, None] * np.exp(r.normal(3, 1, 60))[:, None] * np.array([1, 1.3, 0.8, 1, 2, 0.9])), (60, 6))
    a, b = ("S0", "S1", "S2"), ("S3", "S4", "S5")
    df = spark.createDataFrame([(f"g{j}", f"S{k}", int(x[j, k])) for j in range(60) for k in range(6) if x[j, k]], "gene string, sample string, cnt long")
    got = {r_["gene"]: r_ for r_ in expression.estimate_dispersions(df, a, b).collect()}
    size = x.sum(0)
    y = x * np.exp(np.log(size).mean()) / size
    grid = np.linspace(math.log(1e-4), math.log(10), 41)
    lg = np.vectorize(math.lgamma)
    like = np.array([[sum(lg(g + 1 / f).sum() - 3 * math.lgamma(1 / f) + math.lgamma(3 / f) - math.lgamma(g.sum() + 3 / f) for g in (y[j, :3], y[j, 3:])) for f in np.exp(grid)] for j in range(60)])

    def top(l):
        i = int(l.argmax())
        shift = (l[i - 1] - l[i + 1]) / (2 * (l[i - 1] - 2 * l[i] + l[i + 1])) if 0 < i < 40 else 0.0
        return math.exp(grid[0] + (i + shift) * (grid[1] - grid[0]))

    mean = like.mean(0)
    for j in range(60):
        assert got[f"g{j}"]["common"] == pytest.approx(top(mean), rel=1e-6)
        assert got[f"g{j}"]["dispersion"] == pytest.approx(top(like[j] + 10 / 4 * mean), rel=1e-6)
    assert 0.1 < top(mean) < 0.5  # the dispersions' middle is 0.22
    p = expression.diff_test(df, a, b, expression.estimate_dispersions(df, a, b)).collect()
    assert len(p) == 60 and all(0 <= r_["p"] <= 1 for r_ in p)


def test_reference_sample_is_of_the_middle(spark):
    r = random.Random(2)
    data = [(f"g{j}", f"S{k}", c) for j in range(50) for k in range(4) if (c := r.randrange(0, 30 * (1 + k)))]
    size = {f"S{k}": sum(c for _, s, c in data if s == f"S{k}") for k in range(4)}
    f = {s: np.quantile([next((c for g, t, c in data if (g, t) == (f"g{j}", s)), 0) for j in range(50)], 0.75) / n for s, n in size.items()}
    want = min(f, key=lambda s: (abs(f[s] - np.mean(list(f.values()))), s))
    df = spark.createDataFrame(data, "gene string, sample string, cnt long")
    assert expression.tmm_reference(df).first()["sample"] == want
    assert rows(expression.tmm_factors(df)) == rows(expression.tmm_factors(df, want))


def test_differential_test_against_a_loop(spark):
    r = random.Random(9)
    data = [(f"g{j}", f"S{k}", r.randrange(1, 40) * (3 if j % 3 == 0 and k > 2 else 1)) for j in range(12) for k in range(6) if r.random() < 0.9]
    df = spark.createDataFrame(data, "gene string, sample string, cnt long")
    size = {s: sum(c for _, t, c in data if t == s) for _, s, _ in data}

    def loglik(rows_):
        rate = sum(c for _, c in rows_) / sum(size[s] for s, _ in rows_)
        return sum(c * math.log(rate * size[s] / (rate * size[s] + 10)) + 10 * math.log(10 / (rate * size[s] + 10)) for s, c in rows_)

    for row in expression.diff_test(df, ("S0", "S1", "S2"), ("S3", "S4", "S5")).collect():
        own = [(s, c) for g, s, c in data if g == row["gene"]]
        a, b = [x for x in own if x[0] < "S3"], [x for x in own if x[0] >= "S3"]
        lr = 2 * (loglik(a) + loglik(b) - loglik(own)) if a and b else 0.0
        assert row["p"] == pytest.approx(math.erfc(math.sqrt(max(lr, 0) / 2)), rel=1e-6)
        mean = [sum(c * 1e6 / size[s] for s, c in x) / 3 for x in (a, b)]
        assert row["logfc"] == pytest.approx(math.log2((mean[1] + 0.5) / (mean[0] + 0.5)))


def test_random_sequences_are_distinct(spark):
    names = spark.range(300).select(F.col("id").cast("string").alias("name"))
    got = [r["seq"] for r in enrichment.random_seqs(names, 40, 3).collect()]
    assert len(set(got)) == 300 and all(len(x) == 40 and set(x) <= set("ACGT") for x in got)
    few = [r["seq"] for r in enrichment.random_seqs(names, 4, 3).collect()]
    assert len(few) == len(set(few)) > 100


def test_inverted_repeats_keep_to_their_filters(spark):
    rows_ = [("a", "b", 90.0, 200, 50, 250, 250), ("a", "c", 90.0, 200, 60, 250, 400), ("b", "d", 80.0, 200, 90, 250, 250), ("e", "e", 99.0, 200, 40, 220, 220), ("d", "b", 85.0, 180, 30, 260, 250), ("f", "g", 99.0, 179, 99, 200, 200), ("h", "i", 99.0, 190, 99, 280, 300)]
    df = spark.createDataFrame(rows_, "a string, b string, pident double, length long, bitscore long, alen long, blen long")
    assert rows(loci.inverted_repeats(df).select("a", "b")) == [("a", "c"), ("d", "b"), ("e", "e")]
    assert rows(loci.inverted_repeats(df, foldback=True).select("a", "b")) == [("e", "e")]


def test_streams_sum_windows_behind_a_watermark(spark, tmp_path):
    from tagloom.streaming import counts

    schema = "ts timestamp, lib string, abun long"
    feed = [[("2024-01-01 00:00:10", "a", 2), ("2024-01-01 00:00:50", "a", 3), ("2024-01-01 00:01:10", "b", 5)], [("2024-01-01 00:09:00", "a", 7)], [("2024-01-01 00:10:00", "b", 1)], [("2024-01-01 00:00:20", "a", 100), ("2024-01-01 00:20:00", "a", 1)], [("2024-01-01 00:30:00", "a", 1)]]
    src = tmp_path / "in"
    src.mkdir()
    for k, batch in enumerate(feed):
        (src / f"{k}.csv").write_text("".join(f"{a},{b},{c}\n" for a, b, c in batch))
        os.utime(src / f"{k}.csv", (1_700_000_000 + 60 * k,) * 2)  # read in this order
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).csv(str(src))
    q = counts.stream_windowed(events, "ts", "1 minute", "2 minutes").writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r["start"])[11:16], r["lib"]): r["abun"] for r in spark.table("windowed").collect()}
    assert got[("00:00", "a")] == 5 and got[("00:01", "b")] == 5 and got[("00:09", "a")] == 7


def test_points_are_numbered_as_islands_from_one_reading(spark, tmp_path):
    from tagloom.operators.islands import count_per, number_islands, number_points

    rng = random.Random(5)
    rows = [(c, s, p, rng.randrange(1, 4)) for c in (1, 2, None) for s in "wc" for p in {rng.randrange(3000) for _ in range(60)}]
    rows += [(1, "w", None, 1)]
    df = spark.createDataFrame(rows, "chr long, strand string, pos long, n long")
    for gap, width in ((10, 64), (30, 64), (10, 1 << 16)):
        want = number_islands(df, ["chr"], "pos", "pos", gap, "i")
        got = number_points(df, ["chr"], "pos", gap, "i", width=width)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        records = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        big = count_per(number_islands(records, ["chr"], "pos", "pos", gap, "i"), ["chr", "i"], "pos", "size").filter("size >= 5").select("chr", "strand", "pos", "i").distinct()
        got = number_points(df, ["chr"], "pos", gap, "i", 5, width).select("chr", "strand", "pos", "i")
        assert sorted(map(str, got.collect())) == sorted(map(str, big.collect()))
    df.selectExpr("chr", "strand", "pos", "0.1D AS best_p", "n", "n AS k").write.parquet(f"{tmp_path}/best")
    plan = phasing.phased_clusters(spark.read.parquet(f"{tmp_path}/best"), (0.5, 0.2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/best") <= 1  # what the clusters rest on isn't computed for the numbers and again for the rows


def test_sums_of_points_are_those_of_numbered_points(spark):
    from tagloom.operators.islands import number_points, sum_points

    rng = random.Random(6)
    rows_ = [(c, s, p, rng.randrange(1, 4), p // 50) for c in (1, 2, None) for s in "wc" for p in {rng.randrange(3000) for _ in range(60)}] + [(1, "w", None, 1, None)]
    df = spark.createDataFrame(rows_, "chr long, strand string, pos long, n long, b long")
    for gap, block in ((10, None), (30, "b"), (100, "b")):
        want = number_points(df, ["chr"], "pos", gap, "i").groupBy("chr", "i").agg(F.sum("n"))
        got = sum_points(df, ["chr"], "pos", ("n",), gap, "i", 64, block).groupBy("chr", "i").agg(F.sum("n"))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_positions_have_the_sums_of_their_tags(spark):
    """A tag's hits are its distinct places; records without a tag count for the position only."""
    records = [("A", 21, 1, "w", 5, 10), ("A", 21, 1, "w", 5, 6), ("A", 21, 2, "c", 70_000, 4), ("B", 22, 1, "w", 5, 3), (None, 21, 1, "w", 5, 9), (None, 20, 1, "w", 9, 2)]
    got = phasing.tag_positions(spark.createDataFrame(records, "tag string, len int, chr long, strand string, pos long, abun long"), 21)
    got = [tuple(r) for r in got.select("chr", "strand", "pos", "n", "main", "total", "hits", "n_tags", "norm").orderBy("chr", "pos").collect()]
    assert got == [(1, "w", 5, 4, 16, 19, 5, 3, 11.0), (1, "w", 9, 1, 0, 0, 0, 0, 0.0), (2, "c", 70_000, 1, 4, 4, 2, 1, 2.0)]


def test_acceptance_shuffles_islands_and_not_their_points(spark):
    from tagloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    v = registry.Views(spark, sf)
    points = v.tag_position.select("chr", "strand", "pos").distinct().count()
    got = catalog.queries()["A15"](spark, sf)
    assert most_rows(got) < points and got.count() > 0


def test_clusters_are_formed_at_each_of_the_ten_cutoffs(spark):
    from tagloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    ten = (5e-3, 1e-3, 5e-4, 1e-4, 5e-5, 1e-5, 5e-6, 1e-6, 5e-7, 1e-7)
    best = [r["best_p"] for r in catalog.queries()["W9"](spark, sf).select("best_p").collect()]
    got = {r["cut"]: r["count"] for r in catalog.queries()["W7"](spark, sf).groupBy("cut").count().collect()}
    want = {c: sum(p <= c for p in best) for c in (0.9, 0.5, 0.2, *ten)}
    assert got == {c: n for c, n in want.items() if n} and any(want[c] for c in ten)


def test_run_summary_counts_accepted_clusters_and_their_reads(spark):
    """Clusters of too few of the size or of tags with too many hits don't count; a cluster in two blocks is one; a cutoff without clusters has a row."""
    cols = "cut double, chr long, cl long, main long, total long, hits long, n_hits long, n_tags long, norm double"
    sums = [(0.5, 1, 1, 90, 100, 4, 2, 2, 60.25), (0.5, 1, 2, 10, 100, 2, 2, 2, 100.0), (0.5, 1, 3, 99, 100, 44, 2, 2, 5.0), (0.5, 2, 1, 80, 100, 2, 1, 1, 50.0), (0.5, 2, 1, 100, 100, 3, 1, 1, 33.5), (0.1, 1, 1, 0, 100, 1, 1, 1, 9.0)]
    df = spark.createDataFrame(sums, cols)
    got = phasing.run_summary(df, (0.5, 0.1, 0.01), 24, 700.0, depth=1000)
    assert sorted(map(tuple, got.collect())) == [(0.01, 24, 0, 0.0, 0), (0.1, 24, 0, 0.0, 0), (0.5, 24, 2, 143.75, 205)]
    assert [r["scaled"] for r in phasing.run_summary(df, (0.5,), 24, None).collect()] == [0]


def test_clusters_are_looked_up_after_the_windows(spark):
    """Small clusters go and the others keep their numbers, across blocks too; no row but those of the table of clusters is shuffled for it."""
    rng = random.Random(13)
    at = [(c, s, 65_000 + p) for c in (1, 2) for s in "wc" for p in {rng.randrange(1500) for _ in range(80)}] + [(1, "w", 10), (1, "c", 300), (1, "w", 200_000), (2, "w", 131_000), *((2, "c", 131_500 + 21 * k) for k in range(12))]
    records = [(f"t{i % 7}", 21, c, s, p, i) for i, (c, s, p) in enumerate(at)]
    df = spark.createDataFrame(records, "tag string, len int, chr long, strand string, pos long, abun long")
    want = phasing.best_registers(phasing.occupied_clusters(df), 21)
    got = phasing.best_of_positions(phasing.tag_positions(df, 21), 21)
    assert 0 < want.count() < len(at) and want.select("cluster").distinct().count() > 1
    assert rows(got.select(*want.columns)) == rows(want)


def test_registers_in_one_shuffle_are_those_of_the_steps(spark):
    rng = random.Random(8)
    rows = {(c, s, rng.randrange(1, 2500)) for c in (1, 2) for s in "wc" for _ in range(250)} | {(1, "w", 40 + 21 * k) for k in range(30)} | {(1, "c", 38 + 21 * k) for k in range(30)} | {(1, "c", p) for p in (1, 2, 3)}
    pos = spark.createDataFrame([(c, 1, s, p, p + 3 * (s == "c")) for c, s, p in sorted(rows)], "chr long, cluster long, strand string, pos long, reg long")
    steps = phasing.assign_best_p(phasing.phasing_p(phasing.register_counts(pos, 21), 21).withColumn("p", F.round("p", 9)), 21)
    for width in (1 << 16, 1000):
        assert sorted(map(str, phasing.best_registers(pos, 21, width=width).select(*steps.columns).collect())) == sorted(map(str, steps.collect()))


def test_dispersions_have_one_row_for_each_gene(spark):
    counts = spark.createDataFrame([(f"g{k}", s, 5 + (k * 7 + j * 3) % 20) for k in range(50) for j, s in enumerate("abcd")], "gene string, sample string, cnt long")
    got = expression.estimate_dispersions(counts, ("a", "b"), ("c", "d"))
    assert most_rows(got) <= 50 and got.count() == 50
    x = np.array([1e-4, 0.3, 1.0, 7.5, 400.0, 1e6])
    assert np.allclose(expression.log_gamma_of(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_first_pairs_in_order_are_matched_before_the_rest(spark, monkeypatch):
    sizes = []
    real = loci._match
    monkeypatch.setattr(loci, "_match", lambda left, a, b: (sizes.append(left.count()), real(left, a, b))[1])
    rng = random.Random(3)
    pairs = [(f"n{k}", f"p{rng.randrange(12)}", k, j) for k in range(200) for j in range(3)]
    got = loci.greedy_matching(spark.createDataFrame(pairs, "a string, b string, k long, j long"), [F.col("k"), F.col("j")], first=90).collect()
    used, want = set(), []
    for a, b, k, j in pairs:
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, k, j))
    assert sorted(map(tuple, got)) == sorted(want)
    assert sizes[0] == 90 and sizes[1] < 100  # of 600 pairs


def test_cells_are_joined_once_for_clusters(spark, monkeypatch):
    from tagloom.plans import expression_queries

    read = []
    real = registry.Views.__getattr__
    monkeypatch.setattr(registry.Views, "__getattr__", lambda v, name: (read.append(name), real(v, name))[1])
    plan = expression_queries._components(registry.Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert read == ["cell"] and "lineitem" not in plan


def test_formats_are_written_compressed(spark, tmp_path):
    from tagloom.plans import source_queries

    lines = spark.range(5000).selectExpr("concat('chr1\tsrc\texon\t', id, '\tgene_id \"gT1\"; transcript_id \"T1\";') AS value")
    path = source_queries._text(lines.coalesce(1), registry.Views(spark, ""))
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part"))
    assert size < 5000 * 20
    assert [r["value"] for r in formats.numbered_lines(spark, path).orderBy("number").collect()] == [r["value"] for r in lines.collect()]


def test_compared_libraries_are_read_once_each(spark, tmp_path):
    for name, tags_ in (("a", [("A", 1), ("B", 2), ("B", 3), (None, 4), ("D", None)]), ("b", [("B", 5), ("C", 6), (None, 7)])):
        spark.createDataFrame(tags_, "tag string, abun long").write.parquet(f"{tmp_path}/{name}")
    got = tags.compare_libs(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", 1, "a"), ("B", 2, "common"), ("B", 3, "common"), (None, 4, "a"), ("D", None, "a"), ("C", 6, "b"), (None, 7, "b")], key=str)


def test_overlapping_exons_give_as_many_links_as_transcripts(spark, monkeypatch):
    seen = []
    real = expression.connected_components
    monkeypatch.setattr(expression, "connected_components", lambda e, *a: (seen.append(e.count()), real(e, *a))[1])
    exons = spark.createDataFrame([(f"T{k:02}", 1, "w", 10, 50) for k in range(30)] + [("T90", 1, "w", 50, 60), ("T90", 1, "c", 100, 110), ("T91", 1, "c", 110, 120), ("T92", 1, "c", 121, 130), ("T93", 1, "w", 61, 70)], "trans string, chr long, strand string, xstart long, xend long")
    got = dict(map(tuple, expression.cluster_transcripts(exons).collect()))
    assert got == {f"T{k:02}": "MT00" for k in range(30)} | {"T90": "MT00", "T91": "MT00", "T92": "MT92", "T93": "MT93"}
    assert seen == [31]  # 30 of the island on w, one of that on c; every pair would be 466
