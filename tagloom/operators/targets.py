"""Targets and degradome."""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.seq import base_count
from tagloom.operators import seeds
from tagloom.operators.expression import quantiles
from tagloom.operators.seeds import GAP_MARGIN, MGAP_MORE, MGAP_OPEN, MISMATCH, TGAP_MORE, TGAP_OPEN, cost_limit
from tagloom.runtime import once, ship


def match_validated(pred: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """J17. Predictions with whether a validated one has the same keys (null-safe)."""
    v = valid.select(*[F.col(k).alias(f"v_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"v_{k}")) for k in keys]
    return pred.join(v, on, "left_semi").withColumn("validated", F.lit(True)).unionByName(pred.join(v, on, "left_anti").withColumn("validated", F.lit(False)))


def reverse_map(hits: DataFrame, coords: DataFrame) -> DataFrame:
    """J19. Feature coordinates on the genome: w adds start - 1; c counts from the end and swaps. hits: feature, fstart, fend."""
    c = coords.select(F.col("name").alias("cn"), F.col("chr"), F.col("strand"), "gstart", "gend")
    both = hits.join(c, F.col("feature") == F.col("cn")).drop("cn")
    w = F.col("strand") == "w"
    return both.withColumn("mstart", F.when(w, F.col("gstart") - 1 + F.col("fstart")).otherwise(F.col("gend") + 1 - F.col("fend"))).withColumn("mend", F.when(w, F.col("gstart") - 1 + F.col("fend")).otherwise(F.col("gend") + 1 - F.col("fstart")))


def window_abundance(sites: DataFrame, tagpos: DataFrame, small: int = 1, large: int = 5) -> DataFrame:
    """J20. Abundance within a small and a large window of each site (site, chr, strand, pos); sites without any in the small one go.

    Sites are exploded to the offsets, so the match is an equality join.
    """
    at = sites.select("site", F.col("chr").alias("schr"), F.col("strand").alias("ss"), F.col("pos").alias("spos"), F.explode(F.sequence(F.lit(-large), F.lit(large))).alias("off"))
    per = tagpos.groupBy("chr", "strand", "pos").agg(F.sum("abun").alias("abun"))
    hit = at.join(per, (F.col("schr") == F.col("chr")) & (F.col("ss") == F.col("strand")) & (F.col("spos") + F.col("off") == F.col("pos")))
    agg = hit.groupBy("site").agg(F.coalesce(F.sum(F.when(F.abs("off") <= small, F.col("abun"))), F.lit(0)).alias("small"), F.sum("abun").alias("large"))
    return agg.filter("small > 0").withColumn("ratio", F.col("small") / F.col("large"))


def map_tags_exact(tags: DataFrame, seqs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """J21. Exact, same-strand, end-to-end hits (tag, name, at) of tags of the given sizes.

    Each place of a sequence gives one row, whatever the number of sizes: as many letters as the longest tag has. It meets the tags that begin with its
    first letters, as many as the shortest has, and the rest of a tag is compared.
    """
    shortest, longest = min(sizes), max(sizes)
    own = tags.filter(F.length("tag").isin(*sizes)).select("tag", F.substring("tag", 1, shortest).alias("head")).distinct()
    at = F.explode(F.sequence(F.lit(1), F.length("seq") - shortest + 1)).alias("at")
    parts = seqs.filter(F.length("seq") >= shortest).select("name", "seq", at).select("name", "at", F.substr("seq", F.col("at"), F.lit(longest)).alias("sub"))
    both = parts.join(own, F.substring("sub", 1, shortest) == F.col("head"))
    return both.filter(F.col("sub").startswith(F.col("tag"))).select("tag", "name", "at")


def pair_columns(mir: Column, tar: Column) -> Column:
    """Columns, 5' to 3' of the miRNA, of an aligned pair as structs (i, m, t, kind).

    tar is the target complemented and reversed to the miRNA's direction, so equal letters pair: kind M match, W wobble (A for G, C for
    U or T), X mismatch, B gap in the miRNA, D gap in the target. i is the miRNA's own position, which a gap in it doesn't advance.
    """
    chars = lambda c: F.split(F.translate(F.upper(c), "U", "T"), "")
    both = F.zip_with(chars(mir), chars(tar), lambda m, t: F.struct(m.alias("m"), t.alias("t")))
    kind = lambda p: (
        F.when(p["m"] == "-", "B").when(p["t"] == "-", "D").when(p["m"] == p["t"], "M")
        .when((p["m"] == "G") & (p["t"] == "A") | (p["m"] == "T") & (p["t"] == "C"), "W").otherwise("X")
    )
    place = lambda k: F.length(F.replace(F.substr(mir, F.lit(1), k), F.lit("-"), F.lit(""))) + 1
    return F.transform(both, lambda p, k: F.struct(place(k).alias("i"), p["m"].alias("m"), p["t"].alias("t"), kind(p).alias("kind")))


def pair_profile(pairs: DataFrame) -> DataFrame:
    """P19. Positions of mismatches, wobbles and gaps of (id, mir, tar), and validity: no miRNA gap at 9 to 11 and none in the target that
    leaves off there, at most two miRNA gaps, one target gap, five mismatches, and six mismatches and wobbles."""
    df = once(pairs.select("id", F.col("mir").alias("__m"), F.col("tar").alias("__t")), mir=F.col("__m"), tar=F.col("__t"))
    df = once(df, p=pair_columns(F.col("mir"), F.col("tar")))
    at = lambda k: F.transform(F.filter("p", lambda x: x["kind"] == k), lambda x: x["i"])
    df = df.select("id", "mir", "tar", "p", at("X").alias("mis"), at("W").alias("wob"), at("B").alias("mgap"), at("D").alias("tgap"))
    mid = F.exists("mgap", lambda i: i.between(9, 11)) | F.exists("tgap", lambda i: (i + 1).between(9, 11))
    valid = ~mid & (F.size("mgap") <= 2) & (F.size("tgap") <= 1) & (F.size("mis") <= 5) & (F.size("mis") + F.size("wob") <= 6)
    return df.withColumn("valid", valid)


def score_pairs(profiles: DataFrame, seeded: bool = False) -> DataFrame:
    """P20. Score of a profile. Seedless: mismatch 1, gap 1.5, wobble 0.5 or 1.5 next to a mismatch, 2.5 for mismatches at both 10 and 11.
    Seeded: mismatch 1, gap 1, wobble 0.5, each of them twice that at positions 2 to 13."""
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda a, i: a + f(i))
    if seeded:
        rate = lambda x: lambda i: F.when(i.between(2, 13), 2.0 * x).otherwise(x)
        return profiles.withColumn("score", total("mis", rate(1.0)) + total("mgap", rate(1.0)) + total("tgap", rate(1.0)) + total("wob", rate(0.5)))
    joint = F.array_contains("mis", 10) & F.array_contains("mis", 11)
    mis = total("mis", lambda i: F.when(joint & i.isin(10, 11), 1.25).otherwise(1.0))
    wob = total("wob", lambda i: F.when(F.array_contains("mis", i - 1) | F.array_contains("mis", i + 1), 1.5).otherwise(0.5))
    return profiles.withColumn("score", mis + wob + 1.5 * (F.size("mgap") + F.size("tgap")))


def _plain(c: Column | str) -> Column:
    return F.translate(F.upper(c), "U", "T")


#: A block's miRNAs and letters, those of the smallest blocks, the tasks for each core, and the letters of a part of a sequence.
BLOCK_MIRS, BLOCK_LETTERS, LEAST_MIRS, LEAST_LETTERS, TASKS, PART = 4096, 1 << 21, 256, 1 << 17, 6, 4096


def _seed_hits(mirs: DataFrame, seqs: DataFrame, most: int, gapped: bool, limit: int = 6) -> DataFrame:
    """(mir, mseq, name, right, fix, near): places of sequences that hold a half of a miRNA's reverse complement with at most ``most`` changes and can be a
    site. Without gaps: of at most ``limit`` non-matches, fix its first letter, near the site. gapped: also halves with one letter inserted; a site in the cost
    limit can begin at fix, or end there for right, and near are the letters from there on, enough for the widest site.

    Blocks of miRNAs meet blocks of parts of sequences, each pair in one task (`operators/seeds.py`): what a task holds doesn't depend on the tables, and
    no table of words is written, shuffled or sent to the driver. Rows that repeat are searched once.
    """
    spark = mirs.sparkSession
    ship(spark)
    m = mirs.select(F.col("name").alias("mir"), "mseq").filter(F.length("mseq") > 0).distinct()
    s = seqs.select("name", "seq").filter(F.length("seq") > 0).distinct()
    n_mirs, longest = m.agg(F.count("*"), F.coalesce(F.max(F.length("mseq")), F.lit(1))).first()
    letters = seqs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    of = lambda n, size: max(-(-n // size), 1)
    rows, columns, enough = of(n_mirs, BLOCK_MIRS), of(letters, BLOCK_LETTERS), TASKS * spark.sparkContext.defaultParallelism
    rows = max(rows, min(of(n_mirs, LEAST_MIRS), of(enough, columns)))
    columns = max(columns, min(of(letters, LEAST_LETTERS), of(enough, rows)))
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / PART))).alias("i")
    parts = s.select("name", "seq", cut).select("name", F.substr("seq", F.col("i") * PART + 1, F.lit(PART + longest + 2)).alias("text"), (F.col("i") * PART + 1).cast("int").alias("from"))
    meet = lambda n, f: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)).alias("pair")
    column, row = F.pmod(F.xxhash64("name", "text", "from"), F.lit(columns)), F.pmod(F.xxhash64("mir", "mseq"), F.lit(rows))
    left = m.select(F.lit(True).alias("is_mir"), F.col("mir").alias("name"), F.col("mseq").alias("text"), F.lit(0).alias("from"), meet(columns, lambda c: c * rows + row))
    both = left.unionByName(parts.select(F.lit(False).alias("is_mir"), "name", "text", "from", meet(rows, lambda r: column * rows + r)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches))
        own = block.filter(block["is_mir"])
        other = block.filter(pc.invert(block["is_mir"]))
        if not own.num_rows or not other.num_rows:
            return
        ids, words = own["name"].to_pylist(), own["text"].to_pylist()
        names, texts, froms = (other[c].to_pylist() for c in ("name", "text", "from"))
        for r, part, at, right in seeds.find(texts, words, PART, most, limit, gapped):
            cols: list[list] = [[] for _ in range(6)]
            for i, j, x in zip(r.tolist(), part.tolist(), at.tolist(), strict=True):
                wide = len(words[i]) + (2 if gapped else 0)
                near = texts[j][max(x - wide + 1, 0) : x + 1] if right else texts[j][x : x + wide]
                for col, v in zip(cols, (ids[i], words[i], names[j], right, froms[j] + x, near), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()), strict=True)], ["mir", "mseq", "name", "right", "fix", "near"])

    return both.repartition(min(2 * rows * columns, 4096), "pair").groupBy("pair").applyInArrow(run, "mir string, mseq string, name string, right boolean, fix int, near string")


def predict_targets(mirs: DataFrame, seqs: DataFrame, most_mis: int = 5, most_both: int = 6) -> DataFrame:
    """J22. Ungapped sites of each miRNA (name mir, mseq) on each sequence: (mir, name, at, site, score).

    Of at most ``most_both`` non-matches one half of the site holds at most half. So each half of the reverse complement is looked up with all words of so
    many changes, and places of more than ``most_both`` non-matches in all go there. Letters other than ACGT count as A on the way to these candidates,
    which only adds some; they are then profiled.
    """
    cand = _seed_hits(mirs, seqs, most_both // 2, False, most_both).select("mir", "mseq", "name", F.col("fix").alias("at"), F.col("near").alias("site")).distinct()
    tar = F.translate(_plain(F.reverse("site")), "ACGT", "TGCA")
    prof = pair_profile(cand.select(F.struct("mir", "name", "at", "site").alias("id"), F.col("mseq").alias("mir"), tar.alias("tar")))
    good = score_pairs(prof.filter((F.size("mis") <= most_mis) & (F.size("mis") + F.size("wob") <= most_both)))
    return good.select("id.mir", "id.name", "id.at", "id.site", "score")


def align_gapped(mir: np.ndarray, tar: np.ndarray, start: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For many pairs at once, by dynamic programming in a band: (gaps in the miRNA, gaps in the target) -> (cost, places of the gaps) of the cheapest
    alignment of the whole miRNA with the target from ``start`` on. mir: rows x n codes, tar: rows x letters codes, below 0 where there is none.

    At most two gaps in the miRNA and one in the target, none of them near the ends or where P19 allows none. Places: the number of miRNA letters before
    the first and second gap in it, and of the letter that the target lacks, or -1. Of equal costs the one whose gaps come last is taken.
    """
    rows, n = mir.shape
    far = np.full(rows, 10_000, np.int32)
    none = np.full((rows, 3), -1, np.int8)
    # state: gaps in the miRNA, gaps in the target, whether the last column is a gap in the miRNA
    now = {(0, 0, 0): (np.zeros(rows, np.int32), none)}

    def better(states: dict, key: tuple, cost: np.ndarray, gaps: np.ndarray) -> None:
        if key in states:
            old, old_gaps = states[key]
            take = cost < old
            cost, gaps = np.where(take, cost, old), np.where(take[:, None], gaps, old_gaps)
        states[key] = (cost, gaps)

    for i in range(n + 1):
        if GAP_MARGIN <= i <= n - GAP_MARGIN and not 9 <= i + 1 <= 11:  # gaps in the miRNA before letter i
            for m in (0, 1):
                for (gm, gt, run), (cost, gaps) in list(now.items()):
                    if gm == m:
                        j = start + i + gm - gt
                        there = tar[:, j] >= 0 if j < tar.shape[1] else np.zeros(rows, bool)
                        marked = gaps.copy()
                        marked[:, m] = i
                        better(now, (gm + 1, gt, 1), np.where(there, cost + (MGAP_MORE if run else MGAP_OPEN + MGAP_MORE), far), marked)
        if i == n:
            break
        after: dict = {}
        for (gm, gt, _), (cost, gaps) in now.items():
            j = start + i + gm - gt
            if j < tar.shape[1]:
                t = tar[:, j]
                better(after, (gm, gt, 0), np.where(t < 0, far, cost + MISMATCH * (t != mir[:, i])), gaps)
            if gt == 0 and GAP_MARGIN < i + 1 <= n - GAP_MARGIN and not 9 <= i + 2 <= 11:
                marked = gaps.copy()
                marked[:, 2] = i
                better(after, (gm, 1, 0), cost + TGAP_OPEN + TGAP_MORE, marked)
        now = after
    out: dict = {}
    for (gm, gt, _), (cost, gaps) in now.items():
        better(out, (gm, gt), cost, gaps)
    return out


def _gapped(word: str, places: list[int]) -> str:
    """word with a gap before each of the places, counted in its letters."""
    for p in sorted(places, reverse=True):
        word = word[:p] + "-" + word[p:]
    return word


def predict_gapped_targets(mirs: DataFrame, seqs: DataFrame) -> DataFrame:
    """J22 with bulges. (mir, name, at, site, mir_aln, tar_aln, score): sites that a miRNA meets with one or two gaps in it, one in the target, or both, of each
    place and length the cheapest alignment; gaps and mismatches as P19 allows, the score as P20 says.

    Costs are those of the aligner that the scripts call in exhaustive mode. Under their limit one gap leaves room for four mismatches, two
    neighbouring ones or one in the target for three, two apart for one, and gaps on both sides for none. So one half of the miRNA is without a gap and has
    three changes at most, or has one gap in it and no change: the halves' words are looked up as for sites without gaps, and a hit fixes
    one end of the site. A place whose unlike letters fit no way to place the gaps goes there. A banded dynamic programme, in arrays over many hits,
    aligns the whole miRNA from the others.
    """
    hits = _seed_hits(mirs, seqs, 3, True)
    # the target's part in the miRNA's direction; letters beyond the sequence are missing
    wide, part = F.length("mseq") + 2, F.translate(_plain(F.reverse("near")), "ACGT", "TGCA")
    tar = F.when(F.col("right"), F.rpad(part, wide, "~")).otherwise(F.lpad(part, wide, "~"))
    hits = hits.select("mir", _plain("mseq").alias("mplain"), F.length("mseq").alias("n"), "name", "right", "fix", tar.alias("tar"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df = b.to_pandas()
            cols: dict[str, list] = {c: [] for c in ("mir", "name", "at", "len", "cost", "mir_aln", "tar_aln")}
            for (n, is_right), g in df.groupby(["n", "right"]):
                n = int(n)
                m = np.frombuffer("".join(g["mplain"]).encode("ascii", "replace"), np.uint8).reshape(len(g), n).astype(np.int16)
                t = np.frombuffer("".join(g["tar"]).encode("ascii", "replace"), np.uint8).reshape(len(g), n + 2).astype(np.int16)
                t = np.where(t == ord("~"), -1, t)
                mirs_, names, words, parts, fix = (g[c].tolist() for c in ("mir", "name", "mplain", "tar", "fix"))
                for start in (0,) if is_right else (0, 1, 2, 3):
                    for (gm, gt), (cost, gaps) in align_gapped(m, t, start).items():
                        if gm + gt == 0 or not is_right and start != 2 - gm + gt:
                            continue
                        size = n + gm - gt
                        for r in np.flatnonzero(cost <= cost_limit(n)).tolist():
                            own = [int(x) for x in gaps[r, :2] if x >= 0]
                            said = parts[r][start : start + size]
                            lack = int(gaps[r, 2])
                            cols["mir"].append(mirs_[r])
                            cols["name"].append(names[r])
                            cols["at"].append(fix[r] - size + 1 if is_right else fix[r])
                            cols["len"].append(size)
                            cols["cost"].append(int(cost[r]))
                            cols["mir_aln"].append(_gapped(words[r], own))
                            cols["tar_aln"].append(_gapped(said, [lack + sum(p <= lack for p in own)] if lack >= 0 else []))
            yield pa.RecordBatch.from_arrays([pa.array(cols[c], k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], list(cols))

    found = hits.mapInArrow(run, "mir string, name string, at int, len int, cost int, mir_aln string, tar_aln string")
    best = found.groupBy("mir", "name", "at", "len").agg(F.min(F.struct("cost", "mir_aln", "tar_aln")).alias("b"))
    prof = pair_profile(best.select(F.struct("mir", "name", "at").alias("id"), F.col("b.mir_aln").alias("mir"), F.col("b.tar_aln").alias("tar"))).filter("valid")
    site = F.translate(F.reverse(F.replace("tar", F.lit("-"), F.lit(""))), "ACGT", "TGCA")
    return score_pairs(prof).select("id.mir", "id.name", "id.at", site.alias("site"), F.col("mir").alias("mir_aln"), F.col("tar").alias("tar_aln"), "score")


def filter_mismatch_at(profiles: DataFrame, positions: tuple[int, ...]) -> DataFrame:
    """P10. Pairs with a mismatch or wobble at one of the miRNA's positions."""
    return profiles.filter(F.arrays_overlap(F.concat("mis", "wob"), F.array(*[F.lit(p) for p in positions])))


def cigar_steps() -> Column:
    """The steps (n, o) of the column cigar that read bases or target bases take part in: all but H, N and P."""
    part = lambda p: F.regexp_extract_all("cigar", F.lit(p), F.lit(1))
    return F.zip_with(part(r"(\d+)[MIDSX=]"), part(r"\d+([MIDSX=])"), lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("o")))


def rebuild_alignment(df: DataFrame) -> DataFrame:
    """P18. Gapped miRNA and target strings from (id, seq, cigar, target): I a gap in the target, D a gap in the miRNA.

    The CIGAR's steps are folded over both strings; target is the reference part that the alignment covers, without skipped bases (N). Clipped
    bases of the read (S) are passed over; those that are cut off (H), skipped bases and padding (P) are in neither string.
    """
    steps = cigar_steps()
    start = F.struct(F.lit("").alias("m"), F.lit("").alias("t"), F.lit(1).alias("i"), F.lit(1).alias("j"))

    def step(a: Column, s: Column) -> Column:
        n, clip, seq_on, tar_on = s["n"], s["o"] == "S", s["o"] != "D", ~s["o"].isin("I", "S")
        gap = F.when(clip, "").otherwise(F.repeat(F.lit("-"), n))
        return F.struct(
            F.concat(a["m"], F.when(seq_on & ~clip, F.substr("seq", a["i"], n)).otherwise(gap)).alias("m"), F.concat(a["t"], F.when(tar_on, F.substr("target", a["j"], n)).otherwise(gap)).alias("t"),
            (a["i"] + F.when(seq_on, n).otherwise(0)).alias("i"), (a["j"] + F.when(tar_on, n).otherwise(0)).alias("j"),
        )

    return df.withColumn("x", F.aggregate(steps, start, step)).select("id", F.col("x.m").alias("mir"), F.col("x.t").alias("tar"))


def target_from_md(df: DataFrame) -> DataFrame:
    """P18. (id, seq, cigar, target) from (id, seq, cigar, md): the part of the reference that a read covers. In the MD tag a number copies so many
    bases of the read, which inserted ones are no part of, a letter is the reference's at a mismatch, and ^ begins deleted ones."""
    plain = F.aggregate(
        cigar_steps(), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, s: F.struct(F.concat(a["s"], F.when(s["o"].isin("M", "X", "="), F.substr("seq", a["i"], s["n"])).otherwise("")).alias("s"), (a["i"] + F.when(s["o"] != "D", s["n"]).otherwise(0)).alias("i")),
    )["s"]
    parts = F.regexp_extract_all("md", F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))

    def step(a: Column, x: Column) -> Column:
        n = F.coalesce(x.try_cast("int"), F.lit(0))
        own = F.when(x.startswith("^"), F.substr(x, F.lit(2))).when(x.rlike("^[A-Z]"), x).otherwise(F.substr("__plain", a["i"], n))
        return F.struct(F.concat(a["t"], own).alias("t"), (a["i"] + F.when(x.startswith("^"), 0).when(x.rlike("^[A-Z]"), 1).otherwise(n)).alias("i"))

    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("i"))
    return df.withColumn("__plain", plain).select("id", "seq", "cigar", F.aggregate(parts, start, step)["t"].alias("target"))


def filter_pare(df: DataFrame, most: float, least: float, ratio: float, column: str = "vals") -> DataFrame:
    """P21. Rows of score up to most whose small-window sum reaches least and ratio to the large sum; columns alternate small, large."""
    part = lambda odd: F.aggregate(F.filter(column, lambda x, i: i % 2 == odd), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("small", part(0)).withColumn("large", part(1)).filter((F.col("score") <= most) & (F.col("small") >= least) & (F.col("small") >= ratio * F.col("large")))


def pair_features(profiles: DataFrame) -> DataFrame:
    """P22. Totals of a pair's kinds and bases, whole and in the seed (2 to 10), its number of columns, and position by position the pair's kind
    and base (kinds: one letter for each column; bases: the miRNA's)."""
    count = lambda f: F.size(F.filter("p", f))
    in_seed = lambda x: x["i"].between(2, 10)
    gc = lambda x: (x["kind"] == "M") & x["m"].isin("G", "C")
    au = lambda x: (x["kind"] == "M") & x["m"].isin("A", "T")
    both = lambda f, g: lambda x: f(x) & g(x)
    cols = []
    for name, f in (("gc", gc), ("au", au), ("wobble", lambda x: x["kind"] == "W"), ("mismatch", lambda x: x["kind"] == "X"), ("bulge", lambda x: x["kind"] == "D"), ("gap", lambda x: x["kind"] == "B")):
        cols += [count(f).alias(name), count(both(f, in_seed)).alias(f"seed_{name}")]
    line = lambda field: F.array_join(F.transform("p", lambda x: x[field]), "")
    return profiles.select("id", *cols, F.size("p").alias("columns"), line("kind").alias("kinds"), line("m").alias("bases"))


def pair_profile_table(profiles: DataFrame) -> DataFrame:
    """A28. Per position the share of each kind."""
    x = profiles.select(F.explode("p").alias("x")).select(F.col("x.i").alias("i"), F.col("x.kind").alias("kind"))
    out = []
    for k, n in (("M", "match"), ("W", "wobble"), ("X", "mismatch"), ("B", "mgap"), ("D", "tgap")):
        out.append((100.0 * F.count(F.when(F.col("kind") == k, 1)) / F.count("*")).alias(n))
    return x.groupBy("i").agg(*out)


def density(mapped: DataFrame) -> DataFrame:
    """A10. Hits per gene and location, from (gene, loc, hits) rows; locations of one tag after another are summed."""
    return mapped.groupBy("gene", "loc").agg(F.sum("hits").alias("hits"))


def categorize_genic(dens: DataFrame) -> DataFrame:
    """A11. 4 for one hit, 3 up to the gene's median, above it 2 below the maximum, 1 for the tied and 0 for the only maximum."""
    per = dens.groupBy(F.col("gene").alias("g")).agg(F.expr("percentile(hits, 0.5)").alias("med"), F.max("hits").alias("top"))
    ties = dens.groupBy(F.col("gene").alias("g2"), F.col("hits").alias("h2")).agg(F.count("*").alias("n_same"))
    df = dens.join(per, F.col("gene") == F.col("g")).join(ties, (F.col("gene") == F.col("g2")) & (F.col("hits") == F.col("h2")))
    cat = F.when(F.col("hits") == 1, 4).when(F.col("hits") <= F.col("med"), 3).when(F.col("hits") != F.col("top"), 2).when(F.col("n_same") > 1, 1).otherwise(0)
    return df.select("gene", "loc", "hits", cat.alias("category"))


def categorize_intergenic(dens: DataFrame) -> DataFrame:
    """A12. By percentiles of all hits above 2: up to 2 hits 4, up to the median 3, to the 75th 2, to the 90th 1, else 0."""
    q = quantiles(dens.filter("hits > 2").withColumn("__all", F.lit(1)), "__all", "hits", (0.5, 0.75, 0.9)).groupBy().agg(F.first("q").alias("q"))
    df = dens.crossJoin(F.broadcast(q))  # one row, of nulls without hits above 2
    cat = F.when(F.col("hits") <= 2, 4).when(F.col("hits") <= F.col("q")[0], 3).when(F.col("hits") <= F.col("q")[1], 2).when(F.col("hits") <= F.col("q")[2], 1).otherwise(0)
    return df.select("gene", "loc", "hits", cat.alias("category"))


def eligible_bases(seqs: DataFrame, margin: int = 0) -> DataFrame:
    """One row (bases): the unambiguous bases of all sequences (P23), inside the margins."""
    return seqs.agg(F.sum(base_count(F.col("seq"), margin)).alias("bases"))


def category_fractions(categories: DataFrame, bases: int | DataFrame) -> DataFrame:
    """A13. Positions per category and their share of the eligible bases: a number, or the one row of eligible_bases."""
    per = categories.groupBy("category").agg(F.count("*").alias("n"))
    if isinstance(bases, int):
        return per.withColumn("fraction", F.col("n") / bases)
    return per.crossJoin(F.broadcast(bases)).select("category", "n", (F.col("n") / F.col("bases")).alias("fraction"))


# Distances of cleavage sites from a target's end, and the lengths of miRNAs that have one more.
CLEAVE, CLEAVE_LONG, LONG_MIRNAS = (9, 10, 11), (9, 10, 11, 12), (23, 24)


def best_cleave(targets: DataFrame, cats: DataFrame, standard: bool = False, reach: int = 5) -> DataFrame:
    """W19. Per target (id, gene, tend, mlen) the best cleavage site among end - offsets: least category, most hits, then first; with
    the abundance within reach of it and the ratio. The offsets depend on the miRNA's length, unless ``standard``."""
    long = F.lit(False) if standard else F.coalesce(F.col("mlen").isin(*LONG_MIRNAS), F.lit(False))
    t = targets.select("id", F.col("gene").alias("tg"), "tend", long.alias("long"))
    # what a target meets depends on its end alone: looked up once for each end, however many targets share it
    offsets = F.when(F.col("long"), F.array(*[F.lit(o) for o in CLEAVE_LONG])).otherwise(F.array(*[F.lit(o) for o in CLEAVE]))
    at = t.select("tg", "tend", "long").distinct().withColumn("o", F.explode(offsets))
    hit = at.join(cats, (F.col("tg") == F.col("gene")) & (F.col("tend") - F.col("o") == F.col("loc")))
    best = hit.groupBy("tg", "tend", "long").agg(F.min(F.struct("category", (-F.col("hits")).alias("nh"), "loc", "gene")).alias("b"))
    sites = best.select(F.col("tg").alias("wg"), F.col("b.loc").alias("at")).distinct()
    around = sites.withColumn("l", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach))).join(cats, (F.col("wg") == F.col("gene")) & (F.col("l") == F.col("loc"))).groupBy("wg", "at").agg(F.sum("hits").alias("window"))
    ends = best.join(around, (F.col("tg") == F.col("wg")) & (F.col("b.loc") == F.col("at"))).select(F.col("tg").alias("eg"), F.col("tend").alias("ee"), F.col("long").alias("el"), "b", "window")
    # a target may be given with several ends
    found = t.join(ends, (F.col("tg") == F.col("eg")) & (F.col("tend") == F.col("ee")) & (F.col("long") == F.col("el"))).groupBy("id").agg(F.min(F.struct("b", "window")).alias("x"))
    hits = -F.col("x.b.nh")
    return found.select("id", F.col("x.b.gene").alias("gene"), F.col("x.b.loc").alias("site"), F.col("x.b.category").alias("category"), hits.alias("site_hits"), F.col("x.window").alias("window"), (hits / F.col("x.window")).alias("ratio"))


def cleavage_p(targets: DataFrame, fractions: DataFrame) -> DataFrame:
    """S2. 1 - (1 - f)^n: n predictions of the miRNA with the same score (a fractional score counts its whole integer class).
    Both counts are within a miRNA's class, by which rows are shuffled once."""
    targets = targets.withColumn("__cls", F.floor("score")).repartition("mir", "__cls")
    same, cls = Window.partitionBy("mir", "__cls", "score"), Window.partitionBy("mir", "__cls")
    n = F.when(F.col("score") == F.floor("score"), F.count("*").over(same)).otherwise(F.count("*").over(cls))
    f = fractions.select(F.col("category").alias("c"), "fraction")
    return targets.withColumn("n", n).drop("__cls").join(f, F.col("category") == F.col("c"), "left").withColumn("p", 1.0 - F.pow(1.0 - F.coalesce("fraction", F.lit(0.0)), F.col("n"))).drop("c", "fraction")


def filter_validated(df: DataFrame, noise: bool = True) -> DataFrame:
    """S3. Corrected p = p / ratio; with the noise filter at most .25, ratio at least .25 and category not 4, else below .5."""
    df = df.withColumn("corr_p", F.try_divide("p", "ratio"))
    return df.filter("corr_p <= 0.25 AND ratio >= 0.25 AND category <> 4") if noise else df.filter("corr_p < 0.5")


def score_matrix(hits: DataFrame, mirs: tuple[str, ...]) -> DataFrame:
    """A23. Least score per target and miRNA, - if absent."""
    return hits.groupBy("target").agg(*[F.coalesce(F.min(F.when(F.col("mir") == m, F.col("score"))).cast("string"), F.lit("-")).alias(m) for m in mirs])


def filter_similarity(pairs: DataFrame, least: float, n: int) -> DataFrame:
    """A24. Pairs (x, y, sim) both of whose names have n other partners or more at the least similarity."""
    good = pairs.filter(F.col("sim") >= least).filter("x <> y").select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p")).select("p.a", "p.b").distinct()
    many = good.groupBy("a").agg(F.count("*").alias("k")).filter(F.col("k") >= n).select("a")
    return pairs.join(many, F.col("x") == F.col("a"), "left_semi").join(many, F.col("y") == F.col("a"), "left_semi")


def duplex_asymmetry(pairs: DataFrame) -> DataFrame:
    """A29. Share of pairs (mir, star) of unequal lengths, without those of no prediction."""
    known = pairs.filter(F.col("star") != "NO PREDICTION")
    uneven = F.count(F.when(F.length("mir") != F.length("star"), 1))
    return known.agg(F.count("*").alias("n"), uneven.alias("uneven"), F.try_divide(100.0 * uneven, F.count("*")).alias("percent"))


def score_histogram(real: DataFrame, shuffled: DataFrame) -> DataFrame:
    """A30. Counts and running counts by score of real and shuffled queries."""
    both = real.select("score", F.lit(1).alias("r")).unionByName(shuffled.select("score", F.lit(0).alias("r")))
    per = both.groupBy("score").agg(F.sum("r").alias("real"), F.sum(1 - F.col("r")).alias("shuffled"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)  # one row per score
    return per.withColumn("run_real", F.sum("real").over(w)).withColumn("run_shuffled", F.sum("shuffled").over(w))


def chunk_genome(seqs: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(chr, chunk, cseq): sequences in chunks, so that no chromosome has to meet its intervals in one row."""
    k = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int"))).alias("chunk")
    return seqs.filter(F.length("seq") > 0).select(F.col("name").alias("chr"), "seq", k).select("chr", "chunk", F.substr("seq", F.col("chunk") * size + 1, F.lit(size)).alias("cseq"))


def extract_seqs(chunks: DataFrame, coords: DataFrame, size: int = 1 << 16, flank: int = 0) -> DataFrame:
    """J23. (id, seq) of 1-based intervals (id, chr, strand, istart, iend), flanked, clipped to the chromosome, reverse-complemented on c;
    a null iend is the chromosome's end."""
    lens = chunks.groupBy(F.col("chr").alias("lchr")).agg(F.max(F.col("chunk") * size + F.length("cseq")).alias("clen"))
    c = coords.join(lens, F.col("chr") == F.col("lchr")).select("id", F.col("chr").alias("ichr"), "strand", F.greatest(F.col("istart") - flank, F.lit(1)).alias("s"), F.least(F.coalesce(F.col("iend") + flank, F.col("clen")), F.col("clen")).alias("e")).filter("s <= e")
    c = c.withColumn("k", F.explode(F.sequence(F.floor((F.col("s") - 1) / size).cast("int"), F.floor((F.col("e") - 1) / size).cast("int"))))
    part = c.join(chunks, (F.col("ichr") == F.col("chr")) & (F.col("k") == F.col("chunk")))
    lo = F.greatest(F.col("s") - F.col("k") * size, F.lit(1)).cast("int")
    hi = F.least(F.col("e") - F.col("k") * size, F.lit(size)).cast("int")
    part = part.select("id", "strand", "k", F.substr("cseq", lo, hi - lo + 1).alias("x"))
    full = part.groupBy("id", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]), "").alias("seq"))
    return full.select("id", F.when(F.col("strand") == "c", F.reverse(F.translate("seq", "ACGT", "TGCA"))).otherwise(F.col("seq")).alias("seq"))


def transcript_seqs(chunks: DataFrame, exons: DataFrame, size: int = 1 << 16) -> DataFrame:
    """J24. Exons (trans, chr, strand, xstart, xend) stitched in order, reverse-complemented on c. A transcript of unknown strand (null, or neither w nor c)
    is given in both orientations, the complement as trans_rc."""
    own = exons.select(F.struct("trans", "strand", "xstart", "xend").alias("id"), "chr", F.lit("w").alias("strand"), F.col("xstart").alias("istart"), F.col("xend").alias("iend"))
    x = extract_seqs(chunks, own, size).select("id.trans", "id.strand", "id.xstart", "id.xend", "seq")
    full = x.groupBy("trans", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("xstart", "xend", "seq"))), lambda p: p["seq"]), "").alias("seq"))
    other = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    row = lambda name, seq: F.struct(name.alias("trans"), seq.alias("seq"))
    same, back = row(F.col("trans"), F.col("seq")), row(F.col("trans"), other)
    ways = F.when(F.col("strand") == "w", F.array(same)).when(F.col("strand") == "c", F.array(back)).otherwise(F.array(same, row(F.concat("trans", F.lit("_rc")), other)))
    return full.select(F.explode(ways).alias("x")).select("x.*")


def promoters(chunks: DataFrame, genes: DataFrame, length: int, size: int = 1 << 16) -> DataFrame:
    """J25. Sequence upstream of each gene's 5' end (gene, chr, strand, tstart, tend)."""
    w = F.col("strand") == "w"
    c = genes.select(F.col("gene").alias("id"), "chr", "strand", F.when(w, F.col("tstart") - length).otherwise(F.col("tend") + 1).alias("istart"), F.when(w, F.col("tstart") - 1).otherwise(F.col("tend") + length).alias("iend")).filter("iend >= 1")
    return extract_seqs(chunks, c, size)
