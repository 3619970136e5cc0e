"""Loci across libraries: merging, ranking, placement, triggers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.intervals import bin_join, dice, point_join, round_double
from tagloom.operators.islands import number_rows, number_runs
from tagloom.runtime import checkpoint, few_rows, ship, store

LOCUS = ["name", "neglog_p", "chr", "lstart", "lend", "lib"]
SHARE = 4096  # loci of one block of a merge


def _numbered(loci: DataFrame, order: list) -> DataFrame:
    """Loci numbered along their chromosome (near), with the columns k0, k1, ... of the rule's order, in blocks of neighbours. Loci have both ends.

    An island of overlapping loci is in one block as far as its first SHARE loci go (even block numbers: those of all islands that begin among SHARE loci),
    and what is left of longer ones is cut at every SHARE loci (odd numbers). So a block has less than twice SHARE, and only long islands lie in several.
    """
    near = number_runs(loci, ["chr"], "lstart", "lend", ["lend", "lib", "name", "neglog_p"], "near", "isle")
    by = lambda c: 2 * F.floor(F.col(c) / SHARE)
    block = F.when(F.col("near") - F.col("isle") < SHARE, by("isle")).otherwise(by("near") + 1)
    return near.withColumn("block", block).withColumns({f"k{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate([*order, "near"])})


def _in_order(pdf: pd.DataFrame) -> tuple[list[tuple], list[int]]:
    """The order's values of each row, and the rows' places in it."""
    keys = list(zip(*[pdf[c].tolist() for c in pdf.columns if re.fullmatch(r"k\d", c)], strict=True))
    return keys, sorted(range(len(keys)), key=keys.__getitem__)


def _conflicts(loci: DataFrame, keys: list[str], most: float) -> DataFrame:
    """(chr, u, v, blocks of both): pairs of loci of one key that overlap by more than ``most``."""
    side = lambda x: loci.select(*[F.col(k).alias(f"{k}_{x}") for k in keys], F.col("near").alias(x), F.col("block").alias(f"block_{x}"), F.col("lstart").alias(f"s{x}"), F.col("lend").alias(f"e{x}"))
    both = bin_join(side("u"), side("v"), [(f"{k}_u", f"{k}_v") for k in keys], ("su", "eu"), ("sv", "ev"))
    good = (F.col("u") != F.col("v")) & (dice(F.col("su"), F.col("eu"), F.col("sv"), F.col("ev")) > most)
    return both.filter(good).select(F.col("chr_u").alias("chr"), "u", "v", "block_u", "block_v")


def _replay(loci: DataFrame, keys: list[str], most: float, one: Callable[[pd.DataFrame], list], hops: int) -> DataFrame:
    """Loci with what an order-dependent rule decides about each (say): ``one`` goes through a block's loci in order and says it for the block's own, of
    which it gets, besides, the loci of other blocks that may matter to it (those in conflict, by keys and ``most``, with one of its own, or with one
    in conflict with one, for two hops) with what their blocks said last.

    Loci of different islands don't meet, so only blocks that share a long island have such neighbours. They are replayed until none says anything new: in each
    round, those whose neighbours said something new in the last. What a locus is told depends on earlier ones alone, so by induction over the order the last
    sayings are those of the one-by-one rule, and a round settles at least all that depends on one border more. A task holds one block and its neighbours.
    """
    schema = loci.withColumn("say", F.lit(None).cast("string")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["say"] = one(pdf)
        return pdf[pdf["own"]].drop(columns=["own", "for"])[[f.name for f in schema.fields]]

    def judged(own: DataFrame, around: DataFrame | None = None) -> DataFrame:
        own = own.withColumn("for", F.col("block")).withColumn("own", F.lit(True))
        both = own if around is None else own.unionByName(around.withColumn("own", F.lit(False)))
        return checkpoint(both.groupBy("chr", "for").applyInPandas(run, schema))

    said = judged(loci.withColumn("say", F.lit(None).cast("string")))
    long = loci.filter("block % 2 = 1").select(F.col("chr").alias("c"), F.col("isle").alias("i")).distinct()
    if long.isEmpty():
        return said
    halo = _halo(loci.join(few_rows(long), (F.col("chr") == F.col("c")) & (F.col("isle") == F.col("i")), "left_semi"), keys, most, hops)
    todo = checkpoint(halo.select("hc", "for").distinct())
    of = lambda df, blocks, how: df.join(blocks.select(F.col("hc").alias("tc"), F.col("for").alias("tb")), (F.col("chr") == F.col("tc")) & (F.col("block") == F.col("tb")), how)
    settled, live = of(said, todo, "left_anti"), checkpoint(of(said, todo, "left_semi"))
    while not todo.isEmpty():
        around = live.join(halo.join(todo, ["hc", "for"], "left_semi"), (F.col("chr") == F.col("hc")) & (F.col("near") == F.col("hn"))).drop("hc", "hn")
        now = judged(of(live, todo, "left_semi"), around)
        before = live.select(F.col("chr").alias("c"), F.col("near").alias("n"), F.col("say").alias("was"))
        new = now.join(before, (F.col("chr") == F.col("c")) & (F.col("near") == F.col("n"))).filter("NOT was <=> say").select("c", "n")
        live = checkpoint(of(live, todo, "left_anti").unionByName(now))
        todo = checkpoint(halo.join(new, (F.col("hc") == F.col("c")) & (F.col("hn") == F.col("n")), "left_semi").select("hc", "for").distinct())
    return settled.unionByName(live)


def _halo(loci: DataFrame, keys: list[str], most: float, hops: int) -> DataFrame:
    """(hc, hn, for): chromosome and number of each locus that the block ``for`` has to know besides its own."""
    conflicts = checkpoint(_conflicts(loci, keys, most))
    out = conflicts.filter("block_u <> block_v").select("chr", F.col("block_u").alias("for"), F.col("v").alias("near"))
    if hops > 1:
        link = conflicts.select(F.col("chr").alias("c"), "u", F.col("v").alias("further"))
        out = out.unionByName(out.join(link, (F.col("chr") == F.col("c")) & (F.col("near") == F.col("u"))).select("chr", "for", F.col("further").alias("near")))
        across = conflicts.filter("block_u = block_v").select("chr", F.col("block_u").alias("for"), "v")  # one's own neighbour, and its neighbour outside
        out = out.unionByName(across.join(link, (F.col("chr") == F.col("c")) & (F.col("v") == F.col("u"))).select("chr", "for", F.col("further").alias("near")))
    at = loci.select(F.col("chr").alias("c"), F.col("near").alias("n"), "block")
    halo = out.distinct().join(at, (F.col("chr") == F.col("c")) & (F.col("near") == F.col("n")) & (F.col("for") != F.col("block")))
    return checkpoint(halo.select(F.col("chr").alias("hc"), F.col("near").alias("hn"), "for"))


def _dice(a, b) -> float:
    shared = min(a.lend, b.lend) - max(a.lstart, b.lstart)
    return 2.0 * shared / ((a.lend - a.lstart) + (b.lend - b.lstart)) if shared > 0 else 0.0


def _earlier(rows: list, most: float, same: str | None) -> list[list[int]]:
    """For each of the rows, which are in order, the places of the earlier ones that it overlaps by more than ``most``: by a sweep over their starts."""
    by_start = sorted(range(len(rows)), key=lambda i: rows[i].lstart)
    out: list[list[int]] = [[] for _ in rows]
    open_: list[int] = []
    for i in by_start:
        r = rows[i]
        open_ = [j for j in open_ if rows[j].lend > r.lstart]
        for j in open_:
            if (same is None or getattr(rows[j], same) == getattr(r, same)) and _dice(r, rows[j]) > most:
                out[max(i, j)].append(min(i, j))
        open_.append(i)
    return out


def self_merge(loci: DataFrame, most: float = 0.45) -> DataFrame:
    """W11. Within a library, of loci that overlap by more than ``most`` the best p stays (the longer of equals, then the first).

    Greedy from the best locus on: a locus goes if a kept one overlaps it, so no two that stay overlap, and each that goes is overlapped by
    a better one that stays. That is the intent of taking the best of each group of overlapping loci; where loci overlap in chains
    it doesn't depend on the order of the rows. Blocks of neighbours are judged in parallel, as _replay says.
    """
    ship(loci.sparkSession)
    rows = checkpoint(_numbered(loci.select(*LOCUS), [-F.col("neglog_p"), F.col("lstart") - F.col("lend"), F.col("lstart"), F.col("name")]))

    def one(pdf: pd.DataFrame) -> list:
        _, place = _in_order(pdf)
        rows = list(pdf.iloc[place].itertuples(index=False))
        said = [None] * len(rows)
        for i, before in enumerate(_earlier(rows, most, "lib")):
            said[i] = rows[i].say if not rows[i].own else "goes" if any(said[j] == "stays" for j in before) else "stays"
        return _back(said, place)

    return _replay(rows, ["lib", "chr"], most, one, 1).filter("say = 'stays'").select(*LOCUS)


def merge_libraries(loci: DataFrame, most: float = 0.25) -> DataFrame:
    """W12. Libraries folded in the order of their names: a locus that overlaps none kept by more than ``most`` is added, else the
    longer of it and the kept one it overlaps most (the one added first, of equals) stays.

    A locus says that it goes, or the place of the locus that was added first of those that followed each other in its own. Blocks of neighbours are folded
    in parallel, as _replay says: what a locus meets is in conflict with it, and what may have replaced that, in conflict with what it meets.
    """
    ship(loci.sparkSession)
    rows = checkpoint(_numbered(loci.select(*LOCUS), ["lib", "lstart", "lend", "name"]))

    def one(pdf: pd.DataFrame) -> list:
        keys, place = _in_order(pdf)
        rows = list(pdf.iloc[place].itertuples(index=False))
        said: list[str | None] = [None] * len(rows)
        holder: dict[str, int] = {}  # of each place in the result: who has it
        at: dict[int, str] = {}
        for i, before in enumerate(_earlier(rows, most, None)):
            r = rows[i]
            if not r.own:
                said[i] = r.say
            else:
                met = [j for j in before if j in at]
                best = max(met, key=lambda j: _dice(r, rows[j]), default=None)
                if best is not None:
                    tied = [j for j in met if _dice(r, rows[j]) == _dice(r, rows[best])]
                    best = min(tied, key=lambda j: tuple(json.loads(at[j])))
                if best is None:
                    said[i] = json.dumps(keys[place[i]])  # a new place, named by who is added to it
                elif r.lend - r.lstart > rows[best].lend - rows[best].lstart:
                    said[i] = at[best]
                else:
                    said[i] = "goes"
            if said[i] is not None and said[i] != "goes":
                if (old := holder.get(said[i])) is not None:
                    at.pop(old, None)
                holder[said[i]] = i
                at[i] = said[i]
        return _back(said, place)

    done = _replay(rows, ["chr"], most, one, 2).filter("say <> 'goes'")
    last = done.groupBy("chr", "say").agg(F.max(F.struct("k0", "k1", "k2", "k3", "k4", *[c for c in LOCUS if c != "chr"])).alias("x"))
    return last.select(*[F.col("chr") if c == "chr" else F.col(f"x.{c}").alias(c) for c in LOCUS])


def _back(said: list, place: list[int]) -> list:
    out = [None] * len(said)
    for s, i in zip(said, place, strict=True):
        out[i] = s
    return out


def best_cluster(rows: DataFrame) -> DataFrame:
    """W10. Per locus the cluster of largest k, then largest phased abundance, then smallest id. rows: name, cluster, k, abun."""
    return rows.groupBy("name").agg(F.min(F.struct((-F.col("k")).alias("nk"), (-F.col("abun")).alias("na"), "cluster")).alias("b")).select("name", "b.cluster", (-F.col("b.nk")).alias("k"), (-F.col("b.na")).alias("abun"))


def enumerate_loci(loci: DataFrame, prefix: str = "Phas") -> DataFrame:
    """W21. Loci numbered by zero-padded chromosome name, start and name.

    Numbers come from running counts of loci per chromosome and per block of it plus a rank inside the block, so no task orders all loci.
    """
    df = loci.withColumn("ckey", F.lpad(F.lower(F.col("chr").cast("string")), 8, "0"))
    per = df.groupBy("ckey").agg(F.count("*").alias("n"))
    per = per.select(F.col("ckey").alias("k"), (F.sum("n").over(Window.orderBy("ckey")) - F.col("n")).alias("before"))
    numbered = number_rows(df, ["ckey"], "lstart", ["name"], "nth")
    return numbered.join(per, F.col("ckey") == F.col("k")).select("name", F.concat(F.lit(f"{prefix}-"), (F.col("before") + F.col("nth")).cast("string")).alias("phas_id"), "ckey", "lstart")


def pick_cutoff(loci: DataFrame, want: int, perc: float = 0.25) -> DataFrame:
    """W22. The largest available p at or below the wanted one, as its negative log, and the nearest-rank percentile per library."""
    return loci.groupBy("lib").agg(F.min(F.when(F.col("neglog_p") >= want, F.col("neglog_p"))).alias("cutoff"), F.expr(f"percentile_disc({perc}) WITHIN GROUP (ORDER BY neglog_p)").alias("nearest"))


def summarize_loci(members: DataFrame, tag_count: DataFrame, libs: tuple[str, ...], rl: int = 21, safe: tuple[float, int, int] | None = None) -> DataFrame:
    """A17. Per locus the library sums, total, size ratio (share of size rl, two decimals), best tag's share, the top two tags, and the best
    k of its members. members: (name, tag, k), repeats allowed. safe: (largest best tag's share, least k, least total) that a locus must keep to."""
    m = members.select("name", "tag").distinct().join(tag_count, "tag")
    per_tag = m.groupBy("name", "tag").agg(F.sum("abun").alias("abun"))
    order = Window.partitionBy("name").orderBy(F.desc("abun"), "tag")
    top = per_tag.withColumn("nth", F.row_number().over(order)).filter("nth <= 2").groupBy("name").agg(F.max(F.when(F.col("nth") == 1, F.col("tag"))).alias("tag1"), F.max(F.when(F.col("nth") == 2, F.col("tag"))).alias("tag2"), F.max("abun").alias("top_abun"))
    sums = m.groupBy("name").agg(*[F.coalesce(F.sum(F.when(F.col("lib") == x, F.col("abun"))), F.lit(0)).alias(x) for x in libs], F.sum("abun").alias("total"), F.coalesce(F.sum(F.when(F.length("tag") == rl, F.col("abun"))), F.lit(0)).alias("phased"))
    best = members.groupBy(F.col("name").alias("bn")).agg(F.max("k").alias("best_k"))
    both = sums.join(top.withColumnRenamed("name", "n"), F.col("name") == F.col("n")).join(best, F.col("name") == F.col("bn"))
    out = both.select("name", *libs, "total", round_double(F.try_divide(F.col("phased"), F.col("total")), 2).alias("size_ratio"), (F.col("top_abun") / F.col("total")).alias("max_tag_ratio"), "tag1", "tag2", "best_k")
    return out.filter((F.col("max_tag_ratio") <= safe[0]) & (F.col("best_k") >= safe[1]) & (F.col("total") >= safe[2])) if safe else out


def precursor_ratio(loci: DataFrame, tagpos: DataFrame) -> DataFrame:
    """A18. Shares of the first, and of the first two, distinct tags in all abundance of an interval (name, chr, lstart, lend). A precursor's arms
    are intervals of one name: a tag counts in each arm it lies in, what lies in the loop in none."""
    t = tagpos.select("tag", F.col("chr").alias("tchr"), "pos", "abun")
    hit = point_join(t, loci.select("name", "chr", "lstart", "lend"), [("tchr", "chr")], "pos", ("lstart", "lend"))
    per = hit.groupBy("name", "tag").agg(F.sum("abun").alias("abun"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("abun"), "tag"))
    agg = per.withColumn("nth", nth).groupBy("name").agg(F.sum("abun").alias("total"), F.sum(F.when(F.col("nth") == 1, F.col("abun"))).alias("a1"), F.sum(F.when(F.col("nth") <= 2, F.col("abun"))).alias("a2"))
    return agg.select("name", "total", (F.col("a1") / F.col("total")).alias("ratio1"), (F.col("a2") / F.col("total")).alias("ratio2"))


def precursor_arms(precursors: DataFrame) -> DataFrame:
    """A18. (name, chr, lstart, lend) of both arms of precursors (name, chr, pstart, start5, end5, start3, end3), whose fold-back is given relative to
    pstart, counted from 0. A precursor without a fold-back has no arms."""
    arm = lambda s, e: F.struct((F.col("pstart") + F.col(s)).alias("lstart"), (F.col("pstart") + F.col(e)).alias("lend"))
    both = precursors.select("name", "chr", F.explode(F.array(arm("start5", "end5"), arm("start3", "end3"))).alias("a"))
    return both.select("name", "chr", "a.lstart", "a.lend").filter("lstart <= lend")


def cross_species_clusters(members: DataFrame) -> DataFrame:
    """A32. Clusters with more than one species, first member of each. members: cluster, member, species."""
    per = members.groupBy("cluster", "species").agg(F.min("member").alias("member"))
    many = per.groupBy("cluster").agg(F.count("*").alias("n_species")).filter("n_species > 1")
    return per.join(many, "cluster")


def classify_pairs(names: DataFrame, pairs: DataFrame, isoforms: DataFrame) -> DataFrame:
    """A33. names as paired, isoform of a paired one, or neither. pairs: a, b; isoforms: name, gene."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    genes = isoforms.join(paired, "name", "left_semi").select("gene").distinct()
    iso = isoforms.join(genes, "gene", "left_semi").select(F.col("name").alias("iso")).distinct()
    p = paired.select(F.col("name").alias("p"))
    both = names.join(p, F.col("name") == F.col("p"), "left").join(iso, F.col("name") == F.col("iso"), "left")
    return both.select("name", F.when(F.col("p").isNotNull(), "paired").when(F.col("iso").isNotNull(), "isoform").otherwise("neither").alias("kind"))


def find_triggers(sites: DataFrame, loci: DataFrame, phase: int, first: int = -5, last: int = 7) -> DataFrame:
    """J18. Cleavage sites at a register position of a locus's head (w sites) or tail (c sites), from five cycles before to seven after.

    Class 0 exact, 1 off by one (dicer), 2 off by two (strand); the best class stays for each site and locus. Sites meet the stretch that the cycles span
    in a join by bins, and the distance says the cycle and the class: rows don't grow with the number of cycles. sites: (site, chr, strand, pos).
    """
    ends = F.explode(F.array(F.struct(F.lit("w").alias("s"), F.col("lstart").alias("at")), F.struct(F.lit("c").alias("s"), F.col("lend").alias("at")))).alias("e")
    own = loci.select("name", F.col("chr").alias("lchr"), ends).select("name", "lchr", F.col("e.s").alias("ls"), F.col("e.at").alias("head"))
    own = own.withColumns({"__lo": F.col("head") + (first * phase - 2), "__hi": F.col("head") + (last * phase + 2)})
    both = point_join(sites.select("site", "chr", "strand", "pos"), own, [("chr", "lchr"), ("strand", "ls")], "pos", ("__lo", "__hi"))

    def way(o: int) -> Column:
        d = F.col("pos") - F.col("head") - o
        idx = (d / phase).cast("int")
        return F.when((d % phase == 0) & idx.between(first, last), F.struct(F.lit(abs(o)).alias("cls"), F.abs(idx).alias("d"), idx.alias("idx")))

    best = both.select("site", "name", F.array_min(F.array(*[way(o) for o in (0, -1, 1, -2, 2)])).alias("b")).filter("b IS NOT NULL")
    return best.groupBy("site", "name").agg(F.min("b").alias("b")).select("site", "name", F.col("b.cls").alias("cls"), F.col("b.idx").alias("idx"))


def best_trigger(triggers: DataFrame, preferred: tuple[str, ...], most: int = 3) -> DataFrame:
    """W17. Per locus the trigger of a preferred family first, then of smallest |idx|, then by name; only |idx| up to ``most``."""
    pref = F.when(F.col("family").isin(*preferred), 0).otherwise(1)
    best = triggers.filter(F.abs("idx") <= most).groupBy("name").agg(F.min(F.struct(pref.alias("p"), F.abs("idx").alias("d"), "site", "idx", "family")).alias("b"))
    return best.select("name", "b.site", "b.family", "b.idx")


def greedy_matching(pairs: DataFrame, order: list, a: str = "a", b: str = "b", first: int = 1 << 14) -> DataFrame:
    """W18. Greedy choice of pairs in a total order, each member used once (a and b are two roles of the same names; a pair may be of one with itself).

    Each round finds the best two pairs of every member. A pair that is the best of both its members is chosen, whatever else there is. One that has a
    single better pair beside it is chosen if that one isn't; such pairs point at each other in chains, which doubling resolves in a number of steps that
    grows with the logarithm of their length. Members of chosen pairs leave with all their pairs. A round chooses the best pair of all at least, so it ends;
    chains, the case of many dependent choices, take one round.

    Of more than ``first`` pairs those first in order are matched before the others are looked at: what they choose doesn't depend on the rest, and
    where many pairs share few members it leaves little of them.
    """
    left = store(pairs.withColumn("__o", F.struct(*order)).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).dropDuplicates(["__o"]))
    if left.count() <= first:
        return _match(left, a, b).drop("__o")
    last = checkpoint(left.select("__o").orderBy("__o").limit(first).agg(F.max("__o").alias("__last")))  # one row
    head = _match(checkpoint(left.join(F.broadcast(last), F.col("__o") <= F.col("__last")).drop("__last")), a, b)
    head = checkpoint(head)
    used = head.select(F.explode(F.array(a, b)).alias("u")).distinct()
    used = few_rows(used, 2 * first)
    rest = left.join(F.broadcast(last), F.col("__o") > F.col("__last")).drop("__last")
    rest = store(rest.join(used, F.col(a) == F.col("u"), "left_anti").join(used, F.col(b) == F.col("u"), "left_anti"))
    return head.unionByName(_match(rest, a, b)).drop("__o")


def _match(left: DataFrame, a: str, b: str) -> DataFrame:
    """greedy_matching's rounds over pairs with their place in order (__o)."""
    chosen = left.limit(0)
    rounds = 0
    while not left.isEmpty():
        both = left.select(F.col(a).alias("m"), "__o").unionByName(left.filter(F.col(a) != F.col(b)).select(F.col(b).alias("m"), "__o"))
        # the two best of each member; partial sorts of two rows in every task
        two = both.groupBy("m").agg(F.min("__o").alias("first"))
        second = both.join(two, "m").filter(F.col("__o") > F.col("first")).groupBy("m").agg(F.min("__o").alias("second"))
        two = checkpoint(two.join(second.withColumnRenamed("m", "m2"), F.col("m") == F.col("m2"), "left").drop("m2"))
        of = lambda x: two.select(F.col("m").alias(f"m{x}"), F.col("first").alias(f"f{x}"), F.col("second").alias(f"s{x}"))
        seen = left.join(of("a"), F.col(a) == F.col("ma")).join(of("b"), F.col(b) == F.col("mb"))
        best_a, best_b = F.col("__o") == F.col("fa"), F.col("__o") == F.col("fb")
        next_a, next_b = F.coalesce(F.col("__o") == F.col("sa"), F.lit(False)), F.coalesce(F.col("__o") == F.col("sb"), F.lit(False))
        # the only better pair beside it
        up = F.when(best_a & next_b, F.col("fb")).when(next_a & best_b, F.col("fa")).when(next_a & next_b & (F.col("fa") == F.col("fb")), F.col("fa"))
        seen = checkpoint(seen.withColumn("__up", up).filter((best_a & best_b) | F.col("__up").isNotNull()).select(*left.columns, "__up"))
        top = seen.filter("__up IS NULL")
        if top.isEmpty():
            raise RuntimeError("greedy_matching: no pair is the best of both its members; the order must be total")
        won = resolve_chains(seen.filter("__up IS NOT NULL").select("__o", "__up"), top.select("__o"))
        taken = seen.join(won.withColumnRenamed("__o", "__w"), F.col("__o") == F.col("__w"), "left_semi").drop("__up").unionByName(top.drop("__up"))
        taken = checkpoint(taken)
        chosen = chosen.unionByName(taken)
        rounds += 1
        if rounds % 20 == 0:  # keeps the plan short
            chosen = checkpoint(chosen)
        used = taken.select(F.explode(F.array(a, b)).alias("u")).distinct()
        left = checkpoint(left.join(used, F.col(a) == F.col("u"), "left_anti").join(used, F.col(b) == F.col("u"), "left_anti"))
    return chosen


def resolve_chains(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(__o) of links (__o, __up) at an even distance from a root (__o): a link holds if what it points at doesn't, and roots hold. Links that lead to no
    root are left open. Distances come by pointer doubling: each step joins every open link with the one it points at."""
    at = checkpoint(links.withColumn("odd", F.lit(True)))
    while True:
        far = at.select(F.col("__o").alias("__n"), F.col("__up").alias("further"), F.col("odd").alias("more"))
        step = at.join(far, F.col("__up") == F.col("__n"), "left")
        step = checkpoint(step.select("__o", F.coalesce("further", "__up").alias("__up"), F.when(F.col("__n").isNotNull(), F.col("odd") != F.col("more")).otherwise(F.col("odd")).alias("odd"), F.col("__n").isNotNull().alias("went")))
        at = step.drop("went")
        if step.filter("went").isEmpty():
            break
    return at.filter("NOT odd").join(roots.withColumnRenamed("__o", "__r"), F.col("__up") == F.col("__r"), "left_semi").select("__o")


def inverted_repeats(pairs: DataFrame, foldback: bool = False, least_len: int = 180, least_identity: float = 85.0, share: float = 0.7) -> DataFrame:
    """W18. The best pairs by bit score of (a, b, pident, length, bitscore, alen, blen), each transcript in one pair: alignments of enough
    length, also relative to the shorter transcript, and identity. foldback: pairs of a transcript with itself alone."""
    good = pairs.filter((F.col("length") >= least_len) & (F.col("pident") >= least_identity) & (F.col("length") >= share * F.least("alen", "blen")))
    good = good.filter(F.col("a") == F.col("b")) if foldback else good
    return greedy_matching(good, [(-F.col("bitscore")).alias("s"), F.col("a"), F.col("b"), F.col("length"), F.col("pident")])


def unique_placement(names: DataFrame, places: DataFrame) -> DataFrame:
    """W16. Each name, in order, takes its first place that no earlier name has. names: (name, ord); places: (name, place, pord).

    That is greedy_matching by (name order, place order).
    """
    pairs = places.join(names, "name").select(F.concat(F.lit("n:"), "name").alias("a"), F.concat(F.lit("p:"), "place").alias("b"), "name", "place", "ord", "pord")
    return greedy_matching(pairs, [F.col("ord"), F.col("name"), F.col("pord"), F.col("place")]).select("name", "place")
