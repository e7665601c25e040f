"""Operators on lineages: tries, molecules, consensus, depth, copy numbers, richness, routing, distances, nearest matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.functions import columns as C
from cladewright.functions import kernels as K
from cladewright.shipping import ship

from .scale import cut, running


def trie(chains: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """key, prefix (text), depth, tip and subtree of each prefix of the edit chains (sites, weight)."""
    c = chains.select(key, C.chain(F.col("sites")).alias("c"), weight)
    p = c.select(key, weight, F.size("c").alias("len"), F.explode(F.sequence(F.lit(0), F.size("c"))).alias("depth"), "c")
    p = p.select(key, "depth", F.array_join(F.slice("c", F.lit(1), F.col("depth")), "|").alias("prefix"), weight, (F.col("len") == F.col("depth")).alias("end"))
    return p.groupBy(key, "prefix", "depth").agg(F.sum(F.when(F.col("end"), F.col(weight)).otherwise(0)).alias("tip"), F.sum(weight).alias("subtree"))


def heaviest(t: DataFrame, key: str) -> DataFrame:
    """key, node, depth (of the child), next (the heaviest child of each inner node of ``trie``; ties: the least token), its weight, and off and second: the sum and the greatest of the others'."""
    parent = F.array_join(F.slice(F.split("prefix", r"\|"), F.lit(1), F.col("depth") - 1), "|")
    w = W.partitionBy(key, "node")
    ranked = t.filter("depth > 0").withColumn("node", parent).withColumn("r", F.row_number().over(w.orderBy(F.desc("subtree"), "prefix")))
    other = F.when(F.col("r") > 1, F.col("subtree"))
    return ranked.withColumn("off", F.coalesce(F.sum(other).over(w), F.lit(0))).withColumn("second", F.max(other).over(w)).filter("r = 1").select(key, "node", "depth", F.col("prefix").alias("next"), F.col("subtree").alias("weight"), "off", "second")


def dominant(chains: DataFrame, key: str | list[str], n_sites: int = 6, weight: str = "n") -> DataFrame:
    """key, chain, support, dominance and branched of the dominant lineage: level by level the heaviest child of the node, ``n_sites`` times.

    Each level needs the path so far only, so that all levels come from one trie: the heaviest child of every node, then of the chosen node. branched says that a
    child off the path has a weight of 2 or more.
    """
    keys = [key] if isinstance(key, str) else key
    packed = chains.withColumn("_key", F.struct(*keys))
    best = cut(heaviest(trie(packed, "_key", weight), "_key"))
    path = packed.groupBy("_key").agg(F.sum(weight).alias("total")).withColumn("node", F.lit("")).withColumn("off_path", F.lit(0).cast("long")).withColumn("branched", F.lit(False))
    for k in range(1, n_sites + 1):
        step = best.filter(F.col("depth") == k).select("_key", "node", "next", "off", "second")
        path = path.join(step, ["_key", "node"], "left").select("_key", "total", F.coalesce("next", "node").alias("node"), (F.col("off_path") + F.coalesce("off", F.lit(0))).alias("off_path"), (F.col("branched") | F.coalesce(F.col("second") >= 2, F.lit(False))).alias("branched"))
    support = F.col("total") - F.col("off_path")
    return path.select(*[F.col(f"_key.{c}").alias(c) for c in keys], F.col("node").alias("chain"), support.cast("long").alias("support"), (support / F.col("total")).alias("dominance"), "branched")


def umi_molecules(reads: DataFrame, keys: list[str], merge: int = 1, floor: int = 2) -> DataFrame:
    """keys, sites and molecules of each cell's barcode (``kernels.molecules``). Reads are counted before the shuffle; a group is one cell and barcode."""
    ship(reads.sparkSession)
    counted = reads.groupBy(*keys, "umi", "sites").agg(F.count("*").alias("n"), F.min("read_no").alias("first"))
    kinds = ", ".join(f"{k} {reads.schema[k].dataType.simpleString()}" for k in keys)

    def collapse(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = K.molecules([(u, tuple(s), int(n), int(f)) for u, s, n, f in zip(pdf.umi, pdf.sites, pdf.n, pdf["first"], strict=True)], merge, floor)
        return pd.DataFrame({**{c: [v] * len(out) for c, v in zip(keys, k, strict=True)}, "sites": [list(p) for p in out], "molecules": list(out.values())})

    return counted.groupBy(*keys).applyInPandas(collapse, f"{kinds}, sites array<string>, molecules long")


def branch_stop(chains: DataFrame, key: str | list[str], share: float = 0.25, least: float = 2, n_sites: int = 6, weight: str = "n") -> DataFrame:
    """key, chain, branched and dominance: from the root to the heaviest child (ties: the least token), until a leaf or a branch.

    A node branches where two children have ``least`` each, and ``share`` of what goes through the node; the chain ends there. dominance is the heaviest child's share of the node's own weight, at the
    branch, or else at the last node before the leaf (1 if no chain has an edit).
    """
    keys = [key] if isinstance(key, str) else key
    packed = chains.withColumn("_key", F.struct(*keys))
    t = cut(trie(packed, "_key", weight))
    through = F.col("weight") + F.col("off")
    tips = t.select(F.col("_key").alias("_k"), F.col("prefix").alias("_n"), "tip")
    best = heaviest(t, "_key").join(tips, (F.col("_key") == F.col("_k")) & (F.col("node") == F.col("_n")))
    best = cut(best.select("_key", "node", "depth", "next", (F.coalesce(F.col("second") >= least, F.lit(False)) & (F.col("second") >= share * through)).alias("splits"), (F.col("weight") / (through + F.col("tip"))).alias("own")))
    path = packed.select("_key").distinct().select("_key", F.lit("").alias("node"), F.lit(True).alias("open"), F.lit(False).alias("branched"), F.lit(1.0).alias("dominance"))
    for k in range(1, n_sites + 1):
        step = best.filter(F.col("depth") == k).select(F.col("_key").alias("_k"), F.col("node").alias("_n"), "next", "splits", "own")
        on = path.join(step, F.col("open") & (F.col("_key") == F.col("_k")) & (F.col("node") == F.col("_n")), "left")
        goes = F.col("next").isNotNull()
        path = on.select("_key", F.when(goes & ~F.col("splits"), F.col("next")).otherwise(F.col("node")).alias("node"), (goes & ~F.coalesce("splits", F.lit(True))).alias("open"),
                         (F.col("branched") | F.coalesce("splits", F.lit(False))).alias("branched"), F.when(goes, F.col("own")).otherwise(F.col("dominance")).alias("dominance"))
    return path.select(*[F.col(f"_key.{c}").alias(c) for c in keys], F.col("node").alias("chain"), "branched", "dominance")


def consensus(called: DataFrame, least: int = 3, dominance: float = 0.9) -> DataFrame:
    """Rows of ``dominant`` that have ``least`` molecules and ``dominance``."""
    return called.filter((F.col("support") >= least) & (F.col("dominance") >= dominance))


def cell_qc(called: DataFrame) -> DataFrame:
    """cell, n_loci, n_doublet_loci (branched), mean_dominance and molecules of the calls of each cell."""
    return called.groupBy("cell").agg(F.count("*").alias("n_loci"), F.count_if("branched").alias("n_doublet_loci"), F.avg("dominance").alias("mean_dominance"), F.sum("support").alias("molecules"))


def recovery(called: DataFrame, cells: DataFrame) -> DataFrame:
    """tape, recovered and pct of all ``cells`` (cell)."""
    n = cells.select("cell").distinct().agg(F.count("*").alias("_n"))
    return called.groupBy("tape").agg(F.count("*").alias("recovered")).join(F.broadcast(n)).select("tape", "recovered", (100 * F.col("recovered") / F.col("_n")).alias("pct"))


def molecules_per_cell(called: DataFrame, cells: DataFrame, n: str = "n") -> DataFrame:
    """cells, recovered, mean and median of molecules of all ``cells`` (those without any count 0), and of the recovered ones."""
    per = cells.select("cell").distinct().join(called.groupBy("cell").agg(F.sum(n).alias("_m")), "cell", "left")
    all_, own = F.coalesce("_m", F.lit(0)), F.col("_m")
    return per.agg(F.count("*").alias("cells"), F.count("_m").alias("recovered"), F.avg(all_).alias("mean_all"), F.percentile(all_, F.lit(0.5)).alias("median_all"), F.avg(own).alias("mean_recovered"), F.percentile(own, F.lit(0.5)).alias("median_recovered"))


def fold_dropout(chains: DataFrame, key: str, ratio: float = 4.0, n_sites: int = 6, weight: str = "n") -> DataFrame:
    """key, chain and n after early stops were folded into deeper lineages.

    Where the heaviest child of a prefix weighs ``ratio`` times the prefix's own weight or more, that weight goes to the end of the path of heaviest children below
    it. Weights are those before folding and ends are leaves, which never fold, so all prefixes fold at once. A ``ratio`` of 0 folds nothing.
    """
    t = cut(trie(chains, key, weight))
    if ratio <= 0:
        return t.filter("tip > 0").select(key, F.col("prefix").alias("chain"), F.col("tip").cast("double").alias("n"))
    best = cut(heaviest(t, key))
    step = best.select(key, F.col("node").alias("to"), "next")
    tips = t.filter("tip > 0").select(key, F.col("prefix").alias("node"), "tip").join(best.select(key, "node", "next", "weight"), [key, "node"], "left")
    moved = tips.select(key, F.when(F.col("weight") >= ratio * F.col("tip"), F.col("next")).alias("to"), "node", "tip")
    for _ in range(n_sites - 1):
        moved = moved.join(step, [key, "to"], "left").select(key, F.coalesce("next", "to").alias("to"), "node", "tip")
    return moved.groupBy(key, F.coalesce("to", "node").alias("chain")).agg(F.sum("tip").cast("double").alias("n"))


def reads_per_cell(patterns: DataFrame, key: str, floor: int = 200, width: float = 0.3, points: int = 400, bins: int = 39) -> DataFrame:
    """key and unit: the reads of one cell, as the mode of log10 counts.

    With five counts of ``floor`` or more that differ, the mode of their Gaussian density, of ``width`` standard deviations, at ``points`` even places; else the middle of
    the bin of all counts that has most in it and its two neighbours; 1 without counts. Counts enter as a histogram. Ties go to the least.
    """
    n = patterns.filter("n > 0").groupBy(key, F.log10(F.col("n").cast("double")).alias("v")).agg(F.count("*").alias("times"), F.min("n").alias("n"))
    total = F.sum("times")
    mean = F.sum(F.col("times") * F.col("v")) / total
    big = n.filter(F.col("n") >= floor)
    spread = big.groupBy(key).agg(total.alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"), mean.alias("mean")).filter("k >= 5 and hi > lo")
    sd = big.join(spread, key).groupBy(key, "lo", "hi").agg(F.sqrt(F.sum(F.col("times") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))) / (F.max("k") - 1)).alias("sd"))
    place = sd.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1))
    z = (F.col("x") - F.col("v")) / (width * F.col("sd"))
    dense = place.join(big.select(key, "v", "times"), key).groupBy(key, "i", "x").agg(F.sum(F.col("times") * F.exp(-z * z / 2)).alias("density"))
    smooth = dense.groupBy(key).agg(F.max_by("x", F.struct("density", -F.col("i"))).alias("at"))
    ends = n.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    own = n.join(ends, key).groupBy(key, "lo", "hi", share.alias("b")).agg(total.alias("k"))
    near = own.select(key, "lo", "hi", F.explode(F.sequence(F.greatest(F.col("b") - 1, F.lit(0)), F.least(F.col("b") + 1, F.lit(bins - 1)))).alias("b"), "k").groupBy(key, "lo", "hi", "b").agg(F.sum("k").alias("k"))
    middle = F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / bins).otherwise(F.col("lo"))
    rough = near.groupBy(key).agg(F.max_by(middle, F.struct("k", -F.col("b"))).alias("rough"))
    every = patterns.select(key).distinct().join(rough, key, "left").join(smooth, key, "left")
    return every.select(key, F.coalesce(F.pow(F.lit(10.0), F.coalesce("at", "rough")), F.lit(1.0)).alias("unit"))


def cells(patterns: DataFrame, unit: Column) -> DataFrame:
    """``patterns`` with cells = n / unit rounded half to even, where that is 1 or more."""
    return patterns.withColumn("cells", F.bround(F.col("n") / unit).cast("long")).filter("cells >= 1")


def copies(totals: DataFrame, rounds: int = 3) -> DataFrame:
    """``totals`` (barcode and reads) with unit and copies: the median, then the median of those that round to one copy, ``rounds`` times."""
    unit = totals.agg(F.percentile("reads", F.lit(0.5)).alias("unit"))
    for _ in range(rounds):
        one = totals.join(F.broadcast(unit)).filter(F.greatest(F.lit(1), F.bround(F.col("reads") / F.col("unit"))) == 1)
        unit = unit.withColumnRenamed("unit", "old").join(one.agg(F.percentile("reads", F.lit(0.5)).alias("new"))).select(F.coalesce("new", "old").alias("unit"))
    return totals.join(F.broadcast(unit)).withColumn("copies", F.greatest(F.lit(1), F.bround(F.col("reads") / F.col("unit"))).cast("long"))


def chao1(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """key, n, s_obs, f1, f2, f0 and chao1 of the counts of each key."""
    a = counts.filter(F.col(n) > 0).groupBy(key).agg(F.sum(n).alias("total"), F.count("*").alias("s_obs"), F.count_if(F.col(n) == 1).alias("f1"), F.count_if(F.col(n) == 2).alias("f2"))
    share = (F.col("total") - 1) / F.col("total")
    f0 = share * F.when(F.col("f2") > 0, F.col("f1") * F.col("f1") / (2 * F.col("f2"))).otherwise(F.col("f1") * (F.col("f1") - 1) / 2.0)
    return a.withColumn("f0", f0).withColumn("chao1", F.col("s_obs") + f0)


def rarefied(counts: DataFrame, grid: DataFrame, key: str, n: str = "n") -> DataFrame:
    """key, m and expected distinct: S - sum of C(N - c, m) / C(N, m) up to N (Hurlbert), Chao1's extrapolation beyond it. Counts enter as a histogram."""
    hist = counts.filter(F.col(n) > 0).groupBy(key, F.col(n).alias("c")).agg(F.count("*").alias("times"))
    at = chao1(counts, key, n).join(grid, key)
    low = at.filter("m <= total").join(hist, key).filter("total - c >= m")
    lf, c, m, all_ = C.log_factorial, F.col("c"), F.col("m"), F.col("total")
    lost = low.groupBy(key, "m").agg(F.sum(F.col("times") * F.exp(lf(all_ - c) - lf(all_ - c - m) - lf(all_) + lf(all_ - m))).alias("lost"))
    denom = F.col("total") * F.col("f0") + F.col("f1")
    beyond = F.when((denom > 0) & (F.col("f0") > 0), F.col("f0") * (1 - F.pow(1 - F.col("f1") / denom, F.col("m") - F.col("total")))).otherwise(0.0)
    out = at.join(lost, [key, "m"], "left")
    return out.select(key, "m", F.when(F.col("m") <= F.col("total"), F.col("s_obs") - F.coalesce("lost", F.lit(0.0))).otherwise(F.col("s_obs") + beyond).alias("expected"))


def side_votes(calls: DataFrame, defining: DataFrame, margin: int = 1) -> DataFrame:
    """cell, votes_a, votes_b and route (A, B or set_aside) from calls (cell, tape, site, allele) and defining alleles (tape, site, allele, side)."""
    v = calls.join(F.broadcast(defining), ["tape", "site", "allele"]).groupBy("cell").agg(F.count_if(F.col("side") == "A").alias("votes_a"), F.count_if(F.col("side") == "B").alias("votes_b"))
    d = F.col("votes_a") - F.col("votes_b")
    return v.withColumn("route", F.when(d >= margin, "A").when(-d >= margin, "B").otherwise("set_aside"))


def shared_tape_pairs(genotypes: DataFrame) -> DataFrame:
    """i, j (i < j), shared and distance (mean over shared tapes) of each two cells of ``genotypes`` (cell, tape, sites) that share a tape: an equi-join by tape.

    All pairs are asked for, so the work is quadratic in the cells of a tape; meant for selections of up to about 10,000 cells.
    """
    a = genotypes.select("tape", F.col("cell").alias("i"), F.col("sites").alias("si"))
    b = genotypes.select("tape", F.col("cell").alias("j"), F.col("sites").alias("sj"))
    d = a.join(b, "tape").filter("i < j").select("i", "j", C.tape_distance(F.col("si"), F.col("sj")).alias("d"))
    return d.groupBy("i", "j").agg(F.count("*").alias("shared"), F.avg("d").alias("distance"))


def tokens(genotypes: DataFrame) -> DataFrame:
    """cell and token (tape, site, allele) of each edit."""
    return genotypes.select("cell", "tape", F.posexplode("sites").alias("site", "allele")).filter(F.col("allele") != C.UNEDITED).select("cell", F.concat_ws(":", "tape", "site", "allele").alias("token"))


def overlaps(genotypes: DataFrame, queries: DataFrame, share: float = 0.2) -> DataFrame:
    """q, c and overlap: all other cells with tokens in common with each query cell, by an inverted index without tokens of over ``share`` of all cells."""
    t = tokens(genotypes)
    n = genotypes.select("cell").distinct().agg(F.count("*").alias("cells"))
    rare = t.groupBy("token").agg(F.count("*").alias("f")).join(F.broadcast(n)).filter(F.col("f") <= F.floor(share * F.col("cells"))).select("token")
    t = t.join(rare, "token", "left_semi")
    q = t.join(queries.select("cell"), "cell", "left_semi").withColumnRenamed("cell", "q")
    return q.join(t.withColumnRenamed("cell", "c"), "token").filter("q <> c").groupBy("q", "c").agg(F.count("*").alias("overlap"))


def overlap_top(genotypes: DataFrame, queries: DataFrame, k: int, share: float = 0.2) -> DataFrame:
    """The ``k`` of ``overlaps`` with most tokens in common for each query cell (ties: the least cell)."""
    met = overlaps(genotypes, queries, share)
    return met.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("overlap"), "c"))).filter(F.col("r") <= k).drop("r")


def nearest_match(genotypes: DataFrame, candidates: DataFrame) -> DataFrame:
    """q, c, distance and shared: the nearest candidate (q, c) by mean distance over shared tapes; ties go to more shared tapes, then to the least cell."""
    g = genotypes.select("cell", "tape", "sites")
    d = candidates.select("q", "c").join(g.select(F.col("cell").alias("q"), "tape", F.col("sites").alias("sq")), "q").join(g.select(F.col("cell").alias("c"), "tape", F.col("sites").alias("sc")), ["c", "tape"])
    d = d.groupBy("q", "c").agg(F.avg(C.tape_distance(F.col("sq"), F.col("sc"))).alias("distance"), F.count("*").alias("shared"))
    best = F.min_by(F.struct("c", "distance", "shared"), F.struct("distance", -F.col("shared"), "c"))
    return d.groupBy("q").agg(best.alias("b")).select("q", "b.c", "b.distance", "b.shared")


def nearest_matches(genotypes: DataFrame, candidates: DataFrame, backbone: DataFrame) -> DataFrame:
    """q; c, distance and shared of the nearest candidate (q, c); and b, b_distance and b_shared of the nearest among ``backbone`` (cell), null where a query has none.

    Distances are means over shared tapes; ties go to more shared tapes, then to the candidate with more tapes of its own, then to the least cell. Both are picked from one pass over the pairs.
    """
    g = genotypes.select("cell", "tape", "sites")
    loci = g.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("loci")).join(backbone.select(F.col("cell").alias("c")).distinct().withColumn("is_b", F.lit(True)), "c", "left")
    d = candidates.select("q", "c").join(g.select(F.col("cell").alias("q"), "tape", F.col("sites").alias("sq")), "q").join(g.select(F.col("cell").alias("c"), "tape", F.col("sites").alias("sc")), ["c", "tape"])
    d = d.groupBy("q", "c").agg(F.avg(C.tape_distance(F.col("sq"), F.col("sc"))).alias("distance"), F.count("*").alias("shared")).join(loci, "c")
    order = F.struct("distance", -F.col("shared"), -F.col("loci"), "c")
    best = lambda on: F.min_by(F.struct("c", "distance", "shared"), F.when(on, order))
    out = d.groupBy("q").agg(best(F.lit(True)).alias("a"), best(F.col("is_b")).alias("b"))
    return out.select("q", "a.c", "a.distance", "a.shared", F.col("b.c").alias("b"), F.col("b.distance").alias("b_distance"), F.col("b.shared").alias("b_shared"))


def irreversible(pairs: DataFrame) -> DataFrame:
    """``pairs`` (sites of the template as st, of the cell as sc) with violates: an edit of the template that the cell, observed there, does not have."""
    return pairs.withColumn("violates", F.exists(F.arrays_zip("st", "sc"), lambda z: (z["st"] != C.UNEDITED) & z["sc"].isNotNull() & (z["st"] != z["sc"])))


def pendant_parts(matches: DataFrame, genotypes: DataFrame, founders: DataFrame | None = None) -> DataFrame:
    """cell, host, pendant, residual, new_edits, shared_edits and n_shared of each of ``matches`` (cell, host), from ``genotypes`` (cell, tape, sites; a row for each observed tape).

    Over the tapes that both have: new_edits are the cell's edits beyond the prefix that it shares with its host, pendant is their mean by tape and residual that of the host's own; shared_edits are the
    shared prefixes beyond each tape's founder prefix (``founders``: tape, n, few). Cells without a shared tape have 0 in all.
    """
    g = genotypes.select("cell", "tape", "sites")
    own = g.select(F.col("cell").alias("_c"), "tape", F.col("sites").alias("_sc"))
    its = g.select(F.col("cell").alias("_h"), F.col("tape").alias("_th"), F.col("sites").alias("_sh"))
    met = matches.select("cell", "host").join(own, F.col("cell") == F.col("_c")).join(its, (F.col("host") == F.col("_h")) & (F.col("tape") == F.col("_th")))
    if founders is None:
        met = met.withColumn("_f", F.lit(0))
    else:
        met = met.join(F.broadcast(founders.select(F.col("tape").alias("_tf"), F.col("n").alias("_f"))), F.col("tape") == F.col("_tf"), "left")
    edits = lambda c: F.size(F.filter(c, lambda x: x.isNotNull() & (x != C.UNEDITED)))
    shared = C.shared_prefix(F.col("_sc"), F.col("_sh"))
    per = met.select("cell", "host", (edits("_sc") - shared).alias("_new"), (edits("_sh") - shared).alias("_old"), F.greatest(F.lit(0), shared - F.coalesce("_f", F.lit(0))).alias("_same"))
    n = per.groupBy(F.col("cell").alias("_c"), F.col("host").alias("_h")).agg(*[F.sum(c).cast("long").alias(c) for c in ("_new", "_old", "_same")], F.count("*").alias("_n"))
    out = matches.select("cell", "host").join(n, (F.col("cell") == F.col("_c")) & (F.col("host") == F.col("_h")), "left").na.fill(0, ["_new", "_old", "_same", "_n"])
    by = F.greatest(F.lit(1), "_n")
    return out.select("cell", "host", (F.col("_new") / by).alias("pendant"), (F.col("_old") / by).alias("residual"), F.col("_new").alias("new_edits"), F.col("_same").alias("shared_edits"), F.col("_n").alias("n_shared"))


def sampled_tips(leaves: DataFrame, dropped: list[str], keep: int, seed: int = 1) -> DataFrame:
    """``leaves`` (node, trajectory) without those of ``dropped`` trajectories (null ones stay), and of the rest the ``keep`` with the least md5 of seed and node: a sample for robustness, the same for any partitioning."""
    rest = leaves.filter(~F.coalesce(F.col("trajectory").isin(dropped), F.lit(False))) if dropped else leaves
    keyed = rest.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), "node").cast("binary")))
    return running(keyed, ["_key", "node"], {"_nth": "1L"}).filter(F.col("_nth") <= keep).select(*leaves.columns)

