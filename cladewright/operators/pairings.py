"""Captured pairings of sibling cells against permuted labels, for all thresholds at once.

A post-mitotic cell pairs with the progenitor among its siblings that differs least. Labels are permuted within strata by a keyed permutation of ranks: each node's rank goes to another by
a pseudorandom bijection of the replicate, and the labels stand in the order of their kinds, so that a label is read off a few running totals. No replicate is sorted or gathered: a node carries its kinds in
all replicates, pairs are dealt by cell once, and all replicates of a cell's pairs stay in its task; what leaves it are counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.shipping import ship

from .scale import cut, running
from .statistics import bh
from .summaries import overdispersed_tail

ROUNDS = 24


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of 64 bits of some numbers, element by element."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            h = h ^ h >> np.uint64(31)
    return h


def permuted(x: np.ndarray, n: np.ndarray, *key: np.ndarray | int) -> np.ndarray:
    """Where a bijection of 0 .. n - 1, one for each ``key``, sends x: in each round x and its mirror image about a keyed point change places or not, as a keyed bit of the two says."""
    for r in range(ROUNDS):
        y = ((mixed(*key, r) % n.astype(np.uint64)).astype(np.int64) - x) % n
        x = np.where(mixed(*key, r, np.maximum(x, y)) & np.uint64(1) == 1, y, x)
    return x


def ranked_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``labels`` (node, stratum, cls) with rank (from 0 in the stratum, by node), and for each stratum n, key and kinds: (hi, cls), the running totals of its kinds in order. Kinds are few."""
    ranked = running(labels.select("node", "stratum", "cls"), ["node"], {"upto": "1L"}, ["stratum"]).withColumn("rank", F.col("upto") - 1).drop("upto")
    n = labels.groupBy("stratum", "cls").agg(F.count("*").alias("_n"))
    upto = n.withColumn("hi", F.sum("_n").over(W.partitionBy("stratum").orderBy("cls")))  # a row for each kind
    return ranked, upto.groupBy("stratum").agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("hi", "cls"))).alias("kinds")).withColumn("key", F.xxhash64("stratum"))


def drawn(labels: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``labels`` (node, stratum, cls) with kinds and draws: for each replicate the number of the kind, from 0, that the node gets."""
    ship(labels.sparkSession)

    @F.pandas_udf("array<int>")
    def draws(rank: pd.Series, key: pd.Series, n: pd.Series, upto: pd.Series) -> pd.Series:
        rep, out = np.arange(1, replicates + 1)[None], [None] * len(rank)
        for k in key.unique():
            rows = np.flatnonzero(key == k)
            hi = np.asarray(upto.iloc[rows[0]])
            for low in range(0, len(rows), 1024):
                own = rows[low:low + 1024]
                x = np.repeat(rank.iloc[own].to_numpy(np.int64)[:, None], replicates, 1)
                kinds = np.searchsorted(hi, permuted(x, n.iloc[own].to_numpy(np.int64)[:, None], seed, int(k) & (1 << 64) - 1, rep), "right")
                for i, row in zip(own, kinds, strict=True):
                    out[i] = row
        return pd.Series(out, dtype=object)

    ranked, strata = ranked_labels(labels)
    x = ranked.join(F.broadcast(strata.withColumnRenamed("stratum", "_s")), F.col("stratum").eqNullSafe(F.col("_s")))
    return x.select("node", "stratum", "cls", F.transform("kinds", lambda k: k["cls"]).alias("kinds"), draws("rank", "key", "n", F.transform("kinds", lambda k: k["hi"])).alias("draws"))


def relabelled(labels: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """rep, node, stratum and cls of ``labels`` (node, stratum, cls; nodes told apart, none null) permuted within strata, for each replicate."""
    x = drawn(labels, replicates, seed).select("node", "stratum", "kinds", F.posexplode("draws").alias("_r", "_k"))
    return x.select((F.col("_r") + 1).alias("rep"), "node", "stratum", F.get("kinds", F.col("_k")).alias("cls"))


def directed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each of ``pairs`` (a, b, age, disc, shared; a null or negative disc is left out) from either end, dealt by the first end, with a_ and b_ of all columns of ``labels`` (node, stratum, ...). Pairs need
    labels of one stratum."""
    end = lambda c: labels.select(*[F.col(x).alias(f"{c}_{x}") for x in labels.columns])
    known = pairs.filter("disc >= 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "age", "disc", "shared")
    both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "age", "disc", "shared"))
    met = both.join(end("a"), F.col("a") == F.col("a_node")).join(end("b"), (F.col("b") == F.col("b_node")) & F.col("a_stratum").eqNullSafe(F.col("b_stratum")))
    return met.withColumnRenamed("a_stratum", "stratum").repartition("a")


def counted(rows: DataFrame, post: list[str], ages: list[float], discs: list[int]) -> DataFrame:
    """rep, stratum, age, disc, progenitor, kind and n: cells of a post-mitotic kind (in ``post``) by that of their partner, for pairs of ``age`` or more and ``disc`` or less.

    A cell's partner is its sibling of another kind of cell (none in ``post``) with the least disc, then most shared, then the least node. As disc comes first, a partner that
    is chosen among all counts for every disc from its own on, so that only ages choose anew.
    """
    het = rows.filter(F.col("_a").isin(post) & ~F.col("_b").isin(post))
    best = [F.min(F.when(F.col("age") >= a, F.struct("disc", (-F.col("shared")).alias("unshared"), "b", F.col("_b").alias("cls")))).alias(f"_m{k}") for k, a in enumerate(ages)]
    one = het.groupBy("a", "rep", "stratum", "_a").agg(*best)
    cells = F.array(*[F.struct(F.lit(float(a)).alias("age"), F.col(f"_m{k}").alias("m")) for k, a in enumerate(ages)])
    finest = one.select("rep", "stratum", F.col("_a").alias("kind"), F.explode(F.filter(cells, lambda c: c["m"].isNotNull())).alias("c"))
    finest = finest.groupBy("rep", "stratum", "kind", F.col("c.age").alias("age"), F.col("c.m.cls").alias("progenitor"), F.col("c.m.disc").alias("_d")).agg(F.count("*").alias("n"))
    up = F.filter(F.array(*[F.lit(d) for d in sorted(discs)]), lambda d: d >= F.col("_d"))
    return finest.withColumn("disc", F.explode(up)).groupBy("rep", "stratum", "age", "disc", "progenitor", "kind").agg(F.sum("n").alias("n"))


def observed(pairs: DataFrame, labels: DataFrame, post: list[str], ages: list[float], discs: list[int]) -> DataFrame:
    """stratum, age, disc, progenitor, kind and n of the labels as they are (see ``counted``); a pairing that occurs nowhere has no row."""
    rows = directed(pairs, labels.select("node", "stratum", "cls")).select("a", "b", "age", "disc", "shared", "stratum", F.lit(0).alias("rep"), F.col("a_cls").alias("_a"), F.col("b_cls").alias("_b"))
    return counted(rows, post, ages, discs).drop("rep")


def null_moments(pairs: DataFrame, labels: DataFrame, post: list[str], ages: list[float], discs: list[int], replicates: int = 500, seed: int = 1, pooled: str = "pool") -> DataFrame:
    """stratum, age, disc, progenitor, kind, mean and variance (over all ``replicates``) of the counts under permuted labels, for each stratum and for their sum as ``pooled``.

    Partners are selected anew in every replicate. Pairings that no replicate has are left out: both moments are 0.
    """
    rows = directed(pairs, cut(drawn(labels, replicates, seed).drop("cls"))).withColumn("_z", F.arrays_zip("a_draws", "b_draws"))
    rows = rows.select("a", "b", "age", "disc", "shared", "stratum", "a_kinds", F.posexplode("_z").alias("rep", "_z"))
    rows = rows.select("a", "b", "age", "disc", "shared", "stratum", "rep", F.get("a_kinds", F.col("_z.a_draws")).alias("_a"), F.get("a_kinds", F.col("_z.b_draws")).alias("_b"))
    n = cut(counted(rows, post, ages, discs))
    keys = ["stratum", "age", "disc", "progenitor", "kind"]
    all_ = n.unionByName(n.groupBy("rep", *keys[1:]).agg(F.sum("n").alias("n")).withColumn("stratum", F.lit(pooled)))
    mean = F.sum("n") / F.lit(replicates)
    return all_.groupBy(*keys).agg(mean.alias("mean"), F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("n")) / F.lit(replicates) - mean * mean).alias("variance"))


def captured(counts: DataFrame, moments: DataFrame, least: int = 3, fdr: float = 0.01, fold: float = 3.0, pseudo: float = 1.0, pooled: str = "pool") -> DataFrame:
    """stratum, age, disc, progenitor, kind, n, mean, variance, fold, p, q and captured of pairings with ``least`` or more, for each stratum and for their sum.

    Expected counts and variances have ``pseudo`` added. q is p adjusted within each stratum and threshold; captured says that q is below ``fdr`` and fold at least ``fold``.
    """
    keys = ["stratum", "age", "disc", "progenitor", "kind"]
    seen = counts.unionByName(counts.groupBy(*keys[1:]).agg(F.sum("n").alias("n")).withColumn("stratum", F.lit(pooled)))
    on = seen.filter(F.col("n") >= least).join(moments, keys, "left").na.fill(0.0, ["mean", "variance"])
    x = on.withColumn("fold", (F.col("n") + pseudo) / (F.col("mean") + pseudo)).withColumn("p", overdispersed_tail(F.col("n"), F.col("mean"), F.col("variance"), pseudo))
    return bh(cut(x), "p", ["stratum", "age", "disc"]).withColumn("captured", (F.col("q") < fdr) & (F.col("fold") >= fold))


def robust(tested: DataFrame, stratum: str = "pool") -> DataFrame:
    """progenitor, kind, hits (in how many of all thresholds tried in ``stratum`` the pairing is captured) and everywhere: in all of them."""
    own = tested.filter(F.col("stratum") == stratum)
    cells = own.select("age", "disc").distinct().agg(F.count("*").alias("_cells"))
    hits = own.groupBy("progenitor", "kind").agg(F.count_if("captured").alias("hits"))
    return hits.join(F.broadcast(cells)).filter("hits > 0").select("progenitor", "kind", "hits", (F.col("hits") == F.col("_cells")).alias("everywhere"))
