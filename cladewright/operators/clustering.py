"""Agglomerative clustering of many groups at once, cuts of the trees that come of it, and cophenetic distances.

Clusters that are each other's nearest merge, all such pairs of a round together: for Ward's and average linkage that gives the same tree as one merge at a time. Both linkages follow
from sums over pairs of leaves (of distances, or of their squares), which simply add up when clusters merge, so a round is a relabelling join and a grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import fresh

LINKAGES = ("average", "ward")


def _height(linkage: str, between: Column, na: Column, nb: Column, wa: Column, wb: Column) -> Column:
    """The distance of two clusters from the sum of ``between``, their sizes and their sums within."""
    if linkage == "average":
        return between / (na * nb)
    apart = between / (na * nb) - wa / (na * na) - wb / (nb * nb)  # of the centres, squared
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 * na * nb / (na + nb) * apart))


def agglomerated(distances: DataFrame, linkage: str = "average", key: str = "grp") -> tuple[DataFrame, DataFrame]:
    """Merges (``key``, round, a, b, height, size) and cophenetic distances (``key``, i, j, d, height) of the complete ``distances`` (``key``, i < j, d) of each group.

    A cluster has the name of its least leaf, and b is taken up by a < b. Of equal distances that to the cluster of the least name counts; where ties run in a circle, the
    least pair of those at the least distance merges. height is the mean distance (average) or Ward's (of Euclidean distances, as scipy gives it). A round merges a pair
    of each group at least, so there are no more rounds than leaves in the largest group.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"no linkage {linkage}")
    d = F.col("d").cast("double")
    pairs = fresh(distances.select(F.col(key).alias("g"), "i", "j", (d if linkage == "average" else d * d).alias("s")))
    ends = pairs.select("g", F.col("i").alias("a")).unionByName(pairs.select("g", F.col("j").alias("a"))).distinct()
    who = fresh(ends.select("g", F.col("a").alias("leaf"), F.col("a").alias("name")))  # the cluster of each leaf
    clusters = fresh(ends.select("g", "a", F.lit(1.0).alias("n"), F.lit(0.0).alias("w")))
    sums, merges, joined, turn = pairs.select("g", F.col("i").alias("a"), F.col("j").alias("b"), "s"), None, None, 0
    while not sums.isEmpty():
        turn += 1
        of = lambda x: clusters.select(F.col("g").alias(f"_g{x}"), F.col("a").alias(f"_{x}"), F.col("n").alias(f"n{x}"), F.col("w").alias(f"w{x}"))
        met = sums.join(of("a"), (F.col("g").eqNullSafe(F.col("_ga"))) & (F.col("a") == F.col("_a"))).join(of("b"), (F.col("g").eqNullSafe(F.col("_gb"))) & (F.col("b") == F.col("_b")))
        far = fresh(met.select("g", "a", "b", "s", "na", "nb", "wa", "wb", _height(linkage, F.col("s"), F.col("na"), F.col("nb"), F.col("wa"), F.col("wb")).alias("height")))
        both = far.select("g", "a", "b", "height").unionByName(far.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "height"))
        nearest = both.groupBy("g", "a").agg(F.min(F.struct("height", "b")).alias("m")).select(F.col("g").alias("_g"), F.col("a").alias("_a"), F.col("m.b").alias("_b"))
        back = nearest.select(F.col("_g").alias("_h"), F.col("_a").alias("_c"), F.col("_b").alias("_d"))
        mutual = nearest.join(back, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_c")) & (F.col("_d") == F.col("_a"))).filter("_a < _b").select("_g", "_a", "_b")
        least = far.groupBy("g").agg(F.min(F.struct("height", "a", "b")).alias("m")).select(F.col("g").alias("_g"), F.col("m.a").alias("_a"), F.col("m.b").alias("_b"))
        none = least.join(mutual.select(F.col("_g").alias("_m")).distinct(), F.col("_g").eqNullSafe(F.col("_m")), "left_anti")  # ties in a circle
        chosen = mutual.unionByName(none)
        new = fresh(far.join(chosen, F.col("g").eqNullSafe(F.col("_g")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("g", "a", "b", "height", (F.col("na") + F.col("nb")).alias("size"), (F.col("wa") + F.col("wb") + F.col("s")).alias("w")))
        merges = (lambda x: x if merges is None else merges.unionByName(x))(new.select("g", F.lit(turn).alias("round"), "a", "b", "height", F.col("size").cast("long").alias("size")))
        in_a, in_b = (who.select(F.col("g").alias(f"_g{x}"), F.col("leaf").alias(f"leaf_{x}"), F.col("name").alias(f"_{x}")) for x in "ab")
        pairs_now = new.join(in_a, F.col("g").eqNullSafe(F.col("_ga")) & (F.col("a") == F.col("_a"))).join(in_b, F.col("g").eqNullSafe(F.col("_gb")) & (F.col("b") == F.col("_b")))
        now = pairs_now.select("g", F.least("leaf_a", "leaf_b").alias("i"), F.greatest("leaf_a", "leaf_b").alias("j"), "height")
        joined = now if joined is None else joined.unionByName(now)
        to = new.select(F.col("g").alias("_g"), F.col("b").alias("_from"), F.col("a").alias("_to"))
        at = lambda df, c: df.join(to, F.col("g").eqNullSafe(F.col("_g")) & (F.col(c) == F.col("_from")), "left").withColumn(c, F.coalesce("_to", c)).drop("_g", "_from", "_to")
        who = fresh(at(who, "name"))
        grown = new.select(F.col("g").alias("_g"), F.col("a").alias("_a"), F.col("size").alias("_n"), F.col("w").alias("_w"))
        gone = to.select("_g", "_from")
        left = clusters.join(gone, F.col("g").eqNullSafe(F.col("_g")) & (F.col("a") == F.col("_from")), "left_anti")
        left = left.join(grown, F.col("g").eqNullSafe(F.col("_g")) & (F.col("a") == F.col("_a")), "left")
        clusters = fresh(left.select("g", "a", F.coalesce("_n", "n").alias("n"), F.coalesce("_w", "w").alias("w")))
        named = at(at(far.select("g", "a", "b", "s"), "a"), "b").filter("a <> b")
        sums = fresh(named.groupBy("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")))
    told = distances.select(F.col(key).alias("_g"), F.col("i").alias("_i"), F.col("j").alias("_j"), d.alias("d"))
    empty = pairs.select("g", F.lit(0).alias("round"), F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("size")).limit(0)
    merges = empty if merges is None else merges
    joined = pairs.select("g", "i", "j", F.lit(0.0).alias("height")).limit(0) if joined is None else joined
    cophenetic = joined.join(told, F.col("g").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")))
    return merges.withColumnRenamed("g", key), cophenetic.select(F.col("g").alias(key), "i", "j", "d", "height")


def cut_at(cophenetic: DataFrame, height: float, key: str = "grp") -> DataFrame:
    """``key``, leaf and cluster (its least leaf) when the trees are cut at ``height``: leaves that meet at or below it are one cluster."""
    near = cophenetic.filter(F.col("height") <= height)
    both = near.select(key, F.col("i").alias("leaf"), F.col("j").alias("o")).unionByName(near.select(key, F.col("j").alias("leaf"), F.col("i").alias("o")))
    all_ = cophenetic.select(key, F.col("i").alias("leaf")).unionByName(cophenetic.select(key, F.col("j").alias("leaf"))).distinct()
    own = all_.select(key, "leaf", F.col("leaf").alias("o"))
    return own.unionByName(both).groupBy(key, "leaf").agg(F.min("o").alias("cluster"))


def cophenetic_correlation(cophenetic: DataFrame, key: str = "grp") -> DataFrame:
    """``key``, pairs and r: the correlation of distances with the heights at which leaves meet; null where either does not vary."""
    flat = (F.stddev("d") == 0) | (F.stddev("height") == 0)
    return cophenetic.groupBy(key).agg(F.count("*").alias("pairs"), F.when(~flat, F.corr("d", "height")).alias("r"))
