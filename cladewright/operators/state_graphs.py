"""Inferred transitions against a curated graph of states: distances between all states, and how often steps join neighbours when labels are permuted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairings import relabelled
from .scale import cut, fresh


def all_distances(edges: DataFrame, directed: bool = False) -> DataFrame:
    """a, b and d: the least number of steps between any two states of ``edges`` (src, dst) that are connected, 0 from each to itself.

    Min-plus doubling: a round joins the table with itself over the middle, so that ways of up to twice the length are known; rounds go with the log of the longest. Null ends are left out.
    """
    e = edges.filter("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if not directed:
        e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = e.select("a").unionByName(e.select(F.col("b").alias("a"))).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("d"))
    known = fresh(own.unionByName(e.filter("a <> b").distinct().withColumn("d", F.lit(1))))
    mark = lambda t: t.agg(F.count("*"), F.sum("d")).first()
    seen = mark(known)
    while True:
        far = known.select(F.col("a").alias("_m"), F.col("b").alias("_b"), F.col("d").alias("_d"))
        known = fresh(known.join(far, F.col("b") == F.col("_m")).groupBy("a", F.col("_b").alias("b")).agg(F.min(F.col("d") + F.col("_d")).alias("d")))
        now = mark(known)
        if now == seen:
            return known
        seen = now


def step_distances(steps: DataFrame, distances: DataFrame) -> DataFrame:
    """``steps`` (src, dst and others) with d, the distance of their ends; those with an unknown state, or of states that are not connected, are left out. States are few."""
    far = F.broadcast(distances.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "d"))
    return steps.join(far, (F.col("src") == F.col("_a")) & (F.col("dst") == F.col("_b"))).drop("_a", "_b")


def adjacency_test(steps: DataFrame, edges: DataFrame, states: DataFrame, replicates: int = 9999, seed: int = 1) -> DataFrame:
    """steps, adjacent, median, null_mean, null_sd, enrichment and p, one row: the share of ``steps`` (src, dst) that join neighbours of the graph, and the same after the ``states`` (state) have changed
    places at random, ``replicates`` times.

    p has the +1 rule: of all draws and the observed one, the share that is as high. States of steps that are not in the graph stay unknown in all draws. No measured step gives nulls.
    """
    distances = cut(all_distances(edges))
    placed = states.select(F.col("state").alias("node")).distinct().join(distances.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", F.lit("all").alias("stratum"), F.col("node").alias("cls"))
    perm = cut(relabelled(placed, replicates, seed).select("rep", "node", "cls"))
    own = steps.select("src", "dst").join(placed.select(F.col("node").alias("src")), "src", "left_semi").join(placed.select(F.col("node").alias("dst")), "dst", "left_semi")
    own = cut(own.groupBy("src", "dst").agg(F.count("*").alias("n")))
    real = step_distances(own, distances)
    share = F.sum(F.when(F.col("d") == 1, F.col("n")).otherwise(0)) / F.sum("n")
    seen = real.agg(F.sum("n").alias("steps"), share.alias("adjacent"), F.percentile("d", F.lit(0.5), F.col("n")).alias("median"))
    at = lambda c: perm.select(F.col("rep").alias(f"_rep_{c}"), F.col("node").alias(f"_{c}"), F.col("cls").alias(f"new_{c}"))
    moved = F.broadcast(own).join(at("src"), F.col("src") == F.col("_src")).join(at("dst"), (F.col("dst") == F.col("_dst")) & (F.col("_rep_src") == F.col("_rep_dst")))
    moved = moved.select(F.col("_rep_src").alias("rep"), F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "n")
    null = step_distances(moved, distances).groupBy("rep").agg(share.alias("x"))
    told = null.join(F.broadcast(seen)).agg(F.avg("x").alias("null_mean"), F.stddev_pop("x").alias("null_sd"), F.count_if(F.col("x") >= F.col("adjacent") - 1e-12).alias("_high"))
    return seen.join(F.broadcast(told)).select(
        "steps", "adjacent", "median", "null_mean", "null_sd", F.try_divide("adjacent", "null_mean").alias("enrichment"), F.when(F.col("steps") > 0, (F.col("_high") + 1) / F.lit(replicates + 1)).alias("p"))
