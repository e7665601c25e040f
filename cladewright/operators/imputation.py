"""Nearest neighbours, label transfer, state transitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.shipping import ship

from .neighbours import Nearest


def packed(vectors: DataFrame, prefix: str, per: int = 2048) -> DataFrame:
    """Rows (id, v) in blocks of about ``per``: one row for each, with its number, ids and their vectors."""
    blocks = max(1, -(-vectors.count() // per))
    at = vectors.select("id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_b"))
    return at.groupBy("_b").agg(F.collect_list(F.struct("id", "v")).alias("_x")).select(F.col("_b").alias(f"{prefix}_b"), F.col("_x.id").alias(f"{prefix}_ids"), F.col("_x.v").alias(f"{prefix}_v"))


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, c, distance and rank of the k nearest others of each query (id, v): exact, each query against all vectors; equal distances go to the least id.

    Queries are a stated set, dealt in blocks that each meet every block of vectors in one row; a block pair is compared as matrices. A task goes through the blocks of vectors with the k nearest of
    each query so far, so that of most pairs only the square is looked at, and it gives k rows for each query rather than for each block pair.
    """
    ship(vectors.sparkSession)
    met = packed(queries, "q").crossJoin(packed(vectors, "c"))  # blocks, not rows

    def nearest(batches):
        at, best = None, None
        for pdf in batches:
            for b, qi, qv, ci, cv in zip(pdf.q_b, pdf.q_ids, pdf.q_v, pdf.c_ids, pdf.c_v, strict=True):
                if b != at:
                    if best is not None:
                        yield best.rows()
                    at, best = b, Nearest(np.asarray(qi), np.stack(qv), k)
                best.add(np.asarray(ci), np.stack(cv))
        if best is not None:
            yield best.rows()

    near = met.mapInPandas(nearest, "q long, c long, distance double")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "c"))).filter(F.col("rank") <= k).select("q", "c", "distance", F.col("rank").cast("long").alias("rank"))


def mutual(edges: DataFrame) -> DataFrame:
    """a and b (a < b) of pairs that are each other's neighbours, from directed edges (q, c)."""
    e = edges.select("q", "c")
    return e.join(e.select(F.col("c").alias("q"), F.col("q").alias("c")), ["q", "c"]).filter("q < c").select(F.col("q").alias("a"), F.col("c").alias("b"))


def majority(votes: DataFrame, key: str, label: str) -> DataFrame:
    """key and the label with most votes; ties go to the least."""
    n = votes.groupBy(key, label).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.min_by(label, F.struct(-F.col("_n"), label)).alias(label))


def transitions(steps: DataFrame, least: int = 50) -> DataFrame:
    """src, dst, n, back and asymmetry (n - back) / (n + back) of steps between different states; null where n + back is under ``least``."""
    n = steps.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    r = n.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("back"))
    both = F.col("n") + F.col("back")
    return n.join(r, ["src", "dst"], "left").na.fill(0, ["back"]).withColumn("asymmetry", F.when(both >= least, (F.col("n") - F.col("back")) / both))
