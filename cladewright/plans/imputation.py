"""Queries on neighbours, transferred labels and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import query
from cladewright.operators import imputation as I
from cladewright.operators import neighbours as N

_KNN = "knn AS (SELECT a.vec_id AS q, b.vec_id AS c, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM {embeddings} a JOIN {embeddings} b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) <= 10)"


def nearest(e: DataFrame, some: str = "id % 20 = 0") -> DataFrame:
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return I.knn(v, v.filter(some), 10)


@query(f"WITH {_KNN} SELECT q, c, round(d, 5) AS distance, row_number() OVER (PARTITION BY q ORDER BY d, c) AS rank FROM knn", "embeddings")
def knn_topk(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings).withColumn("distance", F.round("distance", 5))


@query(None, "embeddings")
def forest_neighbours(embeddings: DataFrame) -> DataFrame:
    """Near others by the forest; its share of the true ones is held against ``knn_topk`` by a test."""
    v = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return N.forest_knn(v, v.filter("id % 20 = 0"), 10).withColumn("distance", F.round("distance", 5))


@query(None, "embeddings")
def mutual_nn(embeddings: DataFrame) -> DataFrame:
    """Pairs among all rows: mutuality needs the neighbours of both ends, so every row is a query."""
    return I.mutual(nearest(embeddings, "true"))


@query(f"WITH {_KNN}, v AS (SELECT q, label, count(*) AS n FROM knn JOIN {{embeddings}} e ON e.vec_id = knn.c GROUP BY q, label) SELECT q, label FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, label) = 1", "embeddings")
def label_transfer(embeddings: DataFrame) -> DataFrame:
    return I.majority(nearest(embeddings).join(embeddings.select(F.col("vec_id").alias("c"), "label"), "c"), "q", "label")


@query("""WITH s AS (SELECT p.celltype AS src, n.celltype AS dst FROM {nodes} n JOIN {nodes} p ON p.node = n.parent), c AS (SELECT src, dst, count(*) AS n FROM s WHERE src <> dst GROUP BY src, dst)
  SELECT c.src, c.dst, c.n, coalesce(r.n, 0) AS back, CASE WHEN c.n + coalesce(r.n, 0) >= 5 THEN round((c.n - coalesce(r.n, 0)) / (c.n + coalesce(r.n, 0)), 6) END AS asymmetry FROM c LEFT JOIN c r ON r.src = c.dst AND r.dst = c.src""", "nodes")
def transition_asymmetry(nodes: DataFrame) -> DataFrame:
    up = nodes.select(F.col("node").alias("parent"), F.col("celltype").alias("src"))
    return I.transitions(nodes.join(up, "parent").select("src", F.col("celltype").alias("dst")), 5).withColumn("asymmetry", F.round("asymmetry", 6))
