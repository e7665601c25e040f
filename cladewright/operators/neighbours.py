"""Approximate nearest neighbours by a forest of random projections, searched by joins of leaves.

Trees of hyperplanes are fitted on a bounded sample; every row of the table goes down each tree to a leaf, and each query to the leaves that lie nearest (it crosses the
planes that it is closest to first). Rows and queries of a leaf meet in a task, where distances are exact, so that the forest decides only which rows are compared. Leaves of more
than ``BLOCK`` rows are dealt in blocks that the queries all visit, so that copies of one vector don't end in one task. ``imputation.knn`` compares all and is the measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.shipping import ship

#: Rows that trees are fitted on at most, and how many of them a leaf has at most.
SAMPLE, LEAF = 16_384, 64
TREES, PROBES, BLOCK = 8, 12, 8192


class Tree:
    """Planes by node, and children; a child below 0 is the leaf -1 - child."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        self.normal, self.at, self.kids, self.leaves = [], [], [], 0
        self.root = self.grow(points, leaf, rng)
        self.normal = np.array(self.normal) if self.normal else np.zeros((0, points.shape[1]))
        self.at, self.kids = np.array(self.at), np.array(self.kids, np.int64).reshape(-1, 2)

    def grow(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        todo, out = [(points, None, 0)], 0
        while todo:
            some, above, side = todo.pop()
            normal, low = None, None
            for _ in range(4 if len(some) > leaf else 0):
                a, b = some[rng.choice(len(some), 2, replace=False)]
                along = some @ (a - b)
                middle = float(np.median(along))
                if 0 < (along <= middle).sum() < len(some):
                    normal, low = a - b, along <= middle
                    break
            if normal is None:  # few points, or points alike
                name = -1 - self.leaves
                self.leaves += 1
            else:
                name = len(self.normal)
                size = np.linalg.norm(normal)
                self.normal.append(normal / size)
                self.at.append(middle / size)
                self.kids.append([0, 0])
                todo += [(some[low], name, 0), (some[~low], name, 1)]
            if above is None:
                out = name
            else:
                self.kids[above][side] = name
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        node = np.full(len(x), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            high = np.einsum("ij,ij->i", x[inner], self.normal[n]) > self.at[n]
            node[inner] = self.kids[n, high.astype(int)]
        return -1 - node

    def probes(self, x: np.ndarray, most: int) -> list[int]:
        """The leaves that ``x`` is nearest to, by the farthest plane that lies between, at most ``most``."""
        import heapq

        heap, out = [(0.0, self.root)], []
        while heap and len(out) < most:
            far, node = heapq.heappop(heap)
            while node >= 0:
                over = float(x @ self.normal[node] - self.at[node])
                near = int(over > 0)
                heapq.heappush(heap, (max(far, abs(over)), int(self.kids[node, 1 - near])))
                node = int(self.kids[node, near])
            out.append(-1 - node)
        return out


def fitted(vectors: DataFrame, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, seed: int = 1) -> list[Tree]:
    """``trees`` trees, from at most ``sample`` rows of ``vectors`` (id, v): those of the least hashes of their ids, so that the choice does not depend on how rows are dealt."""
    n = vectors.count()
    share = min(1.0, 2.0 * sample / max(n, 1))
    some = vectors.select("v", F.xxhash64("id", F.lit(seed)).alias("_h"), "id").filter((F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30)) & F.col("v").isNotNull())
    rows = some.orderBy("_h", "id").limit(sample).select(F.col("v").cast("array<double>").alias("v")).collect()
    points = np.array([r.v for r in rows]) if rows else np.zeros((1, 1))
    return [Tree(points, leaf, np.random.default_rng([seed, t])) for t in range(trees)]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    v = batch.column("v")
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))


def forest_knn(vectors: DataFrame, queries: DataFrame, k: int, trees: int = TREES, probes: int = PROBES, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """q, c, distance and rank of ``k`` near others of each query (id, v), by exact distances to the rows of ``vectors`` (id, v) that share one of its leaves; equal distances go to the least id.

    All of ``vectors`` are in each tree. Ids are longs and not null, vectors of one length without nulls; rows with a null vector are left out. More trees or probes give more of the
    true neighbours. No rows, or no queries, give none.
    """
    spark = vectors.sparkSession
    ship(spark)
    known = vectors.filter("v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    asked = queries.filter("v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    planes = spark.sparkContext.broadcast(fitted(known, trees, sample, leaf))

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _rows(batch)
            if len(ids):
                for t, tree in enumerate(planes.value):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(tree.leaf_of(x).astype(np.int32))], ["tree", "leaf"])

    sizes = known.mapInArrow(where, "tree int, leaf int").groupBy("tree", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > block).collect()  # a row for each large leaf
    parts = spark.sparkContext.broadcast({(r.tree, r.leaf): -(-r.n // block) for r in sizes})
    schema = "task long, id long, v array<double>, asks boolean"
    names = ["task", "id", "v", "asks"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _rows(batch)
            if not len(ids):
                continue
            for t, tree in enumerate(planes.value):
                at = tree.leaf_of(x)
                of = np.array([parts.value.get((t, int(f)), 1) for f in at])
                mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                part = ((mixed ^ mixed >> np.uint64(32)) % of.astype(np.uint64)).astype(np.int64)
                task = (np.int64(t) << 48) + (at.astype(np.int64) << 20) + part
                yield pa.RecordBatch.from_arrays([pa.array(task), batch.column("id"), batch.column("v"), pa.array(np.zeros(len(ids), bool))], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _rows(batch)
            if not batch.num_rows:
                continue
            for t, tree in enumerate(planes.value):
                task, row = [], []
                for i in range(len(x)):
                    for f in tree.probes(x[i], probes):
                        for p in range(parts.value.get((t, f), 1)):
                            task.append((t << 48) + (f << 20) + p)
                            row.append(i)
                took = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), took.column("id"), took.column("v"), pa.array(np.ones(len(row), bool))], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, rows, asks = None, [], [], []

        def close() -> pa.RecordBatch:
            a, x, q = np.concatenate(ids), np.concatenate(rows), np.concatenate(asks)
            out = nearest(a[q], x[q], a[~q], x[~q], k)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["q", "c", "distance"])

        for batch in batches:
            own = batch.column("task").to_numpy()
            mine, x = _rows(batch)
            is_query = batch.column("asks").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
            for s, e in zip(edge, [*edge[1:], len(own)], strict=True):
                if own[s] != task:
                    if ids:
                        yield close()
                    task, ids, rows, asks = own[s], [], [], []
                ids.append(mine[s:e])
                rows.append(x[s:e])
                asks.append(is_query[s:e])
        if ids:
            yield close()

    dealt = known.mapInArrow(put, schema).unionByName(asked.mapInArrow(ask, schema)).repartition("task").sortWithinPartitions("task")
    pairs = dealt.mapInArrow(meet, "q long, c long, distance double").groupBy("q", "c").agg(F.min("distance").alias("distance"))
    best = pairs.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "c"))).filter(F.col("rank") <= k)
    return best.select("q", "c", "distance", F.col("rank").cast("long").alias("rank"))


def nearest(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int, rows: int = 256) -> tuple[list[int], list[int], list[float]]:
    """Ids of queries and of their ``k`` nearest others among ``c``, and the distances. Squares find who may be among them, differences tell the distances of these."""
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    if not len(qi) or not len(ci):
        return out
    size = np.einsum("ij,ij->i", c, c)
    for low in range(0, len(qi), rows):
        own = q[low:low + rows]
        square = size[None] - 2 * own @ c.T + np.einsum("ij,ij->i", own, own)[:, None]
        square[qi[low:low + rows, None] == ci[None]] = np.inf
        most = min(k, len(ci))
        slack = 1e-9 * (size.max() + 1)  # what squares may be off
        edge = np.partition(square, most - 1, axis=1)[:, most - 1] + slack
        for r in range(len(own)):
            some = np.flatnonzero((square[r] <= edge[r]) & np.isfinite(square[r]))
            d = np.sqrt(((c[some] - own[r]) ** 2).sum(1))
            some, d = (x[np.lexsort((ci[some], d))[:k]] for x in (some, d))
            out[0].extend([int(qi[low + r])] * len(some))
            out[1].extend(ci[some].tolist())
            out[2].extend(d.tolist())
    return out


class Nearest:
    """The ``k`` nearest others of queries, of vectors that come in blocks; equal distances go to the least id. After the first block few pairs are nearer than the k so far, and only these get a distance."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.d, self.c = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, ci: np.ndarray, c: np.ndarray, rows: int = 256) -> None:
        size = np.einsum("ij,ij->i", c, c)
        for low in range(0, len(self.ids), rows):
            part = slice(low, low + rows)
            own, d, best = self.x[part], self.d[part], self.c[part]
            own_size = np.einsum("ij,ij->i", own, own)
            square = size[None] - 2 * own @ c.T + own_size[:, None]
            edge = d[:, -1] ** 2
            if np.isinf(edge).any() and len(ci) > self.k + 1:
                edge = np.minimum(edge, np.partition(square, self.k, axis=1)[:, self.k])  # one of these may be the query itself
            r, j = np.nonzero(square <= (edge + 1e-9 * (size.max() + own_size.max() + 1))[:, None])  # what squares may be off
            other = self.ids[part][r] != ci[j]
            r, j = r[other], j[other]
            if not len(r):
                continue
            row = np.concatenate((np.repeat(np.arange(len(own)), self.k), r))
            far = np.concatenate((d.ravel(), np.sqrt(((c[j] - own[r]) ** 2).sum(1))))
            who = np.concatenate((best.ravel(), ci[j]))
            order = np.lexsort((who, far, row))
            row, far, who = row[order], far[order], who[order]
            first = np.searchsorted(row, np.arange(len(own)))
            take = first[:, None] + np.arange(self.k)[None]
            self.d[part], self.c[part] = far[take], who[take]

    def rows(self) -> pd.DataFrame:
        """q, c and distance."""
        r, j = np.nonzero(np.isfinite(self.d))
        return pd.DataFrame({"q": self.ids[r], "c": self.c[r, j], "distance": self.d[r, j]})
