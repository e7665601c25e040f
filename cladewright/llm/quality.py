"""Quality by nearest-neighbour voting in a latent space.

A bounded sample of labelled texts (``sample`` for each label) is turned into term weights and a truncated SVD of them (latent semantic analysis); its latent
vectors, of a size that ``sample`` and ``rank`` fix, go to all workers. Each text is projected, compared with all sample vectors by blocked cosine products,
and its ``k`` most similar neighbours vote with the weight of their similarity and of how many labelled rows each sampled row stands for.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, workers_ready

WORDS, SHAPES, FACTS = 1 << 12, 1 << 10, 17 * 9
DIMS = WORDS + SHAPES + FACTS
#: Weights of the three kinds of terms, each of which is a unit vector by itself.
KINDS = ((0, WORDS, 0.4), (WORDS, WORDS + SHAPES, 1.0), (WORDS + SHAPES, DIMS, 1.0))
#: The power of a similarity that is the weight of a vote.
SHARP = 24
_CLASS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))
_RUN = re.compile(rb"(?<=a)a+|(?<=A)A+|(?<=0)0+")


def terms(text: str | None) -> np.ndarray:
    """Raw term weights of a whole text: its words, the shapes of its words (letters, capitals and digits in runs), and facts about it in bins."""
    raw = (text or "").encode("utf-8", "replace")
    order = raw.lower().split()
    words, shapes = Counter(order), Counter(_RUN.sub(b"", raw.translate(_CLASS)).split())
    n, out = max(1, len(order)), np.zeros(DIMS, np.float32)
    if order:
        out[:WORDS] = np.bincount(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS, 1 + np.log(np.fromiter(words.values(), float, len(words))), WORDS)
        out[WORDS:WORDS + SHAPES] = np.bincount(np.fromiter(map(zlib.crc32, shapes), np.int64, len(shapes)) % SHAPES, np.fromiter(shapes.values(), float, len(shapes)) / n, SHAPES)
    lines = raw.split(b"\n")
    facts = (
        len(words) / n, max(words.values(), default=0) / n, sum(map(eq, order, islice(order, 1, None))) / n, len(set(lines)) / len(lines), n / max(1, len(raw)), np.log1p(n) / 12,
        sum(c for w, c in shapes.items() if b"A" in w and b"a" not in w) / n, sum(c for w, c in shapes.items() if w.strip(b"aA0.,;:'")) / n,
        sum(c for w, c in shapes.items() if b"a" not in w and b"A" not in w) / n,
    )
    for k, x in enumerate(facts):  # two neighbouring bins share a fact, so that close values stay close
        low, part = divmod(15 * min(1.0, x), 1)
        at = WORDS + SHAPES + 17 * k + int(low)
        out[at:at + 2] = 1 - part, part
    return out


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of term weights by idf, each kind of terms to its own unit length and weight."""
    x = x * idf
    for low, high, w in KINDS:
        norm = np.linalg.norm(x[:, low:high], axis=1, keepdims=True)
        x[:, low:high] *= w / np.maximum(norm, 1e-9)
    return x


class Voter:
    """Sample vectors, their labels and weights, and the projection; all of a bounded size."""

    def __init__(self, rows: list[tuple], rank: int, k: int) -> None:
        """rows: keys, values, label, weight of each sampled row."""
        self.k = k
        n = len(rows)
        df = np.zeros(DIMS)
        for keys, *_ in rows:
            df[keys] += 1
        self.idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

        def blocks(size: int = 256) -> Iterator[tuple[slice, np.ndarray]]:
            """The sample's weighted terms, some rows at a time: all of them at once would fill the driver."""
            for low in range(0, n, size):
                x = np.zeros((min(size, n - low), DIMS), np.float32)
                for i, (keys, vals, *_) in enumerate(rows[low:low + size]):
                    x[i, keys] = vals
                yield slice(low, low + len(x)), weighted(x, self.idf)

        width = max(1, min(rank + 16, n))
        into = np.random.default_rng(9).standard_normal((DIMS, width), dtype=np.float32)
        times = lambda m: np.concatenate([x @ m for _, x in blocks()])
        back = lambda m: sum(x.T @ m[at] for at, x in blocks())
        y = times(into)
        for _ in range(4):  # subspace iteration
            y = times(back(np.linalg.qr(y)[0]))
        b = back(np.linalg.qr(y)[0]).T
        self.basis = np.ascontiguousarray(np.linalg.svd(b, full_matrices=False)[2][:rank].T, np.float32)
        self.near = self.unit(times(self.basis))
        self.label = np.array([r[2] for r in rows], np.float32)
        self.weight = np.array([r[3] for r in rows], np.float32)

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        k = min(self.k, len(self.label))
        for low in range(0, len(texts), 256):  # blocks of 256 texts by all sample rows
            own = np.stack([terms(t) for t in texts[low:low + 256]])
            near = self.unit(weighted(own, self.idf) @ self.basis) @ self.near.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** SHARP * self.weight[best]
            out[low:low + 256] = (w * self.label[best]).sum(1) / w.sum(1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 2048, rank: int = 48, k: int = 25) -> Voter | None:
    """Learn from at most ``sample`` rows of each label value, those with the least hash of their id, outside the held-out fold; None if there are none.

    Rows with a null id or label are not learned from; where an id has several labels, the least counts.
    """
    spark = docs.sparkSession
    workers_ready(spark)
    known = labels.filter(~held_out() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    size = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1])  # 2 * sample rows at most

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [terms(t) for t in pdf.text]
            keys = [np.flatnonzero(v) for v in made]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "y": pdf.y, "keys": [k.astype(np.int32).tobytes() for k in keys], "vals": [v[k].tobytes() for v, k in zip(made, keys, strict=True)]})

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = texts.mapInPandas(featurize, "doc_id long, y int, keys binary, vals binary").groupBy("doc_id", "y").agg(F.min(F.struct("keys", "vals")).alias("t"))
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    if not rows:
        return None
    each = Counter(r.y for r in rows)
    return Voter([(np.frombuffer(r.t["keys"], np.int32), np.frombuffer(r.t["vals"], np.float32), r.y, size[r.y] / each[r.y]) for r in rows], rank, k)


def scorer(docs: DataFrame, voter: Voter | None):
    """A function of a text column: the score, from 0 to 1, of a whole text. Null counts as empty. Without anything learned every score is 0.5."""
    workers_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for s in texts:
            yield pd.Series(own.score(list(s)) if own and len(s) else np.full(len(s), 0.5))

    return score


def predict(docs: DataFrame, labels: DataFrame, cut_at: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score is ``cut_at`` or more) of every row."""
    score: Column = scorer(docs, fit(docs, labels, **options))(F.col("text"))
    return docs.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= cut_at).cast("int"))
