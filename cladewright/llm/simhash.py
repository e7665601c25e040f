"""SimHash near-duplicates found with pivot distance tables.

Fingerprints of 64 bits link at ``within`` or fewer differing bits, and links join transitively. By the triangle inequality two linked fingerprints are, to within
``within``, as far from each reference fingerprint (pivot). Two sets of pivots are used:

* Block pivots, the fingerprint 0 and the 64 of one bit. Which of the pivots 0 and bit i is nearer tells bit i of x, so two fingerprints have equal distance
  differences to all pivots of a block exactly if they agree on it. ``within`` differing bits touch at most ``within`` of ``within`` + 3 blocks, so a linked pair
  agrees on at least one choice of three blocks: an equi-join on these coordinates gives all candidates and few others. (Distances to arbitrary pivots alone
  prune little among 64-bit fingerprints: they concentrate around 32 with a standard deviation of 4, the same as the threshold.)
* Spread pivots. Candidates that share a bucket have their distances to ``PIVOTS`` pseudorandom pivots in a table; pairs whose maximum coordinate difference
  is above ``within`` are discarded, and survivors are verified by their true distance.

Only links that join parts of a bucket leave it, so their number follows the fingerprints, not the pairs. A bucket that outgrows ``run_cap`` is not compared pair
by pair: its fingerprints go to the exact way of ``midpoints``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, look_up, unused, workers_ready

SHINGLE, WITHIN, SEED, PIVOTS = 4, 4, 42, 16
_SPACE = bytes(range(9, 14))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _SPACE else c for c in range(256))


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint of a whole text as an unsigned number; 0 if it is null or has no words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[k - 1:] if len(words) >= k else ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)), np.uint64, len(last))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_ = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(set_, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def block_masks(within: int = WITHIN, agree: int = 3) -> list[int]:
    """Masks of each choice of ``agree`` out of ``within`` + ``agree`` blocks of the 64 bits."""
    n = within + agree
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, agree)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def joined_within(fps: np.ndarray, within: int = WITHIN, rows: int = 256) -> np.ndarray:
    """For distinct fingerprints, the number of the first one that each is joined to by links within the array."""
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for low in range(0, n, rows):
        a, near = table[low:low + rows], None
        for p in range(table.shape[1]):
            if near is None:
                near = np.nonzero(np.triu(np.abs(a[:, None, p] - table[None, low:, p]) <= within, 1))
            else:
                keep = np.abs(a[near[0], p] - table[near[1] + low, p]) <= within
                near = near[0][keep], near[1][keep]
        i, j = near[0] + low, near[1] + low
        true = np.bitwise_count(fps[i] ^ fps[j]) <= within
        for x, y in zip(i[true].tolist(), j[true].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


def coordinates(fps: np.ndarray) -> np.ndarray:
    """The distance table of the block pivots as bits: bit i says whether the fingerprint is nearer to the pivot of bit i than to the pivot 0."""
    pivot = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    table = np.bitwise_count(fps[:, None] ^ pivot[None, :])
    return np.packbits(table[:, 1:] < table[:, :1], axis=1, bitorder="little").view(np.uint64).ravel()


def bucket_links(fps: DataFrame, within: int = WITHIN, run_cap: int = 1024) -> DataFrame:
    """a, b: links that join the distinct ``fp`` of each bucket as far as they are joined; or a fingerprint of a bucket over ``run_cap`` as a, and null."""
    masks = np.array(block_masks(within), np.uint64)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice = np.arange(len(masks), dtype=np.int32)
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for low in range(0, len(fp), 1024):
                own = fp[low:low + 1024]
                m = (coordinates(own.view(np.uint64))[:, None] & masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(choice, len(own))), pa.array(m), pa.array(np.repeat(own, len(masks)))], ["c", "m", "fp"])

    dealt = fps.select("fp").mapInArrow(bucketed, "c int, m long, fp long").repartition("c", "m").sortWithinPartitions("c", "m", "fp")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []  # the start of a run that the next batch may carry on
        key, hot = None, False

        def close() -> tuple[list, list]:
            run = np.concatenate(left) if left else np.empty(0, np.int64)
            if hot or len(run) < 2:
                return [], []
            root = joined_within(run.view(np.uint64), within)
            other = root != np.arange(len(run))
            return run[root[other]].tolist(), run[other].tolist()

        for batch in batches:
            a, b = [], []
            c, m, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("c", "m", "fp"))
            if not len(c):
                continue
            start = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (m[1:] != m[:-1]))))
            end = np.append(start[1:], len(c))
            if key is not None and key != (c[0], m[0]):
                x, y = close()
                a, b, left, hot = a + x, b + y, [], False
            # runs of one fingerprint are most of them and need nothing, but the first and last may belong to longer ones
            some = (end - start > 1) | (start == 0) | (end == len(c))
            for s, e in zip(start[some].tolist(), end[some].tolist(), strict=True):
                if s > 0:
                    x, y = close()
                    a, b, left, hot = a + x, b + y, [], False
                key = (c[s], m[s])
                left.append(fp[s:e])
                if hot or sum(map(len, left)) > run_cap:
                    mine = np.concatenate(left)
                    a, b, left, hot = a + mine.tolist(), b + [None] * len(mine), [], True
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        x, y = close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(runs, "a long, b long")


def midpoints(hot: DataFrame, within: int = WITHIN) -> DataFrame:
    """a, b: links that join the distinct ``fp`` exactly, with work in proportion to their number. ``within`` must be even.

    Two fingerprints are within ``within`` bits exactly if some 64 bits are within half of that of both. Each fingerprint names all those (2,081 for 4), and
    fingerprints that name the same are linked; no more than 2,081 can.
    """
    if within % 2:
        raise ValueError("midpoints need an even number of differing bits")
    flips = [sum(1 << i for i in some) for size in range(within // 2 + 1) for some in combinations(range(64), size)]
    offsets = np.array(flips, np.uint64).view(np.int64)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for low in range(0, len(fp), 32):
                own = fp[low:low + 32]
                yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ offsets[None, :]).ravel()), pa.array(np.repeat(own, len(offsets)))], ["z", "fp"])

    shared = hot.repartition(F.col("fp")).mapInArrow(named, "z long, fp long").groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n"), F.collect_list("fp").alias("all"))
    return shared.filter("n > 1").select("a", F.explode("all").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, within: int = WITHIN, run_cap: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least doc_id that is reachable by links; nulls count as the greatest, so it is null only where no row of the component has an id. Texts that
    are null or without words have fingerprint 0 and are linked like any other. Repeated rows and equal texts share a fingerprint and are not expanded into pairs.
    Only doc_id and text are read.
    """
    return _classed(docs, within, run_cap).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classed(docs: DataFrame, within: int, run_cap: int) -> DataFrame:
    workers_ready(docs.sparkSession)
    rows = cut(docs.select("doc_id", fingerprints("text").alias("fp")))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    return in_components(rows, fps, components(print_links(fps.select("fp"), within, run_cap)))


def print_links(fps: DataFrame, within: int = WITHIN, run_cap: int = 1024) -> DataFrame:
    """a, b: links that join the distinct ``fp`` as far as they are joined."""
    found = cut(bucket_links(fps, within, run_cap).distinct())
    hot = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    links = found.filter("b is not null")
    return links if hot.isEmpty() else links.unionByName(midpoints(hot, within))


def in_components(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp) with component_id: the least doc_id of the rows of all ``nodes`` (fp, least, times) that ``roots`` (node, root) join."""
    named = cut(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "times", F.coalesce("root", "fp").alias("root")))
    size, n = named.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    first = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_size"))
    known = look_up(named.select("fp", "times", "root"), first, "root", "_size", size).select("fp", "times", "component_id")
    return look_up(rows, known, "fp", "times", n)


def keep_first(docs: DataFrame, within: int = WITHIN, run_cap: int = 1024) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the least doc_id (one of them if it is repeated).

    In a component where no row has an id, one row of each text stays.
    """
    return first_of(docs, _classed(docs, within, run_cap), fingerprints)


def first_of(docs: DataFrame, classed: DataFrame, key: Callable[[str], Column]) -> DataFrame:
    """``keep_first`` of the components in ``classed`` (doc_id, fp, component_id), where ``key`` of a text gives its fp. ``docs`` may have columns of any other names."""
    of, copies = unused(docs, "_of"), unused(docs, "_copies")
    classed = cut(classed)
    kept = cut(classed.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(of)).agg(F.count("*").alias(copies)))
    held = lambda some: docs.join(some.select(of), docs["doc_id"] == F.col(of), "left_semi")
    once = held(kept.filter(F.col(copies) == 1))
    more = kept.filter(F.col(copies) > 1)
    if not more.isEmpty():
        once = once.unionByName(held(more).dropDuplicates(["doc_id"]))
    bare = classed.filter("doc_id is null and component_id is null")
    if not bare.isEmpty():
        bare = bare.select(F.col("fp").alias(of)).distinct()
        nameless = docs.filter(docs["doc_id"].isNull()).dropDuplicates(["text"])
        once = once.unionByName(nameless.join(bare, key("text") == F.col(of), "left_semi"))
    return once
