"""Near-duplicates by Jaccard similarity of word shingles: op4's SimHash fingerprints and their pivot tables, and MinHash bands for what they miss, give candidates; exact similarity decides.

Two texts link where the sets of their shingles of ``SHINGLE`` words (ASCII lower case, split at white space; a shorter text is one shingle) have Jaccard similarity
``SIMILAR`` or more, and links join transitively. A pair of similarity s shares one of ``BANDS`` bands of ``ROWS`` least hashes with chance
1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8. Nothing is linked on the hashes alone: each link is verified on the whole sets.

Texts of one set are one node, so exact copies make no pairs. A bucket of texts that share a band is not expanded into pairs at once: for ``STARS`` rounds each
bucket's members meet one of them, and members that are joined by then need no more. The sets of buckets that are still apart then meet in a task, which verifies all their
pairs and says only what joins them, so no candidate is dropped and no pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, workers_ready
from .simhash import _LOWER, components, fingerprints, first_of, in_components, print_links

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, STARS = 20, 5, 1
#: Sets of a block, and their bytes, on average; a task holds two blocks.
BLOCK_SETS, BLOCK_BYTES = 1024, 32 << 20
_RNG = np.random.default_rng(80)
_TURN = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)
_PLACE = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes; none if it is null or has no words."""
    words = [w for w in (text or "").encode("utf-8", "replace").translate(_LOWER).split(b" ") if w]
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    one = np.fromiter((h(w) for w in words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += one[j:j + n] * _PLACE[j]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def bands(held: np.ndarray) -> np.ndarray:
    """A hash of each band's least hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for low in range(0, len(held), 1024):
        least = np.minimum(least, ((held[None, low:low + 1024] ^ _FLIP[:, None]) * _TURN[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def _key(held: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).view(np.int64))


@F.pandas_udf(T.StructType([T.StructField("key", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bytes", T.LongType())]))
def sketches(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    return pd.DataFrame({"key": [_key(s) for s in sets], "bands": [bands(s) for s in sets], "bytes": [s.nbytes for s in sets]})


@F.pandas_udf(T.StructType([T.StructField("key", T.LongType()), T.StructField("held", T.BinaryType())]))
def held_sets(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    return pd.DataFrame({"key": [_key(s) for s in sets], "held": [s.tobytes() for s in sets]})


@F.pandas_udf(T.LongType())
def set_keys(texts: pd.Series) -> pd.Series:
    return pd.Series([_key(shingles(t)) for t in texts], dtype="int64")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; 1 if both are empty."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def _similar(least: float):
    @F.pandas_udf(T.BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    return similar


def joined_sets(key: list[int], root: list[int], held: list[bytes], bands: np.ndarray, c: int, block: list[int], least: float) -> list[tuple[int, int]]:
    """Links that join the sets of one bucket as far as they are joined: pairs of two roots whose least shared band is ``c``; of two blocks only pairs across them."""
    sets = [np.frombuffer(h, np.uint64) for h in held]
    size = np.array([len(x) for x in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(word, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(word))))
    postings = owner[order]  # of each word, the sets that hold it
    begin = np.concatenate(([0], np.cumsum(size)))
    up = {r: r for r in root}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    blocks, all_roots = np.array(block), np.array(root)
    for i in range(len(sets)):
        mine = word[begin[i]:begin[i + 1]]
        n = at[mine + 1] - at[mine]
        where = np.repeat(at[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(postings[where], minlength=len(sets))[i + 1:]
        near = np.flatnonzero((shared >= least * (size[i] + size[i + 1:] - shared) - 1e-9) & (all_roots[i + 1:] != root[i])) + i + 1
        for j in near.tolist():
            if blocks[i] == blocks[j] >= 0 or (bands[i] == bands[j]).argmax() != c:
                continue
            x, y = find(root[i]), find(root[j])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((key[i], key[j]))
    return out


def apart_links(left: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: links among the members (c, band, key, root, bytes) of each bucket whose roots differ, found by exact similarity in the task that holds the bucket's sets.

    A large bucket is dealt in blocks by a hash of the key, and each two blocks meet in a task of their own. Pairs stay in the task.
    """
    sized = left.groupBy("c", "band").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_bytes"))
    blocks = sized.select("c", "band", F.greatest(F.ceil(F.col("_n") / BLOCK_SETS), F.ceil(F.col("_bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("_blocks"))
    dealt = left.join(blocks, ["c", "band"]).withColumn("_own", F.pmod(F.xxhash64("key"), "_blocks").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("c", "key", "root", F.xxhash64("c", "band", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("task"), F.when(F.col("_own") == F.col("_other"), -1).otherwise(F.col("_own")).alias("block"))
    rows = dealt.join(sets, "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []

        def close(out: list) -> None:
            if len(rest) > 1:
                _, c, key, root, block, held, own = zip(*rest, strict=True)
                out += joined_sets(list(key), list(root), list(held), np.array(own), c[0], list(block), least)

        def said(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(batch.column(x).to_pylist() for x in ("task", "c", "key", "root", "block", "held", "bands")), strict=True):
                if rest and rest[0][:2] != row[:2]:
                    close(out)
                    rest = []
                rest.append(row)
            yield said(out)
        out = []
        close(out)
        yield said(out)

    dealt_out = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("task", "c", "key", "root", "block", "held", "bands").repartition(dealt_out, "task").sortWithinPartitions("task", "c", "key").mapInArrow(verify, "a long, b long")


def set_links(members: DataFrame, sets: DataFrame, least: float = SIMILAR, stars: int = STARS, near: DataFrame | None = None) -> DataFrame:
    """node and root of the keys that links join, from ``members`` (c, band, key, bytes, _n, _central) of shared buckets and ``sets`` (key, held, bands); ``near`` (a, b) are pairs to be tried beside those of the buckets.

    _n is the size of the bucket, _central the sum of these over the buckets of the key.
    """
    similar = _similar(least)
    left, tried, links, roots = members.withColumn("root", F.col("key")), None, None, None
    for k in range(stars):
        # whoever shares buckets with most others is the likeliest source of a group of near copies
        turn = F.struct(-F.col("_central"), "key") if k == 0 else F.struct(F.xxhash64("key", F.lit(k)), "key")
        hub = left.groupBy("c", "band").agg(F.min_by(F.struct("key", "root"), turn).alias("h"))
        met = left.join(hub, ["c", "band"]).select("key", "root", F.col("h.key").alias("other"), F.col("h.root").alias("other_root"))
        pairs = met.filter("root <> other_root").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
        if near is not None and k == 0:
            pairs = pairs.unionByName(near)
        pairs = pairs.distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        x = pairs.join(sets.select(F.col("key").alias("a"), F.col("held").alias("ha")), "a").join(sets.select(F.col("key").alias("b"), F.col("held").alias("hb")), "b")
        new = cut(x.filter(similar("ha", "hb")).select("a", "b"))
        links = new if links is None else links.unionByName(new)
        roots = components(links)
        # of two members the only pair has been tried
        named = cut(members.filter("_n > 2").join(roots, F.col("key") == F.col("node"), "left").select("c", "band", "key", F.coalesce("root", "key").alias("root"), "bytes", "_n", "_central"))
        apart = named.groupBy("c", "band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("c", "band")
        left = cut(named.join(apart, ["c", "band"], "left_semi"))
        if left.isEmpty():
            return roots
    rest = apart_links(left.select("c", "band", "key", "root", "bytes"), sets, least)
    return components(rest if links is None else links.unionByName(rest))


def print_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: keys of ``nodes`` (key, print) whose SimHash fingerprints op4's pivot tables link, by the least key of each fingerprint."""
    first = cut(nodes.groupBy(F.col("print").alias("fp")).agg(F.min("key").alias("first")))
    same = nodes.join(first, F.col("print") == F.col("fp")).select(F.col("key").alias("a"), F.col("first").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(f"_{c}"), F.col("first").alias(f"first_{c}"))
    linked = print_links(first.select("fp"))
    apart = linked.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return same.unionByName(apart).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classed(docs: DataFrame, least: float, stars: int) -> DataFrame:
    workers_ready(docs.sparkSession)
    rows = cut(docs.select("doc_id", sketches("text").alias("s"), fingerprints("text").alias("print")).select("doc_id", "s.*", "print"))
    nodes = cut(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"), F.min("print").alias("print")))
    near = cut(print_pairs(nodes))
    keyed = nodes.select("key", "bytes", F.posexplode("bands").alias("c", "band"))
    shared = keyed.groupBy("c", "band").agg(F.count("*").alias("_n")).filter("_n > 1")
    # a key is in BANDS buckets at most
    members = cut(keyed.join(shared, ["c", "band"]).withColumn("_central", F.sum("_n").over(W.partitionBy("key"))))
    asked = members.select("key").unionByName(near.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    wanted = cut(nodes.join(asked, "key", "left_semi").select("key", "least", "bands"))
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("least").alias("_least")), F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = texts.select(held_sets("text").alias("s")).select("s.key", "s.held").join(wanted.select("key", "bands"), "key").groupBy("key").agg(F.first("held").alias("held"), F.first("bands").alias("bands"))
    roots = set_links(members, cut(sets), least, stars, near)
    return in_components(rows.select("doc_id", F.col("key").alias("fp")), nodes.select(F.col("key").alias("fp"), "least", "times"), roots)


def keep_first(docs: DataFrame, least: float = SIMILAR, stars: int = STARS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the least doc_id (see ``simhash.first_of``). Texts without words are alike."""
    return first_of(docs, _classed(docs, least, stars), set_keys)
