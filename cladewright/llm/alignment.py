"""Two tokenizers aligned over the same bytes, by a dictionary of groups.

Where a token of A and one of B end at the same byte, the text is cut into groups; inside a group of m and n tokens that share no end, m + n - 1 pairs overlap. Groups
are few against their occurrences, so they are interned: a document is a list of distinct groups with frequencies. Each distinct group is expanded into links once;
how many documents hold a pair is the sum, over the groups with that pair, of the documents that hold the group, less what documents with several such
groups count too often (each task tells that for the documents it reads). What a group's links add up to is joined back to the documents by the group's key.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut, remove, shared_folder, workers_ready

#: Groups with at least this part of all rows of (document, distinct group) are broadcast to their rows: at most so many, of LONG_KEY characters and two numbers each.
FREQUENT = 1 << 16
#: A longer group goes by its digest.
LONG_KEY = 48
#: Bytes of texts that are aligned at once.
AT_ONCE = 2 << 20


@lru_cache(maxsize=1)
def pieces(model: bytes) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A SentencePiece model and the bytes of each of its pieces."""
    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    said = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in ((i, p.id_to_piece(i)) for i in range(p.get_piece_size()))]
    return p, said


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A, and of B, each group has."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return (np.diff(np.searchsorted(e, common, "right"), prepend=0) for e in (ends_a, ends_b))


def interned(ids: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each distinct group, and which of these each group is."""
    mixed = []
    for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = np.zeros(len(sizes), np.uint64)
        for x, n in ((ids, sizes), (other, other_sizes)):
            starts = np.cumsum(n) - n
            place = (np.arange(len(x)) - np.repeat(starts, n)).astype(np.uint64) + np.uint64(1)
            v = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(mult)
            v ^= v >> np.uint64(29)
            v = v * (place * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1))
            v ^= v >> np.uint64(32)
            h = h * np.uint64(mult) + np.add.reduceat(v * np.uint64(0x94D049BB133111EB), starts) + n.astype(np.uint64)
            h ^= h >> np.uint64(31)
        mixed.append(h)
    _, first, which = np.unique(mixed[0], return_index=True, return_inverse=True)
    if not np.array_equal(mixed[1][first][which], mixed[1]):  # two groups share a hash of 64 bits
        _, first, which = np.unique(np.stack(mixed, 1), axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


def links_of(a: list[int], size_a: list[int], b: list[int], size_b: list[int]) -> list[tuple[int, int]]:
    """The overlapping pairs of one group's tokens, in order."""
    i = j = end_a = end_b = 0
    end_a, end_b, out = size_a[0], size_b[0], [(a[0], b[0])]
    while i + 1 < len(a) or j + 1 < len(b):
        if end_a < end_b:
            i += 1
            end_a += size_a[i]
        else:
            j += 1
            end_b += size_b[j]
        out.append((a[i], b[j]))
    return out


def parsed(group: str) -> tuple[list[int], list[int]]:
    a, b = group.split("|")
    return [int(x) for x in a.split(",")], [int(x) for x in b.split(",")]


class Aligner:
    """Texts aligned a batch at a time."""

    def __init__(self, spec: str, model: bytes) -> None:
        self.a = bpe.codec(spec, False)
        self.b, self.b_bytes = pieces(model)
        self.b_sizes = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        self.b_names = [str(i) for i in range(len(self.b_bytes))]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The tokens of both for a text; None where it is null, empty, or either's bytes are not the text's."""
        if not text:
            return None
        raw = b" " + text.encode("utf-8", "replace")
        a, b = self.a.encoded(raw), np.array(self.b.encode(text), np.int32)
        said = self.b_bytes
        return (a, b) if self.a.decoded(a) == raw and b"".join([said[i] for i in b.tolist()]) == raw else None

    def links(self, group: str) -> list[tuple[int, int]]:
        a, b = parsed(group)
        return links_of(a, [int(self.a.sizes[i]) for i in a], b, [int(self.b_sizes[i]) for i in b])

    def batch(self, texts: list[str | None]) -> tuple[list[tuple], list[str], dict[tuple[int, int], int]]:
        """Of each text n_a, n_b, n_groups, digest, and its distinct groups with frequencies; the distinct groups; and by pair how many of its groups, less
        one, each text with several groups of that pair has."""
        found = [self.tokens(t) for t in texts]
        some = [x for x in found if x]
        none = (0, 0, 0, "", [], [])
        if not some:
            return [none] * len(texts), [], {}
        a, b = (np.concatenate([x[k] for x in some]) for k in (0, 1))
        n_a, n_b = groups_of(np.cumsum(self.a.sizes[a]), np.cumsum(self.b_sizes[b]))
        first, which = interned(a, n_a, b, n_b)
        start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        names, codes, lows = [], [], [0]
        for g in first.tolist():
            own_a, own_b = a[start_a[g]:start_a[g] + n_a[g]].tolist(), b[start_b[g]:start_b[g] + n_b[g]].tolist()
            names.append(",".join([self.a.names[i] for i in own_a]) + "|" + ",".join([self.b_names[i] for i in own_b]))
            pairs = {x << 32 | y for x, y in links_of(own_a, self.a.sizes[own_a].tolist(), own_b, self.b_sizes[own_b].tolist())} if len(own_a) + len(own_b) > 2 else {own_a[0] << 32 | own_b[0]}
            codes += pairs
            lows.append(len(codes))
        # groups of one text lie together
        ends = np.searchsorted(start_a + n_a, np.cumsum([len(x[0]) for x in some]), "right")
        text_of = np.repeat(np.arange(len(some)), np.diff(ends, prepend=0))
        held, times = np.unique(text_of * len(first) + which, return_counts=True)
        text, group = held // len(first), held % len(first)
        codes_, low = np.array(codes, np.int64), np.array(lows)
        kinds, code = np.unique(codes_, return_inverse=True)
        n = np.diff(low)[group]
        at = np.repeat(low[group], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of_text, k = np.unique(np.repeat(text, n) * len(kinds) + code[at], return_counts=True)
        surplus = np.bincount(of_text[k > 1] % len(kinds), k[k > 1] - 1, len(kinds)).astype(np.int64)
        more = {(int(kinds[i]) >> 32, int(kinds[i]) & 0xFFFFFFFF): int(surplus[i]) for i in np.flatnonzero(surplus)}
        out, i, edges = [], 0, np.searchsorted(text, np.arange(len(some) + 1))
        for x in found:
            if not x:
                out.append(none)
                continue
            mine = which[ends[i - 1] if i else 0:ends[i]].tolist()
            digest = hashlib.sha256(";".join([names[g] for g in mine]).encode()).hexdigest()
            own = slice(edges[i], edges[i + 1])
            out.append((len(x[0]), len(x[1]), len(mine), digest, [names[g] for g in group[own].tolist()], times[own].tolist()))
            i += 1
        return out, names, more


def align(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    ``spec`` is the text of tokenizer A's JSON file, which gets a space and the text; ``model`` B's file. The strings of special tokens are plain text. Null and empty texts, and
    texts that either tokenizer's bytes don't give back, have zeros and an empty digest. Repeated rows, and rows without an id, are documents of their own. No rows give none. Only
    doc_id and text are read.
    """
    spark = docs.sparkSession
    workers_ready(spark)
    files = spark.sparkContext.broadcast((spec, model))
    some = docs.select("doc_id", "text")
    kind = some.schema["doc_id"].dataType.simpleString()
    types = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Aligner(*files.value)
        for batch in batches:
            size = np.cumsum(np.array([len(x) if x else 0 for x in batch.column("text").to_pylist()]))
            step = np.flatnonzero(np.diff(size // AT_ONCE, prepend=0)) if len(size) else []
            for low, high in zip([0, *step], [*step, batch.num_rows], strict=True):
                if high <= low:
                    continue
                rows, _, more = made.batch(batch.column("text").slice(low, high - low).to_pylist())
                n = len(rows)
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)]
                said = [pa.array([list(x)] + [None] * (n - 1), pa.list_(pa.int64())) for x in ([a for a, _ in more], [b for _, b in more], more.values())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), *columns, *said], ["doc_id", *[c for c, _ in types], "more_a", "more_b", "more"])

    # a written table: Parquet's dictionaries keep repeated groups small; its folder goes once the result's own parts have been cut
    at = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    made = some.mapInArrow(read, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<string>, times array<long>, more_a array<long>, more_b array<long>, more array<long>")
    made.withColumn("row", F.monotonically_increasing_id()).write.option("parquet.dictionary.page.size", 16 << 20).option("compression", "zstd").parquet(at)
    rows = spark.read.parquet(at)
    key = F.when(F.length("g") <= LONG_KEY, F.col("g")).otherwise(F.concat(F.lit("#"), F.sha2("g", 256)))
    dictionary = cut(rows.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count("*").alias("docs")).withColumn("key", key))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(*files.value)
        for batch in batches:
            keys, docs_, a, b, n = [], [], [], [], []
            for k, g, d in zip(*(batch.column(c).to_pylist() for c in ("key", "g", "docs")), strict=True):
                pairs: dict[tuple[int, int], int] = {}
                for p in own.links(g):
                    pairs[p] = pairs.get(p, 0) + 1
                for (x, y), t in pairs.items():
                    keys.append(k), docs_.append(d), a.append(x), b.append(y), n.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array(c, pa.int64()) for c in (docs_, a, b, n)]], ["key", "docs", "a", "b", "times"])

    links = cut(dictionary.select("key", "g", "docs").repartition(F.xxhash64("key")).mapInArrow(expand, "key string, docs long, a long, b long, times long"))
    less = rows.filter("more is not null").select(F.explode(F.arrays_zip("more_a", "more_b", "more")).alias("m")).select(F.col("m.more_a").alias("a"), F.col("m.more_b").alias("b"), (-F.col("m.more")).alias("docs"))
    counts = cut(links.select("a", "b", "docs").unionByName(less).groupBy("a", "b").agg(F.sum("docs").alias("n")))
    best = counts.groupBy(F.col("a").alias("_a")).agg(F.max("n").alias("_most"))
    pairs = counts.join(best, F.col("a") == F.col("_a")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n", (F.col("n") == F.col("_most")).cast("long").alias("is_best"))
    worth = links.join(pairs, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).groupBy("key").agg(F.sum(F.col("times") * F.col("is_best")).alias("w_best"), F.sum(F.col("times") * F.col("n")).alias("w_count"))
    held = cut(dictionary.select("key", "docs").join(worth.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k")).drop("_k"))
    total = held.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    often = held.filter(F.col("docs") * FREQUENT >= total).select(F.col("key").alias("_o"), F.col("w_best").alias("_ob"), F.col("w_count").alias("_oc"))
    rest = held.filter(F.col("docs") * FREQUENT < total).select(F.col("key").alias("_r"), F.col("w_best").alias("_rb"), F.col("w_count").alias("_rc"))
    said = rows.select("row", F.explode(F.arrays_zip("groups", "times")).alias("m")).select("row", F.col("m.groups").alias("g"), F.col("m.times").alias("t")).withColumn("key", key)
    met = said.select("row", "key", "t").join(F.broadcast(often), F.col("key") == F.col("_o"), "left")
    near = met.filter("_o is not null").groupBy("row").agg(F.sum(F.col("t") * F.col("_ob")).alias("n_best"), F.sum(F.col("t") * F.col("_oc")).alias("count_sum"))
    far = met.filter("_o is null").join(rest, F.col("key") == F.col("_r")).groupBy("row").agg(F.sum(F.col("t") * F.col("_rb")).alias("n_best"), F.sum(F.col("t") * F.col("_rc")).alias("count_sum"))
    added = cut(near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).withColumnRenamed("row", "_row"))
    out = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(added, F.col("row") == F.col("_row"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = cut(out.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"))
    remove(spark, at)
    return out
