"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are sequences of words. Windows of ``min_tile`` words (of all its words for a shorter item) that a document shares with an item are
seeds, found by a running Karp-Rabin hash. Runs of seeds on one diagonal are maximal matches. The longest match whose words are still unmarked on both sides is marked
as a tile, again and again until none of ``min_tile`` words is left (a match that a mark has cut is queued again with what remains). The share of an item's
words under tiles is its coverage in the document, whatever the order of the tiles, so that reordered passages are caught.

1. Items become rows of window hashes. A bitmap of ``BITS`` bits of them, of one size at any size of the benchmark, goes to the workers.
2. Documents give the windows that the bitmap holds; all others are no seeds. A false hit of the bitmap finds no partner in the join.
3. These are joined with the items' windows by hash. An item that a document covers shares at least q = coverage * words / min_tile of its windows, so one of all
   but q - 1 of them; only those that fewest items have are joined, so that phrases of many items do not pair everything.
4. Each such text and item meet in a row with their windows, and are tiled. Equal texts and equal items are compared once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, unused, workers_ready

MIN_TILE, COVERAGE = 5, 0.6
#: Bits of the bitmap of seeds (8 MB), a power of two.
BITS = 1 << 26
#: Pairs of places that are held at once; texts and items that repeat themselves so often that they have more are tiled row by row.
PAIRS = 1 << 22
#: Rows that are broadcast at most; more are joined by a shuffle.
FEW = 500_000
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_KEPT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WINDOWS = "n int, k array<int>, at array<int>, h array<long>, g array<long>"


def words(text: str | None) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits and of anything beyond ASCII, as UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_KEPT).split()


def numbers(order: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter(map(h, order), np.uint64, len(order))


def rolling(ids: np.ndarray, k: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """A hash modulo 2**64 of each window of k numbers."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        out = out * base + ids[i:len(ids) - k + 1 + i]
    out ^= out >> np.uint64(29)
    return out


def tile(item: np.ndarray, doc: np.ndarray, pairs: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the document, words) by greedy string tiling, given all pairs of places where a window of k words is the same."""
    order = np.lexsort((pairs[:, 1], pairs[:, 1] - pairs[:, 0]))
    pairs = pairs[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(pairs[:, 1] - pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 1))))
    lengths = np.diff(np.append(new, len(pairs))) + k - 1
    heap = [(-int(n), int(j), int(i)) for n, (i, j) in zip(lengths, pairs[new], strict=True)]
    heapq.heapify(heap)
    free_i, free_j, out = np.ones(len(item), bool), np.ones(len(doc), bool), []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = free_i[i:i + n] & free_j[j:j + n]
        if free.all():
            free_i[i:i + n] = free_j[j:j + n] = False
            out.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= k:
                heapq.heappush(heap, (-(b - a), j + a, i + a))
    return sorted(out)


def tile_by_rows(item: np.ndarray, doc: np.ndarray, n_item: int, n_doc: int, k: int) -> list[tuple[int, int, int]]:
    """``tile`` from the numbers of all windows (of ``doc``: 0 where it is no seed), holding one row of places at a time instead of all pairs."""
    free_i, free_j, out = np.ones(n_item, bool), np.ones(n_doc, bool), []
    while True:
        open_i = np.convolve(~free_i, np.ones(k, int))[k - 1:n_item] == 0
        open_j = np.convolve(~free_j, np.ones(k, int))[k - 1:n_doc] == 0
        best, row = (0, 0, 0), np.zeros(len(doc) + 1, np.int32)
        for i in range(len(item)):
            new = np.zeros_like(row)
            if open_i[i]:
                new[1:] = np.where((doc == item[i]) & open_j, row[:-1] + 1, 0)
            if (longest := int(new.max())) >= max(1, -best[0]):
                j = int(new.argmax()) - longest
                best = min(best, (-longest, j, i - longest + 1))
            row = new
        n, j, i = best
        if not n:
            return sorted(out)
        size = k - 1 - n
        free_i[i:i + size] = free_j[j:j + size] = False
        out.append((i, j, size))


def seeds(benchmark: DataFrame, min_tile: int) -> DataFrame:
    """item (a hash of its words) and its windows (``_WINDOWS``: words in all, and length, place and two hashes of each window), once for equal items; and ids.

    Items without words are left out. ids has the item_id of each row that says the same, null where that is null.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf.text, strict=True):
                if order := words(t):
                    ids, k = numbers(order), min(min_tile, len(order))
                    h, g = (rolling(ids, k, b).view(np.int64) for b in _BASES)
                    item = np.uint64(xxhash.xxh64_intdigest(b" ".join(order), 7)).view(np.int64)
                    out.append((i, item, len(order), np.full(len(h), k, np.int32), np.arange(len(h), dtype=np.int32), h, g))
            yield pd.DataFrame(out, columns=["id", "item", "n", "k", "at", "h", "g"])

    held = benchmark.filter("text is not null").select(F.col("item_id").cast("string").alias("id"), "text")
    made = held.mapInPandas(cut_up, "id string, item long, " + _WINDOWS)
    return made.groupBy("item").agg(F.first(F.struct("n", "k", "at", "h", "g")).alias("w"), F.array_sort(F.collect_list(F.struct("id"))).alias("ids")).select("item", "w.*", "ids")


def bitmap(windows: DataFrame) -> np.ndarray:
    """The bits of the hashes ``h``, made in parts of 32,768 bits by the workers; at most ``BITS`` / 8 bytes come to the driver."""
    at = windows.select(F.pmod("h", F.lit(BITS)).alias("p")).distinct()
    parts = at.groupBy(F.expr("p div 32768").alias("b")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[r.b] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def hits(texts: DataFrame, shared, lengths: list[int]) -> DataFrame:
    """id and the windows (``_WINDOWS``) that the bitmap holds, of the texts (id, text) that have some."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, full = shared.value, np.uint64(BITS - 1)
        for pdf in batches:
            ids_of = [numbers(words(t)) for t in pdf.text]
            ids = np.concatenate([*ids_of, np.empty(0, np.uint64)])
            end = np.cumsum([len(x) for x in ids_of], dtype=np.int64)
            found = []
            for k in lengths:
                h = rolling(ids, k)
                p = h & full
                at = np.flatnonzero(bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
                doc = np.searchsorted(end, at, "right")
                inside = at + k <= end[doc]  # windows over the end of a text are none
                at, doc = at[inside], doc[inside]
                g = np.zeros(len(at), np.uint64)
                for i in range(k):
                    g = g * _BASES[1] + ids[at + i]
                g ^= g >> np.uint64(29)
                found.append((doc, np.full(len(at), k, np.int32), at, h[at], g))
            doc, size, at, h, g = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(doc, kind="stable")
            doc, size, at, h, g = doc[order], size[order], at[order], h[order].view(np.int64), g[order].view(np.int64)
            edge = np.searchsorted(doc, np.arange(len(pdf) + 1))
            some = np.flatnonzero(np.diff(edge))
            out = [(pdf["id"].iat[d], len(ids_of[d]), size[a:b], (at[a:b] - (end[d] - len(ids_of[d]))).astype(np.int32), h[a:b], g[a:b]) for d, a, b in zip(some, edge[some], edge[some + 1], strict=True)]
            yield pd.DataFrame(out, columns=["id", "n", "k", "at", "h", "g"])

    return texts.mapInPandas(look, "id long, " + _WINDOWS)


def tiles_of(item: dict, doc: dict) -> list[tuple[int, int, int]]:
    """Tiles of an item and a text, each given as n, k, at, h and g of its windows."""
    k = int(item["k"][0])
    own = doc["k"] == k
    at, h, g = doc["at"][own], doc["h"][own], doc["g"][own]
    both = np.unique(np.concatenate((np.column_stack((item["h"], item["g"])), np.column_stack((h, g)))), axis=0, return_inverse=True)[1].ravel() + 1
    a, b = both[:len(item["h"])], both[len(item["h"]):]
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, "right")
    n = high - low
    if n.sum() > PAIRS:
        row = np.zeros(doc["n"] - k + 1, both.dtype)
        row[at] = b
        return tile_by_rows(a, row, item["n"], doc["n"], k)
    if not n.sum():
        return []
    which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.column_stack((np.repeat(item["at"], n), at[order][which]))
    return tile(np.empty(item["n"]), np.empty(doc["n"]), pairs.astype(np.int64), k)


def leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """text_id (``xxhash64(text)``), item_id, coverage and tiles (item_at, doc_at, words) of each text of ``docs`` and item that it covers to ``coverage`` or more.

    Null and empty texts cover nothing; items without words cannot be matched and are left out; an item without an id counts like any other. An item of fewer than ``min_tile`` words is covered
    where all of it stands in a row. Repeated items each count, repeated texts are one.
    """
    workers_ready(docs.sparkSession)
    items = cut(seeds(benchmark, min_tile))
    windows = items.select("item", "n", F.explode(F.arrays_zip("k", "at", "h", "g")).alias("w")).select("item", "n", "w.*")
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # min_tile of them at most
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(windows))
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("id"), "text")
    found = hits(texts, shared, lengths or [min_tile]).groupBy("id").agg(F.first(F.struct("n", "k", "at", "h", "g")).alias("d"))
    found = cut(found)
    # all but q - 1 windows of each item, those that fewest items have first
    often = windows.groupBy("k", "h", "g").agg(F.count_distinct("item").alias("often"))
    ranked = windows.join(often, ["k", "h", "g"]).withColumn("r", F.row_number().over(W.partitionBy("item").orderBy("often", "h", "at")))
    ranked = ranked.withColumn("all", F.col("n") - F.col("k") + 1).withColumn("q", F.ceil(F.ceil(coverage * F.col("n") - 1e-9) / F.col("k")))
    tried = cut(ranked.filter("r <= all - q + 1").select("k", "h", "g", "item").distinct())
    seen = found.select("id", F.explode(F.arrays_zip("d.k", "d.h", "d.g")).alias("w")).select("id", "w.k", "w.h", "w.g")
    pairs = seen.join(F.broadcast(tried) if tried.count() <= FEW else tried, ["k", "h", "g"]).select("id", "item").distinct()
    met = pairs.join(found, "id").join(items.select("item", F.struct("n", "k", "at", "h", "g").alias("i")), "item")

    def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, item, d, i in zip(pdf["id"], pdf["item"], pdf.d, pdf.i, strict=True):
                marks = tiles_of(_arrays(i), _arrays(d))
                share = sum(m[2] for m in marks) / i["n"]
                if share >= coverage:
                    out.append((t, item, share, [dict(zip(("item_at", "doc_at", "words"), map(int, m), strict=True)) for m in marks]))
            yield pd.DataFrame(out, columns=["text_id", "item", "coverage", "tiles"])

    said = met.mapInPandas(tiled, "text_id long, item long, coverage double, tiles array<struct<item_at:int,doc_at:int,words:int>>")
    kind = benchmark.schema["item_id"].dataType
    return said.join(items.select("item", "ids"), "item").select("text_id", F.explode("ids").alias("item_id"), "coverage", "tiles").withColumn("item_id", F.col("item_id.id").cast(kind))


def _arrays(w: dict) -> dict:
    return {"n": int(w["n"])} | {c: np.asarray(w[c], np.int64) for c in ("k", "at", "h", "g")}


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, coverage, tiles (how many) and longest (words): a row for each document and item that it leaks; clean documents have none."""
    found = cut(leaks(docs, benchmark, **options).select("text_id", "item_id", "coverage", F.size("tiles").alias("tiles"), F.array_max("tiles.words").alias("longest")))
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_id"))
    return rows.join(F.broadcast(found) if found.count() <= FEW else found, "text_id").drop("text_id")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, whatever columns they have. Null and empty texts stay, repeated rows each do; without items or without rows nothing changes."""
    of = unused(docs, "_leak")
    found = cut(leaks(docs, benchmark, **options).select(F.col("text_id").alias(of)).distinct())
    return docs.join(F.broadcast(found) if found.count() <= FEW else found, F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"])) == F.col(of), "left_anti")
