"""Sharding by longest-processing-time scheduling.

Groups of rows that must stay together (here: equal texts), sorted by size, go one by one to the shard with the least load, taken from a heap.
The heap holds a bounded number of items at any input size: a group of at least 1/(n_shards * grain) of all bytes is an item of its own (there are
at most n_shards * grain of those), and smaller groups are hashed into n_shards * grain bundles, each of which is one item. A bundle never splits a group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def longest_first(items: list[tuple[int, tuple]], n_shards: int) -> dict[tuple, int]:
    """Item -> shard. Larger items first (ties: smaller key first), each to the least loaded shard (ties: smallest number)."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(docs: DataFrame, n_shards: int = 40, grain: int = 256, slot_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; rows of equal text share a shard and slots are gapless from 0 in each.

    A null text is a group of its own, counts ``ROW_BYTES`` and has checksum 0. Repeated rows each get a slot. An empty table gives no rows. Columns
    other than doc_id and text are not read. ``grain`` bounds the items (2 * n_shards * grain) and the unevenness (about one part in ``grain``
    of a shard, unless one group alone is larger than a shard's share).
    """
    spark, n_items = docs.sparkSession, n_shards * grain
    text = F.col("text")
    rows = cut(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("gid"),
    ))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = rows.groupBy("gid").agg(F.sum("size").alias("size"))
    alone = F.col("size") * n_items >= total
    large = groups.filter(alone).select(F.col("gid").alias("item"), "size", F.lit(True).alias("alone"))
    small = groups.filter(~alone).groupBy(F.pmod("gid", F.lit(n_items)).alias("item")).agg(F.sum("size").alias("size")).withColumn("alone", F.lit(False))
    items = large.unionByName(small).collect()  # 2 * n_items at most, whatever the input's size
    shard_of = longest_first([(x["size"], (x["alone"], x["item"])) for x in items], n_shards)
    own = spark.createDataFrame([(k[1], s) for k, s in shard_of.items() if k[0]], "gid long, own int")
    bundle = spark.createDataFrame([(k[1], s) for k, s in shard_of.items() if not k[0]], "bundle long, shared int")
    placed = (
        rows.withColumn("bundle", F.pmod("gid", F.lit(n_items)).cast("long"))
        .join(F.broadcast(own), "gid", "left").join(F.broadcast(bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shared"))
        # buckets of a bounded mean size, by id within a text: a large group is spread over all of its shard's buckets
        .withColumn("b", F.pmod(F.xxhash64("gid", "doc_id"), F.lit(max(1, n // slot_rows))))
    )
    before = placed.groupBy("shard", "b").agg(F.count("*").alias("n")).select(
        "shard", "b", (F.sum("n").over(W.partitionBy("shard").orderBy("b")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("r", F.row_number().over(W.partitionBy("shard", "b").orderBy("gid", "doc_id")))
    return numbered.join(before, ["shard", "b"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("r") - 1).cast("long").alias("slot"))

