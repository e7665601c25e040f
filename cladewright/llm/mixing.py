"""Mixing sources to target weights, in DataFrame functions only.

1. Every source's documents, in the order of the md5 of their ids, form one stream of words that is cut into blocks of ``block`` words.
2. Each source gets a target (``targets``); it is met to the word by whole passes over the source's blocks and one part of a pass, whose last block is trimmed.
3. The slots that this takes are thrown into output shards by a hash, so that each shard's count of slots by source is a multinomial draw (given the
   sources' totals, which are thereby met exactly and not only in expectation).
4. Shard by shard, slots take the next indices of their source, and a pseudorandom permutation of the source's block numbers (swap-or-not network,
   keyed by source and pass) turns an index into a block.
5. Blocks and documents meet by index: a document is exploded to the blocks it reaches into, and counts the words of each that the mix takes.

Prefix sums over documents go by ranges of rows (``running``), so that a source with a third of all rows is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, running, spread, word_count

#: Relative weights of the sources, in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words taken in all, as a multiple of all words, and at most from a source, as a multiple of its own.
SHARE, CAP = 1.5, 2.0
BLOCK, ROUNDS = 512, 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with rank (code point order from 0, null last) and target.

    Targets share ``share`` times all words by weight; none is above ``cap`` times its source, and the excess is reshared by weight. The fixed point of
    resharing is target = min(cap * size, level * weight); the level follows from sources sorted by cap over weight.
    """
    ranked = running(sizes, ["source"], {"rank": "1L"}).withColumn("rank", F.col("rank") - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("turn", F.col("most") / F.col("weight"))
    filled = running(ranked, ["turn", "rank"], {"below": "most", "lighter": "weight"})
    words, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (share * words - F.col("below") + F.col("most")) / (weight - F.col("lighter") + F.col("weight"))
    # the first source, in this order, that the level does not fill to its cap has the level that holds for all after it
    open_ = filled.withColumn("level", level).filter(F.col("level") * F.col("weight") < F.col("most")).agg(F.min(F.struct("turn", "rank", "level")).alias("x")).first().x
    target = F.least("most", F.lit(open_.level) * F.col("weight")) if open_ else F.col("most")
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def permuted(i: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where a pseudorandom permutation of 0 .. n - 1 that ``key`` picks takes i: a swap-or-not network.

    Each round pairs i with (k - i) mod n for a round constant k and swaps the pair or not by a bit of the larger one.
    """
    def one(x: Column, r: Column) -> Column:
        k = F.conv(F.substring(F.md5(F.concat_ws(":", key, r).cast("binary")), 1, 12), 16, 10).cast("long")
        y = F.pmod(k - x, n)
        bit = F.substring(F.md5(F.concat_ws(":", key, r, F.greatest(x, y)).cast("binary")), 1, 1) >= "8"
        return F.when(bit, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, one)


def mix(docs: DataFrame, block: int = BLOCK, slots_per_shard: int = 4096, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``.

    A null text has no words; rows without words are kept and take 0. A null source is a source of its own. Repeated rows are documents of their own.
    No row takes more than ``cap`` (2 at most) times its words. An empty table gives no rows. Only doc_id, text and source are read.
    """
    order = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("o", order))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    # where each document starts in its source's stream
    rows = rows.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("s", "source")
    rows = running(rows, ["o", "doc_id", "size"], {"start": "size"}, ["rank"]).withColumn("start", F.col("start") - F.col("size"))
    rows = rows.select("doc_id", "size", "source_size", "target", "rank", "start")
    pieces = rows.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + greatest(size, 1) - 1) div {block})")))
    pieces = pieces.withColumn("block", F.when(F.col("size") > 0, F.col("block")))
    taken = slots(sources, block, slots_per_shard).select(F.col("rank").alias("r"), F.col("block").alias("k"), "take")
    base = F.col("block") * block
    inside = lambda end: F.greatest(F.lit(0), F.least(end, F.col("start") + F.col("size")) - F.greatest(base, F.col("start")))
    met = pieces.join(taken, (F.col("rank") == F.col("r")) & (F.col("block") == F.col("k")), "left")
    # a block that the mix leaves out gives nothing (least() would skip its null)
    words = F.coalesce(F.sum(inside(base + F.coalesce("take", F.lit(0)))), F.lit(0)).cast("long").alias("taken")
    some = met.filter("size > 0").groupBy("rank", "start").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], words)
    none = rows.filter("size = 0").select("rank", "start", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def slots(sources: DataFrame, block: int = BLOCK, slots_per_shard: int = 4096) -> DataFrame:
    """rank, shard, at (the slot's index in its source), block and take (words of that block) of each slot of the mix.

    A pass over a source has a slot for each full block, in permuted order, and then one for the rest of its words.
    """
    goal, size = F.round("target").cast("long"), F.col("source_size")
    per = F.expr(f"(source_size + {block - 1}) div {block}")
    s = sources.filter("source_size > 0").withColumn("goal", goal).withColumn("per", per)
    s = s.withColumn("n", F.expr(f"(goal div source_size) * per + (goal % source_size + {block - 1}) div {block}"))
    s = s.select("rank", "source_size", "goal", "per", "n")
    shards = max(1, -(-s.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // slots_per_shard))
    drawn = spread(s, "n", "draw").groupBy("rank", F.pmod(F.xxhash64("rank", "draw"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("count"))
    drawn = drawn.withColumn("first", F.sum("count").over(W.partitionBy("rank").orderBy("shard")) - F.col("count"))
    # few bytes but much to compute: dealt out by number, which adaptive execution leaves as it is
    dealt = drawn.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "shard")
    one = dealt.withColumn("at", F.explode(F.expr("sequence(first, first + count - 1)"))).join(s, "rank")
    i, full = F.col("at") % F.col("per"), F.expr(f"source_size div {block}")
    # the last slot of a pass is the source's rest, if it has one
    number = F.when(i < full, permuted(i, full, F.concat_ws("/", "rank", F.expr("at div per")))).otherwise(i)
    done = F.expr(f"(at div per) * source_size + (at % per) * {block}")
    length = F.when(i < full, F.lit(block)).otherwise(size % block)
    return one.select("rank", "shard", "at", number.cast("long").alias("block"), F.least(length, F.col("goal") - done).cast("long").alias("take"))
