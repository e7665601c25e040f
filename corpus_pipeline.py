"""A training corpus from ``documents``: quality filter, near-dedup, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Between stages rows go through Parquet in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.llm import decontam, minhash, mixing, quality, sharding
from cladewright.llm.common import cut, remove, shared_folder, table, unused

#: Documents score at least this to stay.
QUALITY_CUT = 0.3
#: None: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, by their text alone: null and empty texts are scored like any other, repeated rows each. No rows give none."""
    voter = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.scorer(docs, voter)(F.col("text")) >= QUALITY_CUT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: Jaccard similarity of 0.8 or more over shingles of five words.

    The least doc_id of a group stays, once if it is repeated; of a group without any id one row of each text. Null and empty texts are alike. No rows give none.
    """
    return minhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark (see ``decontam.clean``)."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def copies(drawn: DataFrame) -> DataFrame:
    """doc_id and times: ``drawn`` (doc_id, t words taken of n, grp) with t / n rounded down or up so that the words of each group keep to its sum of t.

    A group's documents stand in the order of their size class, and each is there as often as whole numbers lie in its part of the running sum of t / n. So at
    every size the roundings cancel, to within one document. Prefix sums go through md5 buckets. Documents without words are there once.
    """
    one = 1 << 30
    x = drawn.filter("n > 0").withColumn("x", F.expr(f"(t div n) * {one} + (t % n) * {one} div n")).withColumn("o", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")))
    x = x.withColumn("c", F.floor(4 * F.log2(F.col("n").cast("double")))).withColumn("b", F.substring("o", 1, 2))
    sums = x.groupBy("grp", "c", "b").agg(F.sum("x").alias("s"))
    sums = sums.select(F.col("grp").alias("g"), F.col("c").alias("gc"), F.col("b").alias("gb"), (F.sum("s").over(W.partitionBy("grp").orderBy("c", "b")) - F.col("s") + one // 2).alias("before"))
    inner = F.sum("x").over(W.partitionBy("grp", "c", "b").orderBy("o", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    at = x.withColumn("in", inner).join(sums, (F.col("grp") == F.col("g")) & (F.col("c") == F.col("gc")) & (F.col("b") == F.col("gb")))
    end = F.col("in") + F.col("before")
    times = F.shiftright(end, 30) - F.shiftright(end - F.col("x"), 30)
    return at.select("doc_id", times.cast("int").alias("times")).unionByName(drawn.filter("n = 0").select("doc_id", F.lit(1).alias("times")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words (rounded down or up, see ``copies``), so that sources have their target shares; documents without words stay once.

    Rows that share a doc_id are drawn together, rows without one too. A null source is a source. No rows give none; other columns go along, whatever their names.
    """
    # sources of one size and target are drawn alike
    drawn = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("n"), F.min(F.struct("source_size", "target")).alias("grp"))
    of, times, copy = (unused(docs, c) for c in ("_of", "_times", "_copy"))
    taken = copies(cut(drawn)).filter("times > 0").select(F.col("doc_id").alias(of), F.col("times").alias(times))
    found = docs.join(taken, docs["doc_id"].eqNullSafe(F.col(of)))
    return found.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document; equal texts share a shard, null texts too. No rows give none; only doc_id and text are read."""
    return sharding.assign(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again; a stage's rows are deleted once the next stage has been written."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
