"""Queries through files: tables are written in the domain's formats to the shared folder, read back with the readers, and must say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import query
from cladewright.operators import reads as R
from cladewright.operators.scale import shared_folder
from cladewright.sources import fastq, tables

from .reads import _COUNTERS, with_sites

TAPES = [f"T{i}" for i in range(11)]


def place(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"


@query(_COUNTERS, "bulk_reads", "whitelisted", "known_insertions")
def fastq_funnel(reads: DataFrame, whitelist: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The read funnel from gzipped FASTQ files."""
    at = place(reads)
    fastq.write_fastq(reads.select("header", "seq", "qual"), at)
    return R.parse_funnel(R.flagged(R.parse_bulk(fastq.read_fastq(reads.sparkSession, at).select("seq")), whitelist, vocabulary)).withColumn("pct", F.round("pct", 4))


@query("SELECT CAST(cell AS STRING) AS cell, tape, pattern FROM {genotypes}", "genotypes")
def consensus_long(genotypes: DataFrame) -> DataFrame:
    at = place(genotypes)
    tables.write_consensus(with_sites(genotypes).select("cell", "tape", "sites"), TAPES, at)
    return tables.read_consensus(genotypes.sparkSession, at).select("cell", "tape", F.array_join("sites", "|").alias("pattern"))


@query("SELECT CAST(cell AS STRING) AS cell, tape, pattern FROM {genotypes}", "genotypes")
def routed_long(genotypes: DataFrame) -> DataFrame:
    at = place(genotypes)
    tables.write_routed(with_sites(genotypes).select("cell", "tape", "sites"), TAPES, at)
    return tables.read_routed(genotypes.sparkSession, at).select("cell", "tape", F.array_join("sites", "|").alias("pattern"))


@query("SELECT CAST(row_number() OVER (ORDER BY n DESC, word) AS INT) AS rank, word AS tapebc, n AS count, round(n / (SELECT sum(n) FROM {barcodes}), 5) AS freq FROM {barcodes}", "barcodes")
def whitelist_rank(words: DataFrame) -> DataFrame:
    at = place(words)
    tables.write_whitelist(words.select(F.col("word").alias("tapebc"), F.col("n").alias("count")), at)
    return tables.read_whitelist(words.sparkSession, at)


@query("SELECT word AS insertion FROM {barcodes} WHERE n >= 2", "barcodes")
def vocabulary_file(words: DataFrame) -> DataFrame:
    at = place(words)
    tables.write_vocabulary(words.select(F.col("word").alias("insertion"), F.col("n").alias("peak"), (F.col("n") >= 2).alias("admitted")), at)
    return tables.read_vocabulary(words.sparkSession, at)


@query("SELECT r_name AS name, concat('set ', CAST(r_regionkey AS STRING)) AS note, n_name AS gene FROM {region} JOIN {nation} ON n_regionkey = r_regionkey", "region", "nation")
def gene_sets(region: DataFrame, nation: DataFrame) -> DataFrame:
    at = place(region)
    sets = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "r_regionkey").agg(F.collect_list("n_name").alias("g"))
    sets.select(F.concat_ws("\t", "r_name", F.format_string("set %d", "r_regionkey"), "g").alias("value")).write.text(at)
    return tables.read_gene_sets(region.sparkSession, at).select("name", "note", F.explode("genes").alias("gene"))


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS i, CAST(n_regionkey + 1 AS BIGINT) AS j, n_nationkey % 7 + 0.5E0 AS v FROM {nation}", "nation")
def sparse_matrix(nation: DataFrame) -> DataFrame:
    at = place(nation)
    n = nation.count()
    rows = nation.select(F.format_string("%d %d %.1f", F.col("n_nationkey") + 1, F.col("n_regionkey") + 1, (F.col("n_nationkey") % 7 + 0.5).cast("double")).alias("value"))
    head = nation.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general",), ("% a comment",), (f"{n} 5 {n}",)], "value string")
    head.coalesce(1).unionByName(rows).coalesce(1).write.text(at)
    return tables.read_sparse(nation.sparkSession, at)


@query("SELECT CAST(n_nationkey AS STRING) AS id, n_name AS name FROM {nation}", "nation")
def commented_table(nation: DataFrame) -> DataFrame:
    at = place(nation)
    rows = nation.select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    head = nation.sparkSession.createDataFrame([("# made up",), ('"# quoted, too",,',), ("id,name",)], "value string")
    head.coalesce(1).unionByName(rows).coalesce(1).write.text(at)
    return tables.read_commented(nation.sparkSession, at)


@query("""WITH n AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) AS k FROM {nation}), d AS (SELECT a.k AS ki, b.k AS kj, CASE WHEN (a.k + b.k) % 4 <> 0 THEN (b.k - a.k) / 8.0E0 END AS d FROM n a JOIN n b ON a.k < b.k), f AS (SELECT avg(d) AS f FROM d)
  SELECT CAST(0 AS BIGINT) AS line_no, CAST(count(*) AS STRING) AS line FROM n UNION ALL SELECT n.k, concat(n.name, coalesce((SELECT ' ' || string_agg(printf('%.6f', coalesce(d, f)), ' ' ORDER BY ki) FROM d, f WHERE kj = n.k), '')) FROM n""", "nation")
def phylip_matrix(nation: DataFrame) -> DataFrame:
    names = nation.select(F.col("n_name").alias("name"))
    k = {r.name: i + 1 for i, r in enumerate(names.orderBy("name").collect())}
    pairs = [(a, b, (k[b] - k[a]) / 8) for a in k for b in k if k[a] < k[b] and (k[a] + k[b]) % 4]
    return tables.phylip_lines(nation.sparkSession.createDataFrame(pairs, "i string, j string, d double"), names)
