"""Tab-separated tables of the domain: whitelists, vocabularies, consensus and routed matrices, gene sets, sparse matrices, distance matrices, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.operators.scale import running

#: Columns of a cell matrix that are no tapes.
QC = ("n_loci", "n_doublet_loci", "mean_dominance", "pass_qc", "blastomere", "route")
#: How a missing tape is written in a routed matrix.
MISSING = "NA"


def read_tsv(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="", nullValue="\u0000", emptyValue="", **options)


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """rank, tapebc, count and freq of a whitelist, in rank order."""
    return read_tsv(spark, path).select(F.col("rank").cast("int").alias("rank"), "tapebc", F.col("count").cast("long").alias("count"), F.col("freq").cast("double").alias("freq")).orderBy("rank")


def write_whitelist(counts: DataFrame, path: str) -> None:
    """``counts`` (tapebc, count) of the accepted barcodes, ranked by count (ties by name), with the share of all as freq to five places. A whitelist is one small file."""
    ranked = counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), "tapebc")))
    total = F.sum("count").over(W.partitionBy())
    ranked.select("rank", "tapebc", "count", F.format_string("%.5f", F.col("count") / total).alias("freq")).coalesce(1).write.csv(path, sep="\t", header=True)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """insertion of the rows that are marked as in the vocabulary."""
    return read_tsv(spark, path).filter("in_vocab = '1'").select("insertion")


def write_vocabulary(peaks: DataFrame, path: str) -> None:
    """``peaks`` (insertion, peak, admitted) as a vocabulary table, greatest peak first."""
    out = peaks.select("insertion", "peak", F.col("admitted").cast("int").alias("in_vocab")).orderBy(F.desc("peak"), "insertion")
    out.coalesce(1).write.csv(path, sep="\t", header=True)


def tapes_of(df: DataFrame, cell: str) -> list[str]:
    return [c for c in df.columns if c != cell and c not in QC]


def wide_to_long(wide: DataFrame, cell: str, value: str = "call") -> DataFrame:
    """cell, tape and ``value`` of each cell and tape column of a matrix."""
    return wide.unpivot([cell], tapes_of(wide, cell), "tape", value).withColumnRenamed(cell, "cell")


def chain_sites(call: Column, n_sites: int = 6, sep: str = "-") -> Column:
    """Sites of a consensus call: null where it is empty, all unedited for ``-``, else the edits padded with unedited sites."""
    edits = F.split(call, sep)
    padded = F.slice(F.concat(edits, F.array_repeat(F.lit("U"), n_sites)), 1, n_sites)
    return F.when(F.coalesce(call, F.lit("")) == "", F.lit(None)).when(call == "-", F.array_repeat(F.lit("U"), n_sites)).otherwise(padded)


def read_consensus(spark: SparkSession, path: str, n_sites: int = 6) -> DataFrame:
    """cell, tape and sites of each observed call of a consensus matrix (first column the cell; tapes not observed are empty)."""
    wide = read_tsv(spark, path)
    long = wide_to_long(wide, wide.columns[0])
    return long.select("cell", "tape", chain_sites(F.col("call"), n_sites).alias("sites")).filter("sites is not null")


def write_consensus(calls: DataFrame, tapes: list[str], path: str) -> None:
    """``calls`` (cell, tape, sites) as a consensus matrix with n_loci; ``tapes`` gives the columns and their order."""
    depth = F.coalesce(F.array_position("sites", "U") - 1, F.size("sites"))
    edits = F.when(F.array_position("sites", "U") == 1, F.lit("-")).otherwise(F.array_join(F.when(F.array_contains("sites", "U"), F.slice("sites", F.lit(1), F.greatest(depth.cast("int"), F.lit(0)))).otherwise(F.col("sites")), "-"))
    wide = calls.withColumn("call", edits).groupBy("cell").pivot("tape", tapes).agg(F.first("call"))
    n = sum(F.col(f"`{t}`").isNotNull().cast("int") for t in tapes)
    wide.select("cell", *[F.coalesce(f"`{t}`", F.lit("")).alias(t) for t in tapes], n.alias("n_loci")).write.csv(path, sep="\t", header=True, quote="", emptyValue="")


def read_routed(spark: SparkSession, path: str, n_sites: int = 6) -> DataFrame:
    """cell, tape and sites of each tape of a routed matrix that is not missing; stops at a call that has not ``n_sites`` sites."""
    wide = read_tsv(spark, path)
    long = wide_to_long(wide, wide.columns[0]).filter(F.col("call") != MISSING).withColumn("sites", F.split("call", r"\|"))
    checked = F.when(F.size("sites") == n_sites, F.col("sites")).otherwise(F.raise_error(F.concat(F.lit("not all sites: "), F.col("call"))).cast("array<string>"))
    return long.select("cell", "tape", checked.alias("sites"))


def write_routed(calls: DataFrame, tapes: list[str], path: str) -> None:
    """``calls`` (cell, tape, sites) as a routed matrix."""
    wide = calls.withColumn("call", F.array_join("sites", "|")).groupBy("cell").pivot("tape", tapes).agg(F.first("call"))
    wide.select("cell", *[F.coalesce(f"`{t}`", F.lit(MISSING)).alias(t) for t in tapes]).write.csv(path, sep="\t", header=True, quote="")


def read_commented(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with a header, some lines of which are comments: those that start with ``#`` or with ``"#``."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r'^"?#')).filter("value <> ''")
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} has no header")
    names = [c.strip('"') for c in first.value.split(sep)]
    rows = lines.filter(F.col("value") != first.value)
    schema = ", ".join(f"`{c}` string" for c in names)
    return rows.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """name, note and genes of each line of a GMT file."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter("value <> ''").select(f[0].alias("name"), f[1].alias("note"), F.filter(F.slice(f, F.lit(3), F.size(f)), lambda g: g != "").alias("genes"))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """i, j (from 1) and v of the entries of Matrix Market coordinate files; the size line of each, its first that is no comment, is left out. Entries without a value are 1."""
    f = F.split(F.trim("value"), r"\s+")
    body = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    body = body.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.groupBy(F.col("_file").alias("_of")).agg(F.min("_id").alias("_first"))  # a row for each file
    return body.join(F.broadcast(size), (F.col("_file") == F.col("_of")) & (F.col("_id") > F.col("_first"))).select(f[0].cast("long").alias("i"), f[1].cast("long").alias("j"), F.when(F.size(f) > 2, f[2].cast("double")).otherwise(1.0).alias("v"))


def phylip_lines(distances: DataFrame, names: DataFrame, digits: int = 6, fill: float | None = None) -> DataFrame:
    """line_no and line of a lower-triangle PHYLIP matrix: the number of names, then each name (name; in its order) with its distances to those before it.

    ``distances`` has i < j names and d. Pairs that it lacks, or a null d, take ``fill``, by default the mean of those known. One line of text for each name, so this is
    for matrices that fit a file.
    """
    order = running(names.select("name").distinct(), ["name"], {"k": "1L"})
    known = distances.select("i", "j", "d").filter("d is not null")
    mean = F.lit(fill) if fill is not None else F.lit(known.agg(F.avg("d")).first()[0])
    low, high = order.select(F.col("name").alias("i"), F.col("k").alias("ki")), order.select(F.col("name").alias("j"), F.col("k").alias("kj"))
    grid = high.withColumn("ki", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kj") - 1))).join(low, "ki", "left")
    both = known.unionByName(known.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    row = grid.join(both, ["i", "j"], "left").groupBy("kj", "j").agg(F.array_sort(F.collect_list(F.when(F.col("ki") > 0, F.struct("ki", F.coalesce("d", mean).alias("d"))))).alias("ds"))
    text = F.array_join(F.concat(F.array("j"), F.transform("ds", lambda x: F.format_string(f"%.{digits}f", x["d"]))), " ")
    head = order.agg(F.count("*").cast("string").alias("line")).select(F.lit(0).cast("long").alias("line_no"), "line")
    return head.unionByName(row.select(F.col("kj").alias("line_no"), text.alias("line")))


def content_key(spark: SparkSession, paths: list[str], **parameters) -> str:
    """A key of files' contents and of parameters, under which results may be kept."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.md5("content").alias("md5"))
    text = json.dumps([sorted(r.md5 for r in files.collect()), parameters], sort_keys=True, default=str)  # a row for each file
    return hashlib.md5(text.encode()).hexdigest()


def kept(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table kept under ``key`` in ``folder``, made by ``make()`` and written there if there is none; a half-written one is made again."""
    at = f"{folder}/{key}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_manifest(spark: SparkSession, path: str, inputs: list[str], **parameters) -> None:
    """A JSON file that says of each input its path, size and md5, and the parameters."""
    files = spark.read.format("binaryFile").load(inputs).select("path", "length", F.md5("content").alias("md5")).orderBy("path")
    rows = [r.asDict() for r in files.collect()]
    spark.createDataFrame([(json.dumps({"inputs": rows, "parameters": parameters}, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def report(metrics: DataFrame, path: str) -> None:
    """``metrics`` (metric, n, pct) as lines of text, in the order of metric."""
    metrics.orderBy("metric").select(F.format_string("%-24s %12d  (%.2f%%)", "metric", F.col("n").cast("long"), F.col("pct").cast("double")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


