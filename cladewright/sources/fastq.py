"""FASTQ files (four lines a record), gzipped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewright.shipping import ship

RECORD = "file string, read_no long, header string, seq string, qual string"


def read_fastq(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """file, read_no (from 0 in each file), header, seq and qual of each record; of each file no more than ``limit`` (first) records.

    A gzipped file is one task, which streams through it with one batch in memory, so many files are many tasks; follow with ``repartition`` if there are few.
    A file that Spark has split (plain text of more than a partition) is refused, since records cannot be told from its middle, and so is one that ends inside a record.
    """
    ship(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")

    def whole(file: str | None, rest: list[str]) -> None:
        if any(rest):  # empty lines may end a file
            raise ValueError(f"{file} ends inside a record")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rest, n = None, [], 0
        for batch in batches:
            out: list[tuple] = []
            for f, at, line in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if at:
                    raise ValueError(f"{f} was split; gzip it, or raise spark.sql.files.maxPartitionBytes")
                if f != file:
                    whole(file, rest)
                    file, rest, n = f, [], 0
                rest.append(line)
                if len(rest) == 4:
                    if limit is None or n < limit:
                        out.append((f, n, rest[0], rest[1], rest[3]))
                    rest, n = [], n + 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "read_no", "header", "seq", "qual"])
        whole(file, rest)

    return lines.mapInArrow(records, RECORD)


def write_fastq(reads: DataFrame, path: str) -> None:
    """``reads`` (header, seq, qual) as gzipped FASTQ, a file for each partition."""
    reads.select(F.concat_ws("\n", "header", "seq", F.lit("+"), "qual").alias("value")).write.text(path, compression="gzip")
