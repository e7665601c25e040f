"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewright.operators.scale import HEAVY, components, cut, look_up, remove, running, shared_folder
from cladewright.shipping import ship

__all__ = ["HEAVY", "components", "cut", "look_up", "remove", "running", "shared_folder"]

#: White space that separates words: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes in an Arrow batch: long texts must fit a worker's memory many at a time.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def workers_ready(spark: SparkSession) -> None:
    """Let workers import this package, and bound Arrow batches by bytes: the same bound for every plan of the session, whenever it runs."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    """True for rows that training never sees: crc32 of the id as text is 0 modulo ``folds``; also where the id is null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds == 0, F.lit(True))


def word_count(text: Column) -> Column:
    """Words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(df: DataFrame, n: str, at: str, per: int = 1 << 16) -> DataFrame:
    """A row for each ``at`` in 0 .. ``n`` - 1 of every row, dealt in runs so that no task makes all rows of a large ``n``."""
    runs = df.filter(F.col(n) > 0).withColumn("_run", F.explode(F.expr(f"sequence(0L, (`{n}` - 1) div {per})")))
    runs = runs.repartition("_run", *[c for c in df.columns if c != n])
    return runs.withColumn(at, F.explode(F.expr(f"sequence(_run * {per}, least(`{n}`, (_run + 1) * {per}) - 1)"))).drop("_run")
