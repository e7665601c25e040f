"""Building blocks that keep plans distributed: lineage cuts, running sums and as-of look-ups by runs, skew-proof look-ups, connected components, pointer doubling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A key with at least this part of all rows is heavy; there are no more than this many heavy keys.
HEAVY = 1024
#: Rows of a run of positions: runs are windows of their own, and only one row of each is summed over in one task.
RUN = 4096
#: Links that one task joins (a megabyte). More go by steps, until they are done or so few are left.
FEW_LINKS = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's checkpoint folder or ``spark.checkpoint.dir``. A local master may do without; a cluster may not."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")
    return df.checkpoint()


def fresh(df: DataFrame) -> DataFrame:
    """``cut`` for rounds of self-joins: without the plan's estimate of the table's size.

    A checkpoint keeps that estimate, and each self-join squares it; after some rounds the planner multiplies numbers of millions of digits.
    """
    spark, done = df.sparkSession, cut(df)._jdf
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)
    out._kept = done
    return out


def forget(df: DataFrame) -> None:
    """Delete the checkpoint of a ``fresh`` frame that is no longer read; the cleaner would, but not before the driver's next collection of garbage."""
    at = df._kept.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        remove(df.sparkSession, at.get())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that is no longer needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def look_up(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts`` for their ``key``, a long that no two facts share; null where there is no fact.

    ``weight`` is the column of ``facts`` that says how many of the ``total`` rows have the key; it is left out of the result. Keys with 1 / ``HEAVY`` of all rows
    or more, of which there are at most ``HEAVY``, are broadcast, and their rows are spread over all tasks rather than sent to one.
    """
    columns = [c for c in facts.columns if c not in (key, weight)]
    heavy = facts.filter(F.col(weight) * HEAVY >= total).select(F.col(key).alias("_heavy"), F.struct(*columns).alias("_h"))
    rest = facts.filter(F.col(weight) * HEAVY < total).select(F.col(key).alias("_key"), F.struct(*columns).alias("_f"))
    met = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    met = met.withColumn("_at", F.when(F.col("_heavy").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))).join(rest, F.col("_at") == F.col("_key"), "left")
    return met.select(*rows.columns, *[F.when(F.col("_heavy").isNull(), F.col("_f")[c]).otherwise(F.col("_h")[c]).alias(c) for c in columns])


def running(df: DataFrame, order: list[str], values: dict[str, str], by: list[str] | None = None, how: str = "sum") -> DataFrame:
    """``df`` with a running sum (or, by ``how``, min or max) of each of ``values`` (new column -> expression) in the order of ``order`` (nulls last), which with ``by`` must tell rows apart.

    Rows are dealt by ranges of that order; each range's sums are one row (for each of ``by``), and only these few are summed over in one task.
    """
    by = by or []
    sort = [F.col(c).asc_nulls_last() for c in [*by, *order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *sort).withColumn("_range", F.spark_partition_id()))
    f, none = {"sum": (F.sum, F.lit(0)), "min": (F.min, F.lit(None)), "max": (F.max, F.lit(None))}[how]
    sums = dealt.groupBy(*by, "_range").agg(*[f(F.expr(v)).alias(f"_{k}") for k, v in values.items()])
    over = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    own = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    before = sums.select(F.col("_range").alias("_r"), *own, *[F.coalesce(f(f"_{k}").over(over), none).alias(f"_{k}") for k in values])
    inner = W.partitionBy(*by, "_range").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    on = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    met = dealt.select("*", *[f(F.expr(v)).over(inner).alias(k) for k, v in values.items()]).join(before, on)
    both = {"sum": lambda k: F.coalesce(F.col(k), F.lit(0)) + F.col(f"_{k}"), "min": lambda k: F.least(k, f"_{k}"), "max": lambda k: F.greatest(k, f"_{k}")}[how]
    return met.select(*df.columns, *[both(k).alias(k) for k in values])


def running_at(df: DataFrame, values: dict[str, Column], at: str, by: list[str] | None = None, run: int = RUN) -> DataFrame:
    """``running`` for rows that have a dense position ``at``: runs are known from it, so that nothing is sampled or dealt by ranges."""
    by = by or []
    r = df.withColumn("_run", F.expr(f"`{at}` div {run}")).select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    runs = r.groupBy(*by, "_run").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    over = W.partitionBy(*by).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    before = runs.select(*by, "_run", *[F.coalesce(F.sum(f"_s_{k}").over(over), F.lit(0)).alias(f"_b_{k}") for k in values])
    inner = W.partitionBy(*by, "_run").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    met = r.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(inner), F.lit(0)).alias(f"_i_{k}") for k in values]).join(before, [*by, "_run"])
    return met.select(*df.columns, *[(F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(k) for k in values])


def last_before(rows: DataFrame, marks: DataFrame, at: str, by: list[str] | None = None, run: int = RUN) -> DataFrame:
    """``rows`` with ``_mark``: the struct of all columns of the mark (``marks`` has ``at`` too) with the greatest ``at`` not above the row's, in the same ``by``; null if none."""
    by = by or []
    both = marks.select(*by, at, F.struct(*marks.columns).alias("_m"), F.lit(0).alias("_kind")).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_run", F.expr(f"CAST(floor(`{at}` / {run}) AS BIGINT)"))
    ends = both.groupBy(*by, "_run").agg(F.max_by("_m", F.when(F.col("_kind") == 0, F.col(at))).alias("_end"))
    over = W.partitionBy(*by).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*by, "_run", F.last("_end", ignorenulls=True).over(over).alias("_carry"))
    inner = W.partitionBy(*by, "_run").orderBy(at, "_kind").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_own", F.last("_m", ignorenulls=True).over(inner)).filter("_kind = 1").join(carried, [*by, "_run"])
    return seen.select(*rows.columns, F.coalesce("_own", "_carry").alias("_mark"))


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """node, root: the least node that each node of ``links`` (a, b) is joined to; roots are not among the nodes. Large-star and small-star steps until nothing changes, or until a task can join the ``few`` links left:
    each step is a plan of a dozen shuffles, which cost the driver more than so few links cost a task.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(edges)
    while seen[0] > few:
        total = 2 * seen[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
        # a node that a great part of all edges meets is looked up without gathering its edges in one task
        edges = look_up(both, least, "u", "n", total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        star = look_up(edges, least, "u", "n", total)
        edges = cut(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return cut(out.repartition(1).mapInArrow(_joined, out.schema)) if 0 < seen[0] <= few else out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node that each is joined to, of all links of a task."""
    up: dict = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    if kind is not None:
        found = [(x, r) for x in list(up) if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind.field(i).type) for i in (0, 1)], ["node", "root"])


def nearest_marked(nodes: DataFrame) -> DataFrame:
    """node and up of ``nodes`` (node, parent, marked): the nearest marked node strictly above, null if there is none. Pointer doubling: rounds go with the log of the depth."""
    flags = nodes.select("node", F.coalesce("marked", F.lit(False)).alias("marked"))
    state = nodes.select("node", "parent").join(flags.select(F.col("node").alias("parent"), F.col("marked").alias("up_marked")), "parent", "left")
    state = fresh(state.select("node", F.col("parent").alias("at"), (F.col("parent").isNull() | F.coalesce("up_marked", F.lit(True))).alias("done")))
    while not state.filter("not done").isEmpty():
        for _ in range(2):
            far = state.select(F.col("node").alias("_n"), F.col("at").alias("_at"), F.col("done").alias("_done"))
            state = state.join(far, (F.col("at") == F.col("_n")) & ~F.col("done"), "left").select(
                "node", F.when(F.col("done"), F.col("at")).otherwise(F.col("_at")).alias("at"), (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done"))
        state = fresh(state)
    # a chain that ends in a node without a row, or in an unmarked root, has no mark
    held = flags.filter("marked").select(F.col("node").alias("at"), F.lit(True).alias("_ok"))
    return state.join(held, "at", "left").select("node", F.when(F.col("_ok"), F.col("at")).alias("up"))
