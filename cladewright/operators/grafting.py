"""Placement of cells on a dated tree: pendant times, capped budgets along chains of cells, and the tree that grows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scale import fresh, running

#: Times that are equal to so many places are one.
PLACES = 9


def pendant_days(matches: DataFrame, rates: DataFrame, by: str = "side") -> DataFrame:
    """``matches`` (distance, ``by``) with days: the distance over the clock rate of its ``by`` in ``rates`` (``by``, rate; a row for each, so few); null without a rate above 0."""
    clock = rates.groupBy(F.col(by).alias("_by")).agg(F.max("rate").alias("_rate"))
    return matches.join(F.broadcast(clock), F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("days", F.when(F.col("_rate") > 0, F.col("distance") / F.col("_rate"))).drop("_by", "_rate")


def capped(tips: DataFrame, attached: DataFrame) -> DataFrame:
    """cell, host, days, cap and clamped of all ``attached`` cells (cell, host, days) whose hosts lead to one of ``tips`` (node, budget).

    A host is a tip or another attached cell. cap is the least of the cell's own days, of those of all cells that it hangs on, and of its tip's budget, to ``PLACES`` places;
    clamped says that the cell has more days than its host has budget. Caps compose (the least of two), so they come by pointer doubling: rounds go with the log of the longest
    chain that leads to a tip, and only cells that are still on their way take part. Cells with null days, in a cycle or on an unknown host are left out, with all that hang on them.
    """
    known = fresh(attached.filter("days is not null and cell <> host").select("cell", "host", F.col("days").cast("double").alias("days")))
    over = lambda least: (F.col("days") > least + 1e-9).alias("clamped")
    budget = tips.select(F.col("node").alias("_n"), F.col("budget").cast("double").alias("_least"))
    done = fresh(known.join(budget, F.col("host") == F.col("_n")).select("cell", "host", "days", F.least("days", "_least").alias("least"), over(F.col("_least"))))
    left = known.join(known.select(F.col("cell").alias("_n")), F.col("host") == F.col("_n"), "left_semi")
    left = fresh(left.select("cell", "host", "days", F.col("host").alias("to"), F.col("days").alias("least")))
    both = F.least("least", "_least")
    for _ in range(known.count().bit_length() + 1):
        if left.isEmpty():
            break
        ends = done.select(F.col("cell").alias("_n"), F.col("least").alias("_least"))
        new = fresh(left.join(ends, F.col("to") == F.col("_n")).select("cell", "host", "days", both.alias("least"), over(both)))
        if new.isEmpty():  # a longer chain has a shorter one in it, so that all others run in cycles
            break
        hops = left.select(F.col("cell").alias("_n"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        left = fresh(left.join(hops, F.col("to") == F.col("_n")).select("cell", "host", "days", F.col("_to").alias("to"), both.alias("least")))
        done = done.unionByName(new)
    return done.select("cell", "host", "days", F.round("least", PLACES).alias("cap"), "clamped")


def forest(nodes: DataFrame, attached: DataFrame, present: float) -> DataFrame:
    """node, parent, time and kind (backbone, split or cell) of the tree of ``nodes`` (node, parent, time, is_leaf; leaves at ``present``) with all ``attached`` cells (cell, host, days) on it.

    Each host's cells branch off its line at ``present`` less their caps, the oldest first; cells of one cap share a split, so that cells without days are siblings of their host. A split's parent is
    the next older one of its host, or else where the host itself branches off. All cells and their hosts stand at the present. Splits get the ids after the greatest of
    all, in the order of host and cap (the greatest first). Ids of cells and nodes must differ; cells that ``capped`` leaves out are not placed.
    """
    up = nodes.select(F.col("node").alias("_p"), F.col("time").alias("_pt"))
    leaves = nodes.filter("is_leaf").join(up, F.col("parent") == F.col("_p")).select("node", (F.lit(float(present)) - F.col("_pt")).alias("budget"), F.col("parent").alias("tip_parent"))
    caps = fresh(capped(leaves, attached))
    levels = caps.select("host", "cap").distinct().withColumn("_order", -F.col("cap"))
    top = max(nodes.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0], attached.agg(F.coalesce(F.max("cell"), F.lit(0))).first()[0])
    split = running(levels, ["host", "_order"], {"_nth": "1"}).select("host", "cap", "_order", (F.col("_nth") + top).cast("long").alias("split"))
    split = fresh(split)
    line = W.partitionBy("host").orderBy("_order")
    ranked = split.withColumn("older", F.lag("split").over(line)).withColumn("youngest", F.lead("split").over(line).isNull())
    ranked = fresh(ranked)
    at = split.select(F.col("host").alias("_h"), F.col("cap").alias("_cap"), F.col("split").alias("_split"))
    hang = caps.join(at, (F.col("host") == F.col("_h")) & (F.col("cap") == F.col("_cap"))).select("cell", F.col("_split").alias("on"))  # where each cell branches off
    base = hang.select(F.col("cell").alias("_b"), F.col("on").alias("_base")).unionByName(leaves.select(F.col("node").alias("_b"), F.col("tip_parent").alias("_base")))
    splits = ranked.join(base, F.col("host") == F.col("_b")).select(F.col("split").alias("node"), F.coalesce("older", "_base").alias("parent"), (F.lit(float(present)) - F.col("cap")).alias("time"), F.lit("split").alias("kind"))
    last = ranked.filter("youngest").select(F.col("host").alias("_l"), F.col("split").alias("_last"))
    now = F.lit(float(present))
    cells = hang.join(last, F.col("cell") == F.col("_l"), "left").select(F.col("cell").alias("node"), F.coalesce("_last", "on").alias("parent"), now.alias("time"), F.lit("cell").alias("kind"))
    old = nodes.join(last, F.col("node") == F.col("_l"), "left").select("node", F.coalesce("_last", "parent").alias("parent"), F.when(F.col("is_leaf"), now).otherwise(F.col("time")).alias("time"), F.lit("backbone").alias("kind"))
    return old.unionByName(splits).unionByName(cells)
