"""Trees in time: sides, editing rates, support, couplings of types over time slices, clone sizes over time, state paths, lineage ladders and age constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.functions import columns as C

from .scale import cut, fresh, nearest_marked, running
from .statistics import enrichment, gini
from .trees import nearest_chosen


def sides(sized: DataFrame) -> DataFrame:
    """``sized`` (node, parent, pre, last, tips) with side: A below the root's child with more tips, B below the other; null at the root. Ties: the least child is A."""
    roots = sized.filter("parent is null").select(F.col("node").alias("parent"))
    kids = sized.join(F.broadcast(roots), "parent", "left_semi")
    named = kids.withColumn("_r", F.row_number().over(W.orderBy(F.desc("tips"), "node"))).filter("_r <= 2")  # the few children of a root
    marks = named.select("node", "pre", "last", F.when(F.col("_r") == 1, "A").otherwise("B").alias("_side"))
    at = nearest_chosen(sized, marks)
    return at.join(F.broadcast(marks.select(F.col("node").alias("clade"), F.col("_side").alias("side"))), "clade", "left").drop("clade")


def with_branch(nodes: DataFrame, least: float = 1e-9) -> DataFrame:
    """``nodes`` (node, parent, time) that have a branch longer than ``least``, with days (its length) and mid."""
    up = nodes.select(F.col("node").alias("parent"), F.col("time").alias("_up"))
    out = nodes.join(up, "parent").withColumn("days", F.col("time") - F.col("_up")).withColumn("mid", (F.col("time") + F.col("_up")) / 2)
    return out.filter(F.col("days") > least).drop("_up")


def binned(c: Column, edges: list[float]) -> Column:
    return C.right_closed(c, edges)


def side_bins(df: DataFrame, edges: list[float]) -> DataFrame:
    """side, bin and bin_mid of each side and bin."""
    s = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.lit(k).alias("bin"), F.lit((a + b) / 2).alias("bin_mid")) for x in "AB" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]))
    return df.sparkSession.range(1).select(s.alias("s")).select("s.*")


def editing_rate(branches: DataFrame, edges: list[float]) -> DataFrame:
    """side, bin, bin_mid, edits, days and rate of each side and bin of branch midpoints (right-closed): edits over days, null where there are no days."""
    n = branches.filter("side is not null").withColumn("bin", binned(F.col("mid"), edges)).groupBy("side", "bin").agg(F.sum("edits").alias("edits"), F.sum("days").alias("days"))
    out = side_bins(branches, edges).join(n, ["side", "bin"], "left").na.fill(0, ["edits", "days"])
    return out.withColumn("rate", F.when(F.col("days") > 0, F.col("edits") / F.col("days")))


def support_over_time(branches: DataFrame, edges: list[float], thresholds: list[int]) -> DataFrame:
    """side, bin, bin_mid, nodes and, for each threshold, n_ge and pct_ge: inner nodes by time whose support (edits) is so great; ``branches`` leaves out roots and empty branches."""
    inner = branches.filter("not is_leaf and side is not null").withColumn("bin", binned(F.col("time"), edges))
    n = inner.groupBy("side", "bin").agg(F.count("*").alias("nodes"), *[F.count_if(F.col("edits") >= t).alias(f"n_ge{t}") for t in thresholds])
    out = side_bins(branches, edges).join(n, ["side", "bin"], "left").na.fill(0, ["nodes", *[f"n_ge{t}" for t in thresholds]])
    return out.select("side", "bin", "bin_mid", "nodes", *[c for t in thresholds for c in (F.col(f"n_ge{t}"), F.when(F.col("nodes") > 0, 100 * F.col(f"n_ge{t}") / F.col("nodes")).alias(f"pct_ge{t}"))])


def clades_at(nodes: DataFrame, leaves: DataFrame, times: DataFrame) -> DataFrame:
    """t, clade and the columns of ``leaves`` (node, pre): for each time the node whose branch crosses it above each leaf. All times are cut in one pass."""
    up = nodes.select(F.col("node").alias("parent"), F.col("time").alias("_up"))
    cuts = nodes.join(up, "parent").join(F.broadcast(times), (F.col("_up") < F.col("t")) & (F.col("t") <= F.col("time"))).select("t", "node", "pre", "last")
    return nearest_chosen(leaves.join(F.broadcast(times)), cuts, ["t"]).filter("clade is not null")


def couplings(members: DataFrame, by: list[str], z: float = 3.0, least: int = 5) -> DataFrame:
    """``by``, a, b, observed, expected and hit (observed exceeds expected by ``z`` roots of it, and is ``least`` or more), from by, clade and cls of each member."""
    keys = F.struct(*by)
    packed = members.withColumn("_by", keys)
    out = enrichment(packed, ["_by"])
    wide = (F.col("observed") - F.col("expected")) / F.sqrt(F.greatest(F.col("expected"), F.lit(1e-9)))
    return out.select("_by.*", "a", "b", "observed", "expected", ((wide >= z) & (F.col("observed") >= least)).alias("hit"))


def coupling_depth(slices: DataFrame, sides: int = 2) -> DataFrame:
    """a, b, depth (the earliest t at which all sides hit), slices (how many hit) and contiguous (they stand side by side among all times), from t, side, a, b and hit."""
    grid = slices.select("t").distinct().withColumn("k", F.row_number().over(W.orderBy("t")))  # a row for each time
    both = slices.groupBy("t", "a", "b").agg(F.count_if("hit").alias("n")).filter(F.col("n") >= sides).join(F.broadcast(grid), "t")
    return both.groupBy("a", "b").agg(F.min("t").alias("depth"), F.count("*").alias("slices"), (F.max("k") - F.min("k") + 1 == F.count("*")).alias("contiguous"))


def clone_sizes_over_time(nodes: DataFrame, founders_at: float, times: DataFrame) -> DataFrame:
    """t, founder and n: the lineages at each time below each founder, the nodes whose branch crosses ``founders_at``. A lineage's founder is that above the cut."""
    up = nodes.select(F.col("node").alias("parent"), F.col("time").alias("_up"))
    b = nodes.join(up, "parent")
    founders = b.filter((F.col("_up") < founders_at) & (F.col("time") >= founders_at)).select("node", "pre", "last")
    lineages = b.join(F.broadcast(times), (F.col("_up") < F.col("t")) & (F.col("t") <= F.col("time"))).select("t", "node", "pre")
    return nearest_chosen(lineages, founders).filter("clade is not null").groupBy("t", F.col("clade").alias("founder")).agg(F.count("*").alias("n"))


def gini_over_time(nodes: DataFrame, founders_at: float, times: DataFrame) -> DataFrame:
    """t, groups (founders), gini and k_half of the lineages that each founder has at each time."""
    return gini(clone_sizes_over_time(nodes, founders_at, times), "t")


def labelled_steps(nodes: DataFrame) -> DataFrame:
    """node, up, src and dst: each labelled node (node, parent, label) with its nearest labelled ancestor."""
    up = nearest_marked(nodes.select("node", "parent", F.col("label").isNotNull().alias("marked")))
    own = nodes.filter("label is not null").select("node", F.col("label").alias("dst")).join(up, "node")
    return own.join(nodes.select(F.col("node").alias("up"), F.col("label").alias("src")), "up").select("node", "up", "src", "dst")


def state_paths(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """node and path of each labelled tip: the labels from the root down, runs of one label taken as one. Paths double: rounds go with the log of the number of labelled ancestors."""
    steps = labelled_steps(nodes)
    lab = nodes.filter("label is not null").select("node", "label")
    state = fresh(lab.join(steps.select("node", "up"), "node", "left").select("node", "up", F.array("label").alias("path")))
    while not state.filter("up is not null").isEmpty():
        far = state.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        state = fresh(state.join(far, F.col("up") == F.col("_n"), "left").select("node", F.col("_up").alias("up"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")))
    runs = F.filter(F.transform("path", lambda x, i: F.when((i == 0) | (x != F.element_at("path", F.greatest(i, F.lit(1)))), x)), lambda x: x.isNotNull())
    return state.join(tips.select("node"), "node", "left_semi").select("node", runs.alias("path"))


def qualifying_paths(paths: DataFrame, asymmetry: DataFrame, cells: int = 5, share: float = 0.01, least: float = 0.2) -> DataFrame:
    """path, n and share (of all traced to its last state): paths of two states or more, none twice, with ``cells`` and ``share`` or more, each step of asymmetry ``least`` or more.

    ``asymmetry`` has src, dst and asymmetry.
    """
    traced = paths.filter((F.size("path") > 1) & (F.size("path") == F.size(F.array_distinct("path"))))
    n = traced.groupBy("path").agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.element_at("path", -1)))).filter((F.col("n") >= cells) & (F.col("share") >= share))
    steps = n.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("s")).select("path", "s.*")
    bad = steps.join(asymmetry, ["src", "dst"], "left").filter(F.coalesce(F.col("asymmetry") < least, F.lit(True))).select("path").distinct()
    return n.join(bad, "path", "left_anti")


def lineage_ladder(nodes: DataFrame) -> DataFrame:
    """node, time, children and lineages of each inner node: lineages there are just after it splits, 1 + the sum of children - 1 over all nodes up to it in time (ties: the least node first)."""
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    inner = nodes.select("node", "time").join(kids, "node")
    return running(inner, ["time", "node"], {"lineages": "children - 1"}).withColumn("lineages", F.col("lineages") + 1)


def earliest(values: DataFrame, landmarks: DataFrame, value: str = "lineages") -> DataFrame:
    """``values`` with min_day: when the ceiling of ``landmarks`` (day, cells) first holds so many; null beyond its last.

    The ceiling never falls (running maximum by day) and is log-linear between landmarks; on a flat part its right end counts. Landmarks are few and broadcast.
    """
    up = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    table = landmarks.withColumn("c1", F.max("cells").over(up)).select("c1", F.col("day").alias("d1"), F.lag("day").over(W.orderBy("day")).alias("d0"), F.lag(F.max("cells").over(up)).over(W.orderBy("day")).alias("c0"))
    v = F.col(value)
    hit = (v <= F.col("c1")) & (F.col("c0").isNull() | (v > F.col("c0")))
    share = (F.ln(v.cast("double")) - F.ln(F.col("c0").cast("double"))) / (F.ln(F.col("c1").cast("double")) - F.ln(F.col("c0").cast("double")))
    day = F.when(F.col("c0").isNull(), F.col("d1")).otherwise(F.col("d0") + share * (F.col("d1") - F.col("d0")))
    return values.join(F.broadcast(table), hit, "left").select(*values.columns, day.alias("min_day"))


def age_constraints(nodes: DataFrame, landmarks: DataFrame, root_day: float) -> DataFrame:
    """node, children, lineages, min_day, day and binding of inner nodes that the ceiling bounds from below; the root, bounds at or before ``root_day`` and those off the table are left out."""
    at = earliest(lineage_ladder(nodes), landmarks)
    root = nodes.filter("parent is null").select("node")
    out = at.join(F.broadcast(root), "node", "left_anti").withColumn("day", F.col("time") + root_day).filter(F.col("min_day") > root_day + 1e-9)
    return out.select("node", "children", "lineages", "min_day", "day", (F.col("min_day") > F.col("day") + 1e-9).alias("binding"))


