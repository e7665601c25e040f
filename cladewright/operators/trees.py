"""Tree operators on node tables (node, parent, time, is_leaf and more), with nested-set ranks pre and last where subtrees matter."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.functions import columns as C
from cladewright.functions import kernels as K
from cladewright.shipping import ship

from .scale import cut, fresh, last_before, nearest_marked, running, running_at


NODE = "pre int, last int, parent_pre int, depth int, blen double, blen_text string, name string, n_children int, is_leaf boolean, time double"
#: Nodes of a frame of small trees.
NODES = 10_000
#: Nodes whose ranks come by pointer doubling. Of larger trees the leaves are taken off first, again and again.
CORE = 65_536
#: Places of a block of the pre-order, and of a block of blocks.
BLOCK = 64
#: Blocks that every task may have (a few megabytes).
FEW_BLOCKS = 2048


def read_newick(trees: DataFrame) -> DataFrame:
    """tree_id and the nodes of each Newick text of ``trees`` (tree_id, newick), nested-set ranks included. One tree is one task's work; many trees are many tasks'."""
    ship(trees.sparkSession)
    kind = trees.schema["tree_id"].dataType.simpleString()

    names = [c.split()[0] for c in NODE.split(", ")]

    def parse(batches):
        for pdf in batches:
            ids, rows = [], []
            for k, (i, text) in enumerate(zip(pdf.tree_id, pdf.newick, strict=True), 1):
                found = K.newick_nodes(text)
                ids += [i] * len(found)
                rows += found
                if len(rows) >= NODES or rows and k == len(pdf):  # many small trees make one frame
                    out = pd.DataFrame(rows, columns=names)
                    out["parent_pre"] = out["parent_pre"].astype("Int32")
                    out.insert(0, "tree_id", pd.Series(ids, dtype=pdf.tree_id.dtype))
                    yield out
                    ids, rows = [], []

    return trees.select("tree_id", "newick").mapInPandas(parse, f"tree_id {kind}, {NODE}")


def write_newick(nodes: DataFrame) -> DataFrame:
    """tree_id and newick, the inverse of ``read_newick``; lengths are written word for word."""
    ship(nodes.sparkSession)
    kind = nodes.schema["tree_id"].dataType.simpleString()

    def write(batches):
        rest, ids, texts = [], [], []  # the rows of a tree that the next batch may carry on

        def close() -> None:
            if rest:
                ids.append(rest[0]["tree_id"])
                texts.append(K.newick_text(rest))

        for batch in batches:
            for row in batch.to_pylist():
                if rest and rest[0]["tree_id"] != row["tree_id"]:
                    close()
                    rest = []
                rest.append(row)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("tree_id").type), pa.array(texts, pa.string())], ["tree_id", "newick"])
                ids, texts = [], []
        close()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("tree_id").type), pa.array(texts, pa.string())], ["tree_id", "newick"])

    rows = nodes.select("tree_id", "pre", "last", "name", "blen_text")
    return rows.repartition("tree_id").sortWithinPartitions("tree_id", "pre").mapInArrow(write, f"tree_id {kind}, newick string")


def nested_set(nodes: DataFrame, core: int = CORE) -> DataFrame:
    """``nodes`` (node, parent; children and roots ordered by node) with depth, size (nodes below and itself), pre and last.

    While there are more than ``core`` nodes, the leaves are taken off and their sizes added to their parents', as long as a quarter of the nodes are leaves; so the rounds of a bushy tree go over ever fewer
    nodes, all of them together over a few times the tree. On what is left, sizes go up and places come down by pointer doubling, so that the number of rounds goes with the log of its depth. Then
    the leaves get their places below their parents', the last taken off first.
    """
    left = fresh(nodes.select("node", "parent", F.lit(1).cast("long").alias("size")))
    off, n = [], left.count()
    while n > core:
        inner = left.select(F.col("parent").alias("_p")).distinct()
        told = fresh(left.join(inner, F.col("node") == F.col("_p"), "left").select("node", "parent", "size", F.col("_p").isNull().alias("_leaf")))
        off.append(told.filter("_leaf").select("node", "parent", "size"))
        given = off[-1].groupBy(F.col("parent").alias("_p")).agg(F.sum("size").alias("_s"))
        left = fresh(told.filter("not _leaf").join(given, F.col("node") == F.col("_p"), "left").select("node", "parent", (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size")))
        many, n = n, left.count()
        if 4 * n > 3 * many:
            break
    # each node hands what is known to be below it to the node 1, 2, 4, ... levels above
    state = fresh(left.select("node", "parent", F.col("parent").alias("up"), "size", F.col("parent").isNotNull().cast("int").alias("depth")))
    while not state.filter("up is not null").isEmpty():
        far = state.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        given = state.filter("up is not null").groupBy(F.col("up").alias("_g")).agg(F.sum("size").alias("_s"))
        met = state.join(far, F.col("up") == F.col("_n"), "left").join(given, F.col("node") == F.col("_g"), "left")
        state = fresh(met.select("node", "parent", F.col("_up").alias("up"), (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
    sized = state.select("node", "parent", "size", "depth", F.lit(len(off)).alias("_k"))
    for k, x in enumerate(off):
        sized = sized.unionByName(x.select("node", "parent", "size", F.lit(None).cast("int").alias("depth"), F.lit(k).alias("_k")))
    older = W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    step = F.coalesce(F.sum("size").over(older), F.lit(0)) + F.col("parent").isNotNull().cast("long")  # places from the parent's to the node's
    sized = fresh(sized.withColumn("_step", step))
    state = fresh(sized.filter(F.col("_k") == len(off)).select("node", F.col("parent").alias("up"), "size", "depth", F.col("_step").alias("pre")))
    while not state.filter("up is not null").isEmpty():
        far = state.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("pre").alias("_pre"))
        state = fresh(state.join(far, F.col("up") == F.col("_n"), "left").select("node", F.col("_up").alias("up"), "size", "depth", (F.col("pre") + F.coalesce("_pre", F.lit(0))).alias("pre")))
    ranks = state.select("node", "depth", "size", "pre")
    for k in reversed(range(len(off))):
        above = ranks.select(F.col("node").alias("_n"), F.col("depth").alias("_d"), F.col("pre").alias("_pre"))
        low = sized.filter(F.col("_k") == k).join(above, F.col("parent") == F.col("_n"), "left")  # a root without children has none above it
        ranks = ranks.unionByName(fresh(low.select("node", F.coalesce(F.col("_d") + 1, F.lit(0)).alias("depth"), "size", (F.coalesce("_pre", F.lit(0)) + F.col("_step")).alias("pre"))))
    return nodes.join(ranks, "node").withColumn("last", F.col("pre") + F.col("size") - 1)


def class_counts(nodes: DataFrame, classes: DataFrame, node_class: str = "cls", most: int = 10_000) -> DataFrame:
    """node, cls and n: leaves of each class below each node, as a difference of two running sums over pre; zeros are kept.

    ``nodes`` has node, pre, last; ``classes`` has the class of each leaf. One row for each node and class comes out, so there may be ``most`` classes.
    """
    kinds = [r[0] for r in classes.select(node_class).distinct().limit(most + 1).collect()]
    if len(kinds) > most:
        raise ValueError(f"over {most} classes")
    leaves = nodes.join(classes.select("node", F.col(node_class).alias("_c")), "node", "left").select("node", "pre", "last", "_c")
    grid = leaves.withColumn(node_class, F.explode(F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<string>")))
    own = F.coalesce((F.col("_c") == F.col(node_class)).cast("long"), F.lit(0))
    cum = running_at(grid, {"cum": own}, "pre", [node_class])
    at = cum.select(F.col("pre").alias("p"), F.col(node_class).alias("k"), F.col("cum").alias("hi"))
    return cum.withColumn("own", own).join(at, (F.col("last") == F.col("p")) & (F.col(node_class) == F.col("k"))).select("node", node_class, (F.col("hi") - F.col("cum") + F.col("own")).alias("n"))


def tips_below(nodes: DataFrame) -> DataFrame:
    """``nodes`` with tips: the leaves at or below each node."""
    r = running_at(nodes, {"cum": F.col("is_leaf").cast("long")}, "pre")
    end = r.select(F.col("pre").alias("_p"), F.col("cum").alias("_hi"))
    return r.join(end, F.col("last") == F.col("_p")).withColumn("tips", F.col("_hi") - F.col("cum") + F.col("is_leaf").cast("long")).drop("_p", "_hi", "cum")


def maximal_clades(sized: DataFrame, least: int, most: int) -> DataFrame:
    """Nodes with ``least`` to ``most`` tips whose parent has more than ``most``; a root is never one."""
    up = sized.select(F.col("node").alias("parent"), F.col("tips").alias("up_tips"))
    return sized.join(up, "parent").filter(F.col("tips").between(least, most) & (F.col("up_tips") > most)).drop("up_tips")


def band_clades(sized: DataFrame, least: int, most: int) -> DataFrame:
    """Inner nodes with ``least`` to ``most`` tips whose parent has more than ``most``, and roots in that band; no two of them share a tip. Ends count as in the band."""
    up = sized.select(F.col("node").alias("_up"), F.col("tips").alias("_tips"))
    met = sized.filter(~F.col("is_leaf") & F.col("tips").between(least, most)).join(up, F.col("parent") == F.col("_up"), "left")
    return met.filter(F.col("parent").isNull() | (F.col("_tips") > most)).drop("_up", "_tips")


def time_cut(nodes: DataFrame, times: DataFrame) -> DataFrame:
    """t and the nodes whose branch crosses each t: parent's time < t <= own time."""
    up = nodes.select(F.col("node").alias("parent"), F.col("time").alias("up_time"))
    return nodes.join(up, "parent").join(F.broadcast(times), (F.col("up_time") < F.col("t")) & (F.col("t") <= F.col("time")))


def nearest_chosen(nodes: DataFrame, chosen: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``nodes`` with clade: the node of ``chosen`` (node, pre, last, an antichain in each of ``by``) at or above each, null if there is none. As-of over pre, by runs."""
    by = by or []
    marks = chosen.select(*by, "pre", F.col("node").alias("_clade"), F.col("last").alias("_last"))
    seen = last_before(nodes, marks, "pre", by)
    return seen.select(*nodes.columns, F.when(F.col("_mark._last") >= F.col("pre"), F.col("_mark._clade")).alias("clade"))


def lineages_through_time(nodes: DataFrame, times: DataFrame, most: int = 10_000) -> DataFrame:
    """t and lineages: branches that cross t (parent's time < t <= own time).

    Each branch says how many of the times (at most ``most``) are not above its start and its end; counts of these numbers, not branches, leave the tasks.
    """
    grid = sorted(r.t for r in times.select(F.col("t").cast("double").alias("t")).distinct().limit(most + 1).collect())
    if len(grid) > most:
        raise ValueError(f"over {most} times")
    up_to = lambda c: F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col(c))) if grid else F.lit(0)
    up = nodes.select(F.col("node").alias("parent"), F.col("time").alias("up_time"))
    ends = nodes.join(up, "parent").select(F.explode(F.array(F.struct(up_to("up_time").alias("k"), F.lit(1).alias("d")), F.struct(up_to("time").alias("k"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("e.k").agg(F.sum("e.d").alias("d"))
    at = times.sparkSession.createDataFrame(list(enumerate(grid)), "k int, t double")
    both = at.select("k", "t", F.lit(0).cast("long").alias("d")).unionByName(steps.select("k", F.lit(None).cast("double").alias("t"), "d"))
    cum = both.groupBy("k").agg(F.max("t").alias("t"), F.sum("d").alias("d")).withColumn("lineages", F.sum("d").over(W.orderBy("k")))  # a row for each time
    return cum.filter("t is not null").select("t", "lineages")


def sibling_groups(nodes: DataFrame) -> DataFrame:
    """parent, k and kind (loner, cherry, polytomy) over leaf children."""
    g = nodes.filter("is_leaf").groupBy("parent").agg(F.count("*").alias("k"))
    return g.withColumn("kind", F.when(F.col("k") == 1, "loner").when(F.col("k") == 2, "cherry").otherwise("polytomy"))


def sibling_pairs(leaves: DataFrame) -> DataFrame:
    """parent, a and b (a < b): leaves that share a parent."""
    return leaves.select("parent", F.col("node").alias("a")).join(leaves.select("parent", F.col("node").alias("b")), "parent").filter("a < b")


def ancestral(nodes: DataFrame, tips: DataFrame, n_sites: int = 6) -> DataFrame:
    """node, tape and prefix: the longest common edit prefix of the observed tips (node, tape, sites) at or below each node of ``nodes`` (node, pre, last).

    Tips of a tape stand in the order of pre. The common prefix of a run of them is as long as the least common prefix of two neighbours, and it is at least s long
    where no two neighbours share less; so running counts of neighbours that share less than s, for each s, give it for every node without a walk over levels.
    """
    short = lambda s: F.coalesce((F.col("shared") < s).cast("int"), F.lit(0))
    leaf = tips.join(nodes.select("node", "pre"), "node").select("tape", "pre", "sites")
    kinds = [r.tape for r in leaf.select("tape").distinct().collect()]  # tapes are few
    grid = nodes.select("node", "pre", "last").withColumn("tape", F.explode(F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<string>")))
    grid = grid.join(leaf, ["tape", "pre"], "left")
    seen = cut(running_at(grid, {"rank": F.col("sites").isNotNull().cast("long")}, "pre", ["tape"]))
    ranked = seen.filter("sites is not null").select("tape", "rank", "pre", "sites")
    left = ranked.select("tape", (F.col("rank") + 1).alias("rank"), F.col("sites").alias("left"))
    pairs = ranked.join(left, ["tape", "rank"], "left").withColumn("shared", F.when(F.col("left").isNotNull(), C.shared_prefix(F.col("left"), F.col("sites"))))
    counts = {f"c{s}": short(s) for s in range(1, n_sites + 1)}
    summed = cut(running_at(pairs.select("tape", "rank", "sites", "shared"), counts, "rank", ["tape"]))
    ends = seen.select("tape", F.col("pre").alias("last"), F.col("rank").alias("hi"))
    span = seen.withColumn("lo", F.col("rank") - F.col("sites").isNotNull().cast("long") + 1).select("node", "tape", "lo", "last").join(ends, ["tape", "last"]).filter("hi >= lo")
    at_lo = summed.select("tape", F.col("rank").alias("lo"), "sites", F.array(*counts).alias("from"))
    at_hi = summed.select("tape", F.col("rank").alias("hi"), F.array(*counts).alias("to"))
    met = span.join(at_lo, ["tape", "lo"]).join(at_hi, ["tape", "hi"])
    agreed = F.size(F.filter(F.arrays_zip("from", "to"), lambda z: z["from"] == z["to"]))
    return met.select("node", "tape", F.slice("sites", F.lit(1), F.least(agreed, C.depth(F.col("sites")))).alias("prefix"))


def branch_support(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """node, edits and tapes: edits on the branch above each node, over tapes observed at both ends (a root: all of its own), and on how many tapes."""
    n = states.select("node", "tape", F.size("prefix").alias("n"))
    own = nodes.select("node", "parent").join(n, "node")
    up = n.select(F.col("node").alias("parent"), "tape", F.col("n").alias("up"))
    d = own.join(up, ["parent", "tape"], "left").withColumn("e", F.when(F.col("parent").isNull(), F.col("n")).otherwise(F.coalesce(F.col("n") - F.col("up"), F.lit(0))))
    s = d.groupBy("node").agg(F.sum("e").alias("edits"), F.count_if(F.col("e") > 0).alias("tapes"))
    return nodes.select("node").join(s, "node", "left").na.fill(0, ["edits", "tapes"])


def lifted(nodes: DataFrame) -> list[DataFrame]:
    """Tables (node, anc) of the nodes 1, 2, 4, ... levels above each: n rows for each power of two of the depth."""
    out = [fresh(nodes.filter("parent is not null").select("node", F.col("parent").alias("anc")))]
    while True:
        far = out[-1].select(F.col("node").alias("anc"), F.col("anc").alias("far"))
        more = fresh(out[-1].join(far, "anc").select("node", F.col("far").alias("anc")))
        if more.isEmpty():
            return out
        out.append(more)


def mrca(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with mrca, from ``nodes`` (node, parent, pre, last); null for nodes of different trees.

    a rises by powers of two, the greatest first, as long as its interval does not hold b; its parent is then the deepest node that holds both.
    """
    at = nodes.select("node", "pre", "last")
    x = pairs.join(at.select(F.col("node").alias("b"), F.col("pre").alias("at")), "b").join(at.select(F.col("node").alias("a"), "pre", "last"), "a")
    inside = F.col("at").between(F.col("pre"), F.col("last"))
    x = x.select("a", "b", "at", F.col("a").alias("m"), inside.alias("done"))
    for table in reversed(lifted(nodes)):
        up = table.join(at.select(F.col("node").alias("anc"), "pre", "last"), "anc").select(F.col("node").alias("m"), "anc", "pre", "last")
        x = fresh(x.join(up, "m", "left").select("a", "b", "at", F.when(~F.col("done") & F.col("anc").isNotNull() & ~inside, F.col("anc")).otherwise(F.col("m")).alias("m"), "done"))
    parent = nodes.select(F.col("node").alias("m"), "parent")
    return x.join(parent, "m").select("a", "b", F.when(F.col("done"), F.col("m")).otherwise(F.col("parent")).alias("mrca"))


def patristic(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with mrca, mrca_time and distance along the tree, from ``nodes`` with time; null for nodes of different trees."""
    t = nodes.select("node", "time")
    out = mrca(nodes, pairs).join(t.select(F.col("node").alias("a"), F.col("time").alias("ta")), "a", "left").join(t.select(F.col("node").alias("b"), F.col("time").alias("tb")), "b", "left")
    out = out.join(t.select(F.col("node").alias("mrca"), F.col("time").alias("mrca_time")), "mrca", "left")
    return out.select("a", "b", "mrca", "mrca_time", (F.col("ta") + F.col("tb") - 2 * F.col("mrca_time")).alias("distance"))


def lca(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b and others) with lca: their lowest common ancestor, from ``ranked`` (``nested_set``: node, parent, pre, depth); null for nodes of different trees or unknown ones."""
    place = lambda c: ranked.select(F.col("node").alias(f"_{c}"), F.col("pre").alias(f"_pre_{c}"))
    x = pairs.join(place("a"), F.col("a") == F.col("_a"), "left").join(place("b"), F.col("b") == F.col("_b"), "left")
    known = F.col("_pre_a").isNotNull() & F.col("_pre_b").isNotNull()
    low, high = (F.when(known, f("_pre_a", "_pre_b")) for f in (F.least, F.greatest))
    return lca_of_places(ranked, x.select(*pairs.columns, low.alias("_x"), high.alias("_y"), F.col("a").alias("_own")))


def lca_of_places(ranked: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks`` with lca instead of _x, _y and _own: the lowest common ancestor of the nodes at the places _x and _y (_x <= _y; one is null: null) of the pre-order of ``ranked``; _own is the node at _x.

    Between two places the least deep node after the first hangs on the ancestor sought. A stretch of places is a part of its first block, a part of its last one, and whole blocks between, whose least deep
    nodes are a stretch of places a level up. So each ask is joined with two blocks a level, levels are as many as the log to the base ``BLOCK`` of the tree, and each is so much smaller than the one below.
    """
    rest = [c for c in asks.columns if c not in ("_x", "_y", "_own")]
    asks = fresh(asks)
    out = asks.filter("_x is null or _y is null or _x = _y").select(*rest, F.when(F.col("_x") == F.col("_y"), F.col("_own")).alias("lca"))
    level = ranked.select(F.col("pre").alias("_at"), F.struct("depth", "parent").alias("m"))
    left = asks.filter("_x < _y").select(*rest, (F.col("_x") + 1).alias("_lo"), F.col("_y").alias("_hi"), F.lit(None).cast(level.schema["m"].dataType).alias("_m"))
    low, high = F.expr(f"_lo div {BLOCK}"), F.expr(f"_hi div {BLOCK}")
    part = lambda a, i, j: F.array_min(F.slice(a, (i % BLOCK + 1).cast("int"), (j - i + 1).cast("int")))
    n = level.count()
    while True:
        blocks = fresh(level.groupBy(F.expr(f"_at div {BLOCK}").alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "m"))), lambda z: z["m"]).alias("_a")))
        n = -(-n // BLOCK)
        at_hand = F.broadcast(blocks) if n <= FEW_BLOCKS else blocks
        first = part(F.col("_a"), F.col("_lo"), F.least(F.col("_hi"), low * BLOCK + BLOCK - 1))
        x = fresh(left.join(at_hand, low == F.col("_b")).select(*rest, "_lo", "_hi", F.least("_m", first).alias("_m")))
        last = part(F.col("_a"), high * BLOCK, F.col("_hi"))
        wide = fresh(x.filter(low < high).join(at_hand, high == F.col("_b")).select(*rest, (low + 1).alias("_lo"), (high - 1).alias("_hi"), F.least("_m", last).alias("_m")))
        left = wide.filter("_lo <= _hi")
        for done in (x.filter(low == high), wide.filter("_lo > _hi")):
            out = out.unionByName(done.select(*rest, F.col("_m.parent").alias("lca")))
        if n <= 1:
            return out
        level = blocks.select(F.col("_b").alias("_at"), F.array_min("_a").alias("m"))


def witnesses(ranked: DataFrame, tips: DataFrame) -> DataFrame:
    """node, tips, first and last of each node of ``ranked`` with any of ``tips`` (pre and others, one at a place) at or below it: how many there are, and the rows of the first and the last of these in pre-order."""
    held = tips.select(F.col("pre").alias("_h"), F.struct(*tips.columns).alias("_tip"))
    x = fresh(ranked.select("node", "pre", "last").join(held, F.col("pre") == F.col("_h"), "left").drop("_h"))
    own = F.col("_tip").isNotNull().cast("long")
    seen = fresh(running_at(x, {"cum": own}, "pre"))
    end = seen.select(F.col("pre").alias("_l"), F.col("cum").alias("_hi"))
    span = seen.join(end, F.col("last") == F.col("_l")).select("node", (F.col("cum") - own + 1).alias("_lo"), "_hi").filter("_hi >= _lo")
    nth = seen.filter("_tip is not null").select("cum", "_tip")
    one = span.join(nth.select(F.col("cum").alias("_c"), F.col("_tip").alias("first")), F.col("_lo") == F.col("_c"))
    both = one.join(nth.select(F.col("cum").alias("_d"), F.col("_tip").alias("last")), F.col("_hi") == F.col("_d"))
    return both.select("node", (F.col("_hi") - F.col("_lo") + 1).alias("tips"), "first", "last")


def node_map(one: DataFrame, two: DataFrame, tips: DataFrame) -> DataFrame:
    """node, tips, mapped, mapped_tips, back and same of each node of ``one`` that has shared tips below: its counterpart in ``two``.

    ``one`` and ``two`` have node and parent; ``tips`` (a, b) says which leaf of one is which of two. A node is told by the first and the last shared tip below it: its counterpart is the lowest common
    ancestor of these in two, and back that of the counterpart's in one. same says that the node comes back and both have as many shared tips.
    """
    r1, r2 = fresh(nested_set(one.select("node", "parent"))), fresh(nested_set(two.select("node", "parent")))
    pairs = tips.select("a", "b").join(r1.select(F.col("node").alias("a"), F.col("pre").alias("pre_a")), "a").join(r2.select(F.col("node").alias("b"), F.col("pre").alias("pre_b")), "b")
    pairs = fresh(pairs)

    def there(ranked: DataFrame, other: DataFrame, own: str, its: str) -> DataFrame:
        w = witnesses(ranked, pairs.select(F.col(f"pre_{own}").alias("pre"), F.col(f"pre_{its}").alias("at"), F.col(its).alias("to")))
        ends = F.col("first.at"), F.col("last.at")
        return lca_of_places(other, w.select("node", "tips", F.least(*ends).alias("_x"), F.greatest(*ends).alias("_y"), F.col("first.to").alias("_own")))

    to, fro = fresh(there(r1, r2, "a", "b")), fresh(there(r2, r1, "b", "a"))
    met = to.join(fro.select(F.col("node").alias("_m"), F.col("tips").alias("mapped_tips"), F.col("lca").alias("back")), F.col("lca") == F.col("_m"), "left")
    same = (F.col("back") == F.col("node")) & (F.col("tips") == F.col("mapped_tips"))
    return met.select("node", "tips", F.col("lca").alias("mapped"), "mapped_tips", "back", F.coalesce(same, F.lit(False)).alias("same"))


def prune(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """node, parent and blen of the tree on the kept leaves: nodes with kept leaves below; those with one child give way to it, lengths added up."""
    kept = keep.select("node").withColumn("_keep", F.lit(1))
    marked = nodes.drop("tips").join(kept, "node", "left").withColumn("is_leaf", F.col("_keep").isNotNull()).drop("_keep")
    alive = cut(tips_below(marked).filter("tips > 0"))
    kids = alive.groupBy("parent").agg(F.count("*").alias("k")).withColumnRenamed("parent", "node")
    forks = alive.join(kids, "node", "left").withColumn("marked", F.col("is_leaf") | (F.coalesce("k", F.lit(0)) > 1))
    above = nearest_marked(forks.select("node", "parent", "marked"))
    out = forks.filter("marked").select("node", "time").join(above.select("node", F.col("up").alias("parent")), "node")
    return out.join(forks.select(F.col("node").alias("parent"), F.col("time").alias("up")), "parent", "left").select("node", "parent", (F.col("time") - F.coalesce("up", F.lit(0.0))).alias("blen"))


def children_means(nodes: DataFrame, leaves: DataFrame, dims: int) -> DataFrame:
    """node and v: each node's vector, a leaf's own, else the unweighted mean of its children's, from the deepest level up."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    at = cut(leaves.select("node", "v").join(nodes.select("node", "parent", "depth"), "node"))
    out = at
    level = at
    edges = nodes.select("node", "parent", "depth")
    for d in range(deepest, 0, -1):
        own = out.filter(F.col("depth") == d)
        mean = F.array(*[F.avg(F.element_at("v", i + 1)) for i in range(dims)])
        level = own.groupBy(F.col("parent").alias("node")).agg(mean.alias("v")).join(edges, "node")
        out = cut(out.unionByName(level.select("node", "v", "parent", "depth")))
    return out.select("node", "v")


def small_tree(distances: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """key, parent, child and length of the neighbour-joining tree of each group's pairs (i, j, d); leaves keep their ids, inner nodes get -1, -2, ... Groups over ``most`` leaves are refused."""
    import numpy as np

    ship(distances.sparkSession)
    kind = distances.schema[key].dataType.simpleString()

    def build(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf.i) | set(pdf.j))
        if len(ids) > most:
            raise ValueError(f"{len(ids)} leaves in one group")
        at = {x: n for n, x in enumerate(ids)}
        d = np.zeros((len(ids), len(ids)))
        i, j = pdf.i.map(at).to_numpy(), pdf.j.map(at).to_numpy()
        d[i, j] = d[j, i] = pdf.d
        name = lambda n: ids[n] if n < len(ids) else len(ids) - 1 - n
        rows = [(k[0], name(p), name(c), float(x)) for p, c, x in K.neighbour_joining(d)]
        return pd.DataFrame(rows, columns=[key, "parent", "child", "length"])

    return distances.select(key, "i", "j", "d").groupBy(key).applyInPandas(build, f"{key} {kind}, parent long, child long, length double")


def grafted(dated: DataFrame, pendants: DataFrame, present: float) -> DataFrame:
    """tip, cell and time: where each cell (tip, cell, days) leaves the branch of its matched dated tip (node, parent_time): present less its pendant, not before the tip's parent.

    Cells of one tip stand in a caterpillar, oldest first; times that are equal to nine places share a node.
    """
    p = pendants.join(dated.select(F.col("node").alias("tip"), "parent_time"), "tip")
    at = F.round(F.greatest(F.col("parent_time"), F.lit(present) - F.col("days")), 9)
    return p.select("tip", "cell", at.alias("time")).withColumn("place", F.dense_rank().over(W.partitionBy("tip").orderBy("time")))


def merged(sides: list[DataFrame], root: int, stem: float) -> DataFrame:
    """One tree of several (node, parent, time) under a new root at day 0, with the same stem above each; node ids must be disjoint."""
    out = sides[0].sparkSession.range(1).select(F.lit(root).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("time"))
    for s in sides:
        out = out.unionByName(s.select("node", F.coalesce("parent", F.lit(root)).cast("long").alias("parent"), (F.col("time") + stem).alias("time")))
    return out


def break_cycles(matches: DataFrame) -> DataFrame:
    """node, parent and held: nodes whose match (node -> match, score) runs into a cycle are resolved by holding, in each cycle, the node with the best score (ties: the least node).

    The graph is functional, so cycles are found by pointer doubling; a held node has no parent here.
    """
    m = matches.select("node", F.col("match").alias("to"))
    n = m.count()
    jump, step = fresh(m), 1
    while step < n:  # after n hops every node that still has a place stands on a cycle
        nxt = jump.withColumnRenamed("to", "mid").join(jump.select(F.col("node").alias("mid"), "to"), "mid").select("node", "to")
        jump, step = fresh(nxt), step * 2
    on = fresh(jump.select(F.col("to").alias("node")).distinct().join(m, "node"))
    least, step = on.select("node", "to", F.col("node").alias("low")), 1
    size = on.count()
    while step < size:
        far = least.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        least = fresh(least.join(far, "to").select("node", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
        step *= 2
    scored = least.join(matches.select("node", "score"), "node")
    held = scored.groupBy("low").agg(F.min_by("node", F.struct(-F.col("score"), "node")).alias("node")).select("node", F.lit(True).alias("held"))
    return matches.join(held, "node", "left").select("node", F.when(F.col("held").isNull(), F.col("match")).alias("parent"), F.coalesce("held", F.lit(False)).alias("held"))


def binarised(nodes: DataFrame) -> DataFrame:
    """node, parent, time and added: each node of k > 2 children gets k - 2 nodes below it, a chain at its own time, so that all have two children at most.

    Children hang on the chain in the order of their ids; added nodes have negative ids that follow from the parent's and the place, where ids are 0 or more; a node
    of over 1,000,000 children stops the query.
    """
    w = W.partitionBy("parent")
    x = nodes.select("node", "parent", "time").withColumn("_r", F.row_number().over(w.orderBy("node"))).withColumn("_k", F.count("*").over(w))
    extra = lambda place: F.when(place < 1_000_000, -(F.col("parent") * 1_000_000 + place)).otherwise(F.raise_error(F.lit("a node has 1,000,000 children or more")).cast("long"))
    many = F.col("parent").isNotNull() & (F.col("_k") > 2)
    hook = F.when(many & (F.col("_r") > 1), extra(F.least(F.col("_r") - 1, F.col("_k") - 2))).otherwise(F.col("parent"))
    kept = x.select("node", hook.alias("parent"), "time", F.lit(False).alias("added"))
    times = nodes.select(F.col("node").alias("parent"), F.col("time").alias("_t"))
    chain = x.filter(many & (F.col("_r") <= F.col("_k") - 2)).join(times, "parent")
    new = chain.select(extra(F.col("_r")).alias("node"), F.when(F.col("_r") == 1, F.col("parent")).otherwise(extra(F.col("_r") - 1)).alias("parent"), F.col("_t").alias("time"), F.lit(True).alias("added"))
    return kept.unionByName(new)


def rerooted(nodes: DataFrame, outgroup: int) -> DataFrame:
    """node, parent and blen of the tree rooted where the leaf ``outgroup`` hangs, without it: branches on the way from there to the old root are turned round.

    The way is found by pointer doubling. An old root that is left with one child stays as a node on its branch.
    """
    e = nodes.select("node", "parent", "blen")
    hops = lifted(nodes)
    way = fresh(e.filter(F.col("node") == outgroup).select("node"))  # all that stand on the way: after the k-th table those up to 2 ** (k + 1) levels above
    for table in hops:
        way = fresh(way.unionByName(way.join(table, "node").select(F.col("anc").alias("node"))).distinct())
    turned = e.join(way, "node", "left_semi").filter(F.col("parent").isNotNull() & (F.col("node") != outgroup)).select(F.col("parent").alias("node"), F.col("node").alias("parent"), "blen")
    first = e.filter(F.col("node") == outgroup).select(F.col("parent").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("blen"))
    return e.join(way, "node", "left_anti").unionByName(turned).unionByName(first)


def diameter(nodes: DataFrame) -> tuple[int, int, float, DataFrame]:
    """Two leaves that are farthest from each other (the deepest of all first; ties: the least node), their distance, and the nodes (node, parent, time, level) with ``up``: the lowest node above or at
    each that stands over the first. Branch lengths are 0 or more, and the tree has one root.

    The leaf farthest from any node ends a longest way, so it is sought from the root, and then from there. How far all others are from the first leaf follows from where their ways up meet its own.
    """
    deep = with_depths(nodes.select("node", "parent", F.lit(1.0).alias("blen"))).select(F.col("node").alias("_d"), F.col("time").alias("level"))
    timed = fresh(with_depths(nodes.select("node", "parent", "blen")).join(deep, F.col("node") == F.col("_d")).select("node", "parent", "time", "level"))
    inner = timed.filter("parent is not null").select(F.col("parent").alias("_i")).distinct()
    leaves = timed.join(inner, F.col("node") == F.col("_i"), "left_anti")
    first = leaves.agg(F.min_by("node", F.struct(-F.col("time"), "node"))).first()[0]
    way = fresh(timed.filter(F.col("node") == first).select("node"))
    for table in lifted(timed):
        way = fresh(way.unionByName(way.join(table, "node").select(F.col("anc").alias("node"))).distinct())
    marked = timed.join(way.select(F.col("node").alias("_w")), F.col("node") == F.col("_w"), "left")
    above = nearest_marked(marked.select("node", "parent", F.col("_w").isNotNull().alias("marked")))
    met = marked.join(above.select(F.col("node").alias("_n"), F.col("up").alias("_up")), F.col("node") == F.col("_n")).select("node", "parent", "time", "level", F.coalesce("_w", "_up").alias("up"))
    met = fresh(met)
    at = timed.select(F.col("node").alias("_u"), F.col("time").alias("_ut"))
    deep = leaves.agg(F.max("time")).first()[0]
    far = met.join(inner, F.col("node") == F.col("_i"), "left_anti").join(at, F.col("up") == F.col("_u")).filter(F.col("node") != first).select("node", (F.lit(deep) + F.col("time") - 2 * F.col("_ut")).alias("d"))
    last = far.agg(F.min_by(F.struct("node", "d"), F.struct(-F.col("d"), "node"))).first()[0]
    return first, last.node if last else first, last.d if last else 0.0, met


def midpoint_rooted(nodes: DataFrame, root: int) -> DataFrame:
    """node, parent and blen of the tree of ``nodes`` (node, parent, blen of 0 or more; null counts as 0) with a new root, the node ``root``, in the middle of its longest way from leaf to leaf.

    The middle is on the way up from the deepest leaf. Branches between it and the old root are turned round; an old root that is left with one child stays as a node on its branch. A
    middle that falls on a node gets a branch of length 0 to it. A tree of one node is only renamed below its root.
    """
    first, _, length, met = diameter(nodes)
    deep = met.filter(F.col("node") == first).first().time
    middle = deep - length / 2
    way = met.filter(F.col("up") == F.col("node"))  # over the first leaf
    time_up = met.select(F.col("node").alias("_p"), F.col("time").alias("_pt"))
    rows = fresh(met.join(time_up, F.col("parent") == F.col("_p"), "left").withColumn("blen", F.col("time") - F.coalesce("_pt", F.lit(0.0))))
    below = way.filter(F.col("time") >= middle - 1e-12).agg(F.min_by(F.struct("node", "parent", "time", "level"), "level")).first()[0]
    if below.parent is None:
        new = [(root, None, 0.0), (below.node, root, 0.0)]
        turned, cut_off = rows.limit(0), [below.node]
    else:
        above = met.filter(F.col("node") == below.parent).first().time
        new = [(root, None, 0.0), (below.node, root, below.time - middle), (below.parent, root, middle - above)]
        turned = rows.join(way.select(F.col("node").alias("_w")), F.col("node") == F.col("_w"), "left_semi").filter((F.col("level") < below.level) & F.col("parent").isNotNull())
        cut_off = [below.node]
    turned = fresh(turned.select("node", "parent", "blen"))
    moved = turned.select(F.col("parent").alias("node"), F.col("node").alias("parent"), "blen")
    gone = turned.select(F.col("node").alias("_t")).unionByName(moved.select(F.col("node").alias("_t")))
    made = nodes.sparkSession.createDataFrame(new, "node long, parent long, blen double")
    kept = rows.select("node", "parent", "blen").filter(~F.col("node").isin(cut_off + ([below.parent] if below.parent is not None else [])))
    kept = kept.join(gone.distinct(), F.col("node") == F.col("_t"), "left_anti")
    return kept.unionByName(moved).unionByName(made)


def nonnegative(nodes: DataFrame) -> DataFrame:
    """node, parent and blen: a branch of negative length becomes 0, and the branches below its node are shorter by as much, from the root down.

    So a node's depth is the greatest sum of lengths on its way from the root so far (0 at least), and its length the difference to its parent's. Sums and greatest sums
    of ways come by pointer doubling.
    """
    e = nodes.select("node", "parent", F.coalesce("blen", F.lit(0.0)).alias("blen"))
    root = F.col("parent").isNull()
    state = fresh(e.select("node", "parent", F.col("parent").alias("up"), F.when(root, 0.0).otherwise(F.col("blen")).alias("sum"), F.when(root, 0.0).otherwise(F.greatest(F.lit(0.0), "blen")).alias("most")))
    while not state.filter("up is not null").isEmpty():
        far = state.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("sum").alias("_s"), F.col("most").alias("_m"))
        state = fresh(state.join(far, F.col("up") == F.col("_n"), "left").select(
            "node", "parent", F.col("_up").alias("up"), (F.col("sum") + F.coalesce("_s", F.lit(0.0))).alias("sum"), F.when(F.col("_s").isNull(), F.col("most")).otherwise(F.greatest("_m", F.col("_s") + F.col("most"))).alias("most")))
    up = state.select(F.col("node").alias("parent"), F.col("most").alias("_d"))
    return state.join(up, "parent", "left").select("node", "parent", (F.col("most") - F.col("_d")).alias("blen"))


def with_depths(nodes: DataFrame, length: str = "blen") -> DataFrame:
    """``nodes`` with time: the sum of branch lengths from the root, by pointer doubling."""
    state = fresh(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce(length, F.lit(0.0))).alias("time")))
    while not state.filter("up is not null").isEmpty():
        far = state.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("time").alias("_t"))
        state = fresh(state.join(far, F.col("up") == F.col("_n"), "left").select("node", F.col("_up").alias("up"), (F.col("time") + F.coalesce("_t", F.lit(0.0))).alias("time")))
    return nodes.drop("time").join(state.select("node", "time"), "node")


def synthetic_root(tapes: list[str], name: str = "root", alternative: str | None = None, n_sites: int = 6):
    """A function of a session: rows cell, tape and sites of a cell without any edit, or, with ``alternative``, of an outgroup that has this token at every first site."""
    sites = [alternative or C.UNEDITED] + [C.UNEDITED] * (n_sites - 1)
    return lambda spark: spark.createDataFrame([(name, t, sites) for t in tapes], "cell string, tape string, sites array<string>")


def cousins(nodes: DataFrame, queries: DataFrame, k: int = 10, by: str = "day", digits: int = 9, wide: int = 32) -> DataFrame:
    """a, b, distance (to ``digits`` places) and rank: the ``k`` nodes nearest to each of ``queries`` (node) along the tree among those of the same ``by``, but for itself, its ancestors and its descendants; ties: the least node.

    ``nodes`` has node, parent, pre, last, time and ``by``. In the pre-order of its group, the farther a node is from a query, the higher they meet. So a query looks at ``wide`` nodes on both sides,
    then at eight times as many, until no node of its group that met it where the outermost did, or higher, could be as near as the ``k`` found. Times must not fall from parent to child for that; where they do, all of a group are looked at.
    """
    n = fresh(running(nodes.select("node", by, "pre").filter(F.col(by).isNotNull()), ["pre"], {"_place": "1L"}, [by]).select("node", F.col(by).alias("_by"), "_place"))
    group = nodes.groupBy(F.col(by).alias("_by")).agg(F.min("time").alias("_first"), F.count("*").alias("_n"))
    times = nodes.select(F.col("node").alias("a"), F.col("time").alias("_ta"))
    left = fresh(n.join(queries.select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "a").join(group, "_by").join(times, "a").select("a", "_by", F.col("_place").alias("_at"), "_first", "_n", "_ta"))
    up = nodes.select(F.col("node").alias("parent"), F.col("time").alias("_up"))
    if not nodes.join(up, "parent").filter(F.coalesce(F.col("time") < F.col("_up"), F.lit(True))).isEmpty():
        wide = group.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    best = fresh(left.select("a", F.col("a").alias("b"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0))
    seen, far = 0, wide
    order = W.partitionBy("a").orderBy("distance", "b")
    while not left.isEmpty():
        places = F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_at") - far), F.least(F.col("_n"), F.col("_at") + far))
        ring = left.select("a", F.col("_by").alias("_g"), F.explode(F.filter(places, lambda p: F.abs(p - F.col("_at")) > seen)).alias("_p"))
        pairs = fresh(ring.join(n, (F.col("_g") == F.col("_by")) & (F.col("_p") == F.col("_place"))).select("a", F.col("node").alias("b")))
        met = fresh(patristic(nodes, pairs))
        found = met.filter("mrca <> a and mrca <> b").select("a", "b", F.round("distance", digits).alias("distance"))
        best = fresh(best.select("a", "b", "distance").unionByName(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        # a node of another tree has none of the query's tree beyond it
        at = n.select(F.col("node").alias("b"), "_place")
        high = F.coalesce("mrca_time", F.lit(float("-inf")))
        sides = met.join(at, "b").join(left, "a").groupBy("a").agg(F.min(F.when(F.col("_place") < F.col("_at"), high)).alias("_tl"), F.min(F.when(F.col("_place") > F.col("_at"), high)).alias("_tr"))
        held = best.groupBy("a").agg(F.max("distance").alias("_worst"), F.count("*").alias("_held"))
        known = left.join(sides, "a", "left").join(held, "a", "left")
        over = lambda t: F.coalesce((F.col("_held") == k) & (F.round(F.col("_ta") + F.col("_first") - 2 * F.col(t), digits) > F.col("_worst")), F.lit(False)) | F.coalesce(F.col(t) == float("-inf"), F.lit(False))
        closed = ((F.col("_at") - far <= 1) | over("_tl")) & ((F.col("_at") + far >= F.col("_n")) | over("_tr"))
        left = fresh(known.filter(~closed).select(*left.columns))
        seen, far = far, 8 * far
    return best


def anchors(nodes: DataFrame, survivors: DataFrame, lost: DataFrame) -> DataFrame:
    """node and anchor of each lost leaf: the surviving leaf with the least pre below its nearest ancestor that has any. ``nodes`` has node, parent, pre, last, is_leaf."""
    keep = survivors.select("node").withColumn("_keep", F.lit(True))
    alive = nodes.drop("tips").join(keep, "node", "left").withColumn("is_leaf", F.coalesce("_keep", F.lit(False)) & F.col("is_leaf")).drop("_keep")
    counted = cut(tips_below(alive))
    up = nearest_marked(counted.select("node", "parent", (F.col("tips") > 0).alias("marked"))).join(lost.select("node"), "node", "left_semi")
    spans = up.filter("up is not null").join(counted.select(F.col("node").alias("up"), F.col("pre").alias("_pre")), "up").select("node", "_pre")
    leaves = counted.filter("is_leaf").select((-F.col("pre")).alias("pre"), F.col("node").alias("anchor"))
    # the first surviving leaf at or after the ancestor's place is below it
    found = last_before(spans.select("node", (-F.col("_pre")).alias("pre")), leaves, "pre")
    return found.select("node", F.col("_mark.anchor").alias("anchor"))


def distances_from(edges: DataFrame, root: str) -> DataFrame:
    """node and depth: the least number of steps from ``root`` over the edges (src, dst) of a small graph of states; a round for each step."""
    edges = fresh(edges.select("src", "dst").distinct())
    seen = fresh(edges.sparkSession.createDataFrame([(root,)], "node string").withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while True:
        depth += 1
        front = fresh(edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = fresh(seen.unionByName(front))


def unrelated_pairs(leaves: DataFrame, siblings: DataFrame, seed: int = 1, digits: int = 2) -> DataFrame:
    """a and b (a < b): leaves (node, cls) paired within their type by a hash, each with the next in that order (among those whose hash begins with the same ``digits``), but for ``siblings`` (a, b): a control sample of pairs of one type."""
    key = F.md5(F.concat_ws(":", F.lit(seed), "node").cast("binary"))
    x = leaves.select("node", "cls").withColumn("_k", key)
    after = F.lead("node").over(W.partitionBy("cls", F.substring("_k", 1, digits)).orderBy("_k", "node"))
    pairs = x.select("node", after.alias("_b")).filter("_b is not null").select(F.least("node", "_b").alias("a"), F.greatest("node", "_b").alias("b"))
    return pairs.join(siblings.select("a", "b"), ["a", "b"], "left_anti")
