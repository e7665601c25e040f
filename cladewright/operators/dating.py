"""Least-squares dates of a tree's nodes under minimum branches and age bounds.

Root and leaves have known days. Branch lengths b (substitutions) are rate * (difference in days) with errors of variance (b + smoothing) / sites, so with x = rate * (day - root's day)
the sum of squares is a quadratic form in all x and the rate: a term for each branch, over its two ends. Such a form is solved by elimination along the tree (messages of precision and mean):

* Rake: all subtrees under ``per`` nodes that hang on larger ones, each in one task, become messages to the nodes that they hang on.
* Compress: chains of what is left are cut into runs of ``per`` nodes; each run, in one task, becomes one branch between its ends.

A tree of ``WHOLE`` times ``per`` nodes is one task's (``forests``). Of larger ones the first rake is by parts, each some subtrees that a task holds as arrays: one pass over the parts both places their nodes and
sends the next messages. What is above the parts is ``per`` nodes at most, which the driver holds, unless the tree is deep. Then rake and compress are repeated until ``per`` nodes are left, which one task solves;
so the rounds go with the log of the number of nodes to a base near ``per`` / 4, whatever the tree's shape, and depend on the tree alone and are made once. Eliminated nodes are told as linear functions of the
ends of their cluster, so that dates come down by joins.

Branches of at least ``shortest`` days and days of at least ``earliest`` are inequalities. An active set of them is held by an augmented Lagrangian: all that the last solution breaks, or
whose multiplier holds, join the form as penalty terms, until the set stays; then multipliers are raised, until the constraints hold to ``TOLERANCE`` of the time from root to leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewright.shipping import ship

from . import forests as S
from . import timed as M
from . import trees as T
from .forests import STEPS, STIFFNESS, TOLERANCE  # noqa: F401
from .scale import forget, fresh, last_before

PER, WHOLE = 8192, 16
#: Nodes whose levels one task counts.
FEW = 65_536
#: A form over a branch (p: its upper, v: its lower end, w: the rate, and 1), and over a node.
EDGE = ["pp", "pv", "pw", "p1", "vv", "vw", "v1", "ww", "w1", "k0"]
NODE = ["nvv", "nvw", "nv1", "nww", "nw1", "nc"]
_PARTS = "out int, node long, p long, c long, ap double, ac double, aw double, a1 double, " + ", ".join(f"{k} double" for k in EDGE)


def raked(e: tuple, m: tuple) -> tuple[tuple, tuple]:
    """The message of a node with branch form ``e`` and node form ``m`` to the node above, and its place as (ap, aw, a1) times (p, w, 1)."""
    pp, pv, pw, p1, vv, vw, v1, ww, w1, c = e
    d, b, k = vv + m[0], vw + m[1], v1 + m[2]
    return (pp - pv * pv / d, pw - pv * b / d, p1 - pv * k / d, ww + m[3] - b * b / d, w1 + m[4] - b * k / d, c + m[5] - k * k / d), (-pv / d, -b / d, -k / d)


def compressed(e: tuple, m: tuple, f: tuple) -> tuple[tuple, tuple]:
    """The form of the branch that is left of two, ``e`` above and ``f`` below a node of form ``m``, and the node's place as (ap, ac, aw, a1) times (upper end, lower end, w, 1)."""
    d, g = e[4] + m[0] + f[0], f[1]
    a, b, k = e[1], e[5] + m[1] + f[2], e[6] + m[2] + f[3]
    new = (e[0] - a * a / d, -a * g / d, e[2] - a * b / d, e[3] - a * k / d, f[4] - g * g / d, f[5] - g * b / d, f[6] - g * k / d, e[7] + m[3] + f[7] - b * b / d, e[8] + m[4] + f[8] - b * k / d, e[9] + m[5] + f[9] - k * k / d)
    return new, (-a / d, -g / d, -b / d, -k / d)


def rake(rows: list[tuple]) -> tuple[int, tuple, list[tuple]]:
    """Of a whole subtree's (node, parent, e, m): the node that it hangs on, its message to that, and (node, ap, aw, a1) of each over it."""
    of = {r[0]: r for r in rows}
    order, kids = [], {}
    for n, p, *_ in rows:
        kids.setdefault(p if p in of else None, []).append(n)
    stack = list(kids[None])
    while stack:
        n = stack.pop()
        order.append(n)
        stack += kids.get(n, [])
    sums = {n: of[n][3] for n in order}
    at, up = {}, None
    for n in reversed(order):
        message, at[n] = raked(of[n][2], sums[n])
        p = of[n][1]
        if p in of:
            sums[p] = tuple(x + y for x, y in zip(sums[p], message, strict=True))
        else:
            up = message if up is None else tuple(x + y for x, y in zip(up, message, strict=True))
    said, place = [], {}
    for n in order:
        a, w, one = at[n]
        if of[n][1] in of:
            pa, pw, p1 = place[of[n][1]]
            a, w, one = a * pa, w + a * pw, one + a * p1
        place[n] = a, w, one
        said.append((n, a, w, one))
    return of[order[0]][1], up, said


def compress(rows: list[tuple]) -> tuple[int, int, tuple, list[tuple]]:
    """Of a chain's (node, parent, e, m): the node above it, its last node, the form of the branch between these, and (node, ap, ac, aw, a1) of each other over both."""
    of = {r[0]: r for r in rows}
    below = {r[1]: r[0] for r in rows}
    n = next(r[0] for r in rows if r[1] not in of)
    top, e, at = of[n][1], of[n][2], []
    while n in below:
        e, a = compressed(e, of[n][3], of[below[n]][2])
        at.append((n, a))
        n = below[n]
    said, lower = [], (0.0, 1.0, 0.0, 0.0)
    for k, (ap, ac, aw, a1) in reversed(at):
        lower = ap + ac * lower[0], ac * lower[1], aw + ac * lower[2], a1 + ac * lower[3]
        said.append((k, *lower))
    return top, n, e, said


def rounds(inner: DataFrame, per: int) -> tuple[list[DataFrame], DataFrame]:
    """Steps, two for each round: tables (node, parent, kind 0 for subtrees and 1 for chains, c1, c2: the cluster, stays) of the nodes that each works on; and the tree (node, parent) that is left."""
    now, out = fresh(inner.select("node", "parent")), []
    while now.count() > per:
        z = fresh(T.nested_set(now))
        up = z.select(F.col("node").alias("parent"), F.col("size").alias("_up"))
        light = z.filter(F.col("size") < per)
        tops = light.join(up, "parent").filter(F.col("_up") >= per).select("node", "pre", "last")
        subtrees = T.nearest_chosen(light, tops).select("node", "parent", F.lit(0).alias("kind"), F.col("clade").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(False).alias("stays"))
        heavy = fresh(T.nested_set(z.filter(F.col("size") >= per).select("node", "parent")))
        kids = heavy.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_k"))
        heavy = heavy.join(kids, "node", "left").withColumn("unary", F.col("parent").isNotNull() & (F.coalesce("_k", F.lit(0)) == 1))
        heavy = fresh(heavy.select("node", "parent", "pre", "unary"))
        # nodes of a chain follow each other in pre-order, after one that is of none
        met = last_before(heavy.filter("unary"), heavy.filter("not unary").select("pre"), "pre").withColumn("_at", F.col("pre") - F.col("_mark.pre") - 1)
        after = heavy.filter("not unary").select((F.col("pre") - 1).alias("pre"), F.lit(True).alias("_ends"))
        chains = met.join(after, "pre", "left").select(
            "node", "parent", F.lit(1).alias("kind"), F.col("_mark.pre").cast("long").alias("c1"), F.expr(f"_at div {per}").alias("c2"), (F.coalesce("_ends", F.lit(False)) | (F.col("_at") % per == per - 1)).alias("stays"), "_at")
        chains = fresh(chains)
        first = chains.filter(F.col("_at") % per == 0).select("c1", "c2", F.col("parent").alias("_top"))
        left = chains.filter("stays").join(first, ["c1", "c2"]).select("node", F.col("_top").alias("parent"))
        # messages reach the nodes of a chain before these are eliminated
        out += [fresh(subtrees), chains.drop("_at")]
        now = fresh(heavy.filter("not unary").select("node", "parent").unionByName(left))
    return out, now


def contracted(forms: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forms (node, parent, EDGE, NODE) that a step leaves, and node, p, c, ap, ac, aw, a1 of the nodes that it eliminates."""
    cols = ["node", "parent", *EDGE, *NODE]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["kind"].iat[0])
        parents = [None if pd.isna(p) else int(p) for p in pdf["parent"]]
        rows = [(int(n), p, e, m) for n, p, e, m in zip(pdf["node"], parents, pdf[EDGE].itertuples(index=False, name=None), pdf[NODE].itertuples(index=False, name=None), strict=True)]
        none, out = (0.0,) * len(EDGE), []
        if kind == 0:
            top, m, said = rake(rows)
            out = [(0, n, top, None, a, 0.0, w, one, *none) for n, a, w, one in said]
            out.append((1, top, None, None, 0.0, 0.0, 0.0, 0.0, *m, *none[len(m):]))
        else:
            top, last, e, said = compress(rows)
            out = [(0, n, top, last, *a, *none) for n, *a in said]
            out.append((2, last, top, None, 0.0, 0.0, 0.0, 0.0, *e))
        made = pd.DataFrame(out, columns=[x.split()[0] for x in _PARTS.split(", ")])
        return made.astype({"p": "Int64", "c": "Int64"})

    own = plan.select(F.col("node").alias("_n"), "kind", "c1", "c2", "stays")
    work = forms.join(own, F.col("node") == F.col("_n")).select("kind", "c1", "c2", *cols)
    done = fresh(work.groupBy("kind", "c1", "c2").applyInPandas(run, _PARTS))
    rest = forms.join(own.filter("not stays"), F.col("node") == F.col("_n"), "left_anti").select(cols)
    sums = done.filter("out = 1").groupBy(F.col("node").alias("_n")).agg(*[F.sum(e).alias(f"_{m}") for e, m in zip(EDGE, NODE, strict=False)])
    edges = done.filter("out = 2").select(F.col("node").alias("_e"), F.col("p").alias("_p"), *[F.col(k).alias(f"_{k}") for k in EDGE])
    met = rest.join(sums, F.col("node") == F.col("_n"), "left").join(edges, F.col("node") == F.col("_e"), "left")
    new = F.col("_e").isNotNull()
    left = met.select(
        "node", F.when(new, F.col("_p")).otherwise(F.col("parent")).alias("parent"), *[F.when(new, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in EDGE],
        *[(F.col(m) + F.coalesce(f"_{m}", F.lit(0.0))).alias(m) for m in NODE])
    return fresh(left), done.filter("out = 0").select("node", "p", "c", "ap", "ac", "aw", "a1")


def solved(forms: DataFrame, plans: list[DataFrame]) -> DataFrame:
    """node, x and w of all ``forms``: the place of each node and the rate at which the sum of all forms is least, the root being at 0."""
    told = []
    for plan in plans:
        forms, at = contracted(forms, plan)
        told.append(at)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        edges, sums = pdf[EDGE].itertuples(index=False, name=None), pdf[NODE].itertuples(index=False, name=None)
        rows = [(int(n), None if pd.isna(p) else int(p), e, m) for n, p, e, m in zip(pdf["node"], pdf["parent"], edges, sums, strict=True)]
        root = next(r for r in rows if r[1] is None)
        m, said = root[3], []
        if len(rows) > 1:
            _, up, said = rake([r for r in rows if r[1] is not None])
            m = tuple(x + y for x, y in zip(m, up, strict=True))
        rate = -m[4] / m[3]  # the root stands at 0
        return pd.DataFrame([(root[0], 0.0, rate)] + [(n, w * rate + one, rate) for n, _, w, one in said], columns=["node", "x", "w"])

    x = fresh(forms.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, "node long, x double, w double"))  # the nodes that are left, ``per`` at most
    for at in reversed(told):
        upper, lower = (x.select(F.col("node").alias(c), F.col("x").alias(f"_{c}"), F.col("w").alias(f"_w{c}")) for c in ("p", "c"))
        met = at.join(upper, "p").join(lower.drop("_wc"), "c", "left")
        new = met.select("node", (F.col("ap") * F.col("_p") + F.col("ac") * F.coalesce("_c", F.lit(0.0)) + F.col("aw") * F.col("_wp") + F.col("a1")).alias("x"), F.col("_wp").alias("w"))
        x = fresh(x.unionByName(new))
    return x


def _square(k: Column, p: float, v: float, w: Column, one: Column) -> dict[str, Column]:
    """The form k * (p * P + v * V + w * W + one) ** 2."""
    z = {"p": F.lit(p), "v": F.lit(v), "w": w, "1": one}
    return {name: k * z[a] * z[b] for name, (a, b) in zip(EDGE, ("pp", "pv", "pw", "p1", "vv", "vw", "v1", "ww", "w1", "11"), strict=True)}


def dated(nodes: DataFrame, root_day: float, tip_day: float, shortest: float = 0.0, earliest: DataFrame | None = None, sites: int = 66, smoothing: float | None = None, per: int = PER, clusters: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """node, day and rate (the same everywhere; substitutions per site and day) of each of ``nodes`` (node, parent, blen; a null blen counts as 0), one tree of two levels or more.

    The root is at ``root_day`` and all leaves are at ``tip_day``; no branch is shorter than ``shortest`` days, no node of ``earliest`` (node, min_day; inner nodes other than the root, others
    and null days are not bounded) stands before its day. ``smoothing`` is what is added to a branch's length in its variance (10 / sites if not given). Constraints that cannot all hold
    raise an error. Equal input gives equal dates to within ``TOLERANCE``; no nodes give no rows. ``clusters`` may be given where a tree is dated again.
    """
    ship(nodes.sparkSession)
    span, soft = tip_day - root_day, 10.0 / sites if smoothing is None else smoothing
    if nodes.isEmpty():
        return nodes.select("node", F.lit(None).cast("double").alias("day"), F.lit(None).cast("double").alias("rate"))
    inner = nodes.filter("parent is not null").select(F.col("parent").alias("_i")).distinct()
    b = F.coalesce("blen", F.lit(0.0)).cast("double")
    s = nodes.join(inner, F.col("node") == F.col("_i"), "left").select("node", "parent", b.alias("b"), (sites / (F.greatest(b, F.lit(0.0)) + soft)).alias("k"), F.col("_i").isNull().alias("tip"))
    bounds = nodes.select("node", F.lit(None).cast("double").alias("low")).limit(0) if earliest is None else earliest.select("node", (F.col("min_day") - root_day).alias("low"))
    bounds = bounds.groupBy(F.col("node").alias("_b")).agg(F.max("low").alias("low"))
    s = s.join(bounds, F.col("node") == F.col("_b"), "left").withColumn("low", F.when(~F.col("tip") & F.col("parent").isNotNull() & (F.col("low") > 0), F.col("low"))).drop("_b")
    state, kind = fresh(s), nodes.schema["node"].dataType
    if clusters is None:
        clusters = clustered(nodes, per)
    x, rate = _apart(state, clusters, span, shortest, per) if clusters else _whole(state, span, shortest)
    return x.select(F.col("node").cast(kind).alias("node"), (F.lit(root_day) + F.col("x") / rate).alias("day"), F.lit(rate).alias("rate"))


def _rows(state: DataFrame) -> DataFrame:
    """``state`` without null parents, for frames of numbers."""
    return state.withColumn("root", F.col("parent").isNull()).withColumn("parent", F.coalesce("parent", F.lit(0)))


def _whole(state: DataFrame, span: float, shortest: float) -> tuple[DataFrame, float]:
    """node and x, and the rate, of a tree that one task solves."""

    def run(frames):
        tree = S.of_rows(pd.concat(list(frames)))
        try:
            rate, why = S.settled(tree, span, shortest), None
        except ValueError as e:
            rate, why, tree.x = None, str(e), tree.node * 0.0
        yield pd.DataFrame({"node": tree.node, "x": tree.x, "w": rate, "why": why})

    found = fresh(_rows(state).repartition(1).mapInPandas(run, "node long, x double, w double, why string"))
    first = found.first()
    if first.why:
        raise ValueError(first.why)
    return found.select("node", "x"), first.w


def clustered(nodes: DataFrame, per: int) -> tuple[DataFrame, ...]:
    """Nothing, or of a tree that is too large for one task: node and part of all subtrees under ``per`` nodes that hang on larger ones, and node of these larger ones. A part is all the subtrees that begin in a range of the pre-order."""
    if nodes.count() <= WHOLE * per:
        return ()
    z = fresh(T.nested_set(nodes.select("node", "parent")).select("node", "parent", "size", "pre"))
    light = z.filter(F.col("size") < per)
    up = z.filter(F.col("size") >= per).select(F.col("node").alias("parent"))
    tops = light.join(up, "parent", "left_semi").select("pre")
    parts = last_before(light.select("node", "pre"), tops, "pre").select("node", F.expr(f"CAST(_mark.pre div {WHOLE // 4 * per} AS INT)").alias("part"))
    return fresh(parts), fresh(z.filter(F.col("size") >= per).select("node"))


#: A part's forest, and of its last places: changes of the active set, the worst, what each part of the step falls, and messages to ``hosts``: five numbers for the new active set and five for larger multipliers.
_PASSED = "part int, forest binary, changed long, worst double, falls array<double>, hosts array<long>, said array<array<double>>"


def _apart(state: DataFrame, clusters: tuple[DataFrame, DataFrame], span: float, shortest: float, per: int) -> tuple[DataFrame, float]:
    """``_whole`` of a tree by its parts: a pass over these places their nodes and sends the next messages to the larger nodes, which are few (``_Few``) unless the tree is deep."""
    parts, above = clusters
    spark, cols = state.sparkSession, ["part", "node", "parent", "root", "b", "k", "tip", "low"]
    head = (_Few if above.count() <= per else _Many)(fresh(state.join(above, "node", "left_semi")), span, shortest, per)
    many = parts.agg(F.max("part")).first()[0] + 1

    def told(forest: S.Forest, sent: list[np.ndarray], changed: int = 0, worst: float = 0.0, falls: np.ndarray = S.PARTWAY) -> tuple:
        return S.packed(forest), changed, worst, falls, forest.hosts, np.concatenate(sent).T.tolist()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        forest = S.of_rows(pdf)
        return pd.DataFrame([(pdf["part"].iat[0], *told(forest, [forest.raked(span, shortest)] * 2))], columns=_names(_PASSED))

    def passed(rate: float, at: tuple[np.ndarray, np.ndarray] | None, last: bool):
        def run(frames):
            for pdf in frames:
                for row in pdf.itertuples(index=False):
                    forest = S.unpacked(row.forest)
                    node, x = at or (row.at_node, row.at_x)
                    order = np.argsort(node)
                    place = np.asarray(x)[order][np.searchsorted(np.asarray(node)[order], forest.hosts)]
                    forest.chosen(raised)
                    forest.raked(span, shortest)
                    changed, worst = forest.placed(span, shortest, rate, place)
                    if last:
                        yield pd.DataFrame({"node": forest.node, "x": forest.x})
                    else:
                        falls = forest.falls(shortest)
                        yield pd.DataFrame([(row.part, *told(forest, forest.tried(span, shortest, bool(changed)), changed, worst, falls))], columns=_names(_PASSED))

        return run

    def stopped(share: float):
        def run(frames):
            for pdf in frames:
                for row in pdf.itertuples(index=False):
                    forest = S.unpacked(row.forest)
                    forest.back(share, span, shortest)
                    forest.step(True)
                    yield pd.DataFrame([(row.part, *told(forest, [forest.raked(span, shortest)] * 2))], columns=_names(_PASSED))

        return run

    rows = _rows(state).join(parts, "node").select(cols).repartition(many, "part")
    made, raised = fresh(rows.groupBy("part").applyInPandas(build, _PASSED)), False
    head.hear(made)
    for _ in range(STEPS):
        rate = head.solve(raised)
        here = head.look(rate)
        blocks, at = head.hand(made)
        new = fresh(blocks.mapInPandas(passed(rate, at, False), _PASSED))
        there, falls = head.hear(new)
        changed, worst = here[0] + there[0], max(here[1], there[1])
        if S.verdict(changed, worst, rate, span):
            x = blocks.mapInPandas(passed(rate, at, True), "node long, x double")
            return fresh(x.unionByName(head.places())), rate
        share = S.share_of(falls + head.falls()) if changed else 1.0
        if share < 1:
            head.back(share)
            way, new = new, fresh(new.mapInPandas(stopped(share), _PASSED))
            head.hear(new)
            forget(way)
        head.step(bool(changed))
        for done in [made] if blocks is made else [made, blocks]:
            forget(done)
        made, raised = new, not changed
    raise ValueError("the constraints cannot all hold, or did not settle")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _sent(made: DataFrame) -> DataFrame:
    """host and what all parts send to it, for the new active set (s0 to s4) and for larger multipliers (r0 to r4)."""
    each = made.select(F.explode(F.arrays_zip("hosts", "said")).alias("m")).select(F.col("m.hosts").alias("host"), *[F.col("m.said")[k].alias(c) for k, c in enumerate(_SENT)])
    return each.groupBy("host").agg(*[F.sum(c).alias(c) for c in _SENT])


def _summed(made: DataFrame) -> tuple[tuple[int, float], np.ndarray]:
    """Changes of all parts and the worst, and what each part of the step falls."""
    r = made.agg(F.sum("changed"), F.max("worst"), *[F.sum(F.col("falls")[k]) for k in range(len(S.PARTWAY))]).first()
    return (r[0], r[1]), np.array(r[2:])


_SENT = [f"s{k}" for k in range(5)] + [f"r{k}" for k in range(5)]


class _Few:
    """The nodes above all parts, ``per`` at most, in the driver."""

    def __init__(self, state: DataFrame, span: float, shortest: float, per: int):
        rows = _rows(state).select("node", "parent", "root", "b", "k", "tip", "low").collect()
        self.tree, self.span, self.shortest = S.of_rows(pd.DataFrame(rows, columns=["node", "parent", "root", "b", "k", "tip", "low"])), span, shortest
        self.spark, self.kind = state.sparkSession, state.schema["node"].dataType

    def hear(self, made: DataFrame) -> tuple[tuple[int, float], np.ndarray]:
        at = {n: k for k, n in enumerate(self.tree.node.tolist())}
        self.sent = np.zeros((10, len(at)))
        for r in _sent(made).collect():
            self.sent[:, at[r.host]] = r[1:]
        return _summed(made)

    def solve(self, raised: bool) -> float:
        form = self.tree.raked(self.span, self.shortest, self.sent[5:] if raised else self.sent[:5])
        return float(-form[4] / form[3])  # the root stands at 0

    def look(self, rate: float) -> tuple[int, float]:
        return self.tree.placed(self.span, self.shortest, rate)

    def hand(self, made: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
        return made, (self.tree.node, self.tree.x)

    def falls(self) -> np.ndarray:
        return self.tree.falls(self.shortest)

    def back(self, share: float) -> None:
        self.tree.back(share, self.span, self.shortest)

    def step(self, changed: bool) -> None:
        self.tree.step(changed)

    def places(self) -> DataFrame:
        return self.spark.createDataFrame(list(zip(self.tree.node.tolist(), self.tree.x.tolist(), strict=True)), "node long, x double")


class _Many:
    """The nodes above all parts of a deep tree, solved by rounds."""

    def __init__(self, state: DataFrame, span: float, shortest: float, per: int):
        self.span, self.shortest = span, shortest
        self.state = fresh(state.drop("tip").select("*", *[F.lit(0.0).alias(c) for c in ("force", "hold")], *[F.lit(False).alias(c) for c in ("pressed", "held")], *[F.lit(None).cast("double").alias(c) for c in ("x0", "xu0")]))
        self.rate = None
        self.plans, _ = rounds(state.select("node", "parent"), per)

    def hear(self, made: DataFrame) -> tuple[tuple[int, float], np.ndarray]:
        self.sent = fresh(_sent(made))
        return _summed(made)

    def solve(self, raised: bool) -> float:
        add = lambda f, g: {k: f[k] + g[k] for k in EDGE}
        only = lambda on, f: {k: F.when(on, v).otherwise(F.lit(0.0)) for k, v in f.items()}
        stiff, k, none = STIFFNESS * F.col("k"), F.col("k"), F.lit(0.0)
        branch = only(F.col("parent").isNotNull(), add(_square(k, 1, -1, none, F.col("b")), only(F.col("pressed"), _square(stiff / 2, 1, -1, F.lit(self.shortest), F.col("force") / stiff))))
        node = only(F.col("held"), _square(stiff / 2, 0, -1, F.coalesce("low", none), F.col("hold") / stiff))
        own = self.state.select("node", "parent", *[branch[c].alias(c) for c in EDGE], *[node[c].alias(m) for c, m in zip(("vv", "vw", "v1", "ww", "w1", "k0"), NODE, strict=True)])
        heard = self.sent.select("host", *[F.col(c).alias(f"_{m}") for c, m in zip(_SENT[5:] if raised else _SENT[:5], NODE, strict=False)], F.lit(0.0).alias("_nc"))
        forms = own.join(heard, F.col("node") == F.col("host"), "left").select("node", "parent", *EDGE, *[(F.col(m) + F.coalesce(f"_{m}", none)).alias(m) for m in NODE])
        self.x = solved(fresh(forms), self.plans)
        return self.x.first().w

    def look(self, rate: float) -> tuple[int, float]:
        at = self.state.join(self.x.select(F.col("node").alias("_x"), "x"), F.col("node") == F.col("_x")).drop("_x")
        at = at.join(self.x.select(F.col("node").alias("_u"), F.col("x").alias("_xu")), F.col("parent") == F.col("_u"), "left").drop("_u")
        self.before, self.rate = self.rate, rate
        return self._looked(at)

    def _looked(self, at: DataFrame) -> tuple[int, float]:
        size, stiff = abs(self.rate) * self.span, STIFFNESS * F.col("k")
        at = at.withColumn("_e", F.coalesce(self.shortest * self.rate + F.col("_xu") - F.col("x"), F.lit(-size))).withColumn("_l", F.coalesce(F.col("low") * self.rate - F.col("x"), F.lit(-size)))
        self.at = fresh(at.withColumn("_pressed", F.col("force") + stiff * F.col("_e") > 0).withColumn("_held", F.col("hold") + stiff * F.col("_l") > 0))
        return tuple(self.at.agg(F.count_if((F.col("_pressed") != F.col("pressed")) | (F.col("_held") != F.col("held"))), F.max(F.greatest("_e", "_l"))).first())

    def falls(self) -> np.ndarray:
        if self.before is None:
            return -S.PARTWAY
        w, w1, shortest = self.before, self.rate, self.shortest

        def run(frames):
            for pdf in frames:
                c = {k: pdf[k].to_numpy(dtype=bool if k == "root" else float) for k in pdf}
                before, after = ((np.nan_to_num(c[a]), np.nan_to_num(c[b]), rate) for a, b, rate in (("x0", "xu0", w), ("x", "_xu", w1)))
                yield pd.DataFrame({"falls": [S.fall(c["k"], c["b"], c["root"], c["low"], c["force"], c["hold"], before, after, shortest)]})

        cols = self.at.select("k", "b", F.col("parent").isNull().alias("root"), "low", "force", "hold", "x0", "xu0", "x", "_xu")
        return np.array(cols.mapInPandas(run, "falls array<double>").agg(*[F.sum(F.col("falls")[k]) for k in range(len(S.PARTWAY))]).first())

    def back(self, share: float) -> None:
        self.rate = self.before + share * (self.rate - self.before)
        at = self.at.withColumn("x", F.col("x0") + share * (F.col("x") - F.col("x0"))).withColumn("_xu", F.col("xu0") + share * (F.col("_xu") - F.col("xu0")))
        self._looked(at.drop("_e", "_l", "_pressed", "_held"))

    def hand(self, made: DataFrame) -> tuple[DataFrame, None]:
        links = made.select("part", F.explode("hosts").alias("host")).join(self.x.select("node", "x"), F.col("host") == F.col("node"))
        given = links.groupBy("part").agg(F.collect_list(F.struct("node", "x")).alias("_g")).select("part", F.col("_g.node").alias("at_node"), F.col("_g.x").alias("at_x"))
        return fresh(made.join(given, "part")), None

    def step(self, changed: bool) -> None:
        stiff = STIFFNESS * F.col("k")
        own = {m: F.col(m) if changed else F.greatest(F.lit(0.0), F.col(m) + stiff * F.col(c)) for m, c in (("force", "_e"), ("hold", "_l"))}
        on = {"pressed": own["force"] + stiff * F.col("_e") > 0, "held": own["hold"] + stiff * F.col("_l") > 0}
        self.state = fresh(self.at.select("node", "parent", "b", "k", "low", *[c.alias(m) for m, c in (own | on).items()], F.col("x").alias("x0"), F.col("_xu").alias("xu0")))

    def places(self) -> DataFrame:
        return self.x.select("node", "x")


def dated_under(nodes: DataFrame, landmarks: DataFrame, root_day: float, tip_day: float, shortest: float, passes: int = 3, per: int = PER, **options) -> DataFrame:
    """``dated`` under a ceiling of lineages: ``landmarks`` (day, cells) say from when on there can be so many, so that inner nodes, ranked by the days found last, have a least day
    (``timed.age_constraints``). Days are found without them first and then ``passes`` times, each ranking by the days before. Least days after the last that minimum branches allow count as that."""
    clusters = clustered(nodes, per)
    days = fresh(dated(nodes, root_day, tip_day, shortest, per=per, clusters=clusters, **options))
    depths = fresh(nodes.select("node", "parent").join(levels_below(nodes), "node"))
    for _ in range(passes):
        timed_ = nodes.select("node", "parent").join(days.select("node", (F.col("day") - root_day).alias("time")), "node")
        least = M.age_constraints(timed_, landmarks, root_day).join(depths.select("node", "below"), "node")
        least = fresh(least.select("node", F.least("min_day", F.lit(float(tip_day)) - shortest * F.col("below")).alias("min_day")))
        days = fresh(dated(nodes, root_day, tip_day, shortest, least, per=per, clusters=clusters, **options))
    return days


def levels_below(nodes: DataFrame, few: int = FEW) -> DataFrame:
    """node and below: the branches on the longest way from each node down to a leaf.

    While leaves are a quarter of more than ``FEW`` nodes they are taken off: the round in which a node goes is what is below it. One task does the ``FEW`` that are left, or else pointer doubling.
    """
    ship(nodes.sparkSession)
    left, out, k, kind = fresh(nodes.select("node", "parent")), None, 0, nodes.schema["node"].dataType
    n = left.count()
    while n > few:
        inner = left.select(F.col("parent").alias("_p")).distinct()
        told = fresh(left.join(inner, F.col("node") == F.col("_p"), "left").select("node", "parent", F.col("_p").isNull().alias("_leaf")))
        rest = told.filter("not _leaf").select("node", "parent")
        many, n = n, rest.count()
        if 4 * n > 3 * many:
            break
        off = told.filter("_leaf").select("node", F.lit(k).cast("long").alias("below"))
        out, left, k = off if out is None else out.unionByName(off), rest, k + 1
    if n <= few:

        def run(frames):
            pdf = pd.concat(list(frames))
            forest = S.of_rows(pdf.assign(b=0.0, k=0.0, tip=False, low=0.0))
            yield pd.DataFrame({"node": forest.node, "below": S.heights(forest)})

        own = _rows(left).repartition(1).mapInPandas(run, "node long, below long").select(F.col("node").cast(kind).alias("node"), "below")
    else:
        own = _levels_by_doubling(left)
    own = own.select("node", (F.col("below") + k).alias("below"))
    return own if out is None else out.unionByName(own)


def _levels_by_doubling(nodes: DataFrame) -> DataFrame:
    """A node's deepest leaf is as deep as the deepest of all that hang on it."""
    ranked = T.nested_set(nodes.select("node", "parent"))
    # greatest depth over a run of places: windows of two powers of two cover it
    level = fresh(ranked.select("node", "pre", "last", "depth"))
    table, out, step, most = level.select("pre", F.col("depth").alias("deep")), None, 1, level.count()
    spans = level.withColumn("n", F.col("last") - F.col("pre") + 1)
    while True:
        own = spans.filter(F.col("n").between(step, 2 * step - 1))
        a = table.select(F.col("pre").alias("_a"), F.col("deep").alias("_da"))
        b = table.select(F.col("pre").alias("_b"), F.col("deep").alias("_db"))
        met = own.join(a, F.col("pre") == F.col("_a")).join(b, F.col("last") - step + 1 == F.col("_b")).select("node", (F.greatest("_da", "_db") - F.col("depth")).alias("below"))
        out = met if out is None else out.unionByName(met)
        if 2 * step > most:
            return out
        far = table.select((F.col("pre") - step).alias("_f"), F.col("deep").alias("_df"))
        table = fresh(table.join(far, F.col("pre") == F.col("_f")).select("pre", F.greatest("deep", "_df").alias("deep")))
        step *= 2
