"""Dates against the conditions of the least sum of squares; grafting against a walk cell by cell."""

import random

import numpy as np
import pytest

from cladewright import catalog
from cladewright.functions import kernels as K
from cladewright.operators import dating as D
from cladewright.operators import grafting as G
from cladewright.operators import trees as T

SITES = 66


def tree(seed, n):
    rng = random.Random(seed)
    parent = {0: None} | {i: rng.choice(range(max(0, i - 8), i) if seed % 2 else range(i)) for i in range(1, n)}
    return parent, {i: 0.0 if p is None else max(0.0, rng.gauss(0.3, 0.3)) for i, p in parent.items()}


def frame(spark, parent, length):
    return spark.createDataFrame([(i, p, length[i]) for i, p in parent.items()], "node long, parent long, blen double")


def optimal(parent, length, rows, shortest, least, root, tip):
    """Whether dates are those of the least sum of squares: all constraints hold, and the gradient is a sum of those of tight constraints with weights of 0 or more."""
    day, rate = {r.node: r.day for r in rows}, rows[0].rate
    inner, span = {p for p in parent.values() if p is not None}, tip - root
    free = [i for i in parent if i in inner and parent[i] is not None]
    at = {v: k for k, v in enumerate(free)}

    def row(i):
        v = np.zeros(len(free) + 1)
        if i in at:
            v[at[i]] = 1
        elif parent[i] is not None:
            v[-1] = span
        return v

    x = np.array([(day[v] - root) * rate for v in free] + [rate])
    edges = [(i, p) for i, p in parent.items() if p is not None]
    a, b = np.array([row(i) - row(p) for i, p in edges]), np.array([length[i] for i, _ in edges])
    w = SITES / (b + 10 / SITES)
    gradient = 2 * a.T @ (w * (a @ x - b))
    unit = np.eye(len(x))[-1]
    c = np.array([row(i) - row(p) - shortest * unit for i, p in edges] + [row(i) - (d - root) * unit for i, d in least.items()])
    slack = c @ x / (rate * span)
    tight = c[slack < 1e-6]
    lam, g, h = np.zeros(len(tight)), tight @ tight.T, tight @ gradient
    for _ in range(20000):
        for k in range(len(lam)):
            lam[k] = max(0.0, lam[k] - (g[k] @ lam - h[k]) / g[k, k])
        rest = np.abs(gradient - tight.T @ lam).max() / np.abs(2 * a.T @ (w * b)).max()
        if rest < 1e-6:
            break
    assert all(abs(day[i] - tip) < 1e-9 for i in parent if i not in inner) and abs(day[0] - root) < 1e-9
    assert slack.min() > -1e-7 and rest < 1e-6
    return len(tight)


def test_dates_are_optimal_whatever_the_clusters(spark):
    parent, length = tree(2, 200)
    inner = sorted(p for p in set(parent.values()) if p)
    least = {v: 4.5 for v in random.Random(2).sample(inner, len(inner) // 4) if v < 50}
    days = spark.createDataFrame([*least.items(), (0, 5.0), (999, 3.0), (inner[-1], None)], "node long, min_day double")
    rows = D.dated(frame(spark, parent, length), 1.5, 13.5, 0.05, days).collect()
    assert optimal(parent, length, rows, 0.05, least, 1.5, 13.5) > 10
    small = {r.node: r.day for r in D.dated(frame(spark, parent, length), 1.5, 13.5, 0.05, days, per=8).collect()}
    assert small == pytest.approx({r.node: r.day for r in rows}, abs=1e-6)


def test_dates_of_a_deep_tree(spark):
    n = 5000
    rng = random.Random(1)
    parent = {0: None} | {i: i - 1 for i in range(1, n)} | {n + i: i for i in range(n)}
    gap, rate = 12 / n, 0.05
    length = {i: 0.0 if not i else rate * gap * rng.uniform(0.9, 1.1) if i < n else rate * gap * (n - (i - n)) for i in parent}
    df = frame(spark, parent, length)
    plans, left = D.rounds(df.filter(f"node < {n}").select("node", "parent"), 256)
    assert len(plans) == 2 and left.count() <= 256  # a round is a step of each kind
    got = D.dated(df, 1.5, 13.5, 0.0, per=256).collect()
    day, found = {r.node: r.day for r in got}, got[0].rate
    x = {i: found * (d - 1.5) for i, d in day.items()}
    pull = dict.fromkeys(parent, 0.0)
    for i, p in parent.items():
        if p is not None:
            f = 2 * SITES / (length[i] + 10 / SITES) * (x[i] - x[p] - length[i])
            pull[i] += f
            pull[p] -= f
    assert found == pytest.approx(rate, rel=0.01) and all(day[i] >= day[p] - 1e-7 for i, p in parent.items() if p is not None)
    assert max(abs(pull[i]) for i in range(1, n)) < 1e-5


def test_odd_trees(spark):
    assert D.dated(frame(spark, {}, {}), 0.0, 1.0).count() == 0
    got = {r.node: r.day for r in D.dated(frame(spark, {0: None, 1: 0, 2: 0}, {0: 0.0, 1: 0.5, 2: None}), 1.0, 3.0).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 3.0}
    with pytest.raises(ValueError, match="constraints"):
        D.dated(frame(spark, {0: None, 1: 0, 2: 1}, {0: 0.0, 1: 0.5, 2: 0.5}), 0.0, 1.0, 0.7).collect()


def test_query_keeps_its_constraints(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.node: r for r in catalog.queries()["dated_nodes"](spark, sf).collect()}
    nodes = catalog.view(spark, sf, "nodes").collect()
    assert {r.node for r in nodes} == set(rows) and len({r.rate for r in rows.values()}) == 1
    assert all(rows[r.node].day >= rows[r.parent].day + 2 / 24 - 2e-5 for r in nodes if r.parent) and all(rows[r.node].day == 13.5 for r in nodes if r.is_leaf)


def plain_forest(nodes, attached, present):
    """Parents and times as a walk from each leaf gives them: (name of node) -> (name of parent, time); splits are named by host and cap."""
    time, parent, leaf = ({r[0]: r[k] for r in nodes} for k in (2, 1, 3))
    kids = {}
    for cell, host, days in attached:
        if days is not None:
            kids.setdefault(host, []).append((cell, days))
    out, clamped = {n: (p, time[n]) for n, p, *_ in nodes}, set()
    todo = [(n, present - time[parent[n]], parent[n]) for n in leaf if leaf[n]]
    while todo:
        host, budget, on = todo.pop()
        at, mine = on, []
        for cell, days in kids.get(host, []):
            if days > budget + 1e-9:
                clamped.add(cell)
            mine.append((round(min(days, budget), 9), cell))
        for cap in sorted({c for c, _ in mine}, reverse=True):
            out[host, cap] = at, present - cap
            at = host, cap
            todo += [(cell, cap, at) for c, cell in mine if c == cap]
        out[host] = at, present
    return out, clamped


@pytest.mark.parametrize("seed", range(3))
def test_forest_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    nodes = [(0, None, 0.0, False), (1, 0, 2.0, False), (2, 1, 3.0, True), (3, 1, 3.0, True), (4, 0, 3.0, True)]
    cells = [(10 + i, rng.choice([2, 3, 4, *range(10, 10 + i)]) if seed else max(2, 9 + i) if i else 2, rng.choice([0.0, 0.25, 0.5, 1.0, 5.0])) for i in range(60)]
    odd = [(900, 901, 1.0), (901, 900, 1.0), (902, 901, 1.0), (903, 555, 1.0), (904, 2, None), (905, 904, 1.0), (906, 906, 0.0)]
    df = spark.createDataFrame(nodes, "node long, parent long, time double, is_leaf boolean")
    attached = spark.createDataFrame(cells + odd, "cell long, host long, days double")
    want, clamped = plain_forest(nodes, cells, 3.0)
    got = G.forest(df, attached, 3.0).collect()
    caps = {r.cell: r for r in G.capped(spark.createDataFrame([(2, 1.0), (3, 1.0), (4, 3.0)], "node long, budget double"), attached).collect()}
    assert {c for c, r in caps.items() if r.clamped} == clamped and set(caps) == {c for c, *_ in cells}
    splits = sorted((k for k in want if isinstance(k, tuple)), key=lambda k: (k[0], -k[1]))
    name = {906 + i + 1: k for i, k in enumerate(splits)}
    assert {name.get(r.node, r.node): (name.get(r.parent, r.parent), round(r.time, 9)) for r in got} == {k: (p, round(t, 9)) for k, (p, t) in want.items()}
    # nothing is older than its parent, all cells stand at the present, and no inner branch has no length unless a cell was clamped
    time, inner = {r.node: r.time for r in got}, {r.parent for r in got}
    assert all(r.parent is None or r.time >= time[r.parent] - 1e-9 for r in got) and all(r.time == 3.0 for r in got if r.node not in inner)


def test_forest_of_a_cherry_and_of_identical_cells(spark):
    df = spark.createDataFrame([(0, None, 0.0, False), (1, 0, 2.0, False), (2, 1, 3.0, True), (3, 1, 3.0, True), (4, 0, 3.0, True)], "node long, parent long, time double, is_leaf boolean")
    some = lambda *rows: {r.node: r for r in G.forest(df, spark.createDataFrame(rows, "cell long, host long, days double"), 3.0).collect()}
    one = some((10, 2, 0.5))
    assert one[10].parent == one[2].parent == 11 and one[11].time == 2.5 and one[11].parent == 1
    same = some((10, 2, 0.5), (11, 2, 0.0), (12, 2, 0.0))
    assert same[2].parent == same[11].parent == same[12].parent != same[10].parent
    far = some((10, 2, 5.0))
    assert far[far[10].parent].time == 2.0
    nested = T.nested_set(G.forest(df, spark.createDataFrame([(10, 2, 0.5), (11, 10, 0.25)], "cell long, host long, days double"), 3.0)).collect()
    assert len(nested) == 9 and K.newick_text([{"pre": r.pre, "last": r["last"], "name": str(r.node), "blen_text": None} for r in nested])
