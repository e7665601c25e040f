"""Tree operators on random and very deep trees, against walks over a parent map."""

import random

import pytest
from pyspark.sql import functions as F

from cladewright.operators import scale
from cladewright.operators import trees as T


def table(spark, parent, **more):
    rows = [(n, p, *(v[n] for v in more.values())) for n, p in parent.items()]
    kinds = {int: "long", float: "double", bool: "boolean", str: "string"}
    extra = "".join(f", {k} {kinds[type(next(iter(v.values())))]}" for k, v in more.items())
    return spark.createDataFrame(rows, f"node long, parent long{extra}")


def random_tree(seed, n=60):
    rng = random.Random(seed)
    ids = rng.sample(range(-500, 500), n)
    return {x: (rng.choice(ids[:i]) if i else None) for i, x in enumerate(ids)}


def caterpillar(n):
    """Node i has children i + 1 and n + i."""
    out = {0: None}
    for i in range(n):
        out |= {i + 1: i, 100_000 + i: i}
    return out


def above(parent, x):
    out = [x]
    while parent[x] is not None:
        x = parent[x]
        out.append(x)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_nested_set_of_random_trees(spark, seed):
    parent = random_tree(seed)
    kids = {}
    for x, p in parent.items():
        kids.setdefault(p, []).append(x)
    want, count = {}, 0

    def visit(x, depth):
        nonlocal count
        pre = count
        count += 1
        for k in sorted(kids.get(x, [])):
            visit(k, depth + 1)
        want[x] = (depth, count - pre, pre, count - 1)

    visit(kids[None][0], 0)
    got = {r.node: (r.depth, r["size"], r.pre, r["last"]) for r in T.nested_set(table(spark, parent)).collect()}
    assert got == want


def test_deep_caterpillar(spark):
    n = 5000
    parent = caterpillar(n)
    leaf = {x: x >= 100_000 or x == n for x in parent}
    nodes = scale.cut(T.nested_set(table(spark, parent, is_leaf=leaf, time={x: float(x if x < 100_000 else x - 100_000 + 1) for x in parent})))
    by = {r.node: r for r in T.tips_below(nodes).collect()}
    assert all(by[i].depth == i and by[i].tips == n - i + 1 and by[i]["last"] - by[i].pre == 2 * (n - i) for i in range(n + 1))
    pairs = spark.createDataFrame([(100_000 + i, 100_000 + (i * 7919) % n) for i in range(0, n, 50)] + [(3, 100_003), (5, 5)], "a long, b long")
    got = {(r.a, r.b): (r.mrca, r.distance) for r in T.patristic(nodes, pairs).collect()}
    for (a, b), (m, d) in got.items():
        x, y = (v - 100_000 if v >= 100_000 else v for v in (a, b))
        assert m == (a if a == b else min(x, y)) and d == (0 if a == b else abs(x - y) + (a >= 100_000) + (b >= 100_000))
    pruned = {r.node: (r.parent, r.blen) for r in T.prune(nodes, spark.createDataFrame([(100_000 + i,) for i in (10, 2000, 4999)], "node long")).collect()}
    assert pruned == {10: (None, 10.0), 100_010: (10, 1.0), 2000: (10, 1990.0), 102_000: (2000, 1.0), 104_999: (2000, 3000.0)}


@pytest.mark.parametrize("seed", range(3))
def test_ancestral_prefixes(spark, seed):
    rng = random.Random(seed)
    parent = random_tree(seed, 50)
    inner = set(parent.values())
    tips = []
    for x in parent:
        for tape in ("T1", "T2"):
            if x not in inner and rng.random() < 0.8:
                d = rng.randint(0, 3)
                tips.append((x, tape, [rng.choice("AC") for _ in range(d)] + ["U"] * (3 - d)))
    nodes = T.nested_set(table(spark, parent))
    got = {(r.node, r.tape): r.prefix for r in T.ancestral(nodes, spark.createDataFrame(tips, "node long, tape string, sites array<string>"), 3).collect()}
    want = {}
    for x in parent:
        for tape in ("T1", "T2"):
            under = [s for t, k, s in tips if k == tape and x in above(parent, t)]
            if under:
                k = 0
                while k < 3 and len({s[k] for s in under}) == 1 and under[0][k] != "U":
                    k += 1
                want[x, tape] = under[0][:k]
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_nearest_marked_and_chosen(spark, seed):
    parent = random_tree(seed)
    rng = random.Random(seed)
    marked = {x: rng.random() < 0.2 for x in parent}
    got = {r.node: r.up for r in scale.nearest_marked(table(spark, parent, marked=marked)).collect()}
    assert got == {x: next((a for a in above(parent, x)[1:] if marked[a]), None) for x in parent}
    nodes = scale.cut(T.nested_set(table(spark, parent)))
    depth = {x: len(above(parent, x)) for x in parent}
    chosen = nodes.filter(F.col("node").isin([x for x in parent if depth[x] == 3]))
    got = {r.node: r.clade for r in T.nearest_chosen(nodes, chosen).collect()}
    assert got == {x: next((a for a in above(parent, x) if depth[a] == 3), None) for x in parent}


def test_last_before_over_many_runs(spark):
    rows = spark.range(0, 1000).select(F.col("id").alias("pre"), (F.col("id") % 3).alias("g"))
    marks = rows.filter("pre % 97 = 5").select("pre", "g", F.col("pre").alias("m"))
    got = {r.pre: r._mark and r._mark.m for r in scale.last_before(rows, marks, "pre", ["g"], run=16).collect()}
    assert got == {p: max((m for m in range(5, 1000, 97) if m <= p and m % 3 == p % 3), default=None) for p in range(1000)}


def test_lineages_through_time(spark):
    parent = random_tree(9)
    time = {x: float(len(above(parent, x)) - 1) for x in parent}
    grid = [0.0, 0.5, 1.0, 2.5, 3.0, 99.0]
    got = {r.t: r.lineages for r in T.lineages_through_time(table(spark, parent, time=time), spark.createDataFrame([(t,) for t in grid], "t double")).collect()}
    assert got == {t: sum(p is not None and time[p] < t <= time[x] for x, p in parent.items()) for t in grid}


@pytest.mark.parametrize("seed", range(2))
def test_lca_of_forests(spark, seed):
    one, two = random_tree(seed, 50), {x + 2000: None if p is None else p + 2000 for x, p in random_tree(seed + 9, 20).items()}
    parent = one | two
    rng = random.Random(seed)
    pairs = [(rng.choice(list(parent)), rng.choice(list(parent))) for _ in range(200)] + [(next(iter(one)), 99999)]
    got = T.lca(scale.cut(T.nested_set(table(spark, parent))), spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "a long, b long, nth int")).collect()
    want = {i: next((x for x in above(parent, a) if x in above(parent, b)), None) if b in parent else None for i, (a, b) in enumerate(pairs)}
    assert {r.nth: r.lca for r in got} == want and len(got) == len(pairs)


def test_node_map_of_a_tree_with_other_ids_and_of_another_tree(spark):
    parent = random_tree(4, 60)
    inner = {p for p in parent.values() if p is not None}
    leaves = [x for x in parent if x not in inner]
    renamed = {x + 5000: None if p is None else p + 5000 for x, p in parent.items()}
    tips = spark.createDataFrame([(x, x + 5000) for x in leaves], "a long, b long")
    got = {r.node: r for r in T.node_map(table(spark, parent), table(spark, renamed), tips).collect()}
    below = {x: {y for y in leaves if x in above(parent, y)} for x in parent}
    assert set(got) == set(parent)
    for x, r in got.items():
        assert r.tips == len(below[x]) and below[r.mapped - 5000] == below[x] and r.mapped_tips == r.tips
        assert below[r.back] == below[x] and r.same == (r.back == x)
    star = {7000: None} | {x + 5000: 7000 for x in leaves}
    got = {r.node: r for r in T.node_map(table(spark, parent), table(spark, star), tips).collect()}
    root = next(x for x, p in parent.items() if p is None)
    assert all(r.mapped == (next(iter(below[x])) + 5000 if len(below[x]) == 1 else 7000) for x, r in got.items()) and sum(r.same for x, r in got.items() if len(below[x]) > 1) == (len(below[root]) > 1)


def ways(edges):
    """Lengths between all nodes of an undirected tree."""
    out = {}
    for s in edges:
        seen, todo = {s: 0.0}, [s]
        while todo:
            x = todo.pop()
            for y, d in edges[x].items():
                if y not in seen:
                    seen[y] = seen[x] + d
                    todo.append(y)
        out[s] = seen
    return out


@pytest.mark.parametrize("seed", range(4))
def test_midpoint_root(spark, seed):
    parent = random_tree(seed, 40) if seed < 3 else {0: None, 1: 0, 2: 0, 3: 2}
    rng = random.Random(seed)
    length = {x: rng.choice([0.0, 0.5, 1.0, 2.5]) if seed < 3 else 1.0 if x < 2 else 0.5 for x in parent}
    edges = {x: {} for x in parent}
    for x, p in parent.items():
        if p is not None:
            edges[x][p] = edges[p][x] = length[x]
    inner = {p for p in parent.values() if p is not None}
    leaves = [x for x in parent if x not in inner]
    far = ways(edges)
    longest = max(far[a][b] for a in leaves for b in leaves)
    first, last, d, _ = T.diameter(table(spark, parent, blen=length))
    assert d == pytest.approx(longest) == pytest.approx(far[first][last])
    got = T.midpoint_rooted(table(spark, parent, blen=length), 9000).collect()
    now = {r.node: r.parent for r in got}
    assert len(got) == len(now) == len(parent) + 1 and [x for x, p in now.items() if p is None] == [9000] and all(r.blen >= 0 for r in got)
    new = {x: {} for x in now}
    for r in got:
        if r.parent is not None:
            new[r.node][r.parent] = new[r.parent][r.node] = r.blen
    after = ways(new)
    assert max(after[9000][x] for x in leaves) == pytest.approx(longest / 2) == pytest.approx(after[9000][first])
    assert all(after[a][b] == pytest.approx(far[a][b]) for a in leaves for b in leaves)
