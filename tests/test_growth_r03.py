"""steps on trees whose rounds do not all go over all rows, with the same results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cladewright.operators import grafting as G
from cladewright.operators import trees as T


def test_cells_in_cycles_cost_no_rounds(spark, monkeypatch):
    """one cell in a cycle kept all rounds going, each over all cells."""
    tips = spark.createDataFrame([(1, 2.0), (2, None)], "node long, budget double")
    cells = [(10 + i, 1 if i < 500 else 10 + i - 500, i % 7 / 2.0) for i in range(1500)] + [(5000, 5000, 1.0), (5001, 5002, 1.0), (5002, 5001, 1.0), (5003, 5002, 1.0), (5004, 2, 9.0), (5005, 5004, 9.5), (5006, -7, 1.0)]
    rounds, fresh = [], G.fresh
    monkeypatch.setattr(G, "fresh", lambda df: (rounds.append(1), fresh(df))[1])
    got = {r.cell: (r.host, r.cap, r.clamped) for r in G.capped(tips, spark.createDataFrame(cells, "cell long, host long, days double")).collect()}
    cap, want = {}, {}
    for cell, host, days in cells[:1500]:
        over = 2.0 if host == 1 else cap[host]
        cap[cell] = min(days, over)
        want[cell] = (host, cap[cell], days > over)
    assert got == want | {5004: (2, 9.0, None), 5005: (5004, 9.0, True)}
    assert len(rounds) <= 8


@pytest.mark.parametrize("core", [0, 1, 20, 10_000])
def test_places_by_taking_leaves_off_and_by_doubling(spark, core):
    """forests of bushes, chains and roots alone, whatever is left for pointer doubling."""
    rng = random.Random(core)
    ids = rng.sample(range(-900, 900), 300)
    parent = {x: None if i % 90 == 0 else ids[i - 1] if i < 100 else rng.choice(ids[:i] if i < 250 else ids[:3]) for i, x in enumerate(ids)} | {5000: None, -5000: None}
    kids = {}
    for x in sorted(parent):
        kids.setdefault(parent[x], []).append(x)
    want, todo, pre = {}, [(x, 0) for x in reversed(kids[None])], 0
    for x, depth in iter(lambda: todo.pop() if todo else None, None):
        want[x] = [depth, 1, pre]
        pre += 1
        todo += [(k, depth + 1) for k in reversed(kids.get(x, []))]
    for x in sorted(want, key=lambda x: -want[x][0]):
        if parent[x] is not None:
            want[parent[x]][1] += want[x][1]
    nodes = spark.createDataFrame(list(parent.items()), "node long, parent long")
    got = {r.node: [r.depth, r["size"], r.pre] for r in T.nested_set(nodes, core).collect()}
    assert got == want


def test_rounds_over_all_nodes_do_not_grow_with_a_bushy_tree(spark, monkeypatch):
    """doubling along the tour took all nodes through as many rounds as the tree's size has digits."""
    rows, fresh = [], T.fresh
    monkeypatch.setattr(T, "fresh", lambda df: (lambda x: (rows.append(x.count()), x)[1])(fresh(df)))
    nodes = spark.range(1, 2048).select(F.col("id").alias("node"), F.when(F.col("id") > 1, F.expr("id div 2")).alias("parent"))
    T.nested_set(nodes, 64).count()
    assert sum(rows) <= 8 * 2047


def test_common_ancestors_over_blocks_of_blocks(spark, monkeypatch):
    """a table of all places for each power of two of them before."""
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "FEW_BLOCKS", 8)
    rows, fresh = [], T.fresh
    rng = random.Random(2)
    parent = {x: None if x in (0, 200) else rng.randrange(max(0 if x < 200 else 200, x - 9), x) for x in range(400)}
    up = lambda x: [x, *up(parent[x])] if parent[x] is not None else [x]
    ranked = T.fresh(T.nested_set(spark.createDataFrame(list(parent.items()), "node long, parent long")))
    pairs = [(rng.randrange(400), rng.randrange(400), i) for i in range(300)] + [(7, 7, 300), (7, 999, 301), (None, 7, 302)]
    monkeypatch.setattr(T, "fresh", lambda df: (rows.append(df), fresh(df))[1])
    got = {r.i: r.lca for r in T.lca(ranked, spark.createDataFrame(pairs, "a long, b long, i long")).collect()}
    assert got == {i: None if a is None or b > 399 else next((x for x in up(a) if x in set(up(b))), None) for a, b, i in pairs}
    assert len(rows) == 1 + 3 * 5
