"""dates in few jobs, by parts as in one task, and settled where active sets alone go round."""

import random

import numpy as np
import pytest

from cladewright.operators import dating as D
from cladewright.operators import forests as S


def random_tree(spark, n, near):
    rng = random.Random(5)
    parent = {0: None} | {i: rng.choice(range(max(0, i - near), i)) for i in range(1, n)}
    rows = [(i, p, 0.0 if p is None else max(0.0, rng.gauss(0.3, 0.3))) for i, p in parent.items()]
    inner = sorted({p for p in parent.values() if p})
    return spark.createDataFrame(rows, "node long, parent long, blen double"), spark.createDataFrame([(v, 4.0) for v in inner[:20]], "node long, min_day double")


def test_a_tree_that_fits_a_task_takes_few_jobs(spark):
    nodes, least = random_tree(spark, 300, 30)
    sc = spark.sparkContext
    sc.setJobGroup("dated", "dated")
    try:
        D.dated(nodes, 1.5, 13.5, 0.05, least).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("dated")) < 40  # a pass took a dozen, and there are 5 passes or more


def test_parts_give_the_dates_of_one_task(spark):
    nodes, least = random_tree(spark, 600, 60)
    whole, parts = ({r.node: r.day for r in D.dated(nodes, 1.5, 13.5, 0.05, least, per=per).collect()} for per in (600, 30))
    assert D.clustered(nodes, 30) and parts == pytest.approx(whole, abs=1e-6)


def test_active_sets_that_go_round_settle():
    """The tree of the query ``nodes`` at six times sf0.1, under its ceiling: with whole steps only, sets of 8, 4, 5 and 3 changes follow each other for ever."""
    n = 90_000
    i = np.arange(1, n)
    b = (i * 7 % 13 - 3) / 8.0
    own = i, i // 2, i == 1, b, 66 / (np.maximum(b, 0) + 10 / 66), 2 * i > n
    free = S.Forest(*own, np.full(n - 1, np.nan))
    rate = S.settled(free, 12.0, 2 / 24)
    inner = ~free.tip
    order = free.node[inner][np.lexsort((free.node[inner], free.x[inner] / rate))]
    lineages = 1 + np.cumsum(np.bincount(i[1:] // 2, minlength=n)[order] - 1)
    c, d, low = np.log([8, 60, 200]), [4, 6, 8], np.full(n, np.nan)
    some = (order > 1) & (lineages <= 200)
    low[order[some]] = np.where(lineages[some] <= 8, 2 * np.log(lineages[some]) / c[0], np.interp(np.log(lineages[some]), c, d)) - 1.5
    below = np.floor(np.log2((n - 1) / i))
    low = np.where(low[1:] > 0, np.minimum(low[1:], 12 - below * 2 / 24), np.nan)
    tree = S.Forest(*own, low)
    rate = S.settled(tree, 12.0, 2 / 24)
    assert rate > 0 and max(tree.e.max(), tree.l.max()) <= S.TOLERANCE * rate * 12


def test_levels_by_leaves_taken_off_are_those_of_doubling(spark):
    nodes, _ = random_tree(spark, 1000, 1000)
    got = [{r.node: r.below for r in df.collect()} for df in (D.levels_below(nodes), D.levels_below(nodes, 100), D.levels_below(nodes, 0), D._levels_by_doubling(nodes))]
    assert got[0] == got[1] == got[2] == got[3]
