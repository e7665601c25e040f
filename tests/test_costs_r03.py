"""nearest neighbours of blocks one by one, and runs of categories by ranges."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from cladewright.operators import neighbours as N
from cladewright.operators import summaries as S


def test_blocks_one_by_one_give_the_nearest_of_all():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (700, 3)).astype(float)  # many equal distances
    ids = rng.permutation(5000)[:700]
    for k, per in ((1, 90), (7, 40), (7, 3), (900, 64)):
        best = N.Nearest(ids[:300], x[:300], k)
        for low in range(0, 700, per):
            best.add(ids[low:low + per], x[low:low + per])
        got = sorted(best.rows().itertuples(index=False, name=None))
        want = sorted(zip(*N.nearest(ids[:300], x[:300], ids, x, k), strict=True))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=0, atol=1e-12)


def test_runs_cross_ranges(spark):
    random.seed(3)
    rows = [(b, i, random.choice(["x", "x", "x", "x", None] if b == "p" else ["x", "y"])) for b in ("p", "q", None) for i in range(400)] + [("long", i, "x") for i in range(3000)]
    want = set()
    for b in ("p", "q", None, "long"):
        run = None
        for i, c in [(i, c) for x, i, c in rows if x == b]:
            if run and c is not None and run[1] == c:
                run = [b, c, run[2], i, run[4] + 1]
            else:
                want.add(tuple(run)) if run else None
                run = [b, c, i, i, 1]
        want.add(tuple(run))
    got = S.runs(spark.createDataFrame(rows, "by string, o long, c string").repartition(7), "o", "c", "by")
    assert {tuple(r) for r in got.select("by", "c", "first", "last", "n").collect()} == want


def test_no_task_takes_all_of_one_category(spark):
    """A day's rows met in one window before."""
    x = S.runs(spark.range(1000).select(F.lit("d").alias("by"), F.col("id").alias("o"), F.lit("c").alias("c")), "o", "c", "by")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(by" in line and "_r#" not in line)
    assert [tuple(r) for r in x.select("first", "last", "n").collect()] == [(0, 999, 1000)]
