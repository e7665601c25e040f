"""The permutation test of captured pairings against a plain selection from the same permuted labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewright.functions import columns as C
from cladewright.operators import pairings as P
from cladewright.operators import state_graphs as G
from cladewright.operators import statistics as S

POST, AGES, DISCS = ["x", "y"], [0.0, 12.0, 13.0], [2, 1, 0]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    labels = [(i, "B1" if i // 6 % 2 else "B2", rng.choice("xyabc")) for i in range(240)]
    pairs = [(a, b, rng.choice([11.0, 12.0, 12.5, 13.5]), rng.choice([-1, 0, 0, 1, 2, 3]), rng.randrange(4)) for g in range(40) for a in range(6 * g, 6 * g + 6) for b in range(a + 1, 6 * g + 6)]
    pairs += [(999, 3, 13.0, 0, 1), (0, 6, 13.0, 0, 1), (1, 2, 13.0, None, 1)]  # an unknown node, two strata, no disc
    return spark.createDataFrame([(b, a, *r) if a % 2 else (a, b, *r) for a, b, *r in pairs], "a long, b long, age double, disc int, shared int"), spark.createDataFrame(labels, "node long, stratum string, cls string"), pairs, labels


def selected(pairs, label, stratum):
    """Counts by (stratum, age, disc, progenitor, kind), threshold by threshold."""
    out = Counter()
    for age in AGES:
        for disc in DISCS:
            best = {}
            for a, b, t, d, s in pairs:
                if d is None or not 0 <= d <= disc or t < age or a not in label or b not in label or stratum[a] != stratum[b]:
                    continue
                for x, y in ((a, b), (b, a)):
                    if label[x] in POST and label[y] not in POST:
                        best[x] = min(best.get(x, (9, 0, 0)), (d, -s, y))
            for x, (_, _, y) in best.items():
                out[stratum[x], age, disc, label[y], label[x]] += 1
    return out


def test_permutations_keep_labels_and_move_them(spark, tables):
    _, labels, _, rows = tables
    got = P.relabelled(labels, 6).collect()
    for rep in range(1, 7):
        own = {r.node: r for r in got if r.rep == rep}
        assert len(own) == len(rows)
        for s in ("B1", "B2"):
            assert Counter(r.cls for r in own.values() if r.stratum == s) == Counter(c for _, t, c in rows if t == s)
    assert len({tuple(r.cls for r in sorted(got, key=lambda r: r.node) if r.rep == k) for k in range(1, 7)}) == 6
    assert sorted(map(tuple, got)) == sorted(map(tuple, P.relabelled(labels.repartition(7), 6).collect()))
    for n in (1, 2, 9, 100):
        assert sorted(P.permuted(np.arange(n), np.array([n]), 5, 3)) == list(range(n))


def test_permutations_are_even():
    n, reps = 6, 3000
    at = P.permuted(np.repeat(np.arange(n)[:, None], reps, 1), np.array([n]), 1, np.arange(reps)[None])
    times = np.array([[(at[i] == j).sum() for j in range(n)] for i in range(n)])
    assert ((times - reps / n) ** 2 / (reps / n)).sum() < 60  # 25 degrees of freedom


def test_counts_and_moments_equal_a_plain_selection(spark, tables):
    pairs, labels, plain, rows = tables
    stratum = {i: s for i, s, _ in rows}
    got = {(r.stratum, r.age, r.disc, r.progenitor, r.kind): r.n for r in P.observed(pairs, labels, POST, AGES, DISCS).collect()}
    assert got == selected(plain, {i: c for i, _, c in rows}, stratum)
    reps = 8
    label = defaultdict(dict)
    for r in P.relabelled(labels, reps).collect():
        label[r.rep][r.node] = r.cls
    each = [selected(plain, label[k], stratum) for k in range(1, reps + 1)]
    for c in each:
        for (_, *k), n in list(c.items()):
            c["pool", *k] += n
    want = {k: (sum(c[k] for c in each) / reps, sum(c[k] ** 2 for c in each) / reps - (sum(c[k] for c in each) / reps) ** 2) for k in set().union(*each)}
    moments = P.null_moments(pairs, labels, POST, AGES, DISCS, reps)
    found = {(r.stratum, r.age, r.disc, r.progenitor, r.kind): (r.mean, r.variance) for r in moments.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    tested = P.captured(P.observed(pairs, labels, POST, AGES, DISCS), moments, fold=1.0, fdr=0.9).collect()
    seen = Counter(got)
    for (_, *k), n in got.items():
        seen["pool", *k] += n
    assert {(r.stratum, r.age, r.disc, r.progenitor, r.kind): r.n for r in tested} == {k: n for k, n in seen.items() if n >= 3}
    for cell in {(r.stratum, r.age, r.disc) for r in tested}:
        own = sorted((r for r in tested if (r.stratum, r.age, r.disc) == cell), key=lambda r: r.p)
        low = 1.0
        for i in range(len(own), 0, -1):
            low = min(low, own[i - 1].p * len(own) / i)
            assert own[i - 1].q == pytest.approx(low)
        assert all(r.fold == pytest.approx((r.n + 1) / (want.get((*cell, r.progenitor, r.kind), (0, 0))[0] + 1)) for r in own)
    hits = Counter((r.progenitor, r.kind) for r in tested if r.stratum == "pool" and r.captured)
    some = spark.createDataFrame(tested)
    assert {(r.progenitor, r.kind): r.hits for r in P.robust(some).collect()} == hits


def test_no_rows(spark, tables):
    pairs, labels, *_ = tables
    assert P.observed(pairs.limit(0), labels, POST, AGES, DISCS).count() == 0 and P.null_moments(pairs, labels.limit(0), POST, AGES, DISCS, 3).count() == 0


def test_log_factorial(spark):
    ns = [0, 1, 2, 5, 20, 170, 1000, 10**6, 10**9]
    got = [r.x for r in spark.createDataFrame([(n,) for n in ns], "n long").select(C.log_factorial(F.col("n")).alias("x")).collect()]
    assert got == pytest.approx([math.lgamma(n + 1) for n in ns], rel=1e-14, abs=1e-13)


def test_adjusted_within_groups(spark):
    rows = [("a", 0.01), ("a", 0.04), ("a", 0.03), ("b", 0.5), (None, 0.2), (None, 0.2)]
    got = sorted((str(r.g), r.p, round(r.q, 9)) for r in S.bh(spark.createDataFrame(rows, "g string, p double"), "p", ["g"]).collect())
    assert got == [("None", 0.2, 0.2), ("None", 0.2, 0.2), ("a", 0.01, 0.03), ("a", 0.03, 0.04), ("a", 0.04, 0.04), ("b", 0.5, 0.5)]


def test_adjacency_equals_a_plain_count(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("e", "f"), ("d", "d")]
    steps = [("a", "b")] * 3 + [("b", "a"), ("a", "c"), ("a", "d"), ("c", "d"), ("e", "f"), ("a", "e"), ("a", "unknown"), (None, "a")]
    link = defaultdict(set)
    for x, y in edges:
        link[x].add(y)
        link[y].add(x)
    far = {}
    for s in "abcdef":
        far[s, s], front, d = 0, {s}, 0
        while front:
            d += 1
            front = {y for x in front for y in link[x] if (s, y) not in far}
            far |= {(s, y): d for y in front}
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {(r.a, r.b): r.d for r in G.all_distances(df).collect()} == far
    one_way = {(r.a, r.b): r.d for r in G.all_distances(df, True).collect()}
    assert one_way["a", "d"] == 3 and ("d", "a") not in one_way
    states = spark.createDataFrame([(x,) for x in "abcdef"], "state string")
    r = G.adjacency_test(spark.createDataFrame(steps, "src string, dst string"), df, states, 99).first()
    share = lambda to: np.mean([far[to[x], to[y]] == 1 for x, y in steps if x in to and y in to and (to[x], to[y]) in far])
    label = defaultdict(dict)
    for x in P.relabelled(states.select(F.col("state").alias("node"), F.lit("all").alias("stratum"), F.col("state").alias("cls")), 99).collect():
        label[x.rep][x.node] = x.cls
    null = [share(label[k]) for k in range(1, 100)]
    own = share({x: x for x in "abcdef"})
    assert (r.steps, r.adjacent, r["median"]) == (8, pytest.approx(own), 1.0)
    assert (r.null_mean, r.null_sd, r.p) == (pytest.approx(np.mean(null)), pytest.approx(np.std(null)), pytest.approx((1 + sum(x >= own - 1e-12 for x in null)) / 100))
    assert G.adjacency_test(spark.createDataFrame([], "src string, dst string"), df, states, 5).first().p is None
