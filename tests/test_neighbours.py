"""The forest's neighbours against all, clustering against one merge at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewright import catalog
from cladewright.operators import clustering as C
from cladewright.operators import neighbours as N


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id long, v array<double>")


def exact(x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        out[q] = [int(i) for i in np.lexsort((np.arange(len(x)), d))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append(r.c)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    at = {i: n for n, i in enumerate(ids)}
    got = found(catalog.queries()["forest_neighbours"](spark, sf))
    want = exact(x, [at[q] for q in ids if q % 20 == 0], 10)
    assert {at[q] for q in got} == set(want)
    hits = sum(len({at[c] for c in got[ids[q]]} & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mutual_neighbours_equal_a_plain_search(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    near = {i: set(c) for i, c in exact(x, range(len(x)), 10).items()}
    want = {(ids[a], ids[b]) for a in near for b in near[a] if a < b and a in near[b]}
    got = [(r.a, r.b) for r in catalog.queries()["mutual_nn"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_clustered_vectors_small_sample_and_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 4 + rng.normal(size=(4000, 16))
    x[:600] = x[0]  # copies of one vector
    df = frame(spark, x)
    got = N.forest_knn(df, df.filter("id % 20 = 0"), 8, sample=500, leaf=32, block=100)
    rows, want = found(got), exact(x, range(0, 4000, 20), 8)
    assert sum(len(set(rows[q]) & set(w)) for q, w in want.items()) >= 0.9 * 8 * len(want)
    assert rows[0] == list(range(1, 9))  # all of the copies are met, whatever block they are in
    assert all(abs(r.distance - np.linalg.norm(x[r.q] - x[r.c])) < 1e-9 for r in got.collect())


def test_odd_tables(spark):
    none = frame(spark, [])
    some = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [5.0, 5.0])], "id long, v array<double>")
    assert N.forest_knn(none, none, 3).count() == 0 and N.forest_knn(some, some.limit(0), 3).count() == 0
    assert found(N.forest_knn(some, some, 5)) == {1: [2, 4], 2: [1, 4], 4: [1, 2]}


def merged_one_by_one(ids, d, linkage):
    """Merges (least, other, height) by the recurrence of Lance and Williams, and the height at which each two leaves meet."""
    size, held = dict.fromkeys(ids, 1), {i: [i] for i in ids}
    d = {frozenset(p): v for p, v in d.items()}
    merges, meet = [], {}
    while len(size) > 1:
        h, a, b = min((v, *sorted(p)) for p, v in d.items())
        merges.append((a, b, h))
        meet |= {(min(x, y), max(x, y)): h for x in held[a] for y in held[b]}
        for k in size:
            if k in (a, b):
                continue
            x, y, n, m, o = d[frozenset((a, k))], d[frozenset((b, k))], size[a], size[b], size[k]
            d[frozenset((a, k))] = (n * x + m * y) / (n + m) if linkage == "average" else (max(0.0, (n + o) * x * x + (m + o) * y * y - o * h * h) / (n + m + o)) ** 0.5
        d = {p: v for p, v in d.items() if b not in p}
        size[a] += size.pop(b)
        held[a] += held.pop(b)
    return merges, meet


@pytest.mark.parametrize("linkage", C.LINKAGES)
def test_clusters_equal_one_merge_at_a_time(spark, linkage):
    rng, rows, want = np.random.default_rng(5), [], {}
    for g, n in (("a", 2), ("b", 25), (None, 9)):
        x = rng.normal(size=(n, 3))
        d = {(i, j): float(np.linalg.norm(x[i] - x[j])) for i in range(n) for j in range(i + 1, n)}
        rows += [(g, i, j, v) for (i, j), v in d.items()]
        want[g] = *merged_one_by_one(range(n), d, linkage), d
    merges, meet = C.agglomerated(spark.createDataFrame(rows, "grp string, i long, j long, d double"), linkage)
    got = {}
    for r in merges.collect():
        got.setdefault(r.grp, []).append((r.a, r.b, r.height))
    meet = meet.persist()
    for g, (steps, heights, d) in want.items():
        assert sorted((a, b) for a, b, _ in got[g]) == sorted((a, b) for a, b, _ in steps)
        assert sorted(h for *_, h in got[g]) == pytest.approx(sorted(h for *_, h in steps))
        own = {(r.i, r.j): r.height for r in meet.filter(F.col("grp").eqNullSafe(F.lit(g))).collect()}
        assert own == pytest.approx(heights)
        cut = sorted(heights.values())[len(heights) // 3] + 1e-9
        labels = {r.leaf: r.cluster for r in C.cut_at(meet.filter(F.col("grp").eqNullSafe(F.lit(g))), cut).collect()}
        assert labels == {i: min([i] + [sum(p) - i for p, h in heights.items() if i in p and h <= cut]) for i in {x for p in d for x in p}}
        r = C.cophenetic_correlation(meet.filter(F.col("grp").eqNullSafe(F.lit(g)))).first()
        assert r.r is None if len(d) < 2 else r.r == pytest.approx(np.corrcoef([d[p] for p in d], [heights[p] for p in d])[0, 1])


def test_ties_settle(spark):
    rows = [("t", i, j, 1.0) for i in range(5) for j in range(i + 1, 5)]
    merges, meet = C.agglomerated(spark.createDataFrame(rows, "grp string, i long, j long, d double"))
    assert sorted((r.a, r.b) for r in merges.collect())[-1][1] == 4 and merges.count() == 4 and {r.height for r in meet.collect()} == {1.0}
    none = spark.createDataFrame([], "grp string, i long, j long, d double")
    assert C.agglomerated(none)[0].count() == 0 and C.agglomerated(none)[1].count() == 0
    with pytest.raises(ValueError):
        C.agglomerated(none, "single")
