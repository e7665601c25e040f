"""What failed at size or on odd input in the third round."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cladewright import catalog
from cladewright.functions import kernels as K
from cladewright.operators import dating, reads, statistics
from cladewright.operators import trees as T

SF = "/root/testdata/sf0.001"


def test_rank_sum_of_counts_whose_product_outgrows_a_long(spark):
    df = spark.range(6_000_000).select(F.lit("g").alias("g"), (F.col("id") % 4).alias("x"), (F.col("id") % 2 == 0).alias("first"))
    r = statistics.rank_sum(df, "x", "first", "g").first()
    assert (r.n1, r.n2) == (3_000_000, 3_000_000) and r.z < -500 and r.z_tied < r.z


def test_junction_failures_are_planned_in_time(spark):
    x = reads.junction_failures(reads.parse_bulk(catalog.view(spark, SF, "bulk_reads").select("seq")))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 500_000


def test_a_filter_on_what_the_walk_gives_runs_it_once(spark):
    x = reads.parse_bulk(catalog.view(spark, SF, "bulk_reads").select("seq")).filter("broken").select("sites")
    assert x._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def plain_molecules(rows, merge, floor):
    total, kept, out = {}, {}, {}
    for u, _, n, f in rows:
        t = total.get(u, (0, f))
        total[u] = t[0] + n, min(t[1], f)
    for u in sorted(total, key=lambda u: (-total[u][0], total[u][1], u)):
        to = next((k for k in kept if len(k) == len(u) and sum(a != b for a, b in zip(k, u, strict=True)) <= merge), u)
        kept.setdefault(to, []).extend(r for r in rows if r[0] == u)
    for own in kept.values():
        by = {}
        for _, p, n, f in own:
            c = by.get(p, (0, f))
            by[p] = c[0] + n, min(c[1], f)
        if sum(c[0] for c in by.values()) >= floor:
            top = min(by, key=lambda p: (-by[p][0], by[p][1], p))
            out[top] = out.get(top, 0) + 1
    return out


@pytest.mark.parametrize("merge", [0, 1, 2])
def test_molecules_equal_the_plain_way(merge):
    rng = random.Random(merge)
    rows = [("".join(rng.choice("AC") for _ in range(rng.choice([1, 4, 5]))), (rng.choice("XYZ"), "U"), rng.randint(1, 4), i) for i in range(60)]
    assert K.molecules(rows, merge, 2) == plain_molecules(rows, merge, 2)


def test_molecules_of_many_umis():
    rng = random.Random(0)
    rows = [("".join(rng.choice("ACGT") for _ in range(16)), ("U",), 1, i) for i in range(20_000)]
    t = time.time()
    assert sum(K.molecules(rows, 1, 1).values()) > 19_000 and time.time() - t < 20


def test_newick_of_trees_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        want = {i: f"((a{i}:1,b:2.50)x:1,(c:1,d:0,e:3e-1):2);" for i in range(50)} | {50: "a;", 51: "(a,b);"}
        texts = spark.createDataFrame(list(want.items()), "tree_id long, newick string")
        assert {r.tree_id: r.newick for r in T.write_newick(T.read_newick(texts)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shuffled_labels_are_not_gathered_in_the_driver(spark):
    labels = spark.range(100).select(F.col("id").alias("node"), (F.col("id") % 3).cast("string").alias("cls"))
    s = statistics.shuffled(labels, 3)
    assert int(str(s._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 10 << 20
    assert s.groupBy("rep", "cls").count().filter("count not in (33, 34)").isEmpty() and s.count() == 300


def test_dates_where_only_the_constraints_make_the_rate_positive(spark):
    tree = spark.createDataFrame([(0, None, 0.0), (1, 0, -0.375), (2, 1, 0.1)], "node long, parent long, blen double")
    got = {r.node: r for r in dating.dated(tree, 0.0, 1.0, 0.05).collect()}
    k1, k2 = 66 / (10 / 66), 66 / (0.1 + 10 / 66)
    rate = (k2 * 0.1 * 0.95 - k1 * 0.375 * 0.05) / (k1 * 0.05**2 + k2 * 0.95**2)
    assert got[1].rate == pytest.approx(rate, rel=1e-4) and got[1].day == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("falls", [False, True])
def test_cousins_equal_brute_force(spark, falls):
    rng = random.Random(5)
    parent = {0: None, 1: None, **{i: rng.randrange(max(0, i - 12), i) for i in range(2, 160)}}
    time_, by = {}, {i: rng.choice(["p", "q"]) for i in parent}
    for i, p in parent.items():
        time_[i] = 0.0 if p is None else round(time_[p] + rng.choice([-0.5 if falls else 0.0, 0.5, 3.0]), 1)

    def up(i):
        out = [i]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    want = set()
    for a in range(0, 160, 5):
        own, near = up(a), []
        for b in parent:
            top = next((x for x in up(b) if x in own), None)
            if by[b] == by[a] and top is not None and top not in (a, b):
                near.append((round(time_[a] + time_[b] - 2 * time_[top], 6), b))
        want |= {(a, b, d, k) for k, (d, b) in enumerate(sorted(near)[:4], 1)}
    nodes = spark.createDataFrame([(i, p, time_[i], by[i]) for i, p in parent.items()], "node long, parent long, time double, day string")
    got = T.cousins(T.nested_set(nodes).drop("depth"), nodes.filter("node % 5 = 0").select("node"), 4, digits=6, wide=2)
    assert {(r.a, r.b, r.distance, r["rank"]) for r in got.collect()} == want
