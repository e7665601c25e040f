"""Results that were once wrong without an error."""

import math

import pytest
from pyspark.sql import functions as F

from cladewright import shipping
from cladewright.operators import lineages as L
from cladewright.operators import reads as R
from cladewright.operators import summaries as S
from cladewright.operators import trees as T
from cladewright.sources import fastq, tables


def test_negative_binomial_up_to_the_mean(spark):
    rows = [(k, m, v) for k in (0, 1, 3, 10, 40) for m in (0.0, 0.5, 4.0, 30.0) for v in (0.0, m / 2, m, 1.04 * m, 1.06 * m, 3 * m)] + [(None, 1.0, 2.0), (1, None, 2.0), (1, 1.0, None)]
    got = spark.createDataFrame(rows, "k long, m double, v double").select("k", "m", "v", S.negative_binomial_tail("k", "m", "v").alias("p"), S.poisson_tail("k", "m").alias("q")).collect()
    assert len(got) == len(rows)
    for r in got:
        if None in (r.k, r.m, r.v):
            assert r.p is None
        elif r.v <= 1.05 * r.m or r.m == 0:
            assert r.p == r.q and (r.q == pytest.approx(1 - sum(math.exp(i * math.log(r.m) - r.m - math.lgamma(i + 1)) for i in range(r.k)), abs=1e-9) if r.m else r.q == float(r.k == 0))
        else:
            s, p = r.m ** 2 / (r.v - r.m), r.m / r.v
            assert r.p == pytest.approx(1 - sum(math.exp(math.lgamma(i + s) - math.lgamma(s) - math.lgamma(i + 1) + s * math.log(p) + i * math.log1p(-p)) for i in range(r.k)), abs=1e-9)
    one = spark.range(1).select(S.overdispersed_tail(F.lit(3), F.lit(0.0), F.lit(0.0)).alias("p"), S.poisson_tail(F.lit(3), F.lit(1.0)).alias("q")).first()
    assert one.p == one.q


def test_sparse_matrices_of_a_folder(spark, tmp_path):
    for k, text in enumerate(["%%MatrixMarket\n2 2 2\n1 1 5\n2 2 7\n", "%%MatrixMarket\n% note\n3 1 1\n\n3 1 2.5\n", "2 2 1\n1 2\n"]):
        (tmp_path / f"m{k}.mtx").write_text(text)
    got = sorted(tuple(r) for r in tables.read_sparse(spark, str(tmp_path)).select("i", "j", "v").collect())
    assert got == [(1, 1, 5.0), (1, 2, 1.0), (2, 2, 7.0), (3, 1, 2.5)]


def test_patristic_keeps_pairs_of_different_trees(spark):
    nodes = spark.createDataFrame([(1, None, 0.0), (2, 1, 1.0), (3, 1, 2.0), (10, None, 0.0), (11, 10, 1.0)], "node long, parent long, time double")
    got = {(r.a, r.b): r.distance for r in T.patristic(T.nested_set(nodes), spark.createDataFrame([(2, 3), (2, 11)], "a long, b long")).collect()}
    assert got == {(2, 3): 3.0, (2, 11): None}


def test_fastq_that_ends_inside_a_record(spark, tmp_path):
    (tmp_path / "ok.fq").write_text("@a\nAC\n+\nII\n\n")
    assert fastq.read_fastq(spark, str(tmp_path / "ok.fq")).count() == 1
    (tmp_path / "cut.fq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(Exception, match="ends inside a record"):
        fastq.read_fastq(spark, str(tmp_path / "cut.fq")).collect()


def test_package_goes_to_clusters_whatever_the_driver_finds(monkeypatch):
    class Context:
        def __init__(self, master):
            self.master, self.files = master, []

        def addPyFile(self, path):
            self.files.append(path)

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    monkeypatch.setenv("PYTHONPATH", str(shipping.ROOT))
    sent = {}
    for master in ("local", "local[4]", "local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        s = Session(master)
        shipping.ship(s)
        shipping.ship(s)
        sent[master] = len(s.sparkContext.files)
    assert sent == {"local": 0, "local[4]": 0, "local-cluster[2,1,1024]": 1, "spark://host:7077": 1, "yarn": 1}


def test_binarised_refuses_ids_that_would_collide(spark):
    nodes = spark.range(1_000_010).select("id", F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent"), F.lit(0.0).alias("time")).withColumnRenamed("id", "node")
    with pytest.raises(Exception, match="1,000,000 children"):
        T.binarised(nodes).agg(F.max("node"), F.min("parent")).collect()


def test_markers_count_absent_values_as_zeros(spark):
    cells = spark.createDataFrame([(i, i < 4) for i in range(10)], "cell long, first boolean")
    values = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (2, "a", 2.0), (5, "a", 0.5), (6, "a", 0.0), (0, "b", 1.0), (5, "c", 1.0)], "cell long, gene string, value double")
    got = {r.gene: r for r in S.markers(values, cells).collect()}
    for gene, held in (("a", {0: 1.0, 1: 2.0, 2: 2.0, 5: 0.5}), ("b", {0: 1.0}), ("c", {5: 1.0})):
        x = [held.get(i, 0.0) for i in range(10)]
        u = sum((x[i] > x[j]) + (x[i] == x[j]) / 2 for i in range(4) for j in range(4, 10))
        ties = sum(x.count(v) ** 3 - x.count(v) for v in set(x))
        z = max(0.0, abs(u - 12) - 0.5) / math.sqrt(4 * 6 / 12 * (11 - ties / 90)) * (1 if u > 12 else -1)
        r = got[gene]
        assert (r.u, r.z, r.p) == (pytest.approx(u), pytest.approx(z), pytest.approx(math.erfc(abs(z) / math.sqrt(2)))) and r.pct1 == sum(i < 4 for i in held) / 4
    d = {r.gene: r for r in S.effect_sizes(values, cells).collect()}["a"]
    m1, m2 = 5 / 4, 0.5 / 6
    v1, v2 = sum((v - m1) ** 2 for v in (1, 2, 2, 0)) / 3, (0.5 - m2) ** 2 / 5 + m2 ** 2
    assert (d.difference, d.d) == (pytest.approx(m1 - m2), pytest.approx((m1 - m2) / math.sqrt((v1 + v2) / 2)))


def test_module_scores_of_all_cells(spark):
    cells = spark.createDataFrame([(i,) for i in range(6)], "cell long")
    values = spark.createDataFrame([(i, f"g{g}", float(i * g % 4 + 1)) for i in range(5) for g in range(12)], "cell long, gene string, value double")
    sets = spark.createDataFrame([("s", "g1"), ("s", "g2"), ("s", "none"), ("t", "g5")], "name string, gene string")
    controls = {}
    for r in S.control_genes(values, sets, 3, 2).collect():
        controls.setdefault(r.name, set()).add(r.gene)
    held = {(r.cell, r.gene): r.value for r in values.collect()}
    got = {(r.cell, r.name): r.score for r in S.module_score(values, sets, cells, 3, 2).collect()}
    assert set(got) == {(c, n) for c in range(6) for n in "st"} and all(len(c) <= 4 for c in controls.values())
    mean = lambda c, genes: sum(held.get((c, g), 0.0) for g in genes) / len(genes)
    assert got == pytest.approx({(c, n): mean(c, {"s": ["g1", "g2"], "t": ["g5"]}[n]) - mean(c, controls[n]) for c in range(6) for n in "st"})


def test_exact_two_sided_subsets(spark):
    rows = [(n, m, d, k) for n, m, d in ((10, 4, 5), (30, 7, 11), (50, 25, 10), (9, 9, 3), (9, 0, 3), (12, 5, 0)) for k in range(max(0, m + d - n), min(m, d) + 1)] + [(0, 0, 0, 0), (None, 1, 1, 1)]
    got = spark.createDataFrame(rows, "n double, m double, d double, k double".replace("double", "long")).select("n", "m", "d", "k", S.two_tails(*[F.col(c).cast("double") for c in "nmdk"]).alias("p")).collect()
    for r in got:
        if not r.n:
            assert r.p is None
            continue
        chance = {k: math.comb(r.m, k) * math.comb(r.n - r.m, r.d - k) / math.comb(r.n, r.d) for k in range(max(0, r.m + r.d - r.n), min(r.m, r.d) + 1)}
        mean = r.m * r.d / r.n
        assert r.p == pytest.approx(sum(c for k, c in chance.items() if abs(k - mean) >= abs(r.k - mean) - 1e-9))


def test_consensus_stops_at_a_branch(spark):
    rows = [
        ("leaf", ["A", "B", "C"], 5), ("leaf", ["A", "B", "U"], 2), ("split", ["A", "B", "U"], 6), ("split", ["A", "C", "U"], 4), ("split", ["A", "U", "U"], 1), ("few", ["A", "U", "U"], 9), ("few", ["B", "U", "U"], 1),
        ("none", ["U", "U", "U"], 3), ("share", ["A", "U", "U"], 90), ("share", ["B", "U", "U"], 10), ("tie", ["B", "U", "U"], 1), ("tie", ["A", "U", "U"], 1), ("gap", ["A", None, "C"], 4),
    ]
    got = {r.cell: (r.chain, r.branched, pytest.approx(r.dominance)) for r in L.branch_stop(spark.createDataFrame(rows, "cell string, sites array<string>, n long"), "cell", n_sites=3).collect()}
    assert got == {"leaf": ("A|B|C", False, 5 / 7), "split": ("A", True, 6 / 11), "few": ("A", False, 0.9), "none": ("", False, 1.0), "share": ("A", False, 0.9), "tie": ("A", False, 0.5), "gap": ("A", False, 1.0)}


def test_junction_forensics(spark):
    unit = lambda token, key="GGA", tail="TGAT": "GGTGAGCACG" + (token + key if token else "") + tail
    array = lambda *units: "ATGAT" + "".join(units) + "GGTGAGCCACAAGGCAATCC"
    ok = [unit("ACG")] * 5
    reads = {
        "whole": array(*ok, unit("TTT")), "tail1": array(unit("ACG"), unit("ACG", tail="TGAA"), *ok[:4]), "tail2": array(unit("ACG", tail="TCAA"), *ok), "key": array(unit("ACG"), unit("ACG"), unit("ACG", key="GTA"), *ok[:3]),
        "odd": array(unit("ACGTT", tail="TGCT"), *ok), "four": array(unit("GATG", key="CCC"), *ok), "missed": "ATGAT" + "GGTGACCACGACGGGATGAT" + "".join(ok) + "GGTGAGCCACAAGGCAATCC", "no array": "ATGAT", "far": "A" * 60 + array(*ok, unit("")),
    }
    parsed = R.walk(spark.createDataFrame([(k, v, 0) for k, v in reads.items()] + [("null", None, None)], "name string, seq string, start int"))
    got = {(r.lacks, r.length, r.kind, r.near): (r.n, r.share) for r in R.junction_failures(parsed).collect()}
    assert got == {("TGAT", 10, "E3", True): (1, 1 / 3), ("TGAT", 10, "E3", False): (1, 1 / 3), ("TGAT", 12, "odd", True): (1, 1 / 3), ("GGA", 10, "E3", True): (1, 0.5), ("GGA", 11, "E4", False): (1, 0.5)}
    offsets = {(r.sites, r.away): r.reads for r in R.anchor_offsets(parsed).collect()}
    assert offsets == {(6, 5): 6, (5, 25): 1, (6, 41): 1}
    some = spark.createDataFrame([(["A", "U", None], True), (["A", "U", None], True), (["U", "A", "A"], True), (["A", "U", "U"], False)], "sites array<string>, broken boolean")
    assert {r.pattern: r.n for r in R.order_patterns(some).collect()} == {"EU.": 2, "UEE": 1}
