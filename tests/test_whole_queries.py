"""Queries take all rows that their names say, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewright import catalog

SF = "/root/testdata/sf0.001"


def tapes(spark):
    out = {}
    for r in catalog.view(spark, SF, "genotypes").collect():
        out.setdefault(r.cell, {})[r.tape] = [r[f"s{i}"] for i in range(1, 7)]
    return out


def depth(s):
    return s.index("U") if "U" in s else 6


def prefix(a, b):
    k = 0
    while k < 6 and a[k] == b[k] != "U":
        k += 1
    return k


def distance(a, b):
    d = [depth(a[t]) + depth(b[t]) - 2 * prefix(a[t], b[t]) for t in a.keys() & b.keys()]
    return sum(d) / len(d), len(d)


def test_tape_queries_take_all_cells(spark):
    g = tapes(spark)
    q = catalog.queries()
    want = {(a, b): distance(g[a], g[b]) for a in g for b in g if a < b and g[a].keys() & g[b].keys()}
    got = {(r.i, r.j): (r.distance, r.shared) for r in q["tape_distance_pairs"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(got)[0] >= 60
    assert all(got[k] == (pytest.approx(want[k][0], abs=1e-6), want[k][1]) for k in want)
    flags = {(r.t, r.c, r.tape): r.violates for r in q["irreversibility_flags"](spark, SF).collect()}
    assert flags == {(a, a + 1, t): any(x != "U" and x != y for x, y in zip(g[a][t], g[a + 1][t], strict=True)) for a in g if a + 1 in g for t in g[a].keys() & g[a + 1].keys()}
    new = {(r.t, r.c): (r.shared, r.new_edits) for r in q["pendant_components"](spark, SF).collect()}
    assert new == {(a, a + 1): (len(s), sum(depth(g[a + 1][t]) - prefix(g[a][t], g[a + 1][t]) for t in s)) for a in g if a + 1 in g and (s := g[a].keys() & g[a + 1].keys())}


def test_bh_takes_all_orders(spark):
    p = {r.o_orderkey: (r.o_orderkey * 7919 % 1000 + 1) / 1000 for r in catalog.view(spark, SF, "orders").collect()}
    got = {r.id: r.q for r in catalog.queries()["bh_qvalues"](spark, SF).collect()}
    up = sorted(p.values())
    x = np.array(up) * len(up) / np.searchsorted(up, up, "right")
    q = dict(zip(up, np.minimum(1, np.minimum.accumulate(x[::-1])[::-1]), strict=True))
    assert got.keys() == p.keys() and all(got[i] == pytest.approx(q[p[i]], abs=1e-8) for i in p)


def test_dictionary_holds_all_suppliers(spark):
    sf = "/root/testdata/sf0.01"
    entries = [r.entry for r in catalog.view(spark, sf, "entries").collect()]
    dna = "select distinct substr(translate(md5(cast(s_suppkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 6) as e from {supplier}"
    assert sorted(entries) == sorted(r.e for r in spark.sql(dna, supplier=catalog.view(spark, sf, "supplier")).collect())
    for r in catalog.queries()["barcode_unique_nearest"](spark, sf).collect():
        d = sorted((sum(x != y for x, y in zip(r.word, e, strict=True)), e) for e in entries)
        assert r.nearest == (d[0][1] if d[0][0] <= 2 and d[0][0] < d[1][0] else None)


def test_nearest_match_scores_all_cells_with_a_common_token(spark):
    g = tapes(spark)
    held = {c: {(t, k, s) for t, six in g[c].items() for k, s in enumerate(six) if s != "U"} for c in g}
    n = {}
    for x in held.values():
        for t in x:
            n[t] = n.get(t, 0) + 1
    rare = {t for t in n if n[t] <= len(g) // 5}
    want = {}
    for q in g:
        if q % 20 == 0:
            near = [(*((d := distance(g[q], g[c]))[0], -d[1]), c) for c in g if c != q and held[q] & held[c] & rare]
            if near:
                want[q] = min(near)[2]
    assert {r.q: r.c for r in catalog.queries()["nearest_match"](spark, SF).collect()} == want


def test_mutual_pairs_of_all_rows(spark):
    rows = sorted((r.vec_id, r.embedding) for r in catalog.view(spark, SF, "embeddings").collect())
    ids, v = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = {int(i): set(ids[np.lexsort((ids, d[k]))[:10]].tolist()) for k, i in enumerate(ids)}
    want = {(a, b) for a in near for b in near[a] if a < b and a in near[b]}
    assert {(r.a, r.b) for r in catalog.queries()["mutual_nn"](spark, SF).collect()} == want


def test_collapse_by_components_equals_collapse_of_whole_barcodes(spark):
    from cladewright.functions import kernels as K

    want = set()
    by = {}
    for r in catalog.view(spark, SF, "patterns").collect():
        by.setdefault(r.tape, []).append((tuple(r[f"s{i}"] for i in range(1, 7)), r.n))
    for tape, rows in by.items():
        want |= {(tape, "|".join(p), n) for p, n in K.collapse_errors(sorted(rows), 2.0).items()}
    assert {(r.tape, r.pattern, r.n) for r in catalog.queries()["collapsed_patterns"](spark, SF).collect()} == want


def test_leading_axis_equals_dense_algebra(spark):
    from cladewright.operators import routing as R
    from cladewright.plans.routing import alleles

    rows = alleles(catalog.view(spark, SF, "routable")).filter("cell < 120")
    weights = R.rarity(rows)
    w = {(r.tape, r.allele): r.weight for r in weights.collect() if r.allele != "U" and r.weight > 0}
    cells, names = sorted({r.cell for r in rows.collect()}), sorted(w)
    x = np.zeros((len(cells), len(names)))
    for r in rows.collect():
        if (r.tape, r.allele) in w:
            x[cells.index(r.cell), names.index((r.tape, r.allele))] = np.sqrt(w[r.tape, r.allele])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    y = x - x.mean(0)
    want = y @ np.linalg.eigh(y.T @ y)[1][:, -1]
    scores = R.leading_axis(rows, weights)
    got = {r.cell: r.score for r in scores.collect()}
    got = np.array([got[c] for c in cells])
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)
    v = sorted(got)
    every = {t: np.var([np.mean(v[:t])] * t + [np.mean(v[t:])] * (len(v) - t)) for t in range(1, len(v))}  # what two flat classes vary
    places = {max(1, int(len(v) * (2 + i / 4) / 100)) for i in range(385)}
    t = max(places, key=lambda t: (round(every[t], 12), -t))
    assert R.best_split(scores) == pytest.approx((v[t - 1] + v[t]) / 2)
    few = rows.filter("cell % 5 <> 0 or tape < 'T4'")
    assert {r.cell for r in R.confident(few, 8).collect()} == {r.cell for r in few.groupBy("cell").agg(F.count_distinct("tape").alias("n")).filter("n >= 8").collect()}
    side = {r.cell: r.side for r in catalog.view(spark, SF, "routable").collect()}
    high = {r.cell: r.high for r in catalog.queries()["split_axis"](spark, SF).collect()}
    agree = np.mean([high[c] == (side[c] == "A") for c in side])
    assert high.keys() == side.keys() and max(agree, 1 - agree) > 0.98


def test_tree_cache_and_manifest(spark, tmp_path):
    import json

    from cladewright.sources import tables

    (tmp_path / "a.nwk").write_text("(a:1,b:2);")
    key = tables.content_key(spark, [str(tmp_path / "a.nwk")], k=1)
    assert key == tables.content_key(spark, [str(tmp_path / "a.nwk")], k=1) != tables.content_key(spark, [str(tmp_path / "a.nwk")], k=2)
    made = []
    for _ in range(2):
        out = tables.kept(spark, str(tmp_path / "kept"), key, lambda: made.append(1) or spark.range(3))
        assert out.count() == 3
    assert made == [1]
    tables.write_manifest(spark, str(tmp_path / "m"), [str(tmp_path / "a.nwk")], k=1)
    text = json.loads(spark.read.text(str(tmp_path / "m")).first().value)
    assert text["parameters"] == {"k": 1} and text["inputs"][0]["length"] == 10
    tables.report(spark.createDataFrame([("total", 10, 100.0), ("some", 3, 30.0)], "metric string, n long, pct double"), str(tmp_path / "r"))
    assert [r.value.split() for r in spark.read.text(str(tmp_path / "r")).collect()] == [["some", "3", "(30.00%)"], ["total", "10", "(100.00%)"]]


def test_fastq_limit_and_many_files(spark, tmp_path):
    from cladewright.sources import fastq

    reads = spark.range(100).select(*[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in ("header", "seq", "qual")])
    fastq.write_fastq(reads.repartition(3), str(tmp_path / "f"))
    got = fastq.read_fastq(spark, str(tmp_path / "f"))
    assert sorted((r.header, r.seq, r.qual) for r in got.collect()) == sorted((f"header{i}", f"seq{i}", f"qual{i}") for i in range(100))
    few = fastq.read_fastq(spark, str(tmp_path / "f"), limit=5).collect()
    assert len(few) == 15 and max(r.read_no for r in few) == 4


def test_whitelist_is_greedy_by_count(spark):
    from cladewright.operators import reads as R

    rows = [("AAAAAA", 100), ("AAAAAT", 90), ("CCCCCC", 80), ("CCCAAA", 70), ("GGGGGG", 1)]
    assert R.whitelist(spark.createDataFrame(rows, "barcode string, n long"), 0.01, 3) == ["AAAAAA", "CCCCCC", "CCCAAA"]
