"""Repairs of the findings on cost: what is parsed, compared or joined how often, with the same results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cladewright.operators import reads as R

ARRAY = "TTGGCATGACGTACGTACGTGCTCTGGATGAT" + "GGTGAGCACGAAAGGATGAT" * 2 + "GGTGAGCACGTGAT" * 4 + "GGTGAGCCACAAGGCAATCC"


def test_headers_are_said_once_in_the_filter(spark):
    """each mention of a header below the pushed filter made the header again."""
    rows = [("@c1,P1,AC,S1", ARRAY), ("c2,P1,AC,xS1y", ARRAY), ("@c3,P1,AC,S2", ARRAY), ("@c4,P1,S1", ARRAY), ("@c5,S1,AC,S2,S1", ARRAY), (None, ARRAY), ("@c6,P1,AC,S1,more", "GG")]
    df = spark.createDataFrame(rows, "raw string, seq string").select(F.translate("raw", "#", "+").alias("header"), "seq")
    parsed = R.parse_cells(df.select("header", "seq"), sample="S1")
    got = {(r.cell, r.pcr, r.umi, r.sample, r.barcode, r.resolved, r.why) for r in parsed.collect()}
    assert got == {("c1", "P1", "AC", "S1", "ACGTACGTACGT", True, "unedited"), ("c2", "P1", "AC", "xS1y", "ACGTACGTACGT", True, "unedited"), ("c6", "P1", "AC", "S1", None, False, "short")}
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("translate(") for line in plan.splitlines() if "Filter" in line) <= 2  # the test for null is the other
    assert {r.cell for r in R.parse_cells(df.select("header", "seq")).collect()} == {"c1", "c2", "c3", "c5", "c6"}
    assert R.parse_cells(df.select("header", "seq"), sample="S2,S1").isEmpty()


@pytest.mark.parametrize("query", ["parse_funnel", "order_patterns", "first_anchors", "junction_table"])
def test_sequences_are_parsed_once(spark, query, monkeypatch):
    """F16, F17, F18: these queries only count reads, so that equal sequences need parsing once."""
    import __spark_entry__

    seen = []
    parse = R.parse_bulk
    monkeypatch.setattr(R, "parse_bulk", lambda reads, *a: (seen.append(reads), parse(reads, *a))[1])
    __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")
    assert seen[0].count() == seen[0].select("seq").distinct().count()


def test_weights_of_sequences_count_as_reads(spark):
    bad = ARRAY.replace("GGTGAGCACGAAAGGATGAT", "GGTGAGCACGTGAT", 1)
    reads = spark.createDataFrame([(s,) for s in [ARRAY] * 3 + [bad] * 2 + [None, "GG", "GG"]], "seq string")
    once = R.parse_bulk(R.dereplicated(reads))
    for of in (lambda x, n: R.order_patterns(x, n), lambda x, n: R.anchor_offsets(x, n=n), lambda x, n: R.junction_failures(x, n=n)):
        assert sorted(map(tuple, of(once, "n_reads").collect())) == sorted(map(tuple, of(R.parse_bulk(reads), None).collect()))
