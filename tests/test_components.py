"""Links of near-duplicates are joined by steps, or in one task once they are few."""

from __future__ import annotations

from cladewright.operators import scale


def test_links_are_joined_alike_by_steps_and_in_a_task(spark):
    """Pipeline: near_dedup planned a dozen shuffles a step for a handful of links, in the driver's memory."""
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {200: 199}
    for few in (0, 60, 1000):
        assert {r.node: r.root for r in scale.components(df, few).collect()} == want
    assert scale.components(df.filter("a < 0")).isEmpty()
