"""Whole copies keep to a source's words, at every size of document."""

import numpy as np
import pytest

import corpus_pipeline


@pytest.mark.parametrize("ratio", [0.4, 0.805, 1.6])
def test_copies_keep_to_the_words_at_every_length(spark, ratio):
    rng = np.random.default_rng(6)
    n = [*map(int, rng.integers(1, 400, 1500)), *map(int, rng.integers(6000, 9000, 60)), 0]
    rows = [(i, round(ratio * x) if x > 512 else int(x * rng.choice([np.floor(ratio), np.ceil(ratio)], p=[1 - ratio % 1, ratio % 1])), x) for i, x in enumerate(n)]
    drawn = spark.createDataFrame([(i, t, x, 0) for i, t, x in rows], "doc_id long, t long, n long, grp int")
    times = {r.doc_id: r.times for r in corpus_pipeline.copies(drawn).collect()}
    assert len(times) == len(rows) and times[len(rows) - 1] == 1
    assert all(t // x <= times[i] <= -(-t // x) for i, t, x in rows if x)
    for long in (True, False):
        some = [(i, t, x) for i, t, x in rows if x and (x > 4096) == long]
        assert sum(times[i] * x for i, _, x in some) == pytest.approx(sum(t for _, t, _ in some), rel=0.04)
