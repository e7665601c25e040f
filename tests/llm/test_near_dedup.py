"""The pipeline's near-dedup stage on pairs that fingerprints of 4 bits miss, and against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from cladewright.llm import minhash, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def word_shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute(sets):
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def varied(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return out


def test_near_copies_of_many_differing_bits_are_dropped(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(varied(rng, base, 3)))]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], COLUMNS)
    text = dict(rows)
    assert all(alike(word_shingles(text[2 * k]), word_shingles(text[2 * k + 1])) for k in range(30))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()) == [2 * k for k in range(30)]


@pytest.mark.parametrize("stars", [3, 1, 0])
def test_kept_rows_equal_brute_force(spark, stars):
    rng = np.random.default_rng(4)
    rows = [(None, "no id here at all today"), (900, None), (901, " "), (902, "a b"), (903, "A  b"), (904, "a b c")]
    for k in range(12):
        base = [f"w{x}" for x in rng.integers(0, 900, 120)]
        rows += [(100 + 20 * k + j, " ".join(varied(rng, base, int(rng.integers(0, 6))))) for j in range(12)]
    rows.append(rows[-1])
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], COLUMNS)
    got = sorted(r.doc_id or -1 for r in minhash.keep_first(df, stars=stars).collect())
    sets = {-1 if i is None else i: word_shingles(t) for i, t in rows}
    want = brute({i: s for i, s in sets.items() if s}) | {900}
    assert got == sorted(want)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == brute({r.doc_id: word_shingles(r.text) for r in docs.collect()})


def test_classes_are_worked_out_once(spark):
    """Rows to keep and rows without any id come from one pass over the classes, which are the longest plan of the stage."""
    docs = spark.createDataFrame([(i, f"text {i // 2}", "en", "a", 1) for i in range(8)], COLUMNS)
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    classed = docs.selectExpr("doc_id", "doc_id div 2 AS fp", "doc_id - doc_id % 2 AS component_id").coalesce(1)
    classed = classed.mapInArrow(counted, classed.schema)
    got = sorted(r.doc_id for r in simhash.first_of(docs, classed, minhash.set_keys).collect())
    assert got == [0, 2, 4, 6]
    assert passed.value == 8
