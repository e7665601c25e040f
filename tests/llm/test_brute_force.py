"""Operators that SQL does not express, row by row against a plain way of doing the same."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewright.llm import language_id, line_dedup, mixing, quality, sharding, simhash
from cladewright.llm.common import components, look_up, running

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def permuted(i, n, key):
    for r in range(1, 13):
        k = int(md5(f"{key}:{r}")[:12], 16)
        j = (k - i) % n
        if md5(f"{key}:{r}:{max(i, j)}")[0] >= "8":
            i = j
    return i


@pytest.mark.parametrize("block", [512, 7])
def test_mix_takes_the_words_of_permuted_blocks(spark, docs, block):
    rows = [(r.doc_id, r.source, len(r.text.replace("\t", " ").replace("\n", " ").split()) if r.text else 0) for r in docs.collect()]
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(size.values()), set(names), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}:
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    want = {}
    for rank, s in enumerate(names):
        stream, at = [], 0
        for d, _, n in sorted((x for x in rows if x[1] == s), key=lambda x: (md5(str(x[0])), x[0])):
            stream.append((d, at, n))
            at += n
        goal, whole = round(target[s]), size[s]
        full, per = whole // block, -(-whole // block)
        times = np.zeros(whole, int)
        done, slot = 0, 0
        while done < goal:
            turn, i = divmod(slot, per)
            b = permuted(i, full, f"{rank}/{turn}") if i < full else i
            take = min(block if i < full else whole % block, goal - done)
            times[b * block:b * block + take] += 1
            done, slot = done + take, slot + 1
        want |= {d: (n, whole, times[a:a + n].sum()) for d, a, n in stream}
    got = mixing.mix(docs, block=block, slots_per_shard=100).collect()
    assert {r.doc_id: (r.size, r.source_size, r.taken) for r in got} == want
    source = {d: s for d, s, _ in rows}
    assert all(r.target == pytest.approx(target[source[r.doc_id]]) for r in got)


def test_mix_of_many_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("s%05d", F.col("id") % 1000).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    rows = mixing.mix(df, block=4).collect()
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=1000) and all(r.taken <= 2 * r.size for r in rows)


def test_running_sums(spark):
    df = spark.createDataFrame([(x, y) for x in [3, 1, None, 2] for y in range(5)], "a int, b int")
    got = running(df, ["a", "b"], {"s": "b", "n": "1L"}).collect()
    order = sorted((r.a is None, r.a or 0, r.b) for r in got)
    want = {k: (sum(x[2] for x in order[:i + 1]), i + 1) for i, k in enumerate(order)}
    assert {(r.a is None, r.a or 0, r.b): (r.s, r.n) for r in got} == want
    assert running(df.limit(0), ["a", "b"], {"s": "b"}).count() == 0


def test_look_up_of_heavy_keys(spark):
    rows = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(3000)] + [(-1, None)], "n long, k long")
    facts = rows.filter("k is not null and k % 3 = 0").groupBy("k").agg(F.count("*").alias("times"), (F.col("k") * 2).alias("v"))
    got = look_up(rows, facts, "k", "times", 3001).collect()
    assert sorted((r.n, r.k, r.v) for r in got if r.k is not None) == sorted((i, k, 2 * k if k % 3 == 0 else None) for i, k in ((i, 0 if i % 2 else i) for i in range(3000)))
    assert [tuple(r) for r in got if r.k is None] == [(-1, None, None)]


def plain_vector(text):
    """Bound and bundled letter trigrams, letter by letter."""
    base = (np.random.default_rng(2).integers(0, 2, (521, 512)) * 2 - 1).astype(int)
    number = [ord(c) % 520 + 1 if c.isalpha() else 0 for c in text.lower()]
    squeezed = [0]
    for x in [*number, 0]:
        if x or squeezed[-1]:
            squeezed.append(x)
    out = np.zeros(512)
    for a, b, c in zip(squeezed, squeezed[1:], squeezed[2:], strict=False):
        out += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    return out


def test_language_vectors_equal_plain_binding(spark):
    texts = ["Hello, World!", "ça va bien", "x", "one  two\n\nthree 4 five", "\U00030000\U00030001 a"]
    got = language_id.Encoder().vectors(texts)
    for v, t in zip(got, texts, strict=True):
        want = plain_vector(t)
        np.testing.assert_allclose(v, want / np.linalg.norm(want), atol=1e-5)


def test_language_prediction_equals_plain_cosines(spark, docs):
    some = docs.filter("length(text) < 400").limit(60)
    rows = some.collect()
    import zlib
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang]
    langs = sorted({r.lang for r in learn})
    proto = np.array([sum(plain_vector(r.text) for r in learn if r.lang == k) for k in langs])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    proto -= proto.mean(0)
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    for r in language_id.predict(spark.createDataFrame(rows, some.schema)).collect():
        v = plain_vector(next(x.text for x in rows if x.doc_id == r.doc_id))
        if v.any():
            cosine = proto @ (v / np.linalg.norm(v))
            assert (r.lang_pred, r.score) == (langs[int(cosine.argmax())], pytest.approx((1 + cosine.max()) / 2, abs=1e-4))


def test_votes_equal_plain_neighbours(spark, docs):
    d, lab = docs, spark.read.parquet(f"{SF}/labels.parquet")
    voter = quality.fit(d, lab, k=7)
    texts = [r.text for r in d.limit(50).collect()] + [None, "", "word " * 5000]
    got = voter.score(texts)
    for t, g in zip(texts, got, strict=True):
        x = quality.weighted(quality.terms(t)[None, :].copy(), voter.idf) @ voter.basis
        x = (x / max(np.linalg.norm(x), 1e-9))[0]
        near = sorted(((float(v @ x), i) for i, v in enumerate(voter.near)), reverse=True)[:7]
        w = [(max(s, 1e-6) ** quality.SHARP * voter.weight[i], voter.label[i]) for s, i in near]
        assert g == pytest.approx(sum(a * b for a, b in w) / sum(a for a, _ in w), abs=2e-3)


def test_shards_equal_plain_scheduling(spark, docs):
    """Groups and bundles, largest first, each to the shard that holds least."""
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, "tie a"), (-2, "tie b"), (-3, "tie a"), (None, None), (-4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("own", F.lit(1))
    gid = {r.text: r.g for r in df.select("text", F.xxhash64(F.col("text").isNull(), "text").alias("g")).collect()}
    n_shards, grain = 5, 4
    size = {}
    for _, t in rows:
        size[t] = size.get(t, 0) + len((t or "").encode()) + 16
    total, items = sum(size.values()), {}
    for t, n in size.items():
        key = (True, gid[t]) if n * n_shards * grain >= total else (False, gid[t] % (n_shards * grain))
        items.setdefault(key, [0, []])
        items[key][0] += n
        items[key][1].append(t)
    load, shard = [0] * n_shards, {}
    for key, (n, texts) in sorted(items.items(), key=lambda x: (-x[1][0], x[0])):
        s = load.index(min(load))
        load[s] += n
        shard |= dict.fromkeys(texts, s)
    got = sharding.assign(df, n_shards, grain, slot_rows=10).collect()
    text = {i: t for i, t in rows if i is not None}
    assert all(r.shard == shard[text.get(r.doc_id)] for r in got) and len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_midpoints_for_other_radii(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6)
    fps = sorted({int(b) ^ sum(1 << int(i) for i in rng.choice(62, rng.integers(0, 9), replace=False)) for b in base for _ in range(12)} | {0, 63})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for within in (2, 4, 6):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= within:
                    root[max(find(a), find(b))] = min(find(a), find(b))
        some = df if within < 6 else spark.createDataFrame([(0,), (63,), (1 << 40,)], "fp long")
        got = {r.node: r.root for r in components(simhash.midpoints(some, within)).collect()}
        want = {x: find(x) for x in fps if find(x) != x} if within < 6 else {63: 0, 1 << 40: 0}
        if within == 6:
            assert (0 ^ 1 << 40).bit_count() <= 6
        assert got == want
    with pytest.raises(ValueError):
        simhash.midpoints(df, 3)


def test_coordinates_tell_the_bits():
    fps = np.random.default_rng(1).integers(0, 1 << 64, 100, np.uint64, endpoint=False)
    assert (simhash.coordinates(fps) == fps).all()


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 2000)] + [(i, i + 1) for i in range(5000, 5100)] + [(7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 2000)} | {i: 5000 for i in range(5001, 5101)}


def test_edit_distance_within():
    rng = np.random.default_rng(8)
    for _ in range(2000):
        a = "".join(rng.choice(list("ab"), rng.integers(0, 9)))
        b = "".join(rng.choice(list("ab"), rng.integers(0, 9)))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert line_dedup.within(a, b) == (row[-1] <= 2)
