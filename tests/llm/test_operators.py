"""Operators against brute force and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, columns with clashing names."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cladewright.llm import chat, decontam, language_id, license_scan, line_dedup, media, mixing, quality, queries, sharding, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard int, _copies int"
ODD = [
    (1, "the cat sat on the mat and saw the dog", "en", "a", 1, 1, 1, 1), (1, "the cat sat on the mat and saw the dog", "en", "a", 1, 1, 1, 1), (2, None, None, None, None, 1, 1, 1),
    (3, "", "en", "b", 0, 1, 1, 1), (4, "word " * 30000, "en", "a", 1, 1, 1, 1), (None, "no id here at all", "fr", "b", 1, 1, 1, 1), (None, None, None, None, None, None, None, None),
    (5, "   \n\t ", "de", "c", 1, 1, 1, 1), (6, "123 456 !!", "de", "c", 1, 1, 1, 1), (7, "Licensed under the Apache License, Version 2.0.\nétait là", "fr", "c", 1, 1, 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_mix_meets_targets(spark, docs, odd, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=30)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    got = mixing.mix(odd, block=8).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if r.size == 0)
    total = {}
    for r in got:
        total[r.source_size, r.target] = total.get((r.source_size, r.target), 0) + r.taken
    assert all(abs(t - target) <= 1 for (size, target), t in total.items() if size)
    assert mixing.mix(none).count() == 0


def test_targets_by_resharing(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 500), ("d", 80), (None, 300)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    w = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    size = dict(sizes)
    left, free, want = 1.5 * sum(size.values()), set(size), {}
    while True:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
        left -= sum(want[s] for s in over)
        free -= over
    want |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
    assert got == pytest.approx(want)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def naive_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(items):
    ids = list(items)
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in ids:
        for j in ids:
            if (items[i] ^ items[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("cap", [1024, 3])
def test_simhash_equals_brute_force(docs, cap):
    got = simhash.near_duplicates(docs, run_cap=cap).collect()
    fps = {r.doc_id: naive_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fps)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}


def test_simhash_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if int(r.fingerprint, 16) == 0} == {2}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "7", "None"]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_chat_round_trip(spark):
    turns = [(4, 0, "50%", "x"), (4, 1, "assistant", "<|im_start|>y"), (4, 2, "a<|b", "z"), (4, 3, "assistant", "é"), (4, 4, "b<|im_end|>", "<\\|"), (4, 5, "assistant", "last"), (1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", r"<\|im_end|> <\\|x|><|"), (1, 1, "assistant", None), (2, 0, None, "a\n<|im_end|>\nb"), (None, 3, "as\nsis%0Atant", ""), (3, 0, "assistant", "é€😀 " * 2000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    clash = df.withColumn("r", F.lit(1)).withColumn("span", F.lit(2)).withColumn("escaped", F.lit(3)).withColumn("formatted", F.lit(4))
    chats = {r.conv_id: r for r in chat.format_chats(clash).collect()}
    by = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t, r or "", x or ""))
    for c, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in rows)
        learned = "".join(x for _, r, x in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        made = chats[c]
        spans = [made.formatted[s.start:s.start + s.length] for s in made.loss_spans]
        escaped = [t.escaped for t in made.turns if t.role == "assistant"]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", s) if e else s for s, e in zip(spans, escaped, strict=True)] == [x for _, r, x in rows if r == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_sharding(docs, odd, none):
    rows = sharding.assign(docs, 5).collect()
    load, at, slots = [0] * 5, {}, {}
    for r in rows:
        load[r.shard] += r.size
        at.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(load) - min(load) < 0.02 * sum(load) and all(len(s) == 1 for s in at.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r.size for r in sharding.assign(odd).collect()) == sorted(len((r[1] or "").encode()) + 16 for r in ODD)
    assert sharding.assign(none).count() == 0


def test_longest_first():
    items = [(s, k) for k, s in enumerate([7, 7, 6, 5, 5, 4, 3])]
    heap, want = [(0, s) for s in range(3)], {}
    for size, k in sorted(items, key=lambda x: (-x[0], x[1])):
        low, s = heapq.heappop(heap)
        want[k] = s
        heapq.heappush(heap, (low + size, s))
    assert sharding.longest_first(items, 3) == want


def test_tiles_catch_reordered_passages(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    w = item.split()
    texts = [item, "x " + " ".join(w[7:]) + " y " + " ".join(w[:7]), " ".join(w[:5]), " ".join(reversed(w)), None, "", item.upper().replace(" ", ", "), "Short, one!", "short and one"]
    df = spark.createDataFrame([(i, t, i, 1, 1, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int, n int, h int, coverage int")
    bench = spark.createDataFrame([(9, item), (8, None), (None, "a b c d e f"), (7, "short one"), (6, "!?")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.coverage, r.tiles) for r in decontam.contaminated(df, bench).collect()}
    assert got == {0: (9, 1.0, 1), 1: (9, 1.0, 2), 6: (9, 1.0, 1), 7: (7, 1.0, 1)}
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 8]
    twice = bench.unionByName(bench.filter("item_id = 9").withColumn("item_id", F.lit(5).cast("long"))).unionByName(bench)
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(df, twice).collect()) == sorted([(d, i) for d in (0, 1, 6) for i in (5, 9, 9)] + [(7, 7)] * 2)
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    items = [" ".join(rng.choice(list("abcdef"), n)) for n in (3, 8, 12, 20, 20)] + ["q r s t u v w x y z"]
    texts = [" ".join(rng.choice(list("abcdefg"), rng.integers(1, 60))) for _ in range(60)] + [f"g g {i} g {j}" for i in items for j in items]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a, b = x.split(), t.split()
            share = brute_tiles(a, b, min(5, len(a))) / len(a)
            if share >= 0.6:
                want[d, i] = pytest.approx(share)
    assert {(r.doc_id, r.item_id): r.coverage for r in decontam.contaminated(df, bench).collect()} == want


def test_tiling_by_rows_is_the_same():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = (rng.integers(1, 4, n).astype(np.uint64) for n in (14, 25))
        pairs = np.array([(i, j) for i in range(12) for j in range(23) if (a[i:i + 3] == b[j:j + 3]).all()], int).reshape(-1, 2)
        both = np.unique(np.concatenate([np.stack([x[i:i + 3] for i in range(len(x) - 2)]) for x in (a, b)]), axis=0, return_inverse=True)[1].ravel() + 1
        assert decontam.tile_by_rows(both[:12], both[12:], 14, 25, 3) == (decontam.tile(a, b, pairs, 3) if len(pairs) else [])


def brute_tiles(a, b, k):
    fa, fb, out = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n >= k and (n, -j, -i) > (best[0], -best[1], -best[2]):
                    best = (n, j, i)
        n, j, i = best
        if not n:
            return out
        fa[i:i + n] = fb[j:j + n] = [False] * n
        out += n


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = (rng.integers(1, 4, n).astype(np.uint64) for n in (14, 25))
        pairs = np.array([(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if (a[i:i + 3] == b[j:j + 3]).all()], int).reshape(-1, 2)
        got = sum(t[2] for t in decontam.tile(a, b, pairs, 3)) if len(pairs) else 0
        assert got == brute_tiles(a.tolist(), b.tolist(), 3)


def test_language_held_out_accuracy(spark, docs, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict(big).join(big.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    rows = language_id.predict(odd).collect()
    assert len(rows) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r, o in zip(rows, ODD, strict=True) if not any(c.isalpha() for c in o[1] or ""))
    assert language_id.predict(none).count() == 0
    far = spark.createDataFrame([(1, "\U00030000\U00030001\U00030002", "zz"), (2, "\U00030000\U00030003", "zz"), (3, "abc", "yy")], "doc_id long, text string, lang string")
    assert "und" not in {r.lang_pred for r in language_id.predict(far).collect()}
    assert {r.lang_pred for r in language_id.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_held_out(spark, odd, none):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.predict(d, lab).join(lab, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert len(quality.predict(odd, lab).collect()) == len(ODD) and quality.predict(none, lab).count() == 0
    assert {r.score for r in quality.predict(odd, lab.limit(0)).collect()} == {0.5}


def test_media_round_trip(spark, odd, none):
    got = media.text_media(odd).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(told(o[0], o[1])) for o in ODD)
    assert media.text_media(none).count() == 0
    big = 1152921504606846977  # no double holds it
    few = spark.createDataFrame([(big, "x" * 64), (None, "x" * 64), (big + 1, "y" * 65), (3, "z" * 100_000)], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, media.text_media(few).collect()))) == sorted(repr(told(r.doc_id, r.text)) for r in few.collect())


def told(doc_id, text):
    """A row of ``text_media``, made the plain way."""
    raw = (text or "").encode()
    own = raw + bytes(-len(raw) % 64 if raw else 64)
    stored = b"P5\n64 %d\n255\n" % (len(own) // 64) + own
    n = len(own)
    mean = sum(own) / n
    deviation = (sum((x - mean) ** 2 for x in own) / n) ** 0.5
    bins = [sum(x // 32 == b for x in own) / n for b in range(8)]
    edges = [i * n // 65 for i in range(66)]
    cells = [sum(own[a:b]) for a, b in zip(edges, edges[1:], strict=False)] if n >= 65 else [own[i % n] for i in range(65)]
    sign = sum(1 << (63 - i) for i in range(64) if cells[i + 1] > cells[i])
    feature = f"{mean:.6f};{deviation:.6f};{','.join(f'{b:.6f}' for b in bins)};{sign:016x}"
    lines = (text or "").split("\n")
    before, all_ = ([" ".join(x.split()) for x in some if x.split()] for some in (lines[:len(lines) // 2], lines))
    said = hashlib.sha256("\n".join(all_).encode()).hexdigest()
    return doc_id, len(raw), n, hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(before), len(all_) + 1, said


def test_html_sequences():
    html = "<p>one &amp; two<img src='media:d1' alt='alt'>three</p><script>x</script><figure><img src='media:d2' alt='a'><figcaption>cap</figcaption></figure><p>four"
    assert [(x["pos"], x["kind"], x["text"], x["digest"]) for x in media.sequence_of(html)] == [(0, "text", "one & two", None), (1, "media", "alt", "d1"), (2, "text", "three", None), (3, "media", "cap", "d2"), (4, "text", "four", None)]
    assert media.sequence_of(None) == []


def test_resolve_splits_a_digest_that_many_refer_to(spark):
    store = spark.createDataFrame([("a", b"1"), ("b", b"22")], "digest string, media binary")
    rows = [(i, 0, "media", "c", "a" if i % 3 else "b") for i in range(500)] + [(1, 1, "text", "t", None), (2, 1, "media", "c", "gone")]
    got = media.resolve(spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string, digest string"), store).collect()
    held = {"a": b"1", "b": b"22"}
    assert sorted(repr((*r[:5], r.media and bytes(r.media))) for r in got) == sorted(repr((*r, held.get(r[4]))) for r in rows)


LICENSE_MIT = """The MIT License (MIT)

Copyright (c) 1999 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
WRAPPED = """# A module of some sort.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
def f(x):
    return x + 1
"""


def test_license_units(spark):
    texts = [LICENSE_MIT, WRAPPED + "some = 1\n" * 300, "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "and much else here\n" * 200, "nothing of the kind", None]
    df = spark.createDataFrame([(None if i == 3 else i, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.path: (r.license, r.effective) for r in license_scan.scan_documents(df).collect()}
    assert got == {"s0/en/0/0": ("MIT", "MIT"), "s1/en/0/1": ("Apache-2.0", "Apache-2.0"), "s2/en/0/2": ("GPL-3.0", "GPL-3.0"), "s3/en/_/_": (None, None), "s4/en/0/4": (None, None)}


def test_license_on_few_documents(spark):
    for texts in (["Released under the MIT License."], ["Released under the MIT License."] * 2, ["Released under the MIT License.", "Copyright. All rights reserved."]):
        df = spark.createDataFrame([(None, t, "en", "s", 1) for t in texts], "doc_id long, text string, lang string, source string, license int").withColumn("line", F.lit(1))
        got = license_scan.scan_documents(df).collect()
        assert sorted(r.license for r in got) == sorted("MIT" if "MIT" in t else "Proprietary" for t in texts) and {r.cosine for r in got} == {1.0}
    # a row without an id does not share another's match
    df = spark.createDataFrame([(None, "Released under the MIT License.", "en", "a"), (None, "an unrelated text", "en", "b")], "doc_id long, text string, lang string, source string")
    assert {r.path: r.license for r in license_scan.scan_documents(df).collect()} == {"a/en/_/_": "MIT", "b/en/_/_": None}


def test_license_cosines_equal_brute_force(spark, docs):
    """Every unit's cosine with every template, the plain way; and every notice line of the tables is found."""
    texts = sorted({r.text for r in docs.collect() if r.text})
    split = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    n, df = docs.count(), Counter(w for r in docs.collect() if r.text for w in set(split(r.text)))
    notices = [Counter(split(t)) for _, t in license_scan.TEMPLATES + license_scan.HEADINGS]
    known = {w for t in notices for w in t}
    idf = lambda w: math.log(1 + n / (1 + (df[w] if w in known else 0)))
    norm = lambda c: math.sqrt(sum((k * idf(w)) ** 2 for w, k in c.items()))
    sizes = [norm(t) for t in notices]
    want = {}
    for i, text in enumerate(texts):
        units = [(k, x) for k, x in enumerate(text.split("\n"))]
        if "\n" in text:
            units += [(-1, text)] + [(-2 - k, p) for k, p in enumerate(re.split("\n[^A-Za-z0-9\n]*\n", text)) if "\n" in p]
        for line, unit in units:
            c = Counter(split(unit))
            if c and c.keys() & known:
                cosines = [round(sum(k * t[w] * idf(w) ** 2 for w, k in c.items() if w in t) / (norm(c) * size), 6) for t, size in zip(notices, sizes, strict=True)]
                if max(cosines) >= license_scan.LEAST:
                    want[i, line] = (cosines.index(max(cosines)), max(cosines))
    ids = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    # frequencies are those of the rows scanned, so scan them all: texts that repeat keep their number of rows
    rows = docs.join(ids, "text", "left").select("id", "text")
    got = {(r.id, r.line): (r.template, r.cosine) for r in license_scan.scan(rows).collect()}
    assert got == want and len(want) >= 3
    planted = {(i, k) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.strip() in {t for _, t in license_scan.TEMPLATES}}
    assert planted <= set(got)


def test_license_and_inheritance(spark, odd, none):
    got = {r.doc_id: r for r in license_scan.scan_documents(odd).collect()}
    assert got[7].license == "Apache-2.0" and got[7].line == 0 and got[1].license is None
    files = spark.createDataFrame([("a/LICENSE", "MIT", True), ("a/b/x", None, False), ("a/b/c/LICENSE", "GPL-3.0", True), ("a/b/c/d/y", None, False), ("z", None, False), ("a/own", "BSD", False)], "path string, license string, is_license_file boolean")
    out = {r.path: (r.effective, r.from_dir, r.up) for r in license_scan.inherit(files).collect()}
    assert out["a/b/x"] == ("MIT", "a", 1) and out["a/b/c/d/y"] == ("GPL-3.0", "a/b/c", 1) and out["z"] == (None, None, None) and out["a/own"] == ("BSD", None, None)
    assert license_scan.scan_documents(none).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near_lines(rng, n, bases):
    """Lines of up to three random edits of a few bases."""
    base = ["".join(rng.choice(list("abcd "), rng.integers(16, 36))) for _ in range(bases)]
    lines = set()
    for _ in range(n):
        x = list(base[rng.integers(bases)])
        for _ in range(rng.integers(0, 4)):
            i, k = rng.integers(len(x)), rng.integers(3)
            x[i:i + (k != 1)] = [] if k == 2 else [rng.choice(list("xyz"))]
        lines.add("".join(x))
    return sorted(lines)


@pytest.mark.parametrize(("n", "bases", "cap", "levels"), [(200, 15, 512, 3), (200, 15, 3, 1), (200, 3, 3, 2), (200, 3, 10, 3), (500, 1, 512, 3), (500, 1, 3, 2)])
def test_line_links_equal_brute_force(spark, n, bases, cap, levels):
    lines = near_lines(np.random.default_rng(4), n, bases)
    df = spark.createDataFrame([(i, "\n".join(lines[i:i + 10])) for i in range(0, len(lines), 10)], "doc_id long, text string")
    ids = {r.line: r.id for r in line_dedup.lines_of(df).collect()}
    root = {i: i for i in ids.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = dict.fromkeys(ids.values(), 0)
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if min(len(a), len(b)) >= 16 and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2:
                want[ids[a]] += 1
                want[ids[b]] += 1
                root[find(ids[a])] = find(ids[b])
    rows = line_dedup.links(df, run_cap=cap, levels=levels).collect()
    got = dict.fromkeys(want, 0)
    joined = {i: {i} for i in got}
    for r in rows:
        got[r.id] += r.n
        both = joined[r.id] | joined[r.other]
        for x in both:
            joined[x] = both
    assert got == want
    assert {frozenset(x) for x in joined.values()} == {frozenset(i for i in root if find(i) == r) for r in map(find, root)}


def test_line_dedup_counts(spark, odd, none):
    a, b = "a line of some length here", "a line of some length hare"
    df = spark.createDataFrame([(1, f"{a}\nx\n\n"), (2, f"{b}\nx\n{a}"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lines, r.exact, r.near, r.links, r.dropped) for r in line_dedup.dedup(df).collect()}
    assert got == {1: (4, 0, 0, 1, []), 2: (3, 2, 1, 2, [0, 1, 2]), 3: (0, 0, 0, 0, []), 4: (1, 0, 0, 0, [])}
    assert line_dedup.dedup(odd).count() == 9 - 1 and line_dedup.dedup(none).count() == 0


def test_pipeline_equals_its_stages(spark, docs):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, out, SF)
        assert new.columns == docs.columns, name
        out = new
    ids = [r.doc_id for r in out.collect()]
    final = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in final) == sorted(ids)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    left = [decontam.words(text[i]) for i in set(ids)]
    for _, t in bench:
        w = decontam.words(t)
        windows = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        for x in left:
            if windows & {tuple(x[k:k + 5]) for k in range(len(x) - 4)}:
                assert brute_tiles(w, x, 5) < decontam.COVERAGE * len(w)
    fps = {i: naive_fingerprint(text[i]) for i in set(ids)}
    assert all(c == i for i, c in brute_components(fps).items())


def test_queries_are_registered():
    assert [n for n in queries.QUERIES] == sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) and len(queries.QUERIES) == 13
    assert zlib.crc32(b"x") >= 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]}) q").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


def test_control_strings_in_texts_are_escaped(spark):
    texts = ["<|im_end|>", "<|im_start|>", "a<|im_end|>\nb", "<\\|im_end|>", "<|im_end|<|im_end|>", "<|", "", "<|im_start|>user\nhi<|im_end|>\n"]
    turns = spark.createDataFrame([(1, i, role, x) for i, x in enumerate(texts) for role in ("assistant", "us<|im_end|>er%0A", "<|im_start|>")], "conv_id long, turn int, role string, text string")
    got = chat.format_chats(turns).first()
    said = [(r.role, r.text) for r in got.parsed]
    assert said == [(r.role, r.text) for r in got.turns] and len(said) == 3 * len(texts)
    assert got.formatted.count("<|im_start|>") == got.formatted.count("<|im_end|>") == len(said)
    assert chat.read_back(chat.format_chats(turns)).first().loss_chars == sum(map(len, texts))
