"""Chunked encoding against the tokenizers library, alignment against a plain count, on real and odd tables."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cladewright.llm import alignment, bpe, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key binary, uid string, n_tokens int, groups int, row int, g int"
TEXTS = [
    "it's they're  <|endoftext|> a\n\n b", "", None, "   ", "é" * 5000, "a" * 40000, "中文 字。　x" * 900, "word " * 30000, "<|endo", "x" + "<|endoftext|>" * 700 + "'s", "tail \t\x00   　 end",
    "the same passage, again and again. " * 200, "and now " + "the same passage, again and again. " * 200, "😀 <s> </s> <unk> <0x41>",
]


@pytest.fixture(scope="module")
def spec():
    return bpe.spec_of(bpe.path_of("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def model():
    with open(bpe.path_of("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, b"k", "u", 1, 1, 1, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0], None, None, None, None, None, None), (None, TEXTS[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def digest(x):
    return hashlib.sha256(x).hexdigest()


def library_rows(spec, rows):
    t = Tokenizer.from_str(spec)
    out = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((i, len(ids), digest(",".join(map(str, ids)).encode()), digest(t.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out, key=repr)


def test_both_encoders_know_the_same_characters_and_entries(spec):
    made = bpe.codec(spec)
    for low in [*range(0, 0x3100, 64), *range(0x3100, 0x110000, 4096)]:
        chars = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        text = "\n".join(f"x{c}1{c} {c}  {c}!{c}'s{c}{c}" for c in chars)
        assert made.whole.encode(text, add_special_tokens=False).ids == made.fast.encode(text, allowed_special="all"), hex(low)
    for i, b in enumerate(made.bytes):
        try:
            assert made.plain(b.decode().encode()).tolist() == made.whole.encode(b.decode(), add_special_tokens=False).ids == [i]
        except UnicodeDecodeError:
            continue


def test_joined_chunks_equal_the_whole(spec):
    made, rnd = bpe.codec(spec), random.Random(7)
    parts = ["the ", "it's", "they're", " ", "  ", "\n", "\n\n", "é", "中文字", "。", "　", "<|endoftext|>", "<|endo", "ftext|>", "12", "4 5", "!!", "'s", " ", "\t", "😀", "a" * 50, "́", "\x00", "''"]
    for n in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3000)))
        raw = text.encode()
        ends = bpe.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        if n % 2:  # cuts that the rolling hash would not make
            ends = sorted({len(text[:rnd.randint(1, len(text))].encode()) for _ in range(9)} | {len(raw)})
        cuts = [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        assert made.joined([(made.plain(c), c) for c in cuts]).tolist() == made.whole.encode(text, add_special_tokens=False).ids


def test_chunks_are_cut_by_content():
    rnd = random.Random(1)
    shared = "".join(rnd.choice("abcdefg é\n") for _ in range(20000)).encode()

    def cut(raw):
        ends = bpe.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        return {raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)}

    one, two = cut(b"start " + shared), cut(b"quite another start, " * 30 + shared)
    assert len(one & two) > len(one) - 4
    assert all(bpe.LEAST <= len(c) <= bpe.MOST + 3 for c in sorted(one, key=shared.find)[:-1] if not shared.endswith(c))
    assert bpe.chunk_ends(np.empty(0, np.uint8), np.array([0, 0])) == [[]]


def test_encoded_documents_equal_the_library(spark, spec, odd, none):
    got = queries.op11_bpe(spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == library_rows(spec, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    got = bpe.encode_documents(odd, spec).collect()
    assert sorted(map(tuple, got), key=repr) == library_rows(spec, [(r.doc_id, r.text) for r in odd.collect()])
    assert bpe.encode_documents(none, spec).collect() == []


def test_shared_chunks_are_encoded_once(spark, spec):
    rnd = random.Random(5)
    body = " ".join("".join(rnd.choice("aeioustrnl") for _ in range(6)) for _ in range(3000))
    docs = spark.createDataFrame([(i, f"{i} " * i + body) for i in range(40)], "doc_id long, text string")
    n = bpe.counted(docs).collect()
    assert sum(r.n == 40 for r in n) > 10 and sum(r.n for r in n if r.n > 1) > 0.8 * sum(r.n for r in n)
    assert sorted(map(tuple, bpe.encode_documents(docs, spec).collect()), key=repr) == library_rows(spec, [(r.doc_id, r.text) for r in docs.collect()])


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(bpe.spec_of(bpe.path_of("word_bpe_49k.json")))


def test_byte_alphabet_is_the_files():
    ranks = {base64.b64decode(a) for a in (line.split()[0] for line in open(bpe.path_of("byte_bpe_50k.tiktoken"), "rb"))}
    assert {bytes([b]) for b in bpe.byte_alphabet().values()} <= ranks and len(bpe.byte_alphabet()) == 256


def plain_alignment(rows, spec, model):
    """All overlaps of all tokens, counted one by one."""
    t, sp = Tokenizer.from_str(spec), sentencepiece.SentencePieceProcessor(model_proto=model)
    t.encode_special_tokens = True
    alphabet, docs = bpe.byte_alphabet(), []
    for i, x in rows:
        e = t.encode(" " + (x or ""), add_special_tokens=False)
        a = [(k, len(tok)) for k, tok in zip(e.ids, e.tokens, strict=True)]
        said = [sp.id_to_piece(k) for k in sp.encode(x or "")]
        b = [(sp.piece_to_id(p), bytes([int(p[3:5], 16)]) if sp.is_byte(sp.piece_to_id(p)) else p.replace("▁", " ").encode()) for p in said]
        raw = (" " + (x or "")).encode()
        if not x or b"".join(p for _, p in b) != raw or bytes(alphabet[c] for tok in e.tokens for c in tok) != raw:
            docs.append((i, [], [], [], None))
            continue
        spans, ends = [], []
        for own in (a, [(k, len(p)) for k, p in b]):
            at, mine = 0, []
            for k, n in own:
                mine.append((at, at + n, k))
                at += n
            spans.append(mine)
            ends.append({s[1] for s in mine})
        links, low = [], 0
        for s, f, k in spans[0]:
            while spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(spans[1]) and spans[1][j][0] < f:
                links.append((k, spans[1][j][2]))
                j += 1
        groups, last = [], 0
        for c in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(k) for s, f, k in own if last < f <= c) if len(own) < 3000 else "" for own in spans))
            last = c
        docs.append((i, *spans, links, groups if max(map(len, spans)) < 3000 else "long"))
    times = Counter(p for d in docs for p in set(d[3]))
    most = defaultdict(int)
    for (a, _), n in times.items():
        most[a] = max(most[a], n)
    return sorted(((i, len(a), len(b), len(links), sum(times[p] == most[p[0]] for p in links), sum(times[p] for p in links),
                    "" if groups is None else "long" if groups == "long" else digest(";".join(groups).encode())) for i, a, b, links, groups in docs), key=repr)


def aligned(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum, r.groups_sha256 if max(r.n_a, r.n_b) < 3000 else "long") for r in df.collect()), key=repr)


def test_alignment_equals_a_plain_count(spark, spec, model, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert aligned(queries.op12_alignment(spark, SF)) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()], spec, model)
    assert aligned(alignment.align(odd, spec, model)) == plain_alignment([(r.doc_id, r.text) for r in odd.collect()], spec, model)
    assert alignment.align(none, spec, model).collect() == []


def test_rare_groups_are_looked_up_like_frequent_ones(spark, spec, model, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = aligned(alignment.align(docs, spec, model))
    monkeypatch.setattr(alignment, "FREQUENT", 64)
    monkeypatch.setattr(alignment, "AT_ONCE", 5000)
    assert aligned(alignment.align(docs, spec, model)) == want


def test_interned_groups_that_share_a_hash():
    ids, sizes, other, others = np.array([1, 2, 1, 2, 3]), np.array([2, 2, 1]), np.array([7, 7, 7]), np.array([1, 1, 1])
    first, which = alignment.interned(ids, sizes, other, others)
    assert len(first) == 2 and which[0] == which[1] != which[2]
