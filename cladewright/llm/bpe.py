"""Byte-level BPE of whole texts by reuse of content-defined chunks, and decoding.

A rolling hash of the last 32 bytes cuts texts into chunks, so that texts that share passages share chunks, wherever these stand. A chunk that several texts have (or one
has several times) is encoded once, in a job of its own; all others are encoded where they are read. Tokens of two chunks in a row are then joined: what stands
between a stable place of the left and one of the right chunk is encoded again, some more of either side with it, and the window widens until the tokens of
both agree with it exactly; chunks without a stable place are swallowed whole.

A stable place is white space after a character that is none. No piece of the byte-level pattern goes over it whatever stands before or after (a piece has white space
at its start only, or nothing else), and no special token has white space inside, so the tokens between two such places don't depend on what is around.

The tokens are those of the ``tokenizers`` library. Pieces of ordinary size are encoded by ``tiktoken`` from the same vocabulary, which is several times as fast and gives the
same ids (tests compare both over all characters and all entries); long windows without a stable place go to ``tokenizers`` itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import HEAVY, cut, workers_ready

#: Bytes of a chunk: at least, on average beyond that, and at most.
LEAST, MEAN, MOST = 256, 1024, 4096
#: Bits of the bitmap of shared chunks (8 MB), a power of two.
BITS = 1 << 26
#: Longer windows are encoded by ``tokenizers``.
LONG = 1 << 15
#: Chunks whose text a task has given are remembered up to this many.
KNOWN = 1 << 17
_GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, np.uint32, endpoint=False)
#: Fixed value: how byte-level tokenizers cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space or line end after a printing character of ASCII, of U+00C0 to U+07FF or of U+4000 to U+FFFF.
_STABLE = re.compile(rb"(?<=[\x21-\x7e])[ \n]|(?<=[\xc3-\xdf][\x80-\xbf])[ \n]|(?<=[\xe4-\xef][\x80-\xbf]{2})[ \n]")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printing Latin-1 for itself, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE tokenizer from the text of its JSON file. With ``special`` false, the strings of special tokens are ordinary text."""

    def __init__(self, spec: str, special: bool = True) -> None:
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = not special
        d = json.loads(spec)
        pre, added = d["pre_tokenizer"] or {}, d["added_tokens"]
        if d["normalizer"] or d["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level tokenizers are known")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or not x["special"] or re.search(r"\s", x["content"]) for x in added):
            raise ValueError("only plain special tokens are known")
        alphabet, own = byte_alphabet(), {x["content"]: x["id"] for x in added}
        vocabulary = {k: i for k, i in d["model"]["vocab"].items() if k not in own}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in d["model"]["merges"]]
        known = sorted((i, bytes(alphabet[c] for c in k)) for k, i in vocabulary.items())
        self.bytes: list[bytes] = [b""] * (max([*vocabulary.values(), *own.values()]) + 1)
        for i, b in known:
            self.bytes[i] = b
        for k, i in own.items():
            self.bytes[i] = k.encode()
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.kind = np.uint16 if len(self.bytes) <= 1 << 16 else np.int32
        self.names = [str(i) for i in range(len(self.bytes))]
        # ids in the order of the merges are what the fast encoder calls ranks
        ranked = [vocabulary[m] for m in merged]
        self.fast = None
        if ranked == sorted(ranked) and len(known) == len(alphabet) + len(ranked):
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in known}, special_tokens=own)
        self.allowed: set[str] | str = "all" if special else set()

    def plain(self, raw: bytes) -> np.ndarray:
        """The ids of a text by itself."""
        text = raw.decode("utf-8", "replace")
        if self.fast is None or len(raw) > LONG:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.fast.encode(text, allowed_special=self.allowed, disallowed_special=()), np.int32)

    def packed(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.kind).tobytes()

    def unpacked(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).astype(np.int32)

    def decoded(self, ids: np.ndarray) -> bytes:
        said = self.bytes
        return b"".join([said[i] for i in ids.tolist()])

    def joined(self, parts: list[tuple[np.ndarray | None, bytes]]) -> np.ndarray:
        """The ids of a text from those of its chunks: (ids or None, bytes) in order."""
        if not parts:
            return np.empty(0, np.int32)
        out: list[np.ndarray] = []
        ids, raw = parts[0]
        held: list[bytes] = []  # chunks after ``raw`` that have no stable place
        for k, (new_ids, new) in enumerate(parts[1:], 2):
            first = _STABLE.search(new)
            if not first and k < len(parts):
                held.append(new)
                continue
            if ids is None:
                ids = self.plain(raw)
            if new_ids is None:
                new_ids = self.plain(new)
            done, ids, raw = self.join(ids, raw, b"".join(held), new_ids, new)
            out.append(done)
            held = []
        out.append(self.plain(raw) if ids is None else ids)
        return np.concatenate(out)

    def join(self, a: np.ndarray, left: bytes, between: bytes, b: np.ndarray, right: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ids up to a stable place of ``right``, the ids after it and the bytes after it, given the ids ``a`` of ``left`` and ``b`` of ``right``."""
        la, lb = np.cumsum(self.sizes[a]), np.cumsum(self.sizes[b])
        reach = 64
        while True:
            all_left, all_right = reach >= len(left), reach >= len(right)
            # the start of ``left`` is where tokens are known to start, and the end of a ``right`` without a stable place is the end of the text
            low = [0] * all_left + [m.start() for m in _STABLE.finditer(left, max(0, len(left) - reach))]
            high = [m.start() for m in _STABLE.finditer(right, 0, reach)] + [len(right)] * all_right
            if (all_left or len(low) > 1) and (all_right or len(high) > 1):
                outer, inner, near, far = low[0], low[-1], high[0], high[-1]
                new = self.plain(left[outer:] + between + right[:far])
                ends, shift = np.cumsum(self.sizes[new]), len(left) - outer + len(between)
                i, j, u, v = _upto(la, outer), _upto(la, inner), _upto(lb, near), _upto(lb, far)
                x, y = _upto(ends, inner - outer), _upto(ends, shift + near)
                # what is encoded again on either side must agree exactly
                if None not in (i, j, u, v, x, y) and np.array_equal(new[:x], a[i:j]) and np.array_equal(new[y:], b[u:v]):
                    return np.concatenate((a[:j], new[x:y])), b[u:], right[near:]
                if all_left and all_right:
                    raw = left + between + right
                    return np.empty(0, np.int32), self.plain(raw), raw
            reach *= 2

    def encoded(self, raw: bytes) -> np.ndarray:
        """The ids of a text; a long one goes by chunks."""
        if len(raw) <= LONG:
            return self.plain(raw)
        b = np.frombuffer(raw, np.uint8)
        at = chunk_ends(b, np.array([0, len(b)]))[0]
        return self.joined([(None, raw[s:e]) for s, e in zip([0, *at], at, strict=False)])


def _upto(ends: np.ndarray, at: int) -> int | None:
    """How many tokens end at or before ``at``; None if none ends there."""
    k = int(np.searchsorted(ends, at, "right"))
    return k if at == (ends[k - 1] if k else 0) else None


@lru_cache(maxsize=2)
def codec(spec: str, special: bool = True) -> Codec:
    """One for each worker."""
    return Codec(spec, special)


def chunk_ends(b: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text end, from its start. ``b`` has the bytes of all texts, text i from ``offsets[i]`` on."""
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)  # after which h tells the last 2k bytes
    at = np.flatnonzero(h < (1 << 32) // MEAN) + 1
    for _ in range(3):  # on to the start of a character
        inside = at < len(b)
        at[inside] += (b[at[inside]] & 0xC0) == 0x80
    out = []
    first = np.searchsorted(at, offsets + LEAST)
    last = np.searchsorted(at, offsets)
    for i in range(len(offsets) - 1):
        start, end, low, mine = int(offsets[i]), int(offsets[i + 1]), int(offsets[i]), []
        marks = at[first[i]:last[i + 1]].tolist()
        for m in [*marks, end]:
            if m < end and m < start + LEAST:
                continue
            while m - start > MOST:
                p = start + MOST
                while b[p] & 0xC0 == 0x80:
                    p -= 1
                mine.append(p - low)
                start = p
            if m == end or m - start >= LEAST:
                if m > start:
                    mine.append(m - low)
                start = m
        out.append(mine)
    return out


def _texts(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a batch's texts (null: empty) and their offsets."""
    c = batch.column("text")
    c = pc.fill_null(c, "").cast(pa.large_string()) if c.null_count else c.cast(pa.large_string())
    _, at, data = c.buffers()
    offsets = np.frombuffer(at, np.int64)[c.offset:c.offset + len(c) + 1]
    whole = data.to_pybytes()[int(offsets[0]):int(offsets[-1])] if data else b""
    return whole, offsets - offsets[0]


def _key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk, 11)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    whole, offsets = _texts(batch)
    for i, ends in enumerate(chunk_ends(np.frombuffer(whole, np.uint8), offsets)):
        low = int(offsets[i])
        yield i, [whole[low + s:low + e] for s, e in zip([0, *ends], ends, strict=False)]


def counted(docs: DataFrame) -> DataFrame:
    """key and n of each distinct chunk: how often it stands in ``docs``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(c) for _, cs in _chunks(batch) for c in cs], pa.binary())], ["key"])

    return docs.select("text").mapInArrow(keys, "key binary").groupBy("key").agg(F.count("*").alias("n"))


def bitmap(keys: DataFrame) -> bytes:
    """A bitmap of the first bits of all keys: ``BITS`` bits in words of 64, whatever their number."""
    at = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % BITS
    rows = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out.tobytes()


def _is_in(bits: np.ndarray, key: bytes) -> bool:
    at = int.from_bytes(key[:4], "big") % BITS
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)


def _said(made: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    names = made.names
    joined = ",".join([names[i] for i in ids.tolist()]).encode()
    text = made.decoded(ids).decode("utf-8", "replace").encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text).hexdigest()


def encode_documents(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the text that they decode to) of every row of ``docs``.

    ``spec`` is the text of the tokenizer's JSON file. Null and empty texts have no tokens. Repeated rows each have a row, null ids too; no rows give none. Only doc_id
    and text are read.
    """
    spark = docs.sparkSession
    workers_ready(spark)
    some = docs.select("doc_id", "text")
    times = cut(counted(some).filter("n > 1"))
    total = times.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast((spec, bitmap(times)))
    kind = some.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, bits = codec(shared.value[0]), np.frombuffer(shared.value[1], np.uint64)
        uid, given = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            ids_of, out = batch.column("doc_id"), []
            for i, chunks in _chunks(batch):
                uid += 1
                keys = [k if _is_in(bits, k) else None for k in map(_key, chunks)]
                if any(keys):
                    for n, (c, k) in enumerate(zip(chunks, keys, strict=True)):
                        first = k is not None and k not in given
                        if first:
                            given = given if len(given) < KNOWN else set()
                            given.add(k)
                        out.append((i, uid, n, k, c if first else None, None if k else made.packed(made.plain(c)), None, None, None))
                else:
                    out.append((i, uid, None, None, None, None, *_said(made, made.joined([(None, c) for c in chunks]))))
            rows = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids_of.take(pa.array(rows[0], pa.int64())), *[pa.array(c, t) for c, t in zip(rows[1:], kinds, strict=True)]],
                ["doc_id", "uid", "piece", "key", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    pieces = cut(some.mapInArrow(read, f"doc_id {kind}, uid long, piece int, key binary, text binary, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(shared.value[0])
        for batch in batches:
            ids = [made.packed(made.plain(c)) for c in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    texts = pieces.filter("text is not null").groupBy("key").agg(F.first("text").alias("text"))
    # a chunk that only one text has may pass the bitmap; it is encoded here as well
    known = cut(texts.mapInArrow(encode, "key binary, ids binary").select(F.col("key").alias("_key"), F.col("ids").alias("_ids")))
    often = times.filter(F.col("n") * HEAVY >= total).select(F.col("key").alias("_key"))  # HEAVY chunks of MOST bytes at most
    hot = known.join(F.broadcast(often), "_key", "left_semi").select(F.col("_key").alias("_hot"), F.col("_ids").alias("_hot_ids"))
    cold = known.join(F.broadcast(often), "_key", "left_anti")
    refs = pieces.filter("key is not null").select("doc_id", "uid", "piece", "key")
    met = refs.join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left")
    at = F.when(F.col("_hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("no key but the row "), F.col("uid").cast("string")).cast("binary"))  # hot rows stay spread
    met = met.withColumn("_at", at).join(cold, F.col("_at") == F.col("_key"), "left").select("doc_id", "uid", "piece", F.coalesce("_ids", "_hot_ids").alias("ids"))
    parts = met.unionByName(pieces.filter("key is null and piece is not null").select("doc_id", "uid", "piece", "ids"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, uid, doc, held = codec(shared.value[0]), None, None, []

        def close(out: list) -> None:
            if uid is not None:
                out.append((doc, *_said(made, made.joined([(x, made.decoded(x)) for x in held]))))

        def rows(out: list) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (id_kind or pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        id_kind = None
        for batch in batches:
            id_kind, out = batch.column("doc_id").type, []
            for d, u, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "ids")), strict=True):
                if u != uid:
                    close(out)
                    uid, doc, held = u, d, []
                held.append(made.unpacked(x))
            yield rows(out)
        out: list = []
        close(out)
        if out:
            yield rows(out)

    whole = parts.repartition("uid").sortWithinPartitions("uid", "piece").mapInArrow(assemble, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return pieces.filter("piece is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(whole)


def spec_of(path: str) -> str:
    """The text of a tokenizer's JSON file, read by the driver; workers get it with their task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def path_of(name: str) -> str:
    """Where a file of the public tokenizers is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
