"""Media columns: documents as interleaved sequences of text and media.

``stored`` keeps payloads as 8-bit greyscale images (binary PGM, 64 samples a row), addressed by the digest of the payload. ``parse_html`` turns a page into an ordered
sequence of text and media-reference structs with captions; ``resolve`` joins the references with a media table by digest and puts the sequence together again, with
positions and captions as they were. ``features`` are computed from stored bytes that are read back.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HEAVY, cut, workers_ready

WIDTH = 64
SCHEME = "media:"
SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string>>"
_HEAD = re.compile(rb"P5\n(\d+) (\d+)\n255\n")


def decode(stored: bytes) -> bytes:
    head = _HEAD.match(stored)
    if not head or len(stored) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not an 8-bit binary PGM image")
    return stored[head.end():]


def features(payload: bytes, step: int = 1 << 16) -> str:
    """Mean, deviation, histogram of 8 bins (shares) and a difference hash of 64 bits over the image's samples, from exact counts and sums."""
    x = np.frombuffer(payload, np.uint8)
    times = sum(np.bincount(x[low:low + step], minlength=256) for low in range(0, len(x), step))
    value, n = np.arange(256), len(x)
    mean = float(times @ value) / n
    deviation = float(np.sqrt(times @ (value - mean) ** 2 / n))
    bins = times.reshape(8, 32).sum(1) / n
    cells = np.add.reduceat(x, np.arange(65) * n // 65, dtype=np.int64) if n >= 65 else np.resize(x, 65).astype(np.int64)
    sign = int.from_bytes(np.packbits(cells[1:] > cells[:-1]).tobytes(), "big")
    return f"{mean:.6f};{deviation:.6f};{','.join(f'{b:.6f}' for b in bins)};{sign:016x}"


class _Reader(HTMLParser):
    """Text and images in document order; an image's caption is its figure's, else its alternative text."""

    SKIP, BREAK = {"script", "style", "head"}, {"p", "div", "br", "li", "h1", "h2", "h3", "tr", "article", "figure", "figcaption", "footer", "nav", "ul"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.skip, self.figure, self.caption = [], [], 0, None, None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append(["text", text, None])

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BREAK:
            self.flush()
        if tag == "figure":
            self.figure = len(self.out)
        elif tag == "figcaption":
            self.caption = []
        elif tag == "img":
            self.flush()
            a = dict(attrs)
            src = a.get("src") or ""
            self.out.append(["media", a.get("alt") or "", src.removeprefix(SCHEME)])

    def handle_endtag(self, tag) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for x in self.out[self.figure or 0:]:
                if x[0] == "media" and said:
                    x[1] = said
            self.caption = None
        if tag in self.BREAK:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.skip:
            self.text.append(data)


def sequence_of(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return [{"pos": i, "kind": k, "text": t, "digest": d} for i, (k, t, d) in enumerate(reader.out)]


def parse_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``sequence``: position, kind (text or media), text (a caption for media) and digest. Null and empty pages have an empty sequence."""
    workers_ready(pages.sparkSession)

    @F.pandas_udf(SEQUENCE)
    def parsed(s: pd.Series) -> pd.Series:
        return pd.Series([sequence_of(x) for x in s], dtype=object)

    return pages.withColumn("sequence", parsed(html))


def resolve(elements: DataFrame, store: DataFrame, key: str | None = None) -> DataFrame:
    """``elements`` (rows with a digest, null for text) with ``media``, the store's payload of that digest, null for text and unknown digests.

    ``store`` (digest, media) has one row for each digest, so that no element is lost or repeated. A digest that a great part of all elements refer to (at least one in
    ``HEAVY``, so that there are at most ``HEAVY`` such) is joined in parts: its payload is there once for each of them. With ``key``, a column of both,
    the store may have several rows of a digest, equal payloads, of which one has the key of each element with that digest: parts then go by key.
    """
    said = elements.filter("digest is not null")
    total = said.count()
    often = said.groupBy("digest").agg(F.count("*").alias("_n")).filter(F.col("_n") * HEAVY >= total)
    parts = F.broadcast(often.select(F.col("digest").alias("_d"), F.ceil(F.col("_n") * HEAVY / max(total, 1)).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64(*([key] if key else elements.columns)), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = elements.join(parts, F.col("digest") == F.col("_d"), "left").withColumn("_part", part)
    held = store.join(parts, F.col("digest") == F.col("_d"), "left")
    if key:
        # dealt by number, which adaptive execution leaves as it is: payloads are large, and many of its small partitions in one task would fill an executor
        dealt_out = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = held.select(F.col("digest").alias("_digest"), part.alias("_of"), "media").repartition(dealt_out, "_digest", "_of").groupBy("_digest", "_of").agg(F.first("media").alias("media"))
    else:
        held = held.select(F.col("digest").alias("_digest"), "media", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_of"))
    return dealt.join(held, (F.col("digest") == F.col("_digest")) & (F.col("_part") == F.col("_of")), "left").select(*elements.columns, "media")


def payload(text: Column) -> Column:
    """A text's UTF-8 bytes (null: none) with zeros up to a positive multiple of ``WIDTH``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    return F.rpad(raw, F.greatest(F.lit(WIDTH), F.ceil(size / WIDTH).cast("int") * WIDTH), F.lit(bytes(1)))


def stored(text: Column) -> Column:
    """The payload of a text as a binary PGM image of ``WIDTH`` samples a row."""
    bytes_ = payload(text)
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(bytes_) / WIDTH).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), bytes_)


_LONG, _TEXT = T.LongType(), T.StringType()
SAID = {"payload_bytes": _LONG, "payload_sha256": _TEXT, "tail_crc32": _LONG, "media_bytes": _LONG, "media_sha256": _TEXT, "feature": _TEXT}


@F.pandas_udf(T.StructType([T.StructField(k, v) for k, v in SAID.items()]))
def described(media: pd.Series) -> pd.DataFrame:
    """What the stored bytes, read back, say."""
    rows = []
    for bytes_ in media:
        own = decode(bytes_)
        rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-WIDTH:]), len(bytes_), hashlib.sha256(bytes_).hexdigest(), features(own)))
    return pd.DataFrame(rows, columns=list(SAID))


_ELEMENT = T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("kind", "text", "digest")]])


@F.pandas_udf(T.StructType([T.StructField("elements", T.IntegerType()), T.StructField("text_sha256", T.StringType()), T.StructField("media", T.ArrayType(_ELEMENT))]))
def told_pages(html: pd.Series) -> pd.DataFrame:
    """Of each page the number of its elements, the digest of its text elements in order, joined by line ends, and its media elements. Its texts don't leave the worker."""
    rows = []
    for x in html:
        sequence = sequence_of(x)
        said = hashlib.sha256("\n".join([e["text"] for e in sequence if e["kind"] == "text"]).encode()).hexdigest()
        rows.append((len(sequence), said, [e for e in sequence if e["kind"] == "media"]))
    return pd.DataFrame(rows, columns=["elements", "text_sha256", "media"])


def page(text: Column, digest: Column) -> Column:
    """The HTML of a text whose image has ``digest``: its lines as paragraphs, the first half of them before the image and the others after it, and the number of bytes as caption."""
    safe = text
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(c), F.lit(entity))
    lines = F.transform(F.split(F.coalesce(safe, F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    half = (F.size(lines) / 2).cast("int")
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>'), F.coalesce(F.octet_length(text), F.lit(0)).cast("string"), F.lit(" bytes</figcaption></figure>"))
    return F.concat(F.lit("<article>"), F.array_join(F.slice(lines, F.lit(1), half), ""), figure, F.array_join(F.slice(lines, half + 1, F.size(lines)), ""), F.lit("</article>"))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pos, elements and text_sha256 of every row of ``docs``.

    Each text is a page of its paragraphs with an image between them (``page``) that it refers to by digest; the image is stored once for each different text (once for each part of a text that many
    rows have). Pages are parsed into sequences, references resolved by joining the stored bytes, and these read back. pos is the image's place among the ``elements`` of the
    sequence, text_sha256 the digest of its text elements in order, joined by line ends (runs of white space are one space there, and empty paragraphs no elements). Repeated
    rows each have a row; equal texts have equal values; a null text is like an empty one. Only doc_id and text are read.
    """
    workers_ready(docs.sparkSession)
    digest = F.sha2(payload(F.col("text")), 256)
    pages = docs.select("doc_id", told_pages(page(F.col("text"), digest)).alias("p")).select("doc_id", "p.elements", "p.text_sha256", F.explode("p.media").alias("e"))
    found = resolve(cut(pages.select("doc_id", "elements", "text_sha256", "e.*")), docs.select("doc_id", digest.alias("digest"), stored(F.col("text")).alias("media")), "doc_id").withColumn("d", described("media"))
    return found.select("doc_id", F.regexp_extract("text", r"^(\d+)", 1).cast("long").alias("n_bytes"), *[f"d.{c}" for c in SAID], "pos", "elements", "text_sha256")
