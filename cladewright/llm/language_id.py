"""Language identification with hyperdimensional profiles.

Each letter has a pseudorandom vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted by its place (rotated), by multiplication; a text's
vector bundles (adds) those of its n-grams, counted over the whole text with a blank at both ends of words. A language's prototype bundles the vectors of its
training texts, less the mean of all prototypes, which all languages share. A text gets the language whose prototype has the greatest cosine with its own vector.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, workers_ready

DIMS, N = 512, 3
#: Letters share this many vectors; a letter's is that of its code point modulo the number (a prime, above the blocks of most alphabets).
ALPHABET = 521
#: Prototypes are with each worker; more languages than this are refused rather than broadcast.
MAX_LANGUAGES = 4096
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Vector number by code point: 0 for anything but a letter."""
    global _LETTER  # noqa: PLW0603
    if _LETTER is None:
        _LETTER = np.array([i % (ALPHABET - 1) + 1 if chr(i).isalpha() else 0 for i in range(sys.maxunicode + 1)], np.int32)
    return _LETTER


def letter_vectors() -> np.ndarray:
    return (np.random.default_rng(2).integers(0, 2, (ALPHABET, DIMS)) * 2 - 1).astype(np.int8)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (numbers in base ``ALPHABET``) of a whole text and their counts; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    ids = letters()[points]
    ids = np.concatenate(([0], ids, [0]))
    ids = ids[np.concatenate(([True], (ids[1:] > 0) | (ids[:-1] > 0)))]  # a blank for each run of other characters
    if len(ids) < N:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.zeros(len(ids) - N + 1, np.int64)
    for i in range(N):
        codes = codes * ALPHABET + ids[i:len(ids) - N + 1 + i]
    codes.sort()
    start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[start], np.diff(np.append(start, len(codes)))


class Encoder:
    """Text vectors. n-gram vectors are bound once and kept, as long as there are not over ``keep`` of them."""

    def __init__(self, keep: int = 60_000) -> None:
        base = letter_vectors()
        self.base = [np.roll(base, N - 1 - i, axis=1) for i in range(N)]
        self.keep, self.codes, self.rows = keep, np.empty(0, np.int64), np.empty((0, DIMS), np.float32)
        self.part = np.empty((4096, DIMS), np.float32)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out, rest = np.ones((len(codes), DIMS), np.int8), codes
        for i in range(N - 1, -1, -1):
            rest, letter = np.divmod(rest, ALPHABET)
            out *= self.base[i][letter]
        return out.astype(np.float32)

    def know(self, codes: np.ndarray) -> None:
        """Bind and keep n-grams that are new, unless they are too many."""
        new = np.setdiff1d(codes, self.codes)
        if len(new) and len(self.codes) + len(new) <= self.keep:
            all_ = np.concatenate((self.codes, new))
            order = np.argsort(all_)
            self.codes, self.rows = all_[order], np.concatenate((self.rows, self.bind(new)))[order]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of distinct n-grams, each times its count."""
        out = np.zeros(DIMS, np.float32)
        for low in range(0, len(codes), len(self.part)):
            some, n = codes[low:low + len(self.part)], counts[low:low + len(self.part)].astype(np.float32)
            at = np.minimum(np.searchsorted(self.codes, some), max(0, len(self.codes) - 1))
            if len(self.codes) and np.array_equal(self.codes[at], some):
                out += n @ np.take(self.rows, at, axis=0, out=self.part[:len(some)], mode="clip")
            else:
                out += n @ self.bind(some)
        return out

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors; zero for texts without letters."""
        found = [ngrams(t) for t in texts]
        if found:
            self.know(np.unique(np.concatenate([c for c, _ in found])))
        out = np.stack([self.bundle(*f) for f in found]) if found else np.zeros((0, DIMS), np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def total(self, texts: list[str | None]) -> np.ndarray:
        """The bundle of the n-grams of all texts."""
        found = [ngrams(t) for t in texts]
        codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        self.know(codes)
        return self.bundle(codes, np.bincount(at, np.concatenate([n for _, n in found]), len(codes)))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from every text with a language outside the held-out fold. Only sums of one vector for each language leave a task."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(), {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang").text:
                sums[lang] = sums.get(lang, 0) + np.rint(encoder.total(list(texts))).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    workers_ready(docs.sparkSession)
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = known.mapInPandas(bundle, "lang string, v array<long>")
    # integers, so that the order of the parts does not matter
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    p = np.array([r.v for r in rows], np.float64).reshape(-1, DIMS)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    if len(p) > 1:
        p -= p.mean(0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    return [r.lang for r in rows], p.astype(np.float32)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned; else the language, and its cosine mapped to 0 to 1. Ties go to the language
    that sorts first. Equal texts get equal results. Rows with a null id or language are predicted but not learned from.
    """
    langs, prototypes = learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))

    @F.pandas_udf("lang string, score double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, own = shared.value
        encoder = Encoder()
        for s in texts:
            v = encoder.vectors(list(s))
            some = v.any(axis=1) & bool(names)
            cosine = v @ own.T if names else np.zeros((len(s), 1))
            best = cosine.argmax(1)
            yield pd.DataFrame({"lang": [names[b] if ok else "und" for b, ok in zip(best, some, strict=True)], "score": np.where(some, np.clip((1 + cosine[np.arange(len(s)), best]) / 2, 0, 1), 0.0)})

    made = docs.select("doc_id", held_out().alias("held_out"), guess("text").alias("g"))
    return made.select("doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"))
