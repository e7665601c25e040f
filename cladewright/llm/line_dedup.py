"""Line dedup by a segment-partition edit join.

Lines of ``MIN_CHARS`` or more whose edit distance is ``EDITS`` or less link, and links join transitively; shorter lines are matched exactly. A line is split into
``EDITS`` + 1 segments; by the pigeonhole principle a line within ``EDITS`` edits holds one of them unchanged, at a place that differs by no more than the edits
left for either side allow (multi-match-aware windows). Each line is indexed under its own segments and probes the segments of lines as long or up to ``EDITS``
shorter. Lines that meet under a key are candidates, verified by a banded bit-parallel edit distance on what is left between common ends.

No pair ever leaves a task. Only the lines of shared keys get their texts; a task that holds a key's lines verifies each pair whose least shared key this is, so that
a link is found and counted once, and says of each line how many links it found there and one line that it is joined to.

A key with over ``run_cap`` lines is hot. Two lines of hot keys are left to the next level, where lines are split into one segment more and keys are
choices of one segment more (of ``EDITS`` + n segments at least n are unchanged), which are shared by fewer lines. What is hot on the last of ``LEVELS`` is
compared block with block, each two blocks in a task of their own; that alone is quadratic, in groups that share nearly everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, look_up, workers_ready

EDITS, MIN_CHARS, RUN_CAP, LEVELS = 2, 16, 512, 3
#: Ids of at most this many lines are broadcast to find their texts (4 MB); more are joined by a shuffle.
FEW_IDS = 500_000


def segments(n: int, k: int = EDITS + 1) -> list[tuple[int, int]]:
    """Start and length of each of ``k`` even segments of a line of n characters, the longer ones last."""
    low, more = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = low + (i >= k - more)
        out.append((at, size))
        at += size
    return out


def plan(n: int, level: int = 1, edits: int = EDITS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Seed and places (from, to) of each key of a line of n characters; first those under which it is indexed itself, one for each choice of segments."""
    k = edits + level
    choices = list(combinations(range(k), level))
    own = [(n << 32 | c, [(at, at + size) for at, size in (segments(n, k)[i] for i in chosen)]) for c, chosen in enumerate(choices)]
    out = list(own)
    for less in range(edits + 1):
        parts = segments(n - less, k)
        for c, chosen in enumerate(choices):
            for shifts in product(range(-edits, edits + 1), repeat=level):
                path = [0, *shifts, less]
                if sum(abs(y - x) for x, y in zip(path, path[1:], strict=False)) > edits:
                    continue
                i = chosen[0]
                if level == 1 and not (-i <= shifts[0] <= i and abs(less - shifts[0]) <= edits - i):
                    continue  # all of the segments before may have changed once, and all after
                places = [(parts[i][0] + s, parts[i][0] + s + parts[i][1]) for i, s in zip(chosen, shifts, strict=True)]
                key = (n - less << 32 | c, places)
                if places[0][0] >= 0 and places[-1][1] <= n and key not in own:
                    out.append(key)
    return out


class Keys:
    """Keys of lines; the plan of each length is made once."""

    def __init__(self, level: int, edits: int) -> None:
        self.level, self.edits, self.plans = level, edits, {}

    def of(self, line: str) -> list[int]:
        n, h = len(line), xxhash.xxh3_64_intdigest
        if (p := self.plans.get(n)) is None:
            p = self.plans[n] = plan(n, self.level, self.edits)
        if self.level == 1:
            return [h(line[w[0][0]:w[0][1]], seed) for seed, w in p]
        return [h("\n".join([line[a:b] for a, b in w]), seed) for seed, w in p]

    def own(self) -> int:
        """How many keys, the first ones, a line is indexed under."""
        return len(list(combinations(range(self.edits + self.level), self.level)))


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is ``edits`` or less. Common ends are cut off; the rest is compared by a bit-parallel automaton of a band of 2 * edits + 1."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    n, low = min(len(a), len(b)), 0
    step = 64
    while low + step <= n and a[low:low + step] == b[low:low + step]:
        low += step
    while low < n and a[low] == b[low]:
        low += 1
    a, b, n = a[low:], b[low:], n - low
    high = 0
    while high + step <= n and a[len(a) - high - step:len(a) - high] == b[len(b) - high - step:len(b) - high]:
        high += step
    while high < n and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[:len(a) - high], b[:len(b) - high]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    # row e: bit i + edits - j stands for "i characters of a, j of b, e edits"; only a band of bits is ever set
    width, masks = (1 << (2 * edits + 1)) - 1, {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << (i + edits)
    rows = [1 << edits]
    for e in range(1, edits + 1):
        rows.append(rows[-1] | rows[-1] << 1)
    limit = lambda bits, j: bits & ((1 << max(0, len(a) + edits - j + 1)) - 1) & width
    for j, c in enumerate(b):
        match = masks.get(c, 0) >> j
        new = []
        for e in range(edits + 1):
            bits = rows[e] & match  # the same character
            if e:
                bits |= rows[e - 1] | rows[e - 1] >> 1 | new[e - 1] << 1  # changed; b's character is added; a's is left out
            new.append(limit(bits, j + 1))
        rows = new
        if not rows[-1]:
            return False
    return bool(rows[-1] >> (len(a) - len(b) + edits) & 1)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line and id (a hash of 64 bits, under which equal lines are one) of each line of every whole text; null texts have none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("id", F.xxhash64("line"))


def keys(lines: DataFrame, level: int, edits: int) -> DataFrame:
    """key, id and own (indexed, or else only probing) of ``lines`` (id, line)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Keys(level, edits)
        n_own = made.own()
        for batch in batches:
            key: list[int] = []
            times = np.empty(batch.num_rows, np.int64)
            for r, line in enumerate(batch.column("line").to_pylist()):
                mine = made.of(line)
                key += mine
                times[r] = len(mine)
            first = np.cumsum(times) - times
            is_own = np.arange(len(key)) - np.repeat(first, times) < n_own
            ids = np.repeat(batch.column("id").to_numpy(), times)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(ids), pa.array(is_own)], ["key", "id", "own"])

    return lines.select("id", "line").mapInArrow(cut_up, "key long, id long, own boolean")


def shared(keyed: DataFrame, run_cap: int) -> DataFrame:
    """key, id and hot (whether over ``run_cap`` lines have the key), once for each line of the keys that several lines have, one of them its own."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        rest = none, none, np.empty(0, bool)  # the last key so far, whose run may go on; no longer than run_cap and a batch
        hot = None  # the key that has outgrown run_cap

        def said(key: np.ndarray, id_: np.ndarray, is_hot: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(id_), pa.array(is_hot)], ["key", "id", "hot"])

        def whole(key: np.ndarray, id_: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            if not len(key):
                return said(none, none, np.empty(0, bool))
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.append(start, len(key)))
            met = np.repeat((n > 1) & np.logical_or.reduceat(own, start), n)
            return said(key[met], id_[met], np.repeat(n > run_cap, n)[met])

        for batch in batches:
            key, id_, own = (np.concatenate((r, batch.column(c).to_numpy(zero_copy_only=False))) for r, c in zip(rest, ("key", "id", "own"), strict=True))
            if not len(key):
                continue
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]))))
            key, id_, own = key[new], id_[new], np.logical_or.reduceat(own, new)
            if hot is not None:
                more = len(key) if (key == hot).all() else int(np.argmax(key != hot))
                yield said(key[:more], id_[:more], np.ones(more, bool))
                key, id_, own = key[more:], id_[more:], own[more:]
                if not len(key):
                    rest = none, none, np.empty(0, bool)
                    continue
                hot = None
            last = len(key) - (len(key) if (key == key[-1]).all() else int(np.argmax((key != key[-1])[::-1])))
            yield whole(key[:last], id_[:last], own[:last])
            rest = key[last:], id_[last:], own[last:]
            if len(rest[0]) > run_cap:
                yield said(rest[0], rest[1], np.ones(len(rest[0]), bool))
                hot, rest = rest[0][0], (none, none, np.empty(0, bool))
        yield whole(*rest)

    return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(runs, "key long, id long, hot boolean")


class Run:
    """The links among some lines that have a key in common."""

    def __init__(self, level: int, edits: int) -> None:
        self.keys, self.edits = Keys(level, edits), edits
        self.n_own = self.keys.own()

    def links(self, key: int, ids: list[int], lines: list[str], later: list[bool], block: list[int]) -> tuple[list[int], list[int], list[int]]:
        """id, the least line of its group here, and links found here, of each line with a link. Pairs of two ``later`` lines are left out, and those within one block (of 0 or more)."""
        k = len(ids)
        unsigned = key & (1 << 64) - 1
        n, root = [0] * k, list(range(k))
        made: list[tuple[set, set] | None] = [None] * k

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def keys_of(i: int) -> tuple[set, set]:
            if made[i] is None:
                x = self.keys.of(lines[i])
                made[i] = set(x[:self.n_own]), set(x)
            return made[i]

        for i, j in self.near(lines):
            if later[i] and later[j] or block[i] == block[j] >= 0 or ids[i] == ids[j]:
                continue
            (own_i, all_i), (own_j, all_j) = keys_of(i), keys_of(j)
            if min((own_i & all_j) | (own_j & all_i), default=None) == unsigned and within(lines[i], lines[j], self.edits):
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        some = [i for i in range(k) if n[i]]
        return [ids[i] for i in some], [ids[find(i)] for i in some], [n[i] for i in some]

    def near(self, lines: list[str], rows: int = 64) -> Iterator[tuple[int, int]]:
        """Pairs whose counts of characters (in 32 classes) allow so few edits; all others have more."""
        k = len(lines)
        if k == 2:
            yield 0, 1
            return
        count = np.empty((k, 32), np.int16)
        for i, t in enumerate(lines):
            count[i] = np.minimum(np.bincount(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) & 31, minlength=32), 1 << 14)
        for low in range(0, k, rows):
            far = np.abs(count[low:low + rows, None] - count[None, low:]).sum(2, dtype=np.int32)
            a, b = np.nonzero(np.triu(far <= 2 * self.edits, 1))
            yield from zip((a + low).tolist(), (b + low).tolist(), strict=True)


def verified(members: DataFrame, level: int, edits: int) -> DataFrame:
    """id, other and n: ``Run.links`` of the rows (task, key, id, line, later, block) of each task; one task's rows at a time are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, task = Run(level, edits), [], None

        def close(out: list[tuple]) -> None:
            if len(held) > 1:
                _, key, ids, lines, later, block = zip(*held, strict=True)
                out += zip(*made.links(key[0], list(ids), list(lines), list(later), list(block)), strict=True)

        def said(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["id", "other", "n"])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("task", "key", "id", "line", "later", "block")), strict=True):
                if row[:2] != task:
                    close(out)
                    task, held = row[:2], []
                held.append(row)
            yield said(out)
        out = []
        close(out)
        yield said(out)

    dealt = members.select("task", "key", "id", "line", "later", "block").repartition("task").sortWithinPartitions("task", "key", "id")
    return dealt.mapInArrow(run, "id long, other long, n long")


def texts_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """id and line of the distinct ``ids``."""
    ids = cut(ids.select("id").distinct())
    some = lines.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", "left_semi")
    return cut(some.groupBy("id").agg(F.first("line").alias("line")))


def blocks(members: DataFrame, run_cap: int) -> DataFrame:
    """The rows (key, id, line) of hot keys dealt into tasks: a key's lines fall into blocks by a hash, and each two blocks meet in a task."""
    per = members.groupBy("key").agg(F.count("*").alias("_n")).select("key", F.ceil(2 * F.col("_n") / run_cap).cast("int").alias("_blocks"))
    dealt = members.join(F.broadcast(per) if per.count() <= FEW_IDS else per, "key").withColumn("block", F.pmod(F.hash("id"), "_blocks"))
    met = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.select(F.xxhash64("key", F.least("block", "_o"), F.greatest("block", "_o")).alias("task"), "key", "id", "line", F.lit(False).alias("later"), F.when(F.col("block") == F.col("_o"), -1).otherwise(F.col("block")).alias("block"))


def links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, run_cap: int = RUN_CAP, levels: int = LEVELS) -> DataFrame:
    """id, other and n: of lines with links, a line that each is joined to (which may be itself) and a number of its links.

    Rows of an id add up: the sum of n is the number of different lines within ``edits``, and the rows' (id, other) join exactly what links join.
    """
    workers_ready(docs.sparkSession)
    lines = lines_of(docs).filter(F.length("line") >= min_chars).select("id", "line")
    found, left = None, lines
    for level in range(1, levels + 1):
        met = cut(shared(keys(left, level, edits), run_cap))
        texts = texts_of(left, met)
        left = cut(texts.join(met.filter("hot").select("id").distinct(), "id", "left_semi"))
        some = met.join(texts, "id").select("key", "id", "hot", "line")
        last = level == levels or left.isEmpty()
        if last:
            members = some.filter("not hot").select(F.col("key").alias("task"), "key", "id", "line", F.lit(False).alias("later"), F.lit(-1).alias("block"))
        else:  # two lines of hot keys meet on the next level
            later = some.filter("not hot").join(left.select(F.col("id").alias("_later")), F.col("id") == F.col("_later"), "left")
            members = later.select(F.col("key").alias("task"), "key", "id", "line", F.col("_later").isNotNull().alias("later"), F.lit(-1).alias("block"))
        if level == levels and not left.isEmpty():
            members = members.unionByName(blocks(some.filter("hot").select("key", "id", "line"), run_cap))
        new = verified(members, level, edits)
        found = new if found is None else found.unionByName(new)
        if last:
            return found
    return found


def dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, run_cap: int = RUN_CAP, levels: int = LEVELS) -> DataFrame:
    """doc_id, lines, exact, near and links of each document, and dropped: the numbers of lines that go.

    Of each class of linked lines the first occurrence (by doc_id, null last, then line number) stays. exact counts lines that repeat an earlier equal line, near those that
    are the first of their own text but not of their class; links counts, over the lines of the document, the different lines that each links to. Empty lines
    and lines of white space are not duplicates of each other. A null text has no lines; rows with the same doc_id are one document.
    """
    found = cut(links(docs, edits, min_chars, run_cap, levels).groupBy("id", "other").agg(F.sum("n").alias("n")))
    degree = found.groupBy("id").agg(F.sum("n").alias("links"))
    at = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "line_no")
    lines = lines_of(docs).withColumn("blank", F.trim("line") == "").drop("line")
    first = lines.filter("not blank").groupBy("id").agg(F.min(at).alias("at"), F.count("*").alias("times"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    # a line that repeats no other and has no links needs no fact; a class's root is not among the nodes of ``roots``
    classed = first.join(degree, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    classed = cut(classed.filter("times > 1 or links is not null"))
    lead = classed.filter("links is not null").groupBy("root").agg(F.min("at").alias("lead"), F.count("*").alias("size"))
    linked = look_up(classed.filter("links is not null"), lead, "root", "size", classed.count())
    known = linked.select("id", "at", "lead", "links", "times").unionByName(classed.filter("links is null").select("id", "at", F.col("at").alias("lead"), F.lit(0).cast("long").alias("links"), "times"))
    plain = lines.withColumn("id", F.when(~F.col("blank"), F.col("id"))).select("doc_id", "line_no", "id")
    told = look_up(plain, known, "id", "times", classed.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    told = told.select("doc_id", "line_no", (at != F.col("at")).alias("exact"), ((at == F.col("at")) & (F.col("at") != F.col("lead"))).alias("near"), "links")
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).cast("long").alias(c)
    per = told.groupBy("doc_id").agg(F.count("*").alias("lines"), n("exact"), n("near"), n("links"), F.array_sort(F.collect_list(F.when(F.col("exact") | F.col("near"), F.col("line_no")))).alias("dropped"))
    bare = docs.filter("text is null").select("doc_id").distinct()
    bare = bare.join(per, bare["doc_id"].eqNullSafe(per["doc_id"]), "left_anti")
    nothing = bare.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("lines", "exact", "near", "links")], F.array().cast("array<int>").alias("dropped"))
    return per.unionByName(nothing)
