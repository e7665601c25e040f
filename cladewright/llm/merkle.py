"""Merkle manifest of a dataset: a digest of each row, of each source and of the whole, and proofs against them.

Levels are windows: nodes that share a group and a parent index stand in one window, whose ordered whole-frame ``collect_list`` is at once the preimage of the parent
and the siblings of each node; one row for each parent then makes the next level. Places in a group come from ranges of rows, so that a group of any size is spread
over all tasks, and a window holds ``ARITY`` rows. The levels of all groups rise together: a group whose one node is left passes by. Paths are handed
down from the tops by joins of a level with the one above, where a parent meets ``ARITY`` rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def said(c: Column) -> Column:
    """A field as it goes into a leaf: its number of UTF-8 bytes, a colon and its value; ``-`` where it is null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row whose text is ``text``."""
    return digest(*[said(text if c == "text" else F.col(c)) for c in fields])


def placed(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in the row's ``group``, in the order of ``order``, nulls first) and ``n``, the rows of the group. ``order`` must tell rows apart.

    Rows are dealt by ranges; only one row for each range and group meets in a task.
    """
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col(group)] if group else []
    dealt = cut(rows.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    counted = dealt.groupBy("_range", *own).agg(F.count("*").alias("_n"))
    all_ = W.partitionBy(*own)
    before = F.sum("_n").over(all_.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    counted = counted.select(F.col("_range").alias("_r"), *[c.alias("_g") for c in own], F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(all_).alias("n"))
    on = F.col("_range") == F.col("_r")
    if group:
        on &= F.col(group).eqNullSafe(F.col("_g"))
    at = F.row_number().over(W.partitionBy("_range", *own).orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    return dealt.withColumn("_at", at).join(counted, on).select(*rows.columns, (F.col("_at") + F.col("_before")).alias("pos"), "n")


def levels(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """From ``nodes`` (grp, pos, n, digest) upwards: tables (grp, pos, left, right) of all nodes of groups that have several on that level, where left and right are
    the joined digests of the siblings on either side; and the tops (grp, digest, height), a row for each group."""
    now, out = cut(nodes.select("grp", "pos", "n", "digest")), []
    most = now.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    tops = now.filter("n = 1").select("grp", "digest", F.lit(0).alias("height"))
    while most > 1:
        run = W.partitionBy("grp", "parent").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        met = now.filter("n > 1").withColumn("parent", F.expr(f"pos div {arity}")).withColumn("run", F.collect_list("digest").over(run))
        place = (F.col("pos") % arity).cast("int")
        level = cut(met.select(
            "grp", "pos", "n", F.array_join(F.slice("run", F.lit(1), place), "").alias("left"), F.array_join(F.slice("run", place + 2, F.lit(arity)), "").alias("right"),
            F.when(place == 0, F.sha2(F.array_join("run", "").cast("binary"), 256)).alias("up")))
        out.append(level.select("grp", "pos", "left", "right"))
        now = level.filter("up is not null").select("grp", F.expr(f"pos div {arity}").alias("pos"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.col("up").alias("digest"))
        most = -(-most // arity)
        tops = tops.unionByName(now.filter("n = 1").select("grp", "digest", F.lit(len(out)).alias("height")))
    return out, tops


def paths(levels_: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """grp, pos and path of each node of the lowest level (with a single node in its group: pos 0), and the other columns of ``above``, which has a row for each group.

    path lists (left, right), the joined digests of the siblings on either side, from the node upwards; ``above`` (grp, height, path, ...) has what follows from the group's top on.
    """
    more = [c for c in above.columns if c not in ("grp", "path", "height")]
    tops = lambda h: above.filter(F.col("height") == h).select("grp", F.lit(0).cast("long").alias("pos"), "path", *more)
    found = tops(len(levels_))
    for h in reversed(range(len(levels_))):
        up = found.select(F.col("grp").alias("_g"), F.col("pos").alias("_p"), F.col("path").alias("_up"), *more)
        met = levels_[h].join(up, F.col("grp").eqNullSafe(F.col("_g")) & (F.expr(f"pos div {arity}") == F.col("_p")))
        found = met.select("grp", "pos", F.concat(F.array(F.struct("left", "right")), "_up").alias("path"), *more).unionByName(tops(h))
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda d, s: digest(s["left"], d, s["right"]))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf's to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """``rows`` (source, doc_id, leaf and others) with subroot, root and path.

    Leaves of a source ascend by doc_id (nulls first, then by leaf; rows alike in all of that have equal leaves, and their order is that of the table), sources by their UTF-8
    bytes (null first). A lone leaf is its source's subroot, a lone subroot the root. No rows give no rows.
    """
    seen = placed(cut(rows.withColumn("_nth", F.monotonically_increasing_id())), "source", ["doc_id", "leaf", "_nth"]).drop("_nth")
    seen = cut(seen)
    by_source, ends = levels(seen.select(F.col("source").alias("grp"), "pos", "n", F.col("leaf").alias("digest")), arity)
    subroots = cut(placed(ends.select(F.col("grp").alias("source"), F.col("digest").alias("subroot"), "height"), None, ["source"]))
    over, end = levels(subroots.select(F.lit(0).alias("grp"), "pos", "n", F.col("subroot").alias("digest")), arity)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    top = paths(over, end.select("grp", "height", nothing.alias("path"), F.col("digest").alias("root")), arity).select(F.col("pos").alias("_at"), "path", "root")
    told = cut(subroots.join(top, F.col("pos") == F.col("_at")).select(F.col("source").alias("grp"), "height", "path", "subroot", "root"))
    found = paths(by_source, told, arity).withColumnRenamed("pos", "_pos")
    met = seen.join(found, F.col("source").eqNullSafe(F.col("grp")) & (F.col("pos") == F.col("_pos")))
    return met.select(*rows.columns, "subroot", "root", "path")


def audited(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs`` (``FIELDS``; other columns are not read).

    folded_root folds the row's path from the leaf that the row has after tampering: where 2 divides the CRC32 of the decimal doc_id (not where it is null), line
    ends are deleted from its text. verified says whether it is the root still. Null fields are told from empty ones. Repeated rows are leaves of their own.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(hit & F.contains("text", F.lit("\n")), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), changed.alias("changed"))
    out = manifest(rows, arity).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS name FROM documents),
    c AS (SELECT *, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(name) + 1), lambda i: [ascii(name[i]), 0, 0, 0, 0, 0, 0, 0]))),
      lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1))) AS crc FROM d),
    f AS (SELECT *, {{said}} FROM c),
    l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || CASE WHEN crc IS NOT NULL AND (crc & 1) = 1 THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS changed FROM f),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
    t AS (SELECT 0 AS up, source, pos, n, leaf AS digest FROM p
      UNION ALL SELECT up + 1, source, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY up, source, pos // {ARITY}, n),
    s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (SELECT 0 AS up, pos, n, subroot AS digest FROM s
      UNION ALL SELECT up + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY up, pos // {ARITY}, n),
    r AS (SELECT digest AS root FROM u WHERE n = 1),
    ts AS (SELECT a.source, a.up, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
      FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.up = b.up AND a.pos // {ARITY} = b.pos // {ARITY} WHERE a.n > 1 GROUP BY a.source, a.up, a.pos),
    us AS (SELECT a.up, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
      FROM u a JOIN u b ON a.up = b.up AND a.pos // {ARITY} = b.pos // {ARITY} WHERE a.n > 1 GROUP BY a.up, a.pos),
    w AS (SELECT doc_id, leaf, source, pos, 0 AS up, changed AS now, '' AS seen FROM p
      UNION ALL SELECT doc_id, leaf, w.source, w.pos // {ARITY}, w.up + 1, sha256(ts.l || now || ts.r), seen || ts.l || ts.r FROM w JOIN ts ON w.source IS NOT DISTINCT FROM ts.source AND w.up = ts.up AND w.pos = ts.pos),
    e AS (SELECT w.* FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source AND w.up = t.up AND t.n = 1),
    v AS (SELECT doc_id, leaf, subroot, s.pos, 0 AS up, now, seen FROM e JOIN s ON e.source IS NOT DISTINCT FROM s.source
      UNION ALL SELECT doc_id, leaf, subroot, v.pos // {ARITY}, v.up + 1, sha256(us.l || now || us.r), seen || us.l || us.r FROM v JOIN us ON v.up = us.up AND v.pos = us.pos)
    SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, now AS folded_root, now = root AS verified FROM v, r WHERE v.up = (SELECT max(up) FROM u)""".format(
    said=" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS[:-1]) + " AS head")
