"""Queries on lineages and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import VIEWS, query
from cladewright.functions import columns as C
from cladewright.operators import lineages as L
from cladewright.operators import trees as T

from .reads import all_sites, with_sites

VIEWS["genotypes"] = """SELECT cell, tape, pattern, s1, s2, s3, s4, s5, s6, n FROM (SELECT *, row_number() OVER (PARTITION BY cell, tape ORDER BY n DESC, pattern) AS rn FROM (
  SELECT cell, tape, pattern, s1, s2, s3, s4, s5, s6, count(*) AS n FROM {sc_reads} GROUP BY cell, tape, pattern, s1, s2, s3, s4, s5, s6) q) r WHERE rn = 1"""
VIEWS["few"] = "SELECT * FROM {genotypes}"  # every cell; the SQL of three queries reads it by this name
_ALL = "SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k"
_DEPTH = "length(replace(regexp_replace(pattern, '(\\|U)+$|^U(\\|U)*$', ''), '|', '')) // 3"
_TRIE = f"""p AS (SELECT tape, n, {_DEPTH} AS len, pattern FROM {{patterns}}), x AS (SELECT tape, n, len, k, array_to_string(string_split(pattern, '|')[1:k], '|') AS prefix FROM p, ({_ALL}) q WHERE k <= len),
  t AS (SELECT tape, prefix, CAST(k AS INT) AS depth, CAST(sum(CASE WHEN k = len THEN n ELSE 0 END) AS BIGINT) AS tip, CAST(sum(n) AS BIGINT) AS subtree FROM x GROUP BY tape, prefix, k)"""


@query(f"WITH {_TRIE} SELECT * FROM t", "patterns")
def trie_prefix_weights(patterns: DataFrame) -> DataFrame:
    return L.trie(with_sites(patterns), "tape")


@query(f"WITH {_TRIE} SELECT tape, depth, count(*) AS nodes FROM t GROUP BY tape, depth", "patterns")
def nodes_per_level(patterns: DataFrame) -> DataFrame:
    return L.trie(with_sites(patterns), "tape").groupBy("tape", "depth").agg(F.count("*").alias("nodes"))


_STEP = ", ".join(f"""l{k} AS (SELECT c.tape, coalesce(b.prefix, c.node) AS node, c.off + coalesce(b.off, 0) AS off, c.br OR coalesce(b.second >= 2, false) AS br FROM l{k - 1} c
  LEFT JOIN b ON b.tape = c.tape AND b.parent = c.node AND b.depth = {k})""" for k in range(1, 7))


@query(f"""WITH {_TRIE}, u AS (SELECT *, array_to_string(string_split(prefix, '|')[1:depth-1], '|') AS parent FROM t WHERE depth > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY tape, parent ORDER BY subtree DESC, prefix) AS r FROM u),
  b AS (SELECT tape, parent, depth, min(prefix) FILTER (r = 1) AS prefix, coalesce(sum(subtree) FILTER (r > 1), 0) AS off, max(subtree) FILTER (r > 1) AS second FROM r GROUP BY tape, parent, depth),
  tot AS (SELECT tape, sum(n) AS total FROM p GROUP BY tape), l0 AS (SELECT tape, '' AS node, 0 AS off, false AS br FROM tot), {_STEP}
  SELECT tape, node AS chain, CAST(total - off AS BIGINT) AS support, round((total - off) / total, 6) AS dominance, br AS branched FROM l6 JOIN tot USING (tape)""", "patterns")
def dominant_chain(patterns: DataFrame) -> DataFrame:
    return L.dominant(with_sites(patterns), "tape").withColumn("dominance", F.round("dominance", 6))


@query(f"""WITH RECURSIVE {_TRIE}, c AS (SELECT tape, regexp_replace(prefix, '\\|?[^|]*$', '') AS node, prefix, subtree, row_number() OVER (PARTITION BY tape, regexp_replace(prefix, '\\|?[^|]*$', '') ORDER BY subtree DESC, prefix) AS r FROM t WHERE depth > 0),
  b AS (SELECT c.tape, node, min(c.prefix) FILTER (r = 1) AS next, coalesce(max(c.subtree) FILTER (r = 2) >= greatest(2, 0.08 * sum(c.subtree)), false) AS splits, max(c.subtree) / (sum(c.subtree) + max(t.tip)) AS own FROM c JOIN t ON t.tape = c.tape AND t.prefix = c.node GROUP BY c.tape, node),
  w AS (SELECT DISTINCT tape, '' AS node, 1.0E0 AS dominance FROM t UNION ALL SELECT w.tape, b.next, b.own FROM w JOIN b ON b.tape = w.tape AND b.node = w.node WHERE NOT splits),
  e AS (SELECT w.tape, w.node, coalesce(splits, false) AS branched, CASE WHEN splits THEN own ELSE dominance END AS dominance FROM w LEFT JOIN b ON b.tape = w.tape AND b.node = w.node WHERE coalesce(splits, true))
  SELECT tape, node AS chain, branched, round(dominance, 6) AS dominance FROM e""", "patterns")
def branch_stops(patterns: DataFrame) -> DataFrame:
    return L.branch_stop(with_sites(patterns), "tape", 0.08).withColumn("dominance", F.round("dominance", 6))


_CHAO = """a AS (SELECT tape, sum(n) AS total, count(*) AS s_obs, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2 FROM {patterns} GROUP BY tape),
  f AS (SELECT *, (total - 1) / total * CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2.0 END AS f0 FROM a)"""


@query(f"WITH {_CHAO} SELECT tape, CAST(total AS BIGINT) AS total, s_obs, f1, f2, round(f0, 6) AS f0, round(s_obs + f0, 6) AS chao1 FROM f", "patterns")
def chao1(patterns: DataFrame) -> DataFrame:
    return L.chao1(patterns, "tape").withColumn("f0", F.round("f0", 6)).withColumn("chao1", F.round("chao1", 6))


@query(f"""WITH {_CHAO}, g AS (SELECT tape, total, s_obs, f1, f0, unnest([1, 5, 10, 50, 100, CAST(total AS BIGINT), 2 * CAST(total AS BIGINT)]) AS m FROM f),
  l AS (SELECT g.tape, g.m, sum(CASE WHEN total - n >= m THEN exp(lgamma(total - n + 1) - lgamma(total - n - m + 1) - lgamma(total + 1) + lgamma(total - m + 1)) ELSE 0 END) AS lost FROM g JOIN {{patterns}} p ON p.tape = g.tape WHERE m <= total GROUP BY 1, 2)
  SELECT DISTINCT g.tape, CAST(g.m AS BIGINT) AS m, round(CASE WHEN g.m <= total THEN s_obs - lost WHEN f0 > 0 THEN s_obs + f0 * (1 - pow(1 - f1 / (total * f0 + f1), g.m - total)) ELSE s_obs END, 6) AS expected FROM g LEFT JOIN l ON l.tape = g.tape AND l.m = g.m""", "patterns")
def rarefaction_curve(patterns: DataFrame) -> DataFrame:
    total = patterns.groupBy("tape").agg(F.sum("n").alias("t"))
    grid = total.select("tape", F.explode(F.array_distinct(F.array(*[F.lit(x).cast("long") for x in (1, 5, 10, 50, 100)], F.col("t"), 2 * F.col("t")))).alias("m"))
    return L.rarefied(patterns, grid, "tape").withColumn("expected", F.round("expected", 6))


@query("""WITH t AS (SELECT tape, CAST(sum(n) AS BIGINT) AS reads FROM {patterns} GROUP BY tape), u0 AS (SELECT median(reads) AS u FROM t),
  u1 AS (SELECT coalesce(median(reads), max(u)) AS u FROM t, u0 WHERE greatest(1, round_even(reads / u, 0)) = 1), u2 AS (SELECT coalesce(median(reads), max(u)) AS u FROM t, u1 WHERE greatest(1, round_even(reads / u, 0)) = 1),
  u3 AS (SELECT coalesce(median(reads), max(u)) AS u FROM t, u2 WHERE greatest(1, round_even(reads / u, 0)) = 1)
  SELECT tape, reads, u AS unit, CAST(greatest(1, round_even(reads / u, 0)) AS BIGINT) AS copies FROM t, u3""", "patterns")
def copy_number_units(patterns: DataFrame) -> DataFrame:
    return L.copies(patterns.groupBy("tape").agg(F.sum("n").alias("reads")))


_UNIT = "u AS (SELECT tape, median(n) AS u FROM {patterns} GROUP BY tape), c AS (SELECT tape, pattern, n, CAST(round_even(n / u, 0) AS BIGINT) AS cells FROM {patterns} JOIN u USING (tape) WHERE round_even(n / u, 0) >= 1)"


def celled(patterns: DataFrame) -> DataFrame:
    unit = patterns.groupBy("tape").agg(F.percentile("n", F.lit(0.5)).alias("unit"))
    return L.cells(patterns.join(F.broadcast(unit), "tape"), F.col("unit"))


@query(f"WITH {_UNIT} SELECT * FROM c", "patterns")
def cells_per_pattern(patterns: DataFrame) -> DataFrame:
    return celled(patterns).select("tape", "pattern", "n", "cells")


@query(f"WITH {_UNIT} SELECT tape, count(*) AS patterns, CAST(sum(cells) AS BIGINT) AS equivalents FROM c GROUP BY tape", "patterns")
def genomic_equivalents(patterns: DataFrame) -> DataFrame:
    return celled(patterns).groupBy("tape").agg(F.count("*").alias("patterns"), F.sum("cells").alias("equivalents"))


_T = [f"T{i}" for i in range(11)]


@query("SELECT cell, " + ", ".join(f"max(CASE WHEN tape = '{t}' THEN pattern END) AS {t}" for t in _T) + ", count(*) AS n_loci, CAST(sum(n) AS BIGINT) AS molecules, round(avg(n), 3) AS mean_n FROM {genotypes} GROUP BY cell", "genotypes")
def cell_qc_pivot(genotypes: DataFrame) -> DataFrame:
    return genotypes.groupBy("cell").agg(*[F.max(F.when(F.col("tape") == t, F.col("pattern"))).alias(t) for t in _T], F.count("*").alias("n_loci"), F.sum("n").alias("molecules"), F.round(F.avg("n"), 3).alias("mean_n"))


# A cell in seven has no genotype, and some cells lack a tape.
VIEWS["all_cells"] = "SELECT DISTINCT cell FROM {genotypes}"
VIEWS["some_calls"] = "SELECT * FROM {genotypes} WHERE cell % 7 <> 0 AND (cell + CAST(substr(tape, 2, 2) AS INT)) % 5 <> 0"


@query("SELECT tape, count(*) AS recovered, round(100.0 * count(*) / (SELECT count(*) FROM {all_cells}), 4) AS pct FROM {some_calls} GROUP BY tape", "some_calls", "all_cells")
def recovery_by_tape(calls: DataFrame, cells: DataFrame) -> DataFrame:
    return L.recovery(calls, cells).withColumn("pct", F.round("pct", 4))


@query("""WITH p AS (SELECT c.cell, sum(n) AS m FROM {all_cells} c LEFT JOIN {some_calls} s USING (cell) GROUP BY c.cell)
  SELECT count(*) AS cells, count(m) AS recovered, round(avg(coalesce(m, 0)), 6) AS mean_all, CAST(median(coalesce(m, 0)) AS DOUBLE) AS median_all, round(avg(m), 6) AS mean_recovered, CAST(median(m) AS DOUBLE) AS median_recovered FROM p""", "some_calls", "all_cells")
def molecules_per_cell(calls: DataFrame, cells: DataFrame) -> DataFrame:
    return L.molecules_per_cell(calls, cells).withColumn("mean_all", F.round("mean_all", 6)).withColumn("mean_recovered", F.round("mean_recovered", 6))


@query("""WITH m AS (SELECT cell, tape, umi, count(*) AS n FROM {sc_reads} GROUP BY cell, tape, umi), c AS (SELECT cell, count(*) AS umis FROM m GROUP BY cell)
  SELECT round(avg(n), 6) AS reads_per_umi, round(1 - count(*) / sum(n), 6) AS duplication, max(x) AS mean_umis, max(y) AS median_umis FROM m, (SELECT round(avg(umis), 6) AS x, median(umis) AS y FROM c) z""", "sc_reads")
def umi_stats(reads: DataFrame) -> DataFrame:
    m = reads.groupBy("cell", "tape", "umi").agg(F.count("*").alias("n"))
    per = m.groupBy("cell").agg(F.count("*").alias("umis")).agg(F.round(F.avg("umis"), 6).alias("mean_umis"), F.percentile("umis", F.lit(0.5)).alias("median_umis"))
    return m.agg(F.round(F.avg("n"), 6).alias("reads_per_umi"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("duplication")).join(per)


_CALLS = " UNION ALL ".join(f"SELECT cell, tape, {i} AS site, s{i} AS allele FROM {{genotypes}}" for i in range(1, 7))


@query(f"""SELECT tape, site, allele, round(count(*) FILTER (cell % 2 = 0) / max(na), 6) AS frac_a, round(count(*) FILTER (cell % 2 = 1) / max(nb), 6) AS frac_b FROM ({_CALLS}) q
  JOIN (SELECT tape, count(*) FILTER (cell % 2 = 0) AS na, count(*) FILTER (cell % 2 = 1) AS nb FROM {{genotypes}} GROUP BY tape) z USING (tape) WHERE allele <> 'U' AND na >= 20 AND nb >= 20 GROUP BY tape, site, allele""", "genotypes")
def founder_fractions(genotypes: DataFrame) -> DataFrame:
    a, b = F.col("cell") % 2 == 0, F.col("cell") % 2 == 1
    seen = genotypes.groupBy("tape").agg(F.count_if(a).alias("na"), F.count_if(b).alias("nb")).filter("na >= 20 and nb >= 20")
    calls = with_sites(genotypes).select("cell", "tape", F.posexplode("sites").alias("p", "allele")).filter("allele <> 'U'")
    n = calls.groupBy("tape", (F.col("p") + 1).alias("site"), "allele").agg(F.count_if(a).alias("ca"), F.count_if(b).alias("cb")).join(F.broadcast(seen), "tape")
    return n.select("tape", "site", "allele", F.round(F.col("ca") / F.col("na"), 6).alias("frac_a"), F.round(F.col("cb") / F.col("nb"), 6).alias("frac_b"))


VIEWS["defining"] = "SELECT DISTINCT tape, 1 AS site, s1 AS allele, CASE WHEN s1 < 'G' THEN 'A' ELSE 'B' END AS side FROM {genotypes} WHERE s1 <> 'U'"


@query(f"""SELECT cell, count(*) FILTER (side = 'A') AS votes_a, count(*) FILTER (side = 'B') AS votes_b, CASE WHEN count(*) FILTER (side = 'A') - count(*) FILTER (side = 'B') >= 1 THEN 'A' WHEN count(*) FILTER (side = 'B') - count(*) FILTER (side = 'A') >= 1 THEN 'B' ELSE 'set_aside' END AS route
  FROM ({_CALLS}) q JOIN {{defining}} USING (tape, site, allele) GROUP BY cell""", "genotypes", "defining")
def blastomere_vote(genotypes: DataFrame, defining: DataFrame) -> DataFrame:
    calls = with_sites(genotypes).select("cell", "tape", F.posexplode("sites").alias("p", "allele")).withColumn("site", F.col("p") + 1)
    return L.side_votes(calls, defining)


@query(f"""SELECT DISTINCT cell FROM {{genotypes}} g WHERE NOT EXISTS (SELECT 1 FROM ({_CALLS}) q JOIN {{defining}} d ON d.tape = q.tape AND d.site = q.site WHERE q.cell = g.cell AND d.side = 'B' AND q.allele = d.allele)""", "genotypes", "defining")
def founder_gate(genotypes: DataFrame, defining: DataFrame) -> DataFrame:
    bad = genotypes.select("cell", "tape", F.col("s1").alias("allele")).join(F.broadcast(defining.filter("side = 'B'")), ["tape", "allele"], "left_semi")
    return genotypes.select("cell").distinct().join(bad, "cell", "left_anti")


def _prefix(a: str, b: str) -> str:
    out = "6"
    for i in range(6, 0, -1):
        out = f"CASE WHEN {a}.s{i} = 'U' OR {b}.s{i} = 'U' OR {a}.s{i} <> {b}.s{i} THEN {i - 1} ELSE {out} END"
    return out


def _dist(a: str, b: str) -> str:
    d = lambda x: "CASE " + " ".join(f"WHEN {x}.s{i} = 'U' THEN {i - 1}" for i in range(1, 7)) + " ELSE 6 END"
    return f"(({d(a)}) + ({d(b)}) - 2 * ({_prefix(a, b)}))"


@query(f"SELECT a.cell AS i, b.cell AS j, count(*) AS shared, round(avg({_dist('a', 'b')}), 6) AS distance FROM {{few}} a JOIN {{few}} b ON a.tape = b.tape AND a.cell < b.cell GROUP BY a.cell, b.cell", "few")
def tape_distance_pairs(few: DataFrame) -> DataFrame:
    return L.shared_tape_pairs(with_sites(few)).withColumn("distance", F.round("distance", 6))


_TOK = " UNION ALL ".join(f"SELECT cell, concat(tape, ':', {i - 1}, ':', s{i}) AS token FROM {{genotypes}} WHERE s{i} <> 'U'" for i in range(1, 7))
_TOP = f"""tok AS ({_TOK}), rare AS (SELECT token FROM tok GROUP BY token HAVING count(*) <= floor(0.2 * (SELECT count(DISTINCT cell) FROM {{genotypes}}))), t AS (SELECT tok.* FROM tok JOIN rare USING (token)),
  o AS (SELECT a.cell AS q, b.cell AS c, count(*) AS overlap FROM t a JOIN t b ON a.token = b.token AND a.cell <> b.cell WHERE a.cell % 20 = 0 GROUP BY 1, 2), top AS (SELECT q, c, overlap FROM o QUALIFY row_number() OVER (PARTITION BY q ORDER BY overlap DESC, c) <= 10)"""


@query(f"WITH {_TOP} SELECT * FROM top", "genotypes")
def token_overlap_topk(genotypes: DataFrame) -> DataFrame:
    return L.overlap_top(with_sites(genotypes), genotypes.filter("cell % 20 = 0").select("cell").distinct(), 10)


@query(f"""WITH {_TOP}, d AS (SELECT o.q, o.c, avg({_dist('a', 'b')}) AS distance, count(*) AS shared FROM o JOIN {{genotypes}} a ON a.cell = o.q JOIN {{genotypes}} b ON b.cell = o.c AND a.tape = b.tape GROUP BY 1, 2)
  SELECT q, c, round(distance, 6) AS distance, shared FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, shared DESC, c) = 1""", "genotypes")
def nearest_match(genotypes: DataFrame) -> DataFrame:
    g = with_sites(genotypes)
    return L.nearest_match(g, L.overlaps(g, genotypes.filter("cell % 20 = 0").select("cell").distinct())).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_TOP}, k AS (SELECT cell, count(*) AS loci FROM {{genotypes}} GROUP BY cell), d AS (SELECT o.q, o.c, avg({_dist('a', 'b')}) AS distance, count(*) AS shared FROM o JOIN {{genotypes}} a ON a.cell = o.q JOIN {{genotypes}} b ON b.cell = o.c AND a.tape = b.tape GROUP BY 1, 2),
  r AS (SELECT q, c, distance, shared, c % 3 = 0 AS bb, row_number() OVER (PARTITION BY q ORDER BY distance, shared DESC, loci DESC, c) AS r, row_number() OVER (PARTITION BY q, c % 3 = 0 ORDER BY distance, shared DESC, loci DESC, c) AS rb FROM d JOIN k ON k.cell = d.c)
  SELECT x.q, x.c, round(x.distance, 6) AS distance, x.shared, y.c AS b, round(y.distance, 6) AS b_distance, y.shared AS b_shared FROM r x LEFT JOIN r y ON y.q = x.q AND y.bb AND y.rb = 1 WHERE x.r = 1""", "genotypes")
def backbone_matches(genotypes: DataFrame) -> DataFrame:
    g = with_sites(genotypes)
    cells = genotypes.select("cell").distinct()
    out = L.nearest_matches(g, L.overlaps(g, cells.filter("cell % 20 = 0")), cells.filter("cell % 3 = 0"))
    return out.withColumn("distance", F.round("distance", 6)).withColumn("b_distance", F.round("b_distance", 6))


@query("SELECT a.cell AS t, b.cell AS c, a.tape, " + " OR ".join(f"(a.s{i} <> 'U' AND a.s{i} <> b.s{i})" for i in range(1, 7)) + " AS violates FROM {few} a JOIN {few} b ON a.tape = b.tape AND b.cell = a.cell + 1", "few")
def irreversibility_flags(few: DataFrame) -> DataFrame:
    g = with_sites(few)
    pairs = g.select(F.col("cell").alias("t"), "tape", F.col("sites").alias("st")).join(g.select(F.col("cell").alias("c"), "tape", F.col("sites").alias("sc")), "tape").filter("c = t + 1")
    return L.irreversible(pairs).select("t", "c", "tape", "violates")


@query(f"""SELECT t, c, CAST(count(*) AS BIGINT) AS shared, CAST(sum(new) AS BIGINT) AS new_edits, round(sum(new) / greatest(sum(pre), 1), 6) AS per_shared FROM (
  SELECT a.cell AS t, b.cell AS c, {_prefix('a', 'b')} AS pre, (CASE {" ".join(f"WHEN b.s{i} = 'U' THEN {i - 1}" for i in range(1, 7))} ELSE 6 END) - {_prefix('a', 'b')} AS new FROM {{few}} a JOIN {{few}} b ON a.tape = b.tape AND b.cell = a.cell + 1) q GROUP BY t, c""", "few")
def pendant_components(few: DataFrame) -> DataFrame:
    g = with_sites(few)
    p = g.select(F.col("cell").alias("t"), "tape", F.col("sites").alias("st")).join(g.select(F.col("cell").alias("c"), "tape", F.col("sites").alias("sc")), "tape").filter("c = t + 1")
    p = p.withColumn("pre", C.shared_prefix(F.col("st"), F.col("sc"))).withColumn("new", C.depth(F.col("sc")) - F.col("pre"))
    return p.groupBy("t", "c").agg(F.count("*").alias("shared"), F.sum("new").cast("long").alias("new_edits"), F.round(F.sum("new") / F.greatest(F.sum("pre"), F.lit(1)), 6).alias("per_shared"))


_BEST = """u AS (SELECT *, array_to_string(string_split(prefix, '|')[1:depth-1], '|') AS node FROM t WHERE depth > 0),
  b AS (SELECT tape, node, prefix AS next, subtree AS weight FROM u QUALIFY row_number() OVER (PARTITION BY tape, node ORDER BY subtree DESC, prefix) = 1)"""
_DOWN = ", ".join(f"m{k} AS (SELECT m.tape, coalesce(b.next, m.x) AS x, m.node, m.tip FROM m{k - 1} m LEFT JOIN b ON b.tape = m.tape AND b.node = m.x)" for k in range(1, 6))


@query(f"""WITH {_TRIE}, {_BEST}, m0 AS (SELECT t.tape, CASE WHEN b.weight >= 4 * t.tip THEN b.next END AS x, t.prefix AS node, t.tip FROM t LEFT JOIN b ON b.tape = t.tape AND b.node = t.prefix WHERE t.tip > 0), {_DOWN}
  SELECT tape, coalesce(x, node) AS chain, CAST(sum(tip) AS DOUBLE) AS n FROM m5 GROUP BY 1, 2""", "patterns")
def folded_lineages(patterns: DataFrame) -> DataFrame:
    return L.fold_dropout(with_sites(patterns), "tape")


@query("""WITH v AS (SELECT tape, n, log10(n) AS v FROM {patterns}), s AS (SELECT tape, count(*) AS k, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM v WHERE n >= 5 GROUP BY tape HAVING count(*) >= 5 AND max(v) > min(v)),
  g AS (SELECT *, lo + i * (hi - lo) / 399 AS x FROM s, (SELECT unnest(range(400)) AS i)), d AS (SELECT g.tape, i, x, sum(exp(-pow((x - v) / (0.3 * sd), 2) / 2)) AS d FROM g JOIN v ON v.tape = g.tape AND n >= 5 GROUP BY ALL),
  sm AS (SELECT tape, x FROM d QUALIFY row_number() OVER (PARTITION BY tape ORDER BY d DESC, i) = 1),
  e AS (SELECT tape, min(v) AS lo, max(v) AS hi FROM v GROUP BY tape), o AS (SELECT tape, lo, hi, CASE WHEN hi > lo THEN least(38, floor((v - lo) / (hi - lo) * 39)) ELSE 0 END AS b FROM v JOIN e USING (tape)),
  nb AS (SELECT tape, lo, hi, b + j AS b, count(*) AS k FROM o, (SELECT unnest([-1, 0, 1]) AS j) WHERE b + j BETWEEN 0 AND 38 GROUP BY ALL), r AS (SELECT *, CASE WHEN hi > lo THEN lo + (b + 0.5) * (hi - lo) / 39 ELSE lo END AS x FROM nb QUALIFY row_number() OVER (PARTITION BY tape ORDER BY k DESC, b) = 1)
  SELECT r.tape, round(pow(10, coalesce(sm.x, r.x)), 4) AS unit FROM r LEFT JOIN sm ON sm.tape = r.tape""", "patterns")
def reads_per_cell(patterns: DataFrame) -> DataFrame:
    return L.reads_per_cell(patterns, "tape", floor=5).withColumn("unit", F.round("unit", 4))


@query(f"SELECT cell, count(*) AS tapes, round(avg(CASE {' '.join(f'WHEN s{i} = {chr(39)}U{chr(39)} THEN {i - 1}' for i in range(1, 7))} ELSE 6 END), 6) AS distance FROM {{genotypes}} WHERE tape <> 'T3' GROUP BY cell", "genotypes")
def root_distances(genotypes: DataFrame) -> DataFrame:
    """How far cells are from a root without edits, over the tapes that it has."""
    root = T.synthetic_root([f"T{k}" for k in range(12) if k != 3])(genotypes.sparkSession).select("tape", F.col("sites").alias("root"))
    met = with_sites(genotypes).join(F.broadcast(root), "tape")
    return met.groupBy("cell").agg(F.count("*").alias("tapes"), F.round(F.avg(C.tape_distance(F.col("root"), F.col("sites"))), 6).alias("distance"))


def _edits(a: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {a}.s{i} <> 'U' THEN 1 ELSE 0 END" for i in range(1, 7)) + ")"


@query(f"""WITH m AS (SELECT DISTINCT cell, cell + 7 AS host FROM {{few}}), p AS (SELECT m.cell, m.host, b.tape, {_edits('a')} AS ea, {_edits('b')} AS eb, {_prefix('a', 'b')} AS sp, CASE WHEN b.tape IN ('T1', 'T2', 'T5') THEN 1 ELSE 0 END AS f
    FROM m JOIN {{few}} a ON a.cell = m.cell LEFT JOIN {{few}} b ON b.cell = m.host AND b.tape = a.tape)
  SELECT cell, host, round(coalesce(sum(ea - sp) FILTER (tape IS NOT NULL), 0) / greatest(count(tape), 1), 6) AS pendant, round(coalesce(sum(eb - sp) FILTER (tape IS NOT NULL), 0) / greatest(count(tape), 1), 6) AS residual,
    CAST(coalesce(sum(ea - sp) FILTER (tape IS NOT NULL), 0) AS BIGINT) AS new_edits, CAST(coalesce(sum(greatest(sp - f, 0)) FILTER (tape IS NOT NULL), 0) AS BIGINT) AS shared_edits, count(tape) AS n_shared FROM p GROUP BY cell, host""", "few")
def pendant_parts(few: DataFrame) -> DataFrame:
    founders = few.sparkSession.createDataFrame([("T1", 1), ("T2", 1), ("T5", 1)], "tape string, n int")
    out = L.pendant_parts(few.select("cell", (F.col("cell") + 7).alias("host")).distinct(), with_sites(few), founders)
    return out.withColumn("pendant", F.round("pendant", 6)).withColumn("residual", F.round("residual", 6))

