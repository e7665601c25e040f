"""Queries on routing cells and on single-cell consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import VIEWS, query
from cladewright.operators import lineages as L
from cladewright.operators import routing as R
from cladewright.operators.scale import cut

from .lineages import _DEPTH, _STEP
from .reads import all_sites, with_sites

# Two sides with founder alleles of their own, which nine in ten cells of a side show; 3 % of cells show one of the other side on one tape, a few on two.
VIEWS["routable"] = """SELECT cell, tape, side, CASE WHEN h % 10 = 0 THEN s1 WHEN h % 31 = 3 THEN concat(CASE side WHEN 'A' THEN 'B' ELSE 'A' END, substr(tape, 2, 2)) ELSE concat(side, substr(tape, 2, 2)) END AS s1, s2, s3, s4, s5, s6, h
  FROM (SELECT *, CASE WHEN cell % 5 < 3 THEN 'A' ELSE 'B' END AS side, (cell * 13 + CAST(substr(tape, 2, 2) AS INT) * 7) % 97 AS h FROM {genotypes}) q"""
_RARE = "ra AS (SELECT tape, s1 AS allele, count(*) AS n, sum(count(*)) OVER (PARTITION BY tape) AS recovered FROM {routable} GROUP BY tape, s1)"
_DEFS = """rec AS (SELECT tape, count(*) FILTER (side = 'A') AS na, count(*) FILTER (side = 'B') AS nb FROM {routable} GROUP BY tape HAVING count(*) FILTER (side = 'A') >= 20 AND count(*) FILTER (side = 'B') >= 20),
  fr AS (SELECT tape, s1 AS allele, count(*) FILTER (side = 'A') / max(na) AS frac_a, count(*) FILTER (side = 'B') / max(nb) AS frac_b FROM {routable} JOIN rec USING (tape) WHERE s1 <> 'U' GROUP BY tape, s1),
  df AS (SELECT *, CASE WHEN frac_a >= 0.3 AND frac_a - frac_b >= 0.2 THEN 'A' WHEN frac_b >= 0.3 AND frac_b - frac_a >= 0.2 THEN 'B' END AS mark, greatest(frac_a, frac_b) >= 0.85 AS near_fixed FROM fr)"""


def alleles(routable: DataFrame) -> DataFrame:
    return R.founder_alleles(with_sites(routable))


def defining(routable: DataFrame) -> DataFrame:
    return R.defining_alleles(alleles(routable), routable.select("cell", "side").distinct())


@query(f"WITH {_RARE} SELECT tape, allele, n, CAST(recovered AS BIGINT) AS recovered, round(-ln(n / recovered), 6) + 0.0 AS weight FROM ra", "routable")
def rarity_weights(routable: DataFrame) -> DataFrame:
    return R.rarity(alleles(routable)).withColumn("weight", F.round("weight", 6) + 0.0)


@query("SELECT cell, tape, s1 AS allele, CASE WHEN s1 = 'U' THEN 0 ELSE (SELECT count(DISTINCT x.s1) FROM {routable} x WHERE x.tape = r.tape AND x.s1 <> 'U' AND x.s1 <= r.s1) END AS code FROM {routable} r", "routable")
def founder_codes(routable: DataFrame) -> DataFrame:
    return R.allele_codes(alleles(routable)).select("cell", "tape", "allele", F.col("code").cast("long").alias("code"))


@query(f"WITH {_DEFS} SELECT tape, allele, mark AS side, round(frac_a, 6) AS frac_a, round(frac_b, 6) AS frac_b, near_fixed FROM df WHERE mark IS NOT NULL", "routable")
def defining_alleles(routable: DataFrame) -> DataFrame:
    return defining(routable).withColumn("frac_a", F.round("frac_a", 6)).withColumn("frac_b", F.round("frac_b", 6))


_ROUTE = f"""{_DEFS}, vo AS (SELECT r.cell, count(*) FILTER (mark = 'A') AS votes_a, count(*) FILTER (mark = 'B') AS votes_b, min(CASE WHEN mark = 'A' THEN r.tape END) AS ta, min(CASE WHEN mark = 'B' THEN r.tape END) AS tb FROM {{routable}} r LEFT JOIN df ON df.tape = r.tape AND df.allele = r.s1 AND mark IS NOT NULL GROUP BY r.cell),
  rs AS (SELECT *, CASE WHEN greatest(votes_a, votes_b) = 0 THEN 'no_founder' WHEN votes_a = votes_b THEN 'tie' WHEN least(votes_a, votes_b) >= 2 THEN 'multibleed' ELSE 'routed' END AS reason FROM vo),
  ou AS (SELECT *, CASE WHEN reason = 'routed' THEN CASE WHEN (votes_a > votes_b) = (SELECT count(*) FILTER (votes_a > votes_b) >= count(*) FILTER (votes_a < votes_b) FROM rs WHERE reason = 'routed') THEN 'B1' ELSE 'B2' END END AS routed,
    CASE WHEN reason = 'routed' AND least(votes_a, votes_b) = 1 THEN CASE WHEN votes_a > votes_b THEN tb ELSE ta END END AS masked FROM rs)"""


@query(f"WITH {_ROUTE} SELECT cell, votes_a, votes_b, routed, reason, masked FROM ou", "routable")
def routed_cells(routable: DataFrame) -> DataFrame:
    return R.route(alleles(routable), cut(defining(routable)))


@query(None, "routable")
def split_axis(routable: DataFrame) -> DataFrame:
    """cell, score on the leading axis, and whether it is above the best split; nearly always the two sides that the founder alleles were made from."""
    a = cut(alleles(routable))
    scores = cut(R.leading_axis(a, R.rarity(a)))
    return scores.select("cell", F.round("score", 6).alias("score"), (F.col("score") > R.best_split(scores)).alias("high"))


VIEWS["seeds"] = "SELECT DISTINCT side, tape, concat(side, substr(tape, 2, 2)) AS allele FROM {routable}"
_GROW = ", ".join(f"""n{k} AS (SELECT *, sum(n) OVER (PARTITION BY side, tape) AS al FROM (SELECT c.side, c.tape, r.s{k + 1} AS next, count(*) AS n FROM c{k} c JOIN {{routable}} r ON r.side = c.side AND r.tape = c.tape AND [{', '.join(f'r.s{i}' for i in range(1, k + 1))}] = c.chain WHERE len(c.chain) = {k} GROUP BY c.side, c.tape, r.s{k + 1})),
  c{k + 1} AS (SELECT c.side, c.tape, CASE WHEN g.next IS NULL THEN c.chain ELSE list_append(c.chain, g.next) END AS chain FROM c{k} c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, tape ORDER BY n DESC, next) AS rn FROM n{k}) WHERE rn = 1 AND next <> 'U' AND n >= 0.12 * al) g ON g.side = c.side AND g.tape = c.tape)""" for k in range(1, 6))
_CHAINS = f"c1 AS (SELECT side, tape, [allele] AS chain FROM {{seeds}}), {_GROW}"


@query(f"WITH {_CHAINS} SELECT side, tape, array_to_string(chain, '-') AS chain FROM c6", "routable", "seeds")
def founder_chains(routable: DataFrame, seeds: DataFrame) -> DataFrame:
    return R.founder_chains(with_sites(routable), seeds, 0.12).select("side", "tape", F.array_join("chain", "-").alias("chain"))


_BAD = "ba AS (SELECT r.cell, count(*) FILTER ([s1, s2, s3, s4, s5, s6][1:len(chain)] <> chain) AS contradicting, count(*) AS n_loci FROM {routable} r LEFT JOIN c6 USING (side, tape) GROUP BY r.cell)"


@query(f"WITH {_CHAINS}, {_BAD} SELECT cell, contradicting, contradicting = 0 AS founder_ok FROM ba", "routable", "seeds")
def founder_contradictions(routable: DataFrame, seeds: DataFrame) -> DataFrame:
    g = with_sites(routable)
    return R.contradictions(g, R.founder_chains(g, seeds, 0.12))


@query(f"WITH {_CHAINS}, {_BAD} SELECT CASE WHEN n_loci >= 7 THEN 'ge7' WHEN n_loci >= 4 THEN '4to6' ELSE 'lt4' END AS band, count(*) AS total, count(*) FILTER (contradicting > 0) AS fail FROM ba GROUP BY 1", "routable", "seeds")
def contradiction_bands(routable: DataFrame, seeds: DataFrame) -> DataFrame:
    g = with_sites(routable)
    cells = R.contradictions(g, R.founder_chains(g, seeds, 0.12)).join(g.groupBy("cell").agg(F.count("*").alias("n_loci")), "cell")
    return R.contradiction_bands(cells)


@query("""WITH g AS (SELECT r.*, s.allele AS own FROM {routable} r LEFT JOIN {seeds} s USING (side, tape)), p AS (SELECT side, tape, count(*) AS calls, count(*) FILTER (s1 = 'U') AS unedited, count(*) FILTER (s1 <> 'U' AND own IS NOT NULL) AS testable, count(*) FILTER (s1 <> 'U' AND s1 <> own) AS off,
    count(*) FILTER (s1 = own) AS onf, count(*) FILTER (s1 = own AND s2 = own) AS tw FROM g GROUP BY side, tape), a AS (SELECT CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(unedited) AS BIGINT) AS unedited, CAST(sum(testable) AS BIGINT) AS testable, CAST(sum(off) AS BIGINT) AS off_founder, sum(tw / onf * testable) FILTER (onf > 0) / sum(testable) FILTER (onf > 0) AS invisible FROM p)
  SELECT calls, unedited, testable, off_founder, round(invisible, 6) AS invisible, round(off_founder / testable / (1 - invisible), 6) AS bound FROM a""", "routable", "seeds")
def frame_shift_bound(routable: DataFrame, seeds: DataFrame) -> DataFrame:
    return R.frame_shift_bound(with_sites(routable), seeds).withColumn("invisible", F.round("invisible", 6)).withColumn("bound", F.round("bound", 6))


@query("""WITH n AS (SELECT concat('g', CAST(l_linenumber % 4 AS STRING)) AS grp, l_returnflag AS label, count(*) AS n FROM {lineitem} WHERE NOT (l_linenumber % 4 = 1 AND l_returnflag = 'R') GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT grp FROM n), (SELECT DISTINCT label FROM n)),
  f AS (SELECT g.grp, g.label, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.grp) AS share FROM g LEFT JOIN n USING (grp, label)) SELECT f.grp, f.label, f.n, round(f.share, 6) AS share, round(f.share / r.share, 6) AS fold FROM f JOIN f r ON r.label = f.label AND r.grp = 'g2'""", "lineitem")
def composition_fold(lineitem: DataFrame) -> DataFrame:
    cells = lineitem.filter("NOT (l_linenumber % 4 = 1 AND l_returnflag = 'R')").select(F.concat(F.lit("g"), (F.col("l_linenumber") % 4).cast("string")).alias("grp"), F.col("l_returnflag").alias("label"))
    return R.composition(cells, "grp", "label", "g2").withColumn("share", F.round("share", 6)).withColumn("fold", F.round("fold", 6))


# UMIs said twice are two bases apart at least, so that none merge, and SQL can tell a cell's molecules: for each UMI the pattern with most reads, of equals the first seen, then the least.
VIEWS["far_umis"] = "SELECT cell, tape, concat(umi, umi) AS umi, pattern, s1, s2, s3, s4, s5, s6, read_no FROM {sc_reads}"
_MOL = """um AS (SELECT cell, tape, umi, pattern, s1, s2, s3, s4, s5, s6 FROM (SELECT cell, tape, umi, pattern, s1, s2, s3, s4, s5, s6, count(*) AS k, min(read_no) AS f FROM {far_umis} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cell, tape, umi ORDER BY k DESC, f, pattern) = 1),
  mo AS (SELECT cell, tape AS tp, concat(CAST(cell AS STRING), ':', tape) AS tape, pattern, CAST(count(*) AS BIGINT) AS n FROM um GROUP BY ALL)"""
_CALLED = f"""{_MOL}, p AS (SELECT tape, n, {_DEPTH} AS len, pattern FROM mo), x AS (SELECT tape, n, len, k, array_to_string(string_split(pattern, '|')[1:k], '|') AS prefix FROM p, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k) q WHERE k <= len),
  t AS (SELECT tape, prefix, CAST(k AS INT) AS depth, CAST(sum(n) AS BIGINT) AS subtree FROM x GROUP BY tape, prefix, k), u AS (SELECT *, array_to_string(string_split(prefix, '|')[1:depth-1], '|') AS parent FROM t WHERE depth > 0), r AS (SELECT *, row_number() OVER (PARTITION BY tape, parent ORDER BY subtree DESC, prefix) AS r FROM u),
  b AS (SELECT tape, parent, depth, min(prefix) FILTER (r = 1) AS prefix, coalesce(sum(subtree) FILTER (r > 1), 0) AS off, max(subtree) FILTER (r > 1) AS second FROM r GROUP BY tape, parent, depth),
  tot AS (SELECT tape, sum(n) AS total FROM p GROUP BY tape), l0 AS (SELECT tape, '' AS node, 0 AS off, false AS br FROM tot), {_STEP},
  ca AS (SELECT CAST(string_split(tape, ':')[1] AS BIGINT) AS cell, string_split(tape, ':')[2] AS tape, node AS chain, CAST(total - off AS BIGINT) AS support, (total - off) / total AS dominance, br AS branched FROM l6 JOIN tot USING (tape)),
  ok AS (SELECT * FROM ca WHERE support >= 3 AND dominance >= 0.6)"""


def molecules(reads: DataFrame) -> DataFrame:
    return L.umi_molecules(reads.withColumn("sites", all_sites()), ["cell", "tape"], floor=1)


def called(reads: DataFrame) -> DataFrame:
    return L.consensus(L.dominant(cut(molecules(reads)), ["cell", "tape"], weight="molecules"), 3, 0.6)


@query(f"WITH {_MOL} SELECT cell, tp AS tape, pattern, n AS molecules FROM mo", "far_umis")
def umi_molecules(reads: DataFrame) -> DataFrame:
    return molecules(reads).select("cell", "tape", F.array_join("sites", "|").alias("pattern"), "molecules")


@query(f"WITH {_CALLED} SELECT cell, tape, chain, support, round(dominance, 6) AS dominance, branched FROM ok", "far_umis")
def sc_consensus(reads: DataFrame) -> DataFrame:
    return called(reads).withColumn("dominance", F.round("dominance", 6))


@query(f"""WITH {_CALLED} SELECT cell, count(*) AS n_loci, count(*) FILTER (branched) AS n_doublet_loci, round(avg(dominance), 3) AS mean_dominance, CAST(sum(support) AS BIGINT) AS molecules, count(*) >= 4 AND avg(dominance) >= 0.75 AND count(*) FILTER (branched) <= 3 AS pass_qc FROM ok GROUP BY cell""", "far_umis")
def sc_cell_qc(reads: DataFrame) -> DataFrame:
    return R.passes(L.cell_qc(called(reads)), 4, 3, 0.75).withColumn("mean_dominance", F.round("mean_dominance", 3))


#: The founders of side A, as its cells mostly have them, on two tapes.
VIEWS["side_founders"] = "SELECT DISTINCT tape, 1 AS site, concat('A', substr(tape, 2, 2)) AS token FROM {routable} WHERE side = 'A' AND tape IN ('T1', 'T4')"


@query("""WITH c AS (SELECT cell, cell % 7 <> 0 AS pass_qc, count(*) AS n_loci FROM {routable} GROUP BY cell), d AS (SELECT cell, count(*) AS divergent FROM {routable} r JOIN {side_founders} f ON f.tape = r.tape WHERE r.s1 <> f.token GROUP BY cell)
  SELECT cell, pass_qc, n_loci, pass_qc AND n_loci >= 6 AS quality, coalesce(divergent, 0) AS divergent, pass_qc AND n_loci >= 6 AND divergent IS NULL AS kept FROM c LEFT JOIN d USING (cell)""", "routable", "side_founders")
def quality_gate(routable: DataFrame, founders: DataFrame) -> DataFrame:
    cells = routable.groupBy("cell").agg((F.col("cell") % 7 != 0).alias("pass_qc"), F.count("*").alias("n_loci"))
    return R.quality_gate(cells, with_sites(routable).select("cell", "tape", "sites"), founders, 6)
