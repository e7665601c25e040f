"""Queries of summary tables, over orders, lines and events as cells, types and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import VIEWS, query
from cladewright.functions import columns as C
from cladewright.operators import reads as R
from cladewright.operators import summaries as S
from cladewright.operators import trees as T
from cladewright.operators.scale import cut

from .trees import _DESC, ranked

VIEWS["typed"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS side, concat('t', CAST(o_custkey % 23 % 9 + CASE WHEN o_orderkey % 101 = 0 THEN 9 ELSE 0 END AS STRING)) AS cls, CAST(floor(o_totalprice) AS BIGINT) AS umi, concat('d', CAST(o_custkey % 4 AS STRING)) AS day FROM {orders}"
VIEWS["founders"] = "SELECT concat('T', CAST(n_nationkey % 11 AS STRING)) AS tape, CASE WHEN n_nationkey < 11 THEN 'A' ELSE 'B' END AS side, CASE n_nationkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN ' ' WHEN 2 THEN 'ACG-TTT' ELSE 'GGA' END AS genotype FROM {nation} WHERE n_nationkey < 22"
r6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


@query("SELECT tape, CAST(i AS INT) AS site, token FROM (SELECT tape, unnest(string_split(trim(genotype), '-')) AS token, unnest(range(1, 1 + len(string_split(trim(genotype), '-')))) AS i FROM {founders} WHERE trim(genotype) NOT IN ('', '(unedited)'))", "founders")
def founder_sites(founders: DataFrame) -> DataFrame:
    return S.founder_rows(founders)


@query("""WITH g AS (SELECT tape, side, CASE WHEN trim(genotype) IN ('', 'none') THEN '(unedited)' ELSE trim(genotype) END AS g FROM {founders})
  SELECT tape, coalesce(max(g) FILTER (side = 'A'), '(unedited)') AS a, coalesce(max(g) FILTER (side = 'B'), '(unedited)') AS b FROM g GROUP BY tape""", "founders")
def founder_table(founders: DataFrame) -> DataFrame:
    return S.founder_wide(founders)


@query("SELECT s1 AS token, CASE WHEN s1 = 'U' THEN '0' ELSE s1 END AS code, count(*) AS n FROM {genotypes} GROUP BY 1, 2", "genotypes")
def recoded_tokens(genotypes: DataFrame) -> DataFrame:
    return genotypes.select(F.col("s1").alias("token"), S.recoded(F.col("s1")).alias("code")).groupBy("token", "code").agg(F.count("*").alias("n"))




@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'plain' WHEN s_suppkey % 5 < 3 THEN concat('a-b', CAST(s_suppkey AS STRING), '-X', CAST(s_suppkey % 5 + 10 AS STRING)) ELSE concat('a-b', CAST(s_suppkey AS STRING), '-W', CAST(s_suppkey % 5 AS STRING)) END AS cell FROM {supplier}", "supplier", "region")
def remapped_wells(supplier: DataFrame, region: DataFrame) -> DataFrame:
    wells = region.filter("r_regionkey < 3").select(F.concat(F.lit("W"), F.col("r_regionkey").cast("string")).alias("well"), F.concat(F.lit("X"), (F.col("r_regionkey") + 10).cast("string")).alias("to"))
    cells = supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 == 0, "plain").otherwise(F.concat(F.lit("a-b"), F.col("s_suppkey").cast("string"), F.lit("-W"), (F.col("s_suppkey") % 5).cast("string"))).alias("cell"))
    return S.remapped(cells, wells)


@query("SELECT cls, count(*) FILTER (side = 'A') AS a, count(*) FILTER (side = 'B') AS b FROM {typed} GROUP BY cls HAVING count(*) FILTER (side = 'A') >= 20 AND count(*) FILTER (side = 'B') >= 20", "typed")
def type_universe(typed: DataFrame) -> DataFrame:
    return S.universe(typed, 20)


@query("WITH n AS (SELECT side, cls, count(*) / sum(count(*)) OVER (PARTITION BY side) AS p FROM {typed} GROUP BY side, cls) SELECT cls FROM n WHERE p >= 0.002 GROUP BY cls HAVING count(*) = 2", "typed")
def abundant_types(typed: DataFrame) -> DataFrame:
    return S.abundant(typed, 0.002)


VIEWS["droplets"] = "SELECT o_orderkey AS id, CAST(floor(o_totalprice / 100) AS BIGINT) AS umi, o_orderkey % 400 AS genes, o_orderkey % 10 / 20.0E0 AS unmatched, 60.0E0 + o_orderkey % 30 AS exon, o_custkey % 15 / 100.0E0 AS doublet, o_custkey % 7 + 0.0E0 AS ribo, o_custkey % 6 + 0.0E0 AS mito FROM {orders}"
_FLOOR = "umi >= 100 AND genes >= 50 AND unmatched < 0.4"


@query(f"""WITH s AS (SELECT avg(log2(umi)) AS m, stddev_samp(log2(umi)) AS sd FROM {{droplets}} WHERE {_FLOOR} AND exon <= 85) SELECT id, {_FLOOR} AND log2(greatest(umi, 1)) >= m - sd AND log2(greatest(umi, 1)) <= m + 2 * sd AND exon <= 85 AND doublet <= 0.1 AND ribo <= 5 AND mito <= 5 AS ok FROM {{droplets}}, s""", "droplets")
def transcriptome_qc(droplets: DataFrame) -> DataFrame:
    return S.transcriptome_qc(droplets).select("id", "ok")


VIEWS["scored_pairs"] = "SELECT ps AS cell, concat('t', CAST(a AS STRING)) AS a, concat('u', CAST(b AS STRING)) AS b FROM (SELECT l_linenumber % 3 AS ps, l_partkey % 9 AS a, l_suppkey % 7 AS b, count(*) AS n FROM {lineitem} GROUP BY 1, 2, 3) q WHERE n >= 1 AND (2 * ps + a + b) % 5 <> 0"


@query("SELECT a, b FROM {scored_pairs} GROUP BY a, b HAVING count(DISTINCT cell) = 3", "scored_pairs")
def grid_pairs(pairs: DataFrame) -> DataFrame:
    return S.pair_grid(pairs, 3)


@query("""WITH n AS (SELECT day, cls, count(*) AS n FROM {typed} WHERE NOT (day = 'd1' AND cls = 't2') GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT day FROM n), (SELECT DISTINCT cls FROM n))
  SELECT day, cls, round(log2(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY day) + 1), 6) AS value FROM g LEFT JOIN n USING (day, cls)""", "typed")
def composition_by_day(typed: DataFrame) -> DataFrame:
    return S.composition_log(typed.filter("NOT (day = 'd1' AND cls = 't2')"), "day", "cls").withColumn("value", F.round("value", 6))


@query("""WITH v AS (SELECT id, side, umi, log10(umi) AS v FROM {typed} WHERE umi > 0), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v), b AS (SELECT id, side, CAST(CASE WHEN hi > lo THEN least(39, floor((v - lo) / (hi - lo) * 40)) ELSE 0 END AS INT) AS bin FROM v, e),
  n AS (SELECT bin, side, count(*) AS n FROM b GROUP BY 1, 2), f AS (SELECT bin, min(n) AS few FROM n GROUP BY bin HAVING count(*) = 2)
  SELECT id, side, bin FROM b JOIN f USING (bin) QUALIFY row_number() OVER (PARTITION BY bin, side ORDER BY md5('1:' || CAST(id AS VARCHAR)), id) <= few""", "typed")
def matched_cells(typed: DataFrame) -> DataFrame:
    return S.matched(typed.filter("umi > 0").select("id", "side", "umi"), "side", "umi").select("id", "side", "bin")


@query("SELECT day, side, count(umi) AS n, quantile_cont(umi, 0.25) AS q1, quantile_cont(umi, 0.5) AS median, quantile_cont(umi, 0.75) AS q3 FROM {typed} GROUP BY day, side", "typed")
def umi_quartiles(typed: DataFrame) -> DataFrame:
    return S.quartiles(typed, ["day", "side"], "umi")


@query("WITH k AS (SELECT cell, count(*) AS k FROM {genotypes} GROUP BY cell) SELECT side, CASE WHEN k >= 11 THEN '11+' ELSE CAST(k AS STRING) END AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY side), 6) AS share FROM (SELECT CASE WHEN cell % 2 = 0 THEN 'A' ELSE 'B' END AS side, k FROM k) GROUP BY 1, 2", "genotypes")
def tapes_histogram(genotypes: DataFrame) -> DataFrame:
    k = genotypes.groupBy("cell").agg(F.count("*").alias("k")).withColumn("side", F.when(F.col("cell") % 2 == 0, "A").otherwise("B"))
    return S.open_histogram(k, "side", "k", 11).withColumn("share", F.round("share", 6))


@query("""WITH x AS (SELECT day, id, cls, coalesce(CAST(cls <> lag(cls) OVER w AS INT), 1) AS nw FROM {typed} WINDOW w AS (PARTITION BY day ORDER BY id)), r AS (SELECT *, sum(nw) OVER (PARTITION BY day ORDER BY id) AS run FROM x)
  SELECT day, cls, min(id) AS first, max(id) AS last, count(*) AS n FROM r GROUP BY day, run, cls""", "typed")
def category_runs(typed: DataFrame) -> DataFrame:
    return S.runs(typed, "id", "cls", "day")


VIEWS["pairs_one"] = "SELECT concat('t', CAST(l_partkey % 11 AS STRING)) AS a, concat('u', CAST(l_suppkey % 5 AS STRING)) AS b, min(l_linenumber) + 0.5E0 AS depth FROM {lineitem} WHERE (l_partkey % 11 + l_suppkey % 5) % 4 <> 0 GROUP BY 1, 2"
VIEWS["pairs_two"] = "SELECT concat('u', CAST(l_suppkey % 5 AS STRING)) AS a, concat('t', CAST(l_partkey % 11 AS STRING)) AS b, max(l_linenumber) + 0.25E0 AS depth FROM {lineitem} WHERE (l_partkey % 11 + l_suppkey % 5) % 3 <> 0 GROUP BY 1, 2"


@query("""SELECT coalesce(o.a, t.b) AS a, coalesce(o.b, t.a) AS b, o.depth AS depth_one, t.depth AS depth_two, t.depth - o.depth AS shift, CASE WHEN o.depth IS NULL THEN 'two only' WHEN t.depth IS NULL THEN 'one only' ELSE 'both' END AS outcome
  FROM {pairs_one} o FULL JOIN {pairs_two} t ON t.b = o.a AND t.a = o.b""", "pairs_one", "pairs_two")
def compared_couplings(one: DataFrame, two: DataFrame) -> DataFrame:
    return S.compared(one, two)


VIEWS["pairings"] = "SELECT concat('t', CAST(l_partkey % 11 AS STRING)) AS cls, concat('u', CAST(l_suppkey % 5 AS STRING)) AS partner, count(*) + 0.0E0 AS fold, count(*) % 3 = 0 AS captured, (count(*) % 10) / 100.0E0 AS q_a, (count(*) % 7) / 100.0E0 AS q_b FROM {lineitem} GROUP BY 1, 2"


@query("SELECT cls, partner, CASE WHEN captured THEN 'captured' WHEN q_a < 0.05 AND q_b < 0.05 THEN 'both' ELSE 'other' END AS class FROM {pairings}", "pairings")
def pairing_classes(pairings: DataFrame) -> DataFrame:
    return S.pair_classes(pairings).select("cls", "partner", "class")


@query("""WITH o AS (SELECT cls, partner, q_a < 0.05 AS also FROM {pairings} WHERE partner <> 'u2') SELECT p.cls, count(*) AS tested, count(*) FILTER (captured) AS captured, count(also) AS testable, count(*) FILTER (captured AND coalesce(also, false)) AS retained,
  coalesce(string_agg(p.partner, ',' ORDER BY fold DESC, p.partner) FILTER (captured), '') AS partners FROM {pairings} p LEFT JOIN o ON o.cls = p.cls AND o.partner = p.partner GROUP BY p.cls""", "pairings")
def pairing_rollup(pairings: DataFrame) -> DataFrame:
    return S.rolled_up(pairings, pairings.filter("partner <> 'u2'").select("cls", "partner", (F.col("q_a") < 0.05).alias("captured")))


VIEWS["guesses"] = "SELECT l_orderkey AS id, l_linenumber AS seed, concat('t', CAST(l_orderkey % 5 AS STRING)) AS truth, concat('t', CAST((l_orderkey + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END) % 5 AS STRING)) AS guess, concat('d', CAST(l_orderkey % 3 AS STRING)) AS day FROM {lineitem}"


@query("SELECT day, truth, count(*) AS n, round(avg(CAST(truth = guess AS INT)), 6) AS accuracy FROM {guesses} GROUP BY day, truth", "guesses")
def accuracy_by_day(guesses: DataFrame) -> DataFrame:
    return S.accuracy(guesses, ["day", "truth"])[0].withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT id, truth FROM {guesses} WHERE truth = guess GROUP BY id, truth HAVING count(DISTINCT seed) >= 4", "guesses")
def robust_guesses(guesses: DataFrame) -> DataFrame:
    return S.accuracy(guesses, ["day"], 4)[1]


@query("SELECT cls, round(sum(r), 6) AS rate, count(*) AS tapes FROM (SELECT concat('c', CAST(cell % 6 AS STRING)) AS cls, tape, avg(CASE WHEN s2 = 'U' THEN 0 WHEN s3 = 'U' THEN 1 ELSE 2 END) / 13.5 AS r FROM {genotypes} GROUP BY 1, 2) q GROUP BY cls", "genotypes")
def rate_after_prefix(genotypes: DataFrame) -> DataFrame:
    edits = F.when(F.col("s2") == "U", 0).when(F.col("s3") == "U", 1).otherwise(2)
    return S.rate_after_prefix(genotypes.select(F.concat(F.lit("c"), (F.col("cell") % 6).cast("string")).alias("cls"), "tape", edits.alias("edits"))).withColumn("rate", F.round("rate", 6))


@query("SELECT concat('s', CAST(n_regionkey AS STRING)) AS sample, count(*) AS barcodes, count(*) FILTER (n_nationkey % 3 = 0) AS single, count(*) FILTER (n_nationkey % 3 > 0) AS multiple, CAST(sum(n_nationkey % 3 + 1) AS BIGINT) AS integrations FROM {nation} GROUP BY 1", "nation")
def copy_summary(nation: DataFrame) -> DataFrame:
    return S.copy_summary(nation.select(F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("sample"), (F.col("n_nationkey") % 3 + 1).alias("copies")))


_WHY = "CASE WHEN m = 1 THEN 'short' WHEN m = 6 OR m = 5 AND d >= 2 THEN 'junction' WHEN d < 6 THEN 'unedited' ELSE 'full' END"


@query(f"WITH w AS (SELECT {_WHY} AS why, CAST(CASE WHEN m = 1 OR m = 6 THEN 1 WHEN m = 5 AND d >= 2 THEN 3 END AS INT) AS site FROM {{bulk_reads}}) SELECT why, site, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY why), 6) AS share FROM w GROUP BY why, site", "bulk_reads")
def failure_table(reads: DataFrame) -> DataFrame:
    return S.failures(R.parse_bulk(cut(reads.select("seq")))).withColumn("share", F.round("share", 6))


@query("""WITH p AS (SELECT l_partkey % 50 AS id, count(*) % 40 AS k, 4.0E0 + l_partkey % 50 % 9 AS mean FROM {lineitem} GROUP BY 1, 3), t AS (SELECT id, k, mean, unnest(range(0, 400)) AS i FROM p)
  SELECT id, round(CASE WHEN k <= 0 THEN 1 ELSE sum(exp(i * ln(mean) - mean - lgamma(i + 1))) FILTER (i >= k) END, 9) AS tail FROM t GROUP BY id, k, mean""", "lineitem")
def poisson_tails(lineitem: DataFrame) -> DataFrame:
    n = lineitem.groupBy((F.col("l_partkey") % 50).alias("id")).agg((F.count("*") % 40).alias("k")).withColumn("mean", 4.0 + F.col("id") % 9)
    return n.select("id", F.round(S.poisson_tail("k", "mean"), 9).alias("tail"))


@query("""WITH p AS (SELECT l_partkey % 50 AS id, count(*) % 40 AS k, 4.0E0 + l_partkey % 50 % 9 AS mean, 2.5E0 * (4.0E0 + l_partkey % 50 % 9) AS var FROM {lineitem} GROUP BY 1, 3, 4), t AS (SELECT *, mean * mean / (var - mean) AS r, mean / var AS p, unnest(range(0, 900)) AS i FROM p)
  SELECT id, round(CASE WHEN k <= 0 THEN 1 ELSE sum(exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) + r * ln(p) + i * ln(1 - p))) FILTER (i >= k) END, 9) AS tail FROM t GROUP BY id, k""", "lineitem")
def negative_binomial_tails(lineitem: DataFrame) -> DataFrame:
    n = lineitem.groupBy((F.col("l_partkey") % 50).alias("id")).agg((F.count("*") % 40).alias("k")).withColumn("mean", 4.0 + F.col("id") % 9)
    return n.select("id", F.round(S.negative_binomial_tail("k", "mean", 2.5 * F.col("mean")), 9).alias("tail"))


@query("""WITH g AS (SELECT cls, count(*) AS drawn, count(*) FILTER (side = 'A') AS hits, sum(count(*)) OVER () AS total, sum(count(*) FILTER (side = 'A')) OVER () AS marked FROM {typed} GROUP BY cls)
  SELECT cls, drawn, hits, round(drawn * marked / total, 6) AS expected, round(hits / (drawn * marked / total), 6) AS fold, round((hits - drawn * marked / total) / sqrt(drawn * (marked / total) * (1 - marked / total) * (total - drawn) / (total - 1)), 6) AS z FROM g""", "typed")
def subset_null(typed: DataFrame) -> DataFrame:
    g = typed.groupBy("cls").agg(F.count("*").alias("drawn"), F.count_if(F.col("side") == "A").alias("hits"))
    all_ = typed.agg(F.count("*").alias("total"), F.count_if(F.col("side") == "A").alias("marked"))
    out = S.hypergeometric(g.join(F.broadcast(all_)), F.col("total"), F.col("marked"), F.col("drawn"), F.col("hits"))
    return out.select("cls", "drawn", "hits", *r6("expected", "fold", "z"))


_FAR = "lgamma(marked + 1) - lgamma(k + 1) - lgamma(marked - k + 1) + lgamma(total - marked + 1) - lgamma(drawn - k + 1) - lgamma(total - marked - drawn + k + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)"


@query(f"""WITH g AS (SELECT id % 5 AS batch, cls, count(*) AS drawn, count(*) FILTER (side = 'A' OR id % 23 < 2) AS hits FROM {{typed}} GROUP BY 1, 2), a AS (SELECT *, sum(drawn) OVER (PARTITION BY batch) AS total, sum(hits) OVER (PARTITION BY batch) AS marked FROM g),
  m AS (SELECT *, drawn * marked / total AS mean FROM a), k AS (SELECT *, unnest(range(CAST(greatest(0, drawn + marked - total) AS BIGINT), CAST(least(drawn, marked) AS BIGINT) + 1)) AS k FROM m),
  p AS (SELECT batch, cls, drawn, hits, mean, least(1, sum(CASE WHEN abs(k - mean) >= abs(hits - mean) - 1e-9 * greatest(1, mean) THEN exp({_FAR}) ELSE 0 END)) AS p FROM k GROUP BY batch, cls, drawn, hits, mean),
  q AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS x FROM p), r AS (SELECT *, least(1, min(x) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM q)
  SELECT batch, cls, drawn, hits, round(hits / mean, 6) AS fold, round(p, 7) AS p, round(q, 7) AS q, q < 0.3 AND hits / mean <= 1 / 1.05 AS low, q < 0.3 AND hits / mean >= 1.05 AS high FROM r""", "typed")
def subset_tests(typed: DataFrame) -> DataFrame:
    mark = F.count_if((F.col("side") == "A") | (F.col("id") % 23 < 2)).alias("hits")
    g = typed.groupBy((F.col("id") % 5).alias("batch"), "cls").agg(F.count("*").alias("drawn"), mark)
    all_ = g.groupBy(F.col("batch").alias("_b")).agg(F.sum("drawn").alias("total"), F.sum("hits").alias("marked"))
    out = S.tested_subsets(g.join(F.broadcast(all_), F.col("batch") == F.col("_b")), F.col("total"), F.col("marked"), F.col("drawn"), F.col("hits"), 0.3, 1.05)
    return out.select("batch", "cls", "drawn", "hits", F.round("fold", 6).alias("fold"), F.round("p", 7).alias("p"), F.round("q", 7).alias("q"), "low", "high")


@query(f"""WITH RECURSIVE {_DESC}, c AS (SELECT anc AS node, count(*) AS tips, count(DISTINCT n.celltype) AS kinds FROM d JOIN {{nodes}} n ON n.node = d.node WHERE n.is_leaf GROUP BY anc)
  SELECT node, CAST(tips AS BIGINT) AS tips, kinds, CAST(row_number() OVER (ORDER BY kinds DESC, abs(tips - 12), node) AS BIGINT) AS rank FROM c WHERE tips BETWEEN 6 AND 30 QUALIFY rank <= 10""", "nodes")
def diverse_clades(nodes: DataFrame) -> DataFrame:
    below = T.class_counts(cut(ranked(nodes)), nodes.filter("is_leaf").select("node", F.col("celltype").alias("cls")))
    return S.diverse_clade(below, 6, 30, 12).withColumn("rank", F.col("rank").cast("long"))


VIEWS["expression"] = "SELECT l_orderkey % 200 AS cell, concat('g', CAST(l_partkey % 60 AS STRING)) AS gene, count(*) AS n FROM {lineitem} GROUP BY 1, 2"
_NORM = "v AS (SELECT cell, gene, ln(1 + 10000.0 * n / sum(n) OVER (PARTITION BY cell)) AS value FROM {expression})"
_VAR = "g AS (SELECT gene, sum(value) / 200 AS mean, (sum(value * value) - sum(value) * sum(value) / 200) / 199 AS variance FROM v GROUP BY gene), h AS (SELECT *, row_number() OVER (ORDER BY round(variance / mean, 9) DESC, gene) AS rank FROM g)"


@query(f"WITH {_NORM} SELECT cell, gene, round(value, 6) AS value FROM v", "expression")
def log_normal(expression: DataFrame) -> DataFrame:
    return S.log_normal(expression).withColumn("value", F.round("value", 6))


#: Few of a cell's genes are seen in it, and some cells have none.
VIEWS["sparse"] = "SELECT l_orderkey % 200 AS cell, concat('g', CAST(l_partkey % 60 AS STRING)) AS gene, count(*) AS n FROM {lineitem} WHERE (l_partkey * 7 + l_orderkey) % 5 = 0 AND l_orderkey % 200 <> 17 GROUP BY 1, 2"
VIEWS["all_cells"] = "SELECT l_orderkey % 200 AS cell, l_orderkey % 200 % 2 = 0 AS first FROM {lineitem} GROUP BY 1, 2"
_SPARSE = "v AS (SELECT cell, gene, ln(1 + 10000.0 * n / sum(n) OVER (PARTITION BY cell)) AS value FROM {sparse}), gr AS (SELECT cell, first, gene, coalesce(value, 0) AS value FROM {all_cells} c CROSS JOIN (SELECT DISTINCT gene FROM v) g LEFT JOIN v USING (cell, gene))"
_DENSE = "g AS (SELECT gene, avg(value) AS mean, var_samp(value) AS variance FROM gr GROUP BY gene), h AS (SELECT *, row_number() OVER (ORDER BY round(variance / mean, 9) DESC, gene) AS rank FROM g)"


@query(f"WITH {_SPARSE}, {_DENSE} SELECT cell, gene, round(least(10, (value - mean) / sqrt(variance)), 5) AS z FROM gr JOIN h USING (gene) WHERE rank <= 20", "sparse", "all_cells")
def scaled_variable_genes(sparse: DataFrame, cells: DataFrame) -> DataFrame:
    v = cut(S.log_normal(sparse))
    return S.scaled(v, S.variable_genes(v, cells.count(), 20), cells).withColumn("z", F.round("z", 5))


@query(f"""WITH {_SPARSE}, s AS (SELECT gene, sum(value) AS s FROM v GROUP BY gene), b AS (SELECT gene, floor((row_number() OVER (ORDER BY s, gene) - 1) * 6 / count(*) OVER ()) AS bin FROM s),
  own AS (SELECT 'm' || CAST(k % 3 AS VARCHAR) AS name, 'g' || CAST(k AS VARCHAR) AS gene FROM (SELECT unnest(range(0, 30)) AS k) q WHERE 'g' || CAST(k AS VARCHAR) IN (SELECT gene FROM s)),
  ct AS (SELECT DISTINCT name, gene FROM (SELECT o.name, y.gene FROM own o JOIN b x ON x.gene = o.gene JOIN b y ON y.bin = x.bin QUALIFY row_number() OVER (PARTITION BY o.name, o.gene ORDER BY md5('1:' || o.name || ':' || o.gene || ':' || y.gene), y.gene) <= 4) z),
  a AS (SELECT cell, name, avg(value) AS x FROM gr JOIN own USING (gene) GROUP BY 1, 2), c AS (SELECT cell, name, avg(value) AS x FROM gr JOIN ct USING (gene) GROUP BY 1, 2) SELECT cell, name, round(a.x - c.x, 6) AS score FROM a JOIN c USING (cell, name)""", "sparse", "all_cells")
def module_scores(sparse: DataFrame, cells: DataFrame) -> DataFrame:
    sets = sparse.sparkSession.createDataFrame([(f"m{k % 3}", f"g{k}") for k in range(30)] + [("m0", "unknown")], "name string, gene string")
    return S.module_score(cut(S.log_normal(sparse)), sets, cells, 6, 4).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SPARSE}, s AS (SELECT gene, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, avg(value) FILTER (first) AS m1, avg(value) FILTER (NOT first) AS m2, var_samp(value) FILTER (first) AS v1, var_samp(value) FILTER (NOT first) AS v2 FROM gr GROUP BY gene)
  SELECT gene, n1, n2, round(m1 - m2, 6) AS difference, round((m1 - m2) / sqrt((v1 + v2) / 2), 5) AS d FROM s""", "sparse", "all_cells")
def effect_sizes(sparse: DataFrame, cells: DataFrame) -> DataFrame:
    return S.effect_sizes(cut(S.log_normal(sparse)), cells).withColumn("difference", F.round("difference", 6)).withColumn("d", F.round("d", 5))


@query(f"""WITH {_SPARSE}, r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, value) AS t FROM gr),
  s AS (SELECT gene, CAST(count(*) FILTER (first) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT first) AS DOUBLE) AS n2, sum(rk) FILTER (first) AS w, sum(CAST(t AS DOUBLE) * t - 1) AS ties, avg(CAST(value > 0 AS INT)) FILTER (first) AS pct1, avg(CAST(value > 0 AS INT)) FILTER (NOT first) AS pct2, avg(exp(value) - 1) FILTER (first) AS e1, avg(exp(value) - 1) FILTER (NOT first) AS e2 FROM r GROUP BY gene),
  u AS (SELECT *, w - n1 * (n1 + 1) / 2 AS u, w - n1 * (n1 + 1) / 2 - n1 * n2 / 2 AS o, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM s)
  SELECT gene, round(pct1, 6) AS pct1, round(pct2, 6) AS pct2, round(log2(e1 + 1) - log2(e2 + 1), 6) AS log2fc, round(u, 3) AS u, round(sign(o) * greatest(0, abs(o) - 0.5) / sd, 6) AS z FROM u WHERE pct1 >= 0.01 OR pct2 >= 0.01""", "sparse", "all_cells")
def marker_genes(sparse: DataFrame, cells: DataFrame) -> DataFrame:
    out = S.markers(cut(S.log_normal(sparse)), cells)
    return out.select("gene", *[F.round(c, 6).alias(c) for c in ("pct1", "pct2", "log2fc")], F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@query("WITH a AS (SELECT cell, gene, n FROM {expression} WHERE cell < 100 AND gene <> 'g7'), b AS (SELECT cell, gene, n FROM {expression} WHERE cell >= 100 AND gene <> 'g9') SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) q WHERE gene IN (SELECT gene FROM a INTERSECT SELECT gene FROM b)", "expression")
def common_genes(expression: DataFrame) -> DataFrame:
    return S.common(expression.filter("cell < 100 AND gene <> 'g7'"), expression.filter("cell >= 100 AND gene <> 'g9'"))


@query("SELECT a, b, age, disc FROM (SELECT l_orderkey AS a, l_partkey AS b, l_linenumber * 2.5E0 AS age, l_suppkey % 4 - 1.0E0 AS disc FROM {lineitem}) q WHERE age >= 12.5 AND disc >= 0 AND disc <= 1", "lineitem")
def eligible_pairs(lineitem: DataFrame) -> DataFrame:
    return S.eligible(lineitem.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_linenumber") * 2.5).alias("age"), (F.col("l_suppkey") % 4 - 1.0).alias("disc")), 12.5, 1.0)


@query("""SELECT cell, tape, CASE WHEN s1 = 'U' THEN '-' ELSE replace(regexp_replace(pattern, '(\\|U)+$', ''), '|', '-') END AS chain, CAST((CAST(substr(tape, 2, 2) AS BIGINT) * 6 + 2) * 8192 + length(s3) AS BIGINT) AS token FROM {genotypes}""", "genotypes")
def chain_texts(genotypes: DataFrame) -> DataFrame:
    sites = F.array(*[F.col(f"s{i}") for i in range(1, 7)])
    token = C.token_id(F.substring("tape", 2, 2).cast("long"), F.lit(2), F.length("s3"))
    return genotypes.select("cell", "tape", C.chain_text(sites).alias("chain"), token.cast("long").alias("token"))


@query("""SELECT node, CASE WHEN time < 0 THEN NULL WHEN time < 1.5 THEN 'E0' WHEN time < 1.75 THEN 'E1.5' WHEN time < 4.25 THEN 'E1.75' WHEN time < 8.5 THEN 'E4.25' ELSE 'E8.5' END AS day, coalesce(m.name, n.key) AS name FROM (SELECT node, time, trim(regexp_replace(lower(concat(' ', celltype, '--Of_', celltype)), '[^a-z0-9]+', ' ', 'g')) AS key FROM {nodes}) n
  LEFT JOIN (SELECT 'ct1 of ct1' AS key, 'one' AS name) m USING (key)""", "nodes")
def day_labels(nodes: DataFrame) -> DataFrame:
    """Day labels of times, and names in normal form with a manual map."""
    by_hand = nodes.sparkSession.createDataFrame([("ct1 of ct1", "one")], "key string, name string")
    x = nodes.select("node", C.day_bin(F.col("time"), [0.0, 1.5, 1.75, 4.25, 8.5]).alias("day"), C.normal_name(F.concat(F.lit(" "), "celltype", F.lit("--Of_"), "celltype")).alias("key"))
    return x.join(F.broadcast(by_hand), "key", "left").select("node", "day", F.coalesce("name", "key").alias("name"))
