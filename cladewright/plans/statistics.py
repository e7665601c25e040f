"""Queries on enrichment, dominance, ranks and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import VIEWS, query
from cladewright.operators import pairings as P
from cladewright.operators import statistics as S
from cladewright.operators import trees as T

VIEWS["members"] = "SELECT CAST(floor(node / 8.0) AS BIGINT) AS clade, celltype AS cls, node FROM {nodes} WHERE is_leaf"
VIEWS["clones"] = "SELECT l_suppkey % 4 AS grp, l_partkey % 37 AS clone, count(*) AS n FROM {lineitem} GROUP BY l_suppkey % 4, l_partkey % 37"
VIEWS["tests"] = "SELECT o_orderkey AS id, (o_orderkey * 7919 % 1000 + 1) / 1000.0E0 AS p FROM {orders}"


@query("SELECT x.a, x.b, count(*) AS observed FROM (SELECT DISTINCT p.clade, p.cls AS a, q.cls AS b FROM {members} p JOIN {members} q ON p.clade = q.clade AND p.cls <= q.cls) x GROUP BY x.a, x.b", "members")
def clade_cooccurrence(members: DataFrame) -> DataFrame:
    return S.cooccurrence(members)


@query("""WITH n AS (SELECT cls, count(*) AS n FROM {members} GROUP BY cls), c AS (SELECT clade, count(*) AS s FROM {members} GROUP BY clade), t AS (SELECT count(*) AS total, count(DISTINCT clade) AS k FROM {members}),
  p AS (SELECT a.cls AS a, b.cls AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.cls < b.cls), m AS (SELECT DISTINCT unnest([na, nb, na + nb]) AS m FROM p),
  f AS (SELECT m, sum(CASE WHEN total - m >= s THEN exp(lgamma(total - m + 1) - lgamma(total - m - s + 1) - lgamma(total + 1) + lgamma(total - s + 1)) ELSE 0 END) AS f FROM m, c, t GROUP BY m),
  o AS (SELECT x.a, x.b, count(*) AS observed FROM (SELECT DISTINCT p.clade, p.cls AS a, q.cls AS b FROM {members} p JOIN {members} q ON p.clade = q.clade AND p.cls < q.cls) x GROUP BY x.a, x.b),
  e AS (SELECT p.a, p.b, coalesce(observed, 0) AS observed, k - x.f - y.f + z.f AS e FROM p JOIN f x ON x.m = na JOIN f y ON y.m = nb JOIN f z ON z.m = na + nb LEFT JOIN o ON o.a = p.a AND o.b = p.b, t)
  SELECT a, b, observed, round(e, 6) AS expected, round(log2((observed + 1) / (e + 1)), 6) AS log2fold FROM e""", "members")
def clade_enrichment(members: DataFrame) -> DataFrame:
    return S.enrichment(members).withColumn("expected", F.round("expected", 6)).withColumn("log2fold", F.round("log2fold", 6))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n) AS r, sum(n) OVER (PARTITION BY grp ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY grp) AS total FROM {clones})
  SELECT grp, count(*) AS groups, round(2 * sum(r * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini, count(*) FILTER (2 * (cum - n) < total) AS k_half FROM r GROUP BY grp""", "clones")
def clone_gini(clones: DataFrame) -> DataFrame:
    return S.gini(clones, "grp").withColumn("gini", F.round("gini", 6))


@query("""SELECT grp, clone, n, round(sum(n) OVER (PARTITION BY grp) * sum(n) OVER (PARTITION BY clone) / sum(n) OVER (), 6) AS expected,
  CASE WHEN n >= 10 THEN round(log2(n / (sum(n) OVER (PARTITION BY grp) * sum(n) OVER (PARTITION BY clone) / sum(n) OVER ())), 6) END AS log2fc FROM {clones}""", "clones")
def founder_type_log2fc(clones: DataFrame) -> DataFrame:
    return S.log2_enrichment(clones, "grp", "clone").withColumn("expected", F.round("expected", 6)).withColumn("log2fc", F.round("log2fc", 6))


@query("""WITH x AS (SELECT id, p, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS x FROM {tests}) SELECT id, p, round(least(1.0, min(x) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 9) AS q FROM x""", "tests")
def bh_qvalues(tests: DataFrame) -> DataFrame:
    return S.bh(tests).withColumn("q", F.round("q", 9))


_RANK = "rank() OVER (PARTITION BY l_returnflag ORDER BY {0}) + (count(*) OVER (PARTITION BY l_returnflag, {0}) - 1) / 2.0"


@query(f"SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT l_returnflag, {_RANK.format('l_quantity')} AS x, {_RANK.format('l_extendedprice')} AS y FROM {{lineitem}}) q GROUP BY l_returnflag".replace("{{lineitem}}", "{lineitem}"), "lineitem")
def spearman_by_group(lineitem: DataFrame) -> DataFrame:
    return S.spearman(lineitem.select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", "l_returnflag").withColumn("rho", F.round("rho", 6))


@query(f"""WITH r AS (SELECT l_returnflag, l_linestatus = 'O' AS f, {_RANK.format('l_quantity')} AS r FROM {{lineitem}}), a AS (SELECT l_returnflag, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(r) FILTER (f) AS w FROM r GROUP BY l_returnflag), t AS (SELECT l_returnflag, sum(k * k * k - k) AS ties FROM (SELECT l_returnflag, l_quantity, CAST(count(*) AS DOUBLE) AS k FROM {{lineitem}} GROUP BY 1, 2) GROUP BY 1)
  SELECT l_returnflag, n1, n2, w - n1 * (n1 + 1) / 2 AS u, round((w - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6) AS z,
  round((w - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z_tied FROM a JOIN t USING (l_returnflag)""", "lineitem")
def wilcoxon_z(lineitem: DataFrame) -> DataFrame:
    return S.rank_sum(lineitem.select("l_returnflag", "l_quantity", (F.col("l_linestatus") == "O").alias("first")), "l_quantity", "first", "l_returnflag").withColumn("z", F.round("z", 6)).withColumn("z_tied", F.round("z_tied", 6))


@query("""WITH s AS (SELECT a.node AS a, b.node AS b, a.celltype AS ca, b.celltype AS cb FROM {nodes} a JOIN {nodes} b USING (parent) WHERE a.node < b.node AND a.is_leaf AND b.is_leaf), n AS (SELECT celltype AS cls, count(*) AS n FROM {nodes} WHERE is_leaf GROUP BY 1),
  e AS (SELECT cls, (SELECT count(*) FROM s WHERE ca = cls AND cb = cls) AS observed, (SELECT count(*) FROM s) * n * (n - 1) / ((SELECT sum(n) FROM n) * ((SELECT sum(n) FROM n) - 1)) AS e FROM n)
  SELECT cls, observed, round(e, 6) AS expected, round(log2((observed + 1) / (e + 1)), 6) AS log2fold FROM e""", "nodes")
def sibling_concordance_exact(nodes: DataFrame) -> DataFrame:
    leaves = nodes.filter("is_leaf")
    return S.sibling_concordance(T.sibling_pairs(leaves), leaves.select("node", F.col("celltype").alias("cls"))).withColumn("expected", F.round("expected", 6)).withColumn("log2fold", F.round("log2fold", 6))


@query("SELECT a, b, disc, shared FROM (SELECT l_orderkey AS a, l_partkey AS b, l_linenumber % 3 AS disc, l_suppkey % 5 AS shared FROM {lineitem}) q QUALIFY row_number() OVER (PARTITION BY a ORDER BY disc, shared DESC, b) = 1", "lineitem")
def captured_pairings(lineitem: DataFrame) -> DataFrame:
    return S.captured_pairings(lineitem.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_linenumber") % 3).alias("disc"), (F.col("l_suppkey") % 5).alias("shared")))


_U = "(CAST('0x' || substr(md5('1:' || CAST(rep AS VARCHAR) || ':' || CAST(founder AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0"


@query(f"""WITH g AS (SELECT rep, founder, CAST(1 + floor(ln({_U}) / ln(1 - 0.05)) AS BIGINT) AS n FROM (SELECT n_nationkey AS founder, unnest(range(1, 51)) AS rep FROM {{nation}})), r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY n) AS r FROM g),
  i AS (SELECT rep, 2 * sum(r * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) AS gini FROM r GROUP BY rep) SELECT 'all' AS grp, round(quantile_cont(gini, 0.5), 6) AS median, round(quantile_cont(gini, 0.025), 6) AS lo, round(quantile_cont(gini, 0.975), 6) AS hi FROM i""", "nation")
def gini_null(nation: DataFrame) -> DataFrame:
    """The band of the Gini index of clone sizes under a pure birth process."""
    sizes = S.geometric_sizes(nation.select(F.col("n_nationkey").alias("founder")), 0.05, 50)
    band = S.null_band(S.gini(sizes, "rep").withColumn("grp", F.lit("all")), "grp", "gini")
    return band.select("grp", *[F.round(c, 6).alias(c) for c in ("median", "lo", "hi")])


def concordance_null(nodes: DataFrame, stratum: str | None) -> DataFrame:
    leaves = nodes.filter("is_leaf").select("node", F.col("celltype").alias("cls"), (F.col("node") % 2).alias("side"))
    s = S.shuffled(leaves, 20, stratum=stratum)
    pairs = T.sibling_pairs(nodes.filter("is_leaf"))
    both = pairs.join(s.select(F.col("node").alias("a"), "rep", F.col("cls").alias("ca")), "a").join(s.select(F.col("node").alias("b"), "rep", F.col("cls").alias("cb")), ["b", "rep"])
    per = both.groupBy("rep", F.col("ca").alias("cls")).agg(F.count_if(F.col("ca") == F.col("cb")).alias("n"))
    return S.permutation_moments(per, ["cls"], 20).select("cls", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def _null(stratum: str) -> str:
    return f"""WITH l AS (SELECT node, parent, celltype AS cls, {stratum} AS side, rep FROM {{nodes}}, (SELECT unnest(range(1, 21)) AS rep) WHERE is_leaf), t AS (SELECT *, row_number() OVER (PARTITION BY rep, side ORDER BY md5('1:' || CAST(rep AS VARCHAR) || ':' || CAST(node AS VARCHAR)), node) AS k, row_number() OVER (PARTITION BY rep, side ORDER BY node) AS j FROM l),
  s AS (SELECT a.rep, a.node, a.parent, b.cls FROM t a JOIN t b ON a.rep = b.rep AND a.side = b.side AND a.k = b.j), p AS (SELECT x.rep, x.cls, count(*) FILTER (x.cls = y.cls) AS n FROM s x JOIN s y ON x.rep = y.rep AND x.parent = y.parent AND x.node < y.node GROUP BY 1, 2)
  SELECT cls, round(sum(n) / 20, 6) AS mean, round((sum(n * n) - sum(n) * sum(n) / 20) / 19, 6) AS variance FROM p GROUP BY cls"""


@query(_null("0"), "nodes")
def permuted_concordance(nodes: DataFrame) -> DataFrame:
    """Mean and variance over 20 shuffles of the sibling pairs of one type; the mean is near that of the closed form."""
    return concordance_null(nodes, None)


@query(_null("node % 2"), "nodes")
def stratified_concordance(nodes: DataFrame) -> DataFrame:
    """The same with labels shuffled within each of two strata."""
    return concordance_null(nodes, "side")


#: Sibling leaves of the tree of five children: two strata, ages of their parents, edits in which they differ and that they share.
VIEWS["typed_tips"] = "SELECT b.node, b.parent, CASE WHEN b.parent % 3 = 0 THEN 'B1' ELSE 'B2' END AS stratum, concat('ct', CAST((b.node * 7 + CAST(floor(b.node / 5.0) AS BIGINT)) % 5 AS STRING)) AS cls FROM {bushy} b WHERE b.node NOT IN (SELECT parent FROM {bushy} WHERE parent IS NOT NULL)"
VIEWS["sibling_tips"] = "SELECT a.node AS a, b.node AS b, 11.5E0 + a.parent % 5 * 0.5E0 AS age, (a.node * 3 + b.node) % 5 - 1 AS disc, (a.node + b.node) % 7 AS shared FROM {typed_tips} a, {typed_tips} b WHERE a.parent = b.parent AND a.node < b.node"
POST, AGES, DISCS = ["ct0", "ct3"], [0.0, 12.0, 12.5, 13.0], [2, 1, 0]
_GRIDDED = """di AS (SELECT a, b, age, disc, shared FROM {sibling_tips} WHERE disc >= 0 UNION ALL SELECT b, a, age, disc, shared FROM {sibling_tips} WHERE disc >= 0), th AS (SELECT unnest([0.0E0, 12.0, 12.5, 13.0]) AS t),
  se AS (SELECT t, x.stratum, x.cls AS kind, y.cls AS progenitor, di.disc AS d FROM di JOIN {typed_tips} x ON x.node = di.a JOIN {typed_tips} y ON y.node = di.b JOIN th ON age >= t WHERE x.cls IN ('ct0', 'ct3') AND y.cls NOT IN ('ct0', 'ct3') QUALIFY row_number() OVER (PARTITION BY t, di.a ORDER BY di.disc, shared DESC, di.b) = 1)"""


@query(f"WITH {_GRIDDED} SELECT stratum, t AS age, g.disc, progenitor, kind, count(*) AS n FROM se, (SELECT unnest([0, 1, 2]) AS disc) g WHERE d <= g.disc GROUP BY ALL", "sibling_tips", "typed_tips")
def pairing_grid(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Captured divisions by progenitor and kind, for all twelve thresholds."""
    return P.observed(pairs, labels, POST, AGES, DISCS).withColumn("disc", F.col("disc").cast("int"))


@query(None, "sibling_tips", "typed_tips")
def pairing_test(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same against 50 permutations of the labels within strata."""
    moments = P.null_moments(pairs, labels, POST, AGES, DISCS, 50)
    out = P.captured(P.observed(pairs, labels, POST, AGES, DISCS), moments, fold=1.1)
    return out.select("stratum", "age", "disc", "progenitor", "kind", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "fold", "p", "q")], "captured")

