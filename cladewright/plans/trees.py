"""Queries on trees. The tree of the driver's tables is binary: node i has parent i div 2, for the keys of customer; times grow from parent to child."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import VIEWS, query
from cladewright.functions import udfs as U
from cladewright.operators import grafting as G
from cladewright.operators import lineages as L
from cladewright.operators import state_graphs as SG
from cladewright.operators import trees as T
from cladewright.operators.scale import cut

VIEWS["nodes"] = """SELECT i AS node, CASE WHEN i > 1 THEN CAST(floor(i / 2.0) AS BIGINT) END AS parent, (length(bin(i)) - 1) + (i % 7) / 10.0 + 0.0E0 AS time, 2 * i > m AS is_leaf, length(bin(i)) - 1 AS depth,
  concat('ct', CAST((i * 7) % 5 AS STRING)) AS celltype FROM (SELECT c_custkey AS i, (SELECT count(*) FROM {customer}) AS m FROM {customer} WHERE c_custkey > 0) q"""
_DESC = "d AS (SELECT node AS anc, node FROM {nodes} UNION ALL SELECT d.anc, n.node FROM d JOIN {nodes} n ON n.parent = d.node)"
_SIZE = f"{_DESC}, z AS (SELECT anc AS node, count(*) FILTER (n.is_leaf) AS tips FROM d JOIN {{nodes}} n ON n.node = d.node GROUP BY anc)"
VIEWS["tips"] = """SELECT n.node, concat('T', CAST(k AS STRING)) AS tape, substr(w, 1, 3) AS s1, CASE WHEN dd >= 2 THEN substr(w, 4, 3) ELSE 'U' END AS s2, CASE WHEN dd >= 3 THEN substr(w, 7, 3) ELSE 'U' END AS s3
  FROM (SELECT node, k, (node + k) % 3 + 1 AS dd, translate(md5(CAST(floor(node / 32.0) * 10 + k AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS w FROM (SELECT node, 1 AS k FROM {nodes} WHERE is_leaf UNION ALL SELECT node, 2 AS k FROM {nodes} WHERE is_leaf AND node % 4 <> 0) a) n"""
VIEWS["tips"] = VIEWS["tips"].replace("CAST(floor(node / 32.0) * 10 + k AS STRING)", "CAST(CAST(floor(node / 32.0) AS BIGINT) * 10 + k AS STRING)")


def ranked(nodes: DataFrame) -> DataFrame:
    return T.nested_set(nodes.drop("depth"))


@query(f"WITH RECURSIVE {_SIZE} SELECT node, tips FROM z", "nodes")
def subtree_sizes(nodes: DataFrame) -> DataFrame:
    return T.tips_below(ranked(nodes)).select("node", "tips")


@query(f"WITH RECURSIVE {_DESC} SELECT anc AS node, k.celltype AS cls, count(*) FILTER (n.is_leaf AND n.celltype = k.celltype) AS n FROM d JOIN {{nodes}} n ON n.node = d.node, (SELECT DISTINCT celltype FROM {{nodes}} WHERE is_leaf) k GROUP BY 1, 2", "nodes")
def class_counts(nodes: DataFrame) -> DataFrame:
    return T.class_counts(ranked(nodes), nodes.filter("is_leaf").select("node", F.col("celltype").alias("cls")))


_MAX = "m AS (SELECT n.node FROM {nodes} n JOIN z ON z.node = n.node JOIN z p ON p.node = n.parent WHERE z.tips BETWEEN 3 AND 15 AND p.tips > 15)"


@query(f"WITH RECURSIVE {_SIZE}, {_MAX} SELECT m.node, z.tips FROM m JOIN z USING (node)", "nodes")
def maximal_clades(nodes: DataFrame) -> DataFrame:
    return T.maximal_clades(T.tips_below(ranked(nodes)), 3, 15).select("node", "tips")


@query(f"WITH RECURSIVE {_SIZE}, {_MAX} SELECT n.node, max(m.node) AS clade FROM {{nodes}} n LEFT JOIN d ON d.node = n.node LEFT JOIN m ON m.node = d.anc WHERE n.is_leaf GROUP BY n.node", "nodes")
def tip_clades(nodes: DataFrame) -> DataFrame:
    sized = cut(T.tips_below(ranked(nodes)))
    return T.nearest_chosen(sized.filter("is_leaf"), T.maximal_clades(sized, 3, 15)).select("node", "clade")


_TIMES = "t AS (SELECT unnest([1.5, 2.25, 3.0, 4.05, 5.5, 7.0]) + 0.0E0 AS t)"


def times(nodes: DataFrame) -> DataFrame:
    return nodes.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in (1.5, 2.25, 3.0, 4.05, 5.5, 7.0)])).alias("t"))


@query(f"WITH {_TIMES} SELECT t, n.node FROM {{nodes}} n JOIN {{nodes}} p ON p.node = n.parent JOIN t ON p.time < t AND t <= n.time", "nodes")
def time_cut_clades(nodes: DataFrame) -> DataFrame:
    return T.time_cut(nodes, times(nodes)).select("t", "node")


@query(f"WITH {_TIMES} SELECT t, count(p.node) AS lineages FROM t LEFT JOIN ({{nodes}}) n ON n.time >= t LEFT JOIN {{nodes}} p ON p.node = n.parent AND p.time < t GROUP BY t".replace("({nodes})", "{nodes}"), "nodes")
def ltt_curve(nodes: DataFrame) -> DataFrame:
    return T.lineages_through_time(nodes, times(nodes))


@query("SELECT parent, a.node AS a, b.node AS b FROM {nodes} a JOIN {nodes} b USING (parent) WHERE a.node < b.node AND a.is_leaf AND b.is_leaf", "nodes")
def sibling_pairs(nodes: DataFrame) -> DataFrame:
    return T.sibling_pairs(nodes.filter("is_leaf"))


@query("SELECT parent, count(*) AS k, CASE count(*) WHEN 1 THEN 'loner' WHEN 2 THEN 'cherry' ELSE 'polytomy' END AS kind FROM {nodes} WHERE is_leaf GROUP BY parent", "nodes")
def sibling_groups(nodes: DataFrame) -> DataFrame:
    return T.sibling_groups(nodes)


_LCP = f"""{_DESC}, b AS (SELECT d.anc AS node, tape, count(DISTINCT s1) AS k1, count(DISTINCT concat(s1, s2)) AS k2, count(DISTINCT concat(s1, s2, s3)) AS k3, min(s1) AS s1, min(s2) AS s2, min(s3) AS s3, count(*) FILTER (s2 = 'U') AS u2, count(*) FILTER (s3 = 'U') AS u3 FROM d JOIN {{tips}} t ON t.node = d.node GROUP BY 1, 2),
  st AS (SELECT node, tape, CASE WHEN k1 > 1 THEN 0 WHEN k2 > 1 OR u2 > 0 THEN 1 WHEN k3 > 1 OR u3 > 0 THEN 2 ELSE 3 END AS n, s1, s2, s3 FROM b)"""


@query(f"WITH RECURSIVE {_LCP} SELECT node, tape, CASE n WHEN 0 THEN '' WHEN 1 THEN s1 WHEN 2 THEN concat(s1, '|', s2) ELSE concat(s1, '|', s2, '|', s3) END AS prefix FROM st", "nodes", "tips")
def ancestral_lcp(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    sites = tips.select("node", "tape", F.array("s1", "s2", "s3").alias("sites"))
    return T.ancestral(ranked(nodes), sites, 3).select("node", "tape", F.array_join("prefix", "|").alias("prefix"))


@query(f"""WITH RECURSIVE {_LCP} SELECT n.node, CAST(coalesce(sum(CASE WHEN n.parent IS NULL THEN st.n ELSE coalesce(st.n - p.n, 0) END), 0) AS BIGINT) AS edits, count(*) FILTER (CASE WHEN n.parent IS NULL THEN st.n ELSE coalesce(st.n - p.n, 0) END > 0) AS tapes
  FROM {{nodes}} n LEFT JOIN st ON st.node = n.node LEFT JOIN st p ON p.node = n.parent AND p.tape = st.tape GROUP BY n.node""", "nodes", "tips")
def branch_support(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    sites = tips.select("node", "tape", F.array("s1", "s2", "s3").alias("sites"))
    return T.branch_support(nodes, T.ancestral(ranked(nodes), sites, 3))


@query(f"""WITH RECURSIVE {_DESC}, p AS (SELECT node AS a, node + 5 AS b FROM {{nodes}} WHERE is_leaf AND node + 5 <= (SELECT max(node) FROM {{nodes}}))
  SELECT a, b, max(x.anc) AS mrca FROM p JOIN d x ON x.node = a JOIN d y ON y.node = b AND y.anc = x.anc GROUP BY a, b""", "nodes")
def mrca_pairs(nodes: DataFrame) -> DataFrame:
    leaf = nodes.filter("is_leaf").select(F.col("node").alias("a"))
    pairs = leaf.join(nodes.select((F.col("node") - 5).alias("a"), F.col("node").alias("b")), "a")
    return T.mrca(ranked(nodes), pairs)


@query(f"""WITH RECURSIVE {_DESC}, k AS (SELECT anc AS node, count(*) FILTER (n.is_leaf AND n.node % 3 = 0) AS kept FROM d JOIN {{nodes}} n ON n.node = d.node GROUP BY anc),
  a AS (SELECT n.node, n.parent, n.time, n.is_leaf AND n.node % 3 = 0 AS tip FROM {{nodes}} n JOIN k USING (node) WHERE kept > 0), f AS (SELECT a.node, a.time FROM a LEFT JOIN a c ON c.parent = a.node GROUP BY a.node, a.time, a.tip HAVING a.tip OR count(c.node) > 1),
  u AS (SELECT f.node, max(g.node) AS parent FROM f LEFT JOIN d ON d.node = f.node AND d.anc <> f.node LEFT JOIN f g ON g.node = d.anc GROUP BY f.node)
  SELECT u.node, u.parent, round(f.time - coalesce(g.time, 0), 6) AS blen FROM u JOIN f ON f.node = u.node LEFT JOIN f g ON g.node = u.parent""", "nodes")
def pruned_tree(nodes: DataFrame) -> DataFrame:
    r = cut(ranked(nodes))
    return T.prune(r, r.filter("is_leaf and node % 3 = 0")).withColumn("blen", F.round("blen", 6))


_UPW = _DESC + ", alive AS (SELECT DISTINCT anc FROM d JOIN {nodes} n ON n.node = d.node WHERE n.is_leaf), k AS (SELECT parent, count(*) AS k FROM {nodes} JOIN alive ON anc = node GROUP BY parent), w AS (SELECT node AS anc, node, 1.0E0 AS w FROM {nodes} UNION ALL SELECT w.anc, n.node, w.w / k.k FROM w JOIN {nodes} n ON n.parent = w.node JOIN k ON k.parent = w.node)"


@query(f"WITH RECURSIVE {_UPW} SELECT anc AS node, round(sum(w * (n.node % 11)), 6) AS v0, round(sum(w * (n.node % 7)), 6) AS v1 FROM w JOIN {{nodes}} n ON n.node = w.node WHERE n.is_leaf GROUP BY anc", "nodes")
def children_mean_vectors(nodes: DataFrame) -> DataFrame:
    leaves = nodes.filter("is_leaf").select("node", F.array((F.col("node") % 11).cast("double"), (F.col("node") % 7).cast("double")).alias("v"))
    return T.children_means(nodes, leaves, 2).select("node", *[F.round(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in range(2)])


@query("SELECT n.node AS tip, n.node + 1000000 AS cell, round(greatest(p.time, 12.0 - (n.node % 9)), 9) AS time, CAST(1 AS BIGINT) AS place FROM {nodes} n JOIN {nodes} p ON p.node = n.parent WHERE n.is_leaf", "nodes")
def grafted_cells(nodes: DataFrame) -> DataFrame:
    dated = nodes.join(nodes.select(F.col("node").alias("parent"), F.col("time").alias("parent_time")), "parent")
    cells = nodes.filter("is_leaf").select(F.col("node").alias("tip"), (F.col("node") + 1000000).alias("cell"), (F.col("node") % 9).alias("days"))
    return T.grafted(dated, cells, 12.0).withColumn("place", F.col("place").cast("long"))


#: Cells on dated leaves and on each other: chains of three, ties, cells without days, an unknown host and a cycle.
VIEWS["attached"] = """SELECT node + 1000000 AS cell, node AS host, (node % 9) / 2.0E0 AS days, node % 2 AS side FROM {nodes} WHERE is_leaf
  UNION ALL SELECT node + 2000000, node + 1000000, (node % 5) * 0.9E0, node % 2 FROM {nodes} WHERE is_leaf AND node % 3 <> 0 UNION ALL SELECT node + 3000000, node + 2000000, (node % 7) * 0.5E0, node % 2 FROM {nodes} WHERE is_leaf AND node % 3 = 1
  UNION ALL SELECT node + 4000000, node, CASE WHEN node % 4 = 0 THEN (node % 9) / 2.0E0 ELSE 0.0E0 END, node % 2 FROM {nodes} WHERE is_leaf AND node % 2 = 0
  UNION ALL SELECT node + 5000000, CASE WHEN node % 16 = 1 THEN -7 ELSE node + 5000000 END, 1.0E0, node % 2 FROM {nodes} WHERE is_leaf AND node % 16 < 2"""
_CAPS = """a AS (SELECT *, days / (1.0 + side) AS d FROM {attached}), ca AS (SELECT a.cell, host, d, least(d, 24.0 - p.time) AS c, d > 24.0 - p.time + 1e-9 AS clamped FROM a JOIN {nodes} n ON n.node = a.host AND n.is_leaf JOIN {nodes} p ON p.node = n.parent
    UNION ALL SELECT a.cell, a.host, a.d, least(a.d, ca.c), a.d > ca.c + 1e-9 FROM ca JOIN a ON a.host = ca.cell), cc AS (SELECT *, round(c, 9) AS cap FROM ca)"""


def attached_days(attached: DataFrame) -> DataFrame:
    rates = attached.sparkSession.createDataFrame([(0, 1.0), (1, 2.0)], "side long, rate double")
    return G.pendant_days(attached.withColumnRenamed("days", "distance"), rates)


@query(f"WITH RECURSIVE {_CAPS} SELECT cell, host, cap, clamped FROM cc", "nodes", "attached")
def capped_pendants(nodes: DataFrame, attached: DataFrame) -> DataFrame:
    up = nodes.select(F.col("node").alias("parent"), (24.0 - F.col("time")).alias("budget"))
    return G.capped(nodes.filter("is_leaf").join(up, "parent"), attached_days(attached)).select("cell", "host", "cap", "clamped")


@query(f"""WITH RECURSIVE {_CAPS}, s AS (SELECT host, cap, (SELECT max(cell) FROM {{attached}}) + row_number() OVER (ORDER BY host, cap DESC) AS split FROM (SELECT DISTINCT host, cap FROM cc) q),
  r AS (SELECT *, lag(split) OVER (PARTITION BY host ORDER BY cap DESC) AS older, lead(split) OVER (PARTITION BY host ORDER BY cap DESC) AS next FROM s), o AS (SELECT cell, split AS sp FROM cc JOIN s USING (host, cap))
  SELECT split AS node, coalesce(older, o.sp, n.parent) AS parent, round(24.0 - cap, 6) AS time, 'split' AS kind FROM r LEFT JOIN o ON o.cell = r.host LEFT JOIN {{nodes}} n ON n.node = r.host
  UNION ALL SELECT o.cell, coalesce(r.split, o.sp), 24.0, 'cell' FROM o LEFT JOIN r ON r.host = o.cell AND r.next IS NULL
  UNION ALL SELECT n.node, coalesce(r.split, n.parent), CASE WHEN is_leaf THEN 24.0 ELSE round(time, 6) END, 'backbone' FROM {{nodes}} n LEFT JOIN r ON r.host = n.node AND r.next IS NULL""", "nodes", "attached")
def grafted_forest(nodes: DataFrame, attached: DataFrame) -> DataFrame:
    return G.forest(nodes, attached_days(attached), 24.0).withColumn("time", F.round("time", 6))


@query("SELECT node AS tree_id, printf('((a%d:1,b:2.50)x:1,(c:1,d:0,e:3e-1):2);', node) AS newick, true AS same FROM {nodes}", "nodes")
def newick_round_trip(nodes: DataFrame) -> DataFrame:
    texts = nodes.select(F.col("node").alias("tree_id"), F.format_string("((a%d:1,b:2.50)x:1,(c:1,d:0,e:3e-1):2);", "node").alias("newick"))
    back = T.write_newick(T.read_newick(texts))
    return texts.join(back.withColumnRenamed("newick", "written"), "tree_id").select("tree_id", F.col("written").alias("newick"), (F.col("newick") == F.col("written")).alias("same"))


@query("""SELECT node AS tree_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pre, unnest([0.0E0, 1.0, 2.0, 3.5, 2.0, 3.0, 2.0, 2.3]) AS time, unnest([7, 3, 2, 3, 7, 5, 6, 7]) AS last, unnest([false, false, true, true, false, true, true, true]) AS is_leaf FROM {nodes}""", "nodes")
def newick_nodes(nodes: DataFrame) -> DataFrame:
    """Ranks, times and leaves of Newick texts."""
    texts = nodes.select(F.col("node").alias("tree_id"), F.format_string("((a%d:1,b:2.50)x:1,(c:1,d:0,e:3e-1):2);", "node").alias("newick"))
    return T.read_newick(texts).select("tree_id", "pre", F.round("time", 6).alias("time"), "last", "is_leaf")


# Node i has parent i div 5, so that inner nodes have five children.
VIEWS["bushy"] = "SELECT i AS node, CASE WHEN i > 0 THEN CAST(floor((i - 1) / 5.0) AS BIGINT) END AS parent, i / 10.0E0 AS time FROM (SELECT c_custkey - 1 AS i FROM {customer} WHERE c_custkey > 0) q"


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY node) AS r, count(*) OVER (PARTITION BY parent) AS k FROM {bushy})
  SELECT node, CASE WHEN parent IS NOT NULL AND k > 2 AND r > 1 THEN -(parent * 1000000 + least(r - 1, k - 2)) ELSE parent END AS parent, time, false AS added FROM x
  UNION ALL SELECT -(x.parent * 1000000 + r), CASE WHEN r = 1 THEN x.parent ELSE -(x.parent * 1000000 + r - 1) END, p.time, true FROM x JOIN {bushy} p ON p.node = x.parent WHERE k > 2 AND r <= k - 2""", "bushy")
def binarised_tree(bushy: DataFrame) -> DataFrame:
    return T.binarised(bushy)


VIEWS["lengths"] = "SELECT node, parent, is_leaf, (node * 7 % 13 - 3) / 8.0E0 AS blen FROM {nodes}"


@query("""WITH RECURSIVE o AS (SELECT max(node) AS o FROM {nodes}), up AS (SELECT node, parent, blen FROM {lengths}, o WHERE node = o UNION ALL SELECT l.node, l.parent, l.blen FROM up JOIN {lengths} l ON l.node = up.parent)
  SELECT node, parent, blen FROM {lengths} WHERE node NOT IN (SELECT node FROM up) UNION ALL SELECT parent, node, blen FROM up, o WHERE parent IS NOT NULL AND node <> o UNION ALL SELECT parent, NULL, 0.0 FROM up, o WHERE node = o""", "lengths")
def rerooted_tree(lengths: DataFrame) -> DataFrame:
    return T.rerooted(lengths, lengths.agg(F.max("node")).first()[0])


@query("""WITH RECURSIVE t AS (SELECT node, parent, 0.0E0 AS owed, CAST(NULL AS DOUBLE) AS blen FROM {lengths} WHERE parent IS NULL
  UNION ALL SELECT l.node, l.parent, CASE WHEN l.blen + t.owed < 0 THEN l.blen + t.owed ELSE 0 END, greatest(l.blen + t.owed, 0) FROM t JOIN {lengths} l ON l.parent = t.node) SELECT node, parent, round(blen, 6) AS blen FROM t""", "lengths")
def nonnegative_lengths(lengths: DataFrame) -> DataFrame:
    return T.nonnegative(lengths).withColumn("blen", F.round("blen", 6))


@query("SELECT CAST(0 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 0.0E0 AS time UNION ALL SELECT node, coalesce(parent, 0), time + 1.5 FROM {nodes} UNION ALL SELECT node + 1000000, coalesce(parent + 1000000, 0), time + 1.5 FROM {nodes} WHERE node < 64", "nodes")
def merged_sides(nodes: DataFrame) -> DataFrame:
    other = nodes.filter("node < 64").select((F.col("node") + 1000000).alias("node"), (F.col("parent") + 1000000).alias("parent"), "time")
    return T.merged([nodes, other], 0, 1.5)


# Matches run up the tree, but for each node that 16 divides, which closes a cycle over its four ancestors.
VIEWS["matches"] = "SELECT node, CASE WHEN node % 16 = 0 AND node >= 16 THEN node ELSE parent END AS match, node * 37 % 101 + 0.0E0 AS score FROM (SELECT node, CASE WHEN parent IS NULL THEN (SELECT max(node) FROM {nodes} WHERE node < 16) ELSE parent END AS parent FROM {nodes}) q"


@query("""WITH RECURSIVE c AS (SELECT node AS start, match AS hop, 1 AS k FROM {matches} UNION ALL SELECT c.start, m.match, c.k + 1 FROM c JOIN {matches} m ON m.node = c.hop WHERE c.hop <> c.start AND c.k < 40),
  cy AS (SELECT DISTINCT start FROM c WHERE hop = start), me AS (SELECT c.start, min(least(c.start, c.hop)) AS low FROM c JOIN cy USING (start) GROUP BY c.start),
  h AS (SELECT me.start AS node FROM me JOIN {matches} m ON m.node = me.start QUALIFY row_number() OVER (PARTITION BY low ORDER BY score DESC, me.start) = 1)
  SELECT m.node, CASE WHEN h.node IS NULL THEN m.match END AS parent, h.node IS NOT NULL AS held FROM {matches} m LEFT JOIN h ON h.node = m.node""", "matches")
def broken_cycles(matches: DataFrame) -> DataFrame:
    return T.break_cycles(matches)


_REL = f"{_DESC}, m AS (SELECT x.node AS a, y.node AS b, max(x.anc) AS mrca FROM d x JOIN d y ON y.anc = x.anc JOIN {{nodes}} p ON p.node = x.node JOIN {{nodes}} q ON q.node = y.node AND q.depth = p.depth WHERE x.node % 50 = 0 AND x.node <> y.node GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_REL}, c AS (SELECT a, b, round(p.time + q.time - 2 * z.time, 6) AS distance FROM m JOIN {{nodes}} p ON p.node = a JOIN {{nodes}} q ON q.node = b JOIN {{nodes}} z ON z.node = mrca WHERE mrca <> a AND mrca <> b)
  SELECT a, b, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM c QUALIFY rank <= 10""", "nodes")
def nearest_cousins(nodes: DataFrame) -> DataFrame:
    tree = cut(T.nested_set(nodes.drop("depth"))).withColumn("day", F.col("depth"))
    out = T.cousins(tree, nodes.filter("node % 50 = 0").select("node"), 10, digits=6)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH RECURSIVE {_DESC}, lo AS (SELECT node FROM {{nodes}} WHERE is_leaf AND node % 4 <> 1), su AS (SELECT node FROM {{nodes}} WHERE is_leaf AND node % 4 = 1 AND node % 3 = 0),
  k AS (SELECT d.anc, count(*) AS n FROM d JOIN su ON su.node = d.node GROUP BY 1), u AS (SELECT lo.node, max(d.anc) AS up FROM lo JOIN d ON d.node = lo.node AND d.anc <> lo.node JOIN k ON k.anc = d.anc GROUP BY 1),
  key AS (SELECT su.node, d.anc, su.node << (20 - CAST(length(bin(su.node)) AS INT)) AS place FROM su JOIN d ON d.node = su.node) SELECT u.node, arg_min(key.node, place) AS anchor FROM u JOIN key ON key.anc = u.up GROUP BY u.node""", "nodes")
def true_anchors(nodes: DataFrame) -> DataFrame:
    leaf = nodes.filter("is_leaf")
    return T.anchors(cut(ranked(nodes)), leaf.filter("node % 4 = 1 and node % 3 = 0"), leaf.filter("node % 4 <> 1"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT concat('s', CAST(n_nationkey AS VARCHAR)) AS src, concat('s', CAST(x AS VARCHAR)) AS dst FROM (SELECT n_nationkey, unnest([n_nationkey * 2 % 25, (n_nationkey + 7) % 25]) AS x FROM {nation} WHERE n_nationkey % 6 <> 5)),
  b AS (SELECT 's1' AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM b JOIN e ON e.src = b.node WHERE depth < 30) SELECT node, CAST(min(depth) AS INT) AS depth FROM b GROUP BY node""", "nation")
def state_graph_depths(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    edges = nation.filter("n_nationkey % 6 <> 5").select(k.alias("k"), F.explode(F.array(k * 2 % 25, (k + 7) % 25)).alias("x"))
    return T.distances_from(edges.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("x").cast("string")).alias("dst")), "s1")


@query("""WITH x AS (SELECT node, celltype, parent, md5('1:' || CAST(node AS VARCHAR)) AS k FROM {nodes} WHERE is_leaf), y AS (SELECT node, lead(node) OVER (PARTITION BY celltype, substr(k, 1, 1) ORDER BY k, node) AS b FROM x), p AS (SELECT least(node, b) AS a, greatest(node, b) AS b FROM y WHERE b IS NOT NULL)
  SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM {nodes} m JOIN {nodes} n ON n.parent = m.parent WHERE m.node = p.a AND n.node = p.b)""", "nodes")
def control_pairs(nodes: DataFrame) -> DataFrame:
    leaves = nodes.filter("is_leaf")
    return T.unrelated_pairs(leaves.select("node", F.col("celltype").alias("cls")), T.sibling_pairs(leaves), digits=1)


@query("SELECT node AS tree_id, unnest(['a', 'b', 'c', 'd', 'e']) AS name, unnest([2.0E0, 3.5, 3.0, 2.0, 2.3]) AS time FROM {nodes}", "nodes")
def newick_leaves(nodes: DataFrame) -> DataFrame:
    """The leaves of Newick texts, by the table function for SQL."""
    U.register(nodes.sparkSession)
    texts = nodes.select(F.col("node").alias("tree_id"), F.lit("((a:1,b:2.50)x:1,(c:1,d:0,e:3e-1):2);").alias("newick"))
    return nodes.sparkSession.sql("SELECT t.tree_id, n.name, round(n.time, 6) AS time FROM {texts} t, LATERAL newick_nodes(t.newick) n WHERE n.is_leaf", texts=texts)


VIEWS["additive"] = "SELECT a.r_regionkey AS grp, x.n_nationkey AS i, y.n_nationkey AS j, (x.n_nationkey + 1.0E0) + (y.n_nationkey + 1) + abs(x.n_nationkey - y.n_nationkey) * (a.r_regionkey + 1) AS d FROM {region} a, {nation} x, {nation} y WHERE x.n_nationkey < y.n_nationkey AND y.n_nationkey < 9"


@query("SELECT grp, i AS a, j AS b, round(d, 6) AS distance FROM {additive}", "additive")
def joined_trees(additive: DataFrame) -> DataFrame:
    """Distances along trees that neighbour joining built give back the additive distances they were built from."""
    edges = cut(T.small_tree(additive, "grp"))
    key = lambda c: F.col("grp") * 1000 + F.col(c) + 100
    nodes = edges.select(key("child").alias("node"), key("parent").alias("parent"), "length")
    top = edges.select(key("parent").alias("node")).join(nodes.select("node"), "node", "left_anti").distinct()
    all_ = cut(T.nested_set(nodes.unionByName(top.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("length")))))
    times = T.with_depths(all_, "length")
    pairs = additive.select(key("i").alias("a"), key("j").alias("b"))
    out = T.patristic(times, pairs)
    grp = F.expr("a div 1000")
    return out.select(grp.alias("grp"), (F.col("a") - 100 - 1000 * grp).alias("a"), (F.col("b") - 100 - 1000 * grp).alias("b"), F.round("distance", 6).alias("distance"))


_BUSHY_TIPS = "bt AS (SELECT node AS a, node - 1 AS b FROM {nodes} WHERE is_leaf)"


@query(f"""WITH RECURSIVE {_DESC}, e AS (SELECT node AS anc, node FROM {{bushy}} UNION ALL SELECT e.anc, b.node FROM e JOIN {{bushy}} b ON b.parent = e.node), {_BUSHY_TIPS},
  x AS (SELECT anc, count(*) AS n FROM d JOIN bt ON bt.a = d.node GROUP BY anc), y AS (SELECT anc, count(*) AS n FROM e JOIN bt ON bt.b = e.node GROUP BY anc),
  -- the preorder of both trees, children by id, as paths of zero-padded ids
  p1 AS (SELECT node, printf('%09d', node) AS path FROM {{nodes}} WHERE parent IS NULL UNION ALL SELECT n.node, p1.path || printf('%09d', n.node) FROM p1 JOIN {{nodes}} n ON n.parent = p1.node),
  p2 AS (SELECT node, printf('%09d', node) AS path FROM {{bushy}} WHERE parent IS NULL UNION ALL SELECT n.node, p2.path || printf('%09d', n.node) FROM p2 JOIN {{bushy}} n ON n.parent = p2.node),
  w1 AS (SELECT anc, arg_min(bt.b, path) AS f, arg_max(bt.b, path) AS l FROM d JOIN bt ON bt.a = d.node JOIN p1 ON p1.node = bt.a GROUP BY anc),
  w2 AS (SELECT anc, arg_min(bt.a, path) AS f, arg_max(bt.a, path) AS l FROM e JOIN bt ON bt.b = e.node JOIN p2 ON p2.node = bt.b GROUP BY anc),
  m1 AS (SELECT w1.anc AS node, arg_max(u.anc, length(p2.path)) AS mapped FROM w1 JOIN e u ON u.node = f JOIN e v ON v.node = l AND v.anc = u.anc JOIN p2 ON p2.node = u.anc GROUP BY 1),
  m2 AS (SELECT w2.anc AS node, arg_max(u.anc, length(p1.path)) AS back FROM w2 JOIN d u ON u.node = f JOIN d v ON v.node = l AND v.anc = u.anc JOIN p1 ON p1.node = u.anc GROUP BY 1)
  SELECT m1.node, x.n AS tips, mapped, y.n AS mapped_tips, back, back = m1.node AND x.n = y.n AS same FROM m1 JOIN x ON x.anc = m1.node JOIN y ON y.anc = mapped JOIN m2 ON m2.node = mapped""", "nodes", "bushy")
def mapped_nodes(nodes: DataFrame, bushy: DataFrame) -> DataFrame:
    """Nodes of the binary tree and their counterparts in the tree of five children on the same customers."""
    return T.node_map(nodes, bushy, nodes.filter("is_leaf").select(F.col("node").alias("a"), (F.col("node") - 1).alias("b")))


@query(None, "lengths")
def midpoint_rooted(lengths: DataFrame) -> DataFrame:
    return T.midpoint_rooted(lengths.withColumn("blen", F.abs("blen")), 0).withColumn("blen", F.round("blen", 6))


VIEWS["state_edges"] = "SELECT DISTINCT concat('s', CAST(n_nationkey AS STRING)) AS src, concat('s', CAST((n_nationkey * 2 + n_regionkey) % 25 AS STRING)) AS dst FROM {nation} WHERE n_nationkey % 6 <> 5"
VIEWS["state_steps"] = "SELECT concat('s', CAST(l_partkey % 25 AS STRING)) AS src, concat('s', CAST(CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey % 27 ELSE (l_partkey % 25 * 2 + 1) % 25 END AS STRING)) AS dst FROM {lineitem}"


@query("""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {state_edges} UNION SELECT dst, src FROM {state_edges}), w AS (SELECT a, a AS b, 0 AS d FROM e UNION SELECT w.a, e.b, w.d + 1 FROM w JOIN e ON e.a = w.b WHERE w.d < 26)
  SELECT a, b, min(d) AS d FROM w GROUP BY a, b""", "state_edges")
def state_distances(edges: DataFrame) -> DataFrame:
    return SG.all_distances(edges)


@query(None, "state_steps", "state_edges")
def adjacency_test(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps between states of line items against the graph of nations, with 499 permutations."""
    states = steps.select(F.explode(F.array("src", "dst")).alias("state")).distinct()
    out = SG.adjacency_test(steps, edges, states, 499)
    return out.select("steps", "median", *[F.round(c, 6).alias(c) for c in ("adjacent", "null_mean", "null_sd", "enrichment", "p")])


@query(f"WITH RECURSIVE {_SIZE} SELECT n.node, z.tips FROM {{nodes}} n JOIN z ON z.node = n.node LEFT JOIN z p ON p.node = n.parent WHERE NOT n.is_leaf AND z.tips BETWEEN 20 AND 40 AND (n.parent IS NULL OR p.tips > 40)", "nodes")
def band_clades(nodes: DataFrame) -> DataFrame:
    return T.band_clades(T.tips_below(ranked(nodes)), 20, 40).select("node", "tips")


@query("SELECT node, celltype AS trajectory FROM {nodes} WHERE is_leaf AND celltype NOT IN ('ct1', 'ct4') QUALIFY row_number() OVER (ORDER BY md5('1:' || CAST(node AS VARCHAR)), node) <= 40", "nodes")
def sampled_tips(nodes: DataFrame) -> DataFrame:
    return L.sampled_tips(nodes.filter("is_leaf").select("node", F.col("celltype").alias("trajectory")), ["ct1", "ct4"], 40)
