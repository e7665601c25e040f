"""Queries on trees in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import VIEWS, query
from cladewright.operators import dating
from cladewright.operators import imputation as I
from cladewright.operators import timed as M
from cladewright.operators import trees as T
from cladewright.operators.scale import cut

from .trees import _DESC, _SIZE, ranked

EDGES = [0.0, 1.0, 2.5, 4.0, 6.0, 9.0, 20.0]
_BIN = "CASE " + " ".join(f"WHEN {{0}} {'>=' if k == 0 else '>'} {a} AND {{0}} <= {b} THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " END"
_GRID = "gr AS (SELECT side, bin, (lo + hi) / 2 AS bin_mid FROM (SELECT unnest(['A', 'B']) AS side), (SELECT unnest([{0}]) AS bin, unnest([{1}]) AS lo, unnest([{2}]) AS hi))".format(
    ", ".join(map(str, range(len(EDGES) - 1))), ", ".join(f"{x}e0" for x in EDGES[:-1]), ", ".join(f"{x}e0" for x in EDGES[1:]))
_SIDES = f"""{_SIZE}, rc AS (SELECT n.node, row_number() OVER (ORDER BY z.tips DESC, n.node) AS r FROM {{nodes}} n JOIN z USING (node) WHERE n.parent IN (SELECT node FROM {{nodes}} WHERE parent IS NULL)),
  sd AS (SELECT n.node, max(CASE rc.r WHEN 1 THEN 'A' WHEN 2 THEN 'B' END) AS side FROM {{nodes}} n LEFT JOIN d ON d.node = n.node LEFT JOIN rc ON rc.node = d.anc GROUP BY n.node)"""
_BRANCH = f"""{_SIDES}, br AS (SELECT n.node, n.time, n.is_leaf, side, n.time - p.time AS days, (n.time + p.time) / 2 AS mid, n.node * 5 % 4 AS edits FROM {{nodes}} n JOIN {{nodes}} p ON p.node = n.parent JOIN sd ON sd.node = n.node WHERE n.time - p.time > 1e-9)"""


def sided(nodes: DataFrame) -> DataFrame:
    return cut(M.sides(T.tips_below(cut(ranked(nodes)))))


def branches(nodes: DataFrame) -> DataFrame:
    return M.with_branch(sided(nodes)).withColumn("edits", F.col("node") * 5 % 4)


@query(f"WITH RECURSIVE {_SIDES} SELECT * FROM sd", "nodes")
def tree_sides(nodes: DataFrame) -> DataFrame:
    return sided(nodes).select("node", "side")


@query(f"""WITH RECURSIVE {_BRANCH}, {_GRID}, s AS (SELECT side, {_BIN.format('mid')} AS bin, sum(edits) AS edits, sum(days) AS days FROM br GROUP BY 1, 2)
  SELECT side, bin, bin_mid, CAST(coalesce(edits, 0) AS BIGINT) AS edits, round(coalesce(days, 0), 6) AS days, round(CASE WHEN days > 0 THEN edits / days END, 6) AS rate FROM gr LEFT JOIN s USING (side, bin)""", "nodes")
def editing_rate(nodes: DataFrame) -> DataFrame:
    return M.editing_rate(branches(nodes), EDGES).withColumn("days", F.round("days", 6)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH RECURSIVE {_BRANCH}, {_GRID}, s AS (SELECT side, {_BIN.format('time')} AS bin, count(*) AS nodes, count(*) FILTER (edits >= 1) AS n_ge1, count(*) FILTER (edits >= 2) AS n_ge2 FROM br WHERE NOT is_leaf GROUP BY 1, 2)
  SELECT side, bin, bin_mid, coalesce(nodes, 0) AS nodes, coalesce(n_ge1, 0) AS n_ge1, round(100 * n_ge1 / nodes, 6) AS pct_ge1, coalesce(n_ge2, 0) AS n_ge2, round(100 * n_ge2 / nodes, 6) AS pct_ge2 FROM gr LEFT JOIN s USING (side, bin)""", "nodes")
def support_over_time(nodes: DataFrame) -> DataFrame:
    return M.support_over_time(branches(nodes), EDGES, [1, 2]).withColumn("pct_ge1", F.round("pct_ge1", 6)).withColumn("pct_ge2", F.round("pct_ge2", 6))


_CUTS = (2.25, 3.0, 4.05, 5.05)
_T = f"t AS (SELECT unnest([{', '.join(f'{x}e0' for x in _CUTS)}]) AS t)"
_COUPLED = f"""{_SIDES}, {_T}, mem AS (SELECT t.t, side, n.node AS clade, l.celltype AS cls FROM {{nodes}} n JOIN {{nodes}} p ON p.node = n.parent JOIN t ON p.time < t.t AND t.t <= n.time JOIN d ON d.anc = n.node JOIN {{nodes}} l ON l.node = d.node AND l.is_leaf JOIN sd ON sd.node = n.node
    QUALIFY count(*) OVER (PARTITION BY t.t, n.node) >= 3),
  n AS (SELECT t, side, cls, count(*) AS n FROM mem GROUP BY ALL), c AS (SELECT t, side, clade, count(*) AS s FROM mem GROUP BY ALL), tot AS (SELECT t, side, count(*) AS total, count(DISTINCT clade) AS k FROM mem GROUP BY ALL),
  p AS (SELECT a.t, a.side, a.cls AS a, b.cls AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.t = b.t AND a.side = b.side AND a.cls < b.cls), m AS (SELECT DISTINCT t, side, unnest([na, nb, na + nb]) AS m FROM p),
  f AS (SELECT m.t, m.side, m, sum(CASE WHEN total - m >= s THEN exp(lgamma(total - m + 1) - lgamma(total - m - s + 1) - lgamma(total + 1) + lgamma(total - s + 1)) ELSE 0 END) AS f FROM m JOIN c ON c.t = m.t AND c.side = m.side JOIN tot ON tot.t = m.t AND tot.side = m.side GROUP BY ALL),
  o AS (SELECT t, side, a, b, count(*) AS observed FROM (SELECT DISTINCT x.t, x.side, x.clade, x.cls AS a, y.cls AS b FROM mem x JOIN mem y ON x.t = y.t AND x.clade = y.clade AND x.cls < y.cls) GROUP BY ALL),
  e AS (SELECT p.t, p.side, p.a, p.b, coalesce(observed, 0) AS observed, greatest(k - x.f - y.f + z.f, 0) AS expected FROM p JOIN f x ON x.t = p.t AND x.side = p.side AND x.m = na JOIN f y ON y.t = p.t AND y.side = p.side AND y.m = nb JOIN f z ON z.t = p.t AND z.side = p.side AND z.m = na + nb
    JOIN tot ON tot.t = p.t AND tot.side = p.side LEFT JOIN o ON o.t = p.t AND o.side = p.side AND o.a = p.a AND o.b = p.b),
  h AS (SELECT *, (observed - expected) / sqrt(greatest(expected, 1e-9)) >= -0.1 AND observed >= 2 AS hit FROM e)"""


def slices(nodes: DataFrame) -> DataFrame:
    tree = sided(nodes)
    times = nodes.sparkSession.createDataFrame([(x,) for x in _CUTS], "t double")
    leaves = tree.filter("is_leaf").select("node", "pre", "side", F.col("celltype").alias("cls"))
    members = cut(M.clades_at(tree, leaves, times).select("t", "side", "clade", "cls"))
    large = members.groupBy("t", "clade").agg(F.count("*").alias("n")).filter("n >= 3")
    return M.couplings(members.join(large, ["t", "clade"], "left_semi"), ["t", "side"], -0.1, 2)


@query(f"WITH RECURSIVE {_COUPLED} SELECT t, side, a, b, observed, round(expected, 6) AS expected, hit FROM h", "nodes")
def time_slice_couplings(nodes: DataFrame) -> DataFrame:
    return slices(nodes).withColumn("expected", F.round("expected", 6))


@query(f"""WITH RECURSIVE {_COUPLED}, g AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM h)), b AS (SELECT h.t, a, b, k FROM h JOIN g ON g.t = h.t WHERE hit GROUP BY ALL HAVING count(*) >= 2)
  SELECT a, b, min(t) AS depth, count(*) AS slices, max(k) - min(k) + 1 = count(*) AS contiguous FROM b GROUP BY a, b""", "nodes")
def coupling_depth(nodes: DataFrame) -> DataFrame:
    return M.coupling_depth(slices(nodes))


@query(f"""WITH RECURSIVE {_DESC}, {_T}, fo AS (SELECT n.node FROM {{nodes}} n JOIN {{nodes}} p ON p.node = n.parent WHERE p.time < 2.1 AND n.time >= 2.1), s AS (SELECT t.t, fo.node AS founder, count(*) AS n FROM {{nodes}} n JOIN {{nodes}} p ON p.node = n.parent JOIN t ON p.time < t.t AND t.t <= n.time JOIN d ON d.node = n.node JOIN fo ON fo.node = d.anc GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n) AS r, sum(n) OVER (PARTITION BY t ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY t) AS total FROM s)
  SELECT t, count(*) AS groups, round(2 * sum(r * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini, count(*) FILTER (2 * (cum - n) < total) AS k_half FROM r GROUP BY t""", "nodes")
def gini_over_time(nodes: DataFrame) -> DataFrame:
    times = nodes.sparkSession.createDataFrame([(x,) for x in _CUTS], "t double")
    return M.gini_over_time(cut(ranked(nodes)), 2.1, times).withColumn("gini", F.round("gini", 6))


VIEWS["labelled"] = "SELECT node, parent, is_leaf, CASE WHEN node % 5 <> 0 THEN concat('k', CAST(node * 37 % 101 % 6 AS STRING)) END AS label FROM {nodes}"
_STEPS = """c AS (SELECT n.node, n.label AS dst, p.node AS at, p.label AS src, p.parent AS up FROM {labelled} n JOIN {labelled} p ON p.node = n.parent WHERE n.label IS NOT NULL
    UNION ALL SELECT c.node, c.dst, p.node, p.label, p.parent FROM c JOIN {labelled} p ON p.node = c.up WHERE c.src IS NULL),
  n AS (SELECT src, dst, count(*) AS n FROM c WHERE src <> dst GROUP BY 1, 2), tr AS (SELECT n.src, n.dst, n.n, coalesce(r.n, 0) AS back, CASE WHEN n.n + coalesce(r.n, 0) >= 4 THEN (n.n - coalesce(r.n, 0)) / (n.n + coalesce(r.n, 0)) END AS asymmetry FROM n LEFT JOIN n r ON r.src = n.dst AND r.dst = n.src)"""
_PATHS = """up AS (SELECT node AS tip, parent, [label] AS path FROM {labelled} WHERE is_leaf AND label IS NOT NULL
    UNION ALL SELECT up.tip, p.parent, CASE WHEN p.label IS NULL OR p.label = up.path[1] THEN up.path ELSE list_prepend(p.label, up.path) END FROM up JOIN {labelled} p ON p.node = up.parent),
  sp AS (SELECT tip AS node, path FROM up WHERE parent IS NULL)"""


@query(f"WITH RECURSIVE {_STEPS} SELECT src, dst, n, back, round(asymmetry, 6) AS asymmetry FROM tr", "labelled")
def labelled_transitions(labelled: DataFrame) -> DataFrame:
    return I.transitions(M.labelled_steps(labelled), 4).withColumn("asymmetry", F.round("asymmetry", 6))


@query(f"WITH RECURSIVE {_PATHS} SELECT node, array_to_string(path, '>') AS path FROM sp", "labelled")
def state_paths(labelled: DataFrame) -> DataFrame:
    return M.state_paths(labelled, labelled.filter("is_leaf")).select("node", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {_PATHS}, {_STEPS}, k AS (SELECT path, count(*) AS n FROM sp WHERE len(path) > 1 AND len(list_distinct(path)) = len(path) GROUP BY path), s AS (SELECT *, n / sum(n) OVER (PARTITION BY path[-1]) AS share FROM k),
  q AS (SELECT path, n, share FROM s WHERE n >= 2 AND share >= 0.01), st AS (SELECT path, unnest(path[1:-2]) AS src, unnest(path[2:]) AS dst FROM q)
  SELECT array_to_string(path, '>') AS path, n, round(share, 6) AS share FROM q WHERE NOT EXISTS (SELECT 1 FROM st LEFT JOIN tr ON tr.src = st.src AND tr.dst = st.dst WHERE st.path = q.path AND coalesce(tr.asymmetry < -0.9, true))""", "labelled")
def qualifying_paths(labelled: DataFrame) -> DataFrame:
    paths = M.state_paths(labelled, labelled.filter("is_leaf"))
    out = M.qualifying_paths(paths, I.transitions(M.labelled_steps(labelled), 4), 2, 0.01, -0.9)
    return out.select(F.array_join("path", ">").alias("path"), "n", F.round("share", 6).alias("share"))


VIEWS["ceiling"] = "SELECT r_regionkey * 2.0E0 AS day, CASE r_regionkey WHEN 0 THEN 1.0E0 WHEN 1 THEN 8.0E0 WHEN 2 THEN 5.0E0 WHEN 3 THEN 60.0E0 ELSE 200.0E0 END AS cells FROM {region}"
_LADDER = """k AS (SELECT parent AS node, count(*) AS children FROM {nodes} WHERE parent IS NOT NULL GROUP BY 1), la AS (SELECT node, time, children, CAST(1 + sum(children - 1) OVER (ORDER BY time, node ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lineages FROM k JOIN {nodes} USING (node)),
  ce AS (SELECT day AS d1, max(cells) OVER (ORDER BY day) AS c1 FROM {ceiling}), co AS (SELECT *, lag(d1) OVER (ORDER BY d1) AS d0, lag(c1) OVER (ORDER BY d1) AS c0 FROM ce),
  mi AS (SELECT la.*, CASE WHEN c0 IS NULL THEN d1 ELSE d0 + (ln(lineages) - ln(c0)) / (ln(c1) - ln(c0)) * (d1 - d0) END AS min_day FROM la LEFT JOIN co ON lineages <= c1 AND (c0 IS NULL OR lineages > c0))"""


@query(f"WITH {_LADDER} SELECT node, time, children, lineages, round(min_day, 6) AS min_day FROM mi", "nodes", "ceiling")
def min_age_ladder(nodes: DataFrame, ceiling: DataFrame) -> DataFrame:
    return M.earliest(M.lineage_ladder(nodes), ceiling).withColumn("min_day", F.round("min_day", 6))


@query(f"WITH {_LADDER} SELECT node, children, lineages, round(min_day, 6) AS min_day, round(time + 1.5, 6) AS day, min_day > time + 1.5 + 1e-9 AS binding FROM mi WHERE min_day > 1.5 + 1e-9 AND node NOT IN (SELECT node FROM {{nodes}} WHERE parent IS NULL)", "nodes", "ceiling")
def age_constraints(nodes: DataFrame, ceiling: DataFrame) -> DataFrame:
    return M.age_constraints(nodes, ceiling, 1.5).withColumn("min_day", F.round("min_day", 6)).withColumn("day", F.round("day", 6))


@query(None, "lengths", "ceiling")
def dated_nodes(lengths: DataFrame, ceiling: DataFrame) -> DataFrame:
    """Root at day 1.5, leaves at 13.5, branches of two hours at least, no more lineages than the ceiling allows, from one ranking."""
    found = dating.dated_under(lengths, ceiling, 1.5, 13.5, 2 / 24, 1)
    return found.select("node", F.round("day", 5).alias("day"), F.round("rate", 6).alias("rate"))


@query(f"WITH RECURSIVE {_DESC} SELECT anc AS node, CAST(max(n.depth) - min(n.depth) AS BIGINT) AS below FROM d JOIN {{nodes}} n ON n.node = d.node GROUP BY anc", "nodes")
def levels_below(nodes: DataFrame) -> DataFrame:
    return dating.levels_below(nodes).withColumn("below", F.col("below").cast("long"))


@query(f"""WITH RECURSIVE {_DESC}, p AS (SELECT node AS a, node + 3 AS b FROM {{nodes}} WHERE is_leaf AND node + 3 <= (SELECT max(node) FROM {{nodes}})), m AS (SELECT a, b, max(x.anc) AS mrca FROM p JOIN d x ON x.node = a JOIN d y ON y.node = b AND y.anc = x.anc GROUP BY a, b)
  SELECT a, b, mrca, n.time AS mrca_time, round(x.time + y.time - 2 * n.time, 6) AS distance FROM m JOIN {{nodes}} n ON n.node = mrca JOIN {{nodes}} x ON x.node = a JOIN {{nodes}} y ON y.node = b""", "nodes")
def patristic_distances(nodes: DataFrame) -> DataFrame:
    leaf = nodes.filter("is_leaf").select(F.col("node").alias("a"))
    pairs = leaf.join(nodes.select((F.col("node") - 3).alias("a"), F.col("node").alias("b")), "a")
    return T.patristic(cut(ranked(nodes)), pairs).withColumn("distance", F.round("distance", 6))
