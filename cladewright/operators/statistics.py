"""Statistics over trees and groups: co-occurrence and its closed-form null, enrichment, dominance, ranks, multiple testing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladewright.functions import columns as C

from .scale import cut, fresh, running


def cooccurrence(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, a, b (a <= b) and observed: clades that hold both types (a = b: clades that hold it), from clade and cls of each member."""
    by = by or []
    p = members.select(*by, "clade", "cls").distinct()
    return p.select(*by, "clade", F.col("cls").alias("a")).join(p.select(*by, "clade", F.col("cls").alias("b")), [*by, "clade"]).filter("a <= b").groupBy(*by, "a", "b").agg(F.count("*").alias("observed"))


def enrichment(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, a, b, observed, expected and log2 fold of each two types under random labels: clades - F(na) - F(nb) + F(na + nb), where F(m) adds up, over clades, the chance to miss all of m cells.

    Clades enter as a histogram of sizes, so the work is sizes times distinct m, whatever the number of clades. An expectation is never below 0.
    """
    by = by or ["_all"]
    members = cut((members if "_all" not in by else members.withColumn("_all", F.lit(0))).select(*by, "clade", "cls"))
    n_of = members.groupBy(*by, "cls").agg(F.count("*").alias("n"))
    hist = members.groupBy(*by, "clade").agg(F.count("*").alias("s")).groupBy(*by, "s").agg(F.count("*").alias("times"))
    tot = members.groupBy(*by).agg(F.count("*").alias("total"), F.countDistinct("clade").alias("clades"))
    obs = cooccurrence(members, by)
    pairs = n_of.select(*by, F.col("cls").alias("a"), F.col("n").alias("na")).join(n_of.select(*by, F.col("cls").alias("b"), F.col("n").alias("nb")), by).filter("a < b").withColumn("nab", F.col("na") + F.col("nb"))
    m = pairs.select(*by, F.explode(F.array("na", "nb", "nab")).alias("m")).distinct()
    lf, left, size, all_ = C.log_factorial, F.col("total") - F.col("m"), F.col("s"), F.col("total")
    g = m.join(tot, by).join(hist, by).filter("total - m >= s")
    miss = cut(g.groupBy(*by, "m").agg(F.sum(F.col("times") * F.exp(lf(left) - lf(left - size) - lf(all_) + lf(all_ - size))).alias("f")))
    out = pairs
    for c in ("na", "nb", "nab"):
        out = out.join(miss.select(*by, F.col("m").alias(c), F.col("f").alias(f"f_{c}")), [*by, c], "left").na.fill(0.0, [f"f_{c}"])
    out = out.join(tot, by).join(obs, [*by, "a", "b"], "left").na.fill(0, ["observed"])
    e = F.greatest(F.col("clades") - F.col("f_na") - F.col("f_nb") + F.col("f_nab"), F.lit(0.0))
    return out.select(*[c for c in by if c != "_all"], "a", "b", "observed", e.alias("expected"), F.log2((F.col("observed") + 1) / (e + 1)).alias("log2fold"))


def gini(sizes: DataFrame, key: str, value: str = "n") -> DataFrame:
    """key, groups, gini and k_half: the fewest groups that hold half of all. Sizes enter as counts of equal ones, summed by ranges of size."""
    v, t = F.col(value), F.col("_t")
    times = sizes.filter(v.isNotNull()).groupBy(key, value).agg(F.count("*").alias("_t"))
    up = running(times, [value], {"_upto": "_t", "_mass": f"_t * `{value}`"}, [key])
    total = times.groupBy(key).agg(F.sum("_t").alias("groups"), F.sum(t * v).alias("_s"))
    x = up.join(total, key)
    ranks = t * (F.col("_upto") - t) + t * (t + 1) / 2  # of these sizes, from the least
    larger = F.col("_s") - F.col("_mass")
    half = F.when(v > 0, F.least(t, F.greatest(F.lit(0), F.ceil((F.col("_s") / 2 - larger) / v)))).otherwise(0)
    a = x.groupBy(key, "groups", "_s").agg(F.sum(ranks * v).alias("_rs"), F.sum(half).cast("long").alias("k_half"))
    return a.select(key, "groups", (2 * F.col("_rs") / (F.col("groups") * F.col("_s")) - (F.col("groups") + 1) / F.col("groups")).alias("gini"), "k_half")


def log2_enrichment(counts: DataFrame, a: str, b: str, n: str = "n", least: int = 10) -> DataFrame:
    """a, b, n, expected from the margins and log2 of observed over expected; null where n is under ``least``."""
    of_a, of_b = counts.groupBy(a).agg(F.sum(n).alias("_a")), counts.groupBy(b).agg(F.sum(n).alias("_b"))
    all_ = counts.agg(F.sum(n).alias("_all"))
    e = F.col("_a") * F.col("_b") / F.col("_all")
    out = counts.join(of_a, a).join(of_b, b).join(F.broadcast(all_))
    return out.select(*counts.columns, e.alias("expected"), F.when(F.col(n) >= least, F.log2(F.col(n) / e)).alias("log2fc"))


def bh(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """``tests`` with q: Benjamini-Hochberg in each of ``by``, the least p * n / rank of its own and all greater p. Equal p are one row, and ranks and least values go by ranges of p."""
    by = by or []
    g = tests.groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranked = running(g, ["_p"], {"_rank": "_n"}, by)
    all_ = g.groupBy(*[F.col(c).alias(f"_all_{c}") for c in by]).agg(F.sum("_n").alias("_all"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_all_{c}"))
    x = ranked.join(F.broadcast(all_) if not by else all_, same).withColumn("_x", F.col("_p") * F.col("_all") / F.col("_rank")).withColumn("_down", -F.col("_p"))
    q = running(x.select(*by, "_p", "_x", "_down"), ["_down"], {"_q": "_x"}, by, how="min").select(*[F.col(c).alias(f"_by_{c}") for c in by], "_p", F.least(F.lit(1.0), "_q").alias("q"))
    on = F.col(p).eqNullSafe(F.col("_p"))
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return tests.join(q, on).select(*tests.columns, "q")


def ranked_values(df: DataFrame, value: str, key: str, **counts) -> DataFrame:
    """key, value, rank (average over equal values) and ``counts``, once for each value of each key."""
    v = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_t"), *[c.alias(k) for k, c in counts.items()])
    return running(v, [value], {"_upto": "_t"}, [key]).withColumn("rank", F.col("_upto") - (F.col("_t") - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """key, n and rho: correlation of average ranks, of the rows that have both values. Equal pairs of values are one row, counted once; ranks and sizes follow from these counts."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)
    pairs = cut(both.groupBy(key, x, y).agg(F.count("*").alias("_w")))
    ranks = []
    for c, r in ((x, "_rx"), (y, "_ry")):
        upto = running(pairs.groupBy(key, c).agg(F.sum("_w").alias("_t")), [c], {"_upto": "_t"}, [key])
        ranks.append(upto.select(key, c, (F.col("_upto") - (F.col("_t") - 1) / 2.0).alias(r)))
    n = pairs.groupBy(key).agg(F.sum("_w").alias("n"))
    a, b, w = F.col("_rx") - (F.col("n") + 1) / 2.0, F.col("_ry") - (F.col("n") + 1) / 2.0, F.col("_w")
    s = pairs.join(ranks[0], [key, x]).join(ranks[1], [key, y]).join(n, key).groupBy(key, "n").agg(F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    return s.select(key, "n", F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


def rank_sum(df: DataFrame, value: str, first: str, key: str) -> DataFrame:
    """key, n1, n2, u, z and z_tied of the Wilcoxon rank-sum test of rows where ``first`` holds against the others; z_tied has the variance corrected for ties."""
    r = ranked_values(df, value, key, _n1=F.count_if(first), _n2=F.count_if(~F.col(first)))
    t = F.col("_t").cast("double")
    a = r.groupBy(key).agg(F.sum("_n1").alias("n1"), F.sum("_n2").alias("n2"), F.sum(F.col("_n1") * F.col("rank")).alias("w"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")  # their products outgrow a long
    n, u = n1 + n2, F.col("w") - n1 * (n1 + 1) / 2
    off = u - n1 * n2 / 2
    return a.select(key, "n1", "n2", u.alias("u"), F.try_divide(off, F.sqrt(n1 * n2 * (n + 1) / 12.0)).alias("z"), F.try_divide(off, F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))).alias("z_tied"))


def sibling_concordance(pairs: DataFrame, leaves: DataFrame) -> DataFrame:
    """cls, observed (sibling pairs of one type), expected under random labels (pairs * n (n - 1) / (N (N - 1))) and log2 fold."""
    c = leaves.select("node", "cls")
    both = pairs.join(c.select(F.col("node").alias("a"), F.col("cls").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("cls").alias("cb")), "b")
    obs = both.filter("ca = cb").groupBy(F.col("ca").alias("cls")).agg(F.count("*").alias("observed"))
    n = c.groupBy("cls").agg(F.count("*").alias("n")).join(F.broadcast(c.agg(F.count("*").alias("total")))).join(F.broadcast(pairs.agg(F.count("*").alias("pairs"))))
    e = F.col("pairs") * F.col("n") * (F.col("n") - 1) / (F.col("total") * (F.col("total") - 1))
    return n.join(obs, "cls", "left").na.fill(0, ["observed"]).select("cls", "observed", e.alias("expected"), F.log2((F.col("observed") + 1) / (e + 1)).alias("log2fold"))


def shuffled(labels: DataFrame, replicates: int, seed: int = 1, stratum: str | None = None) -> DataFrame:
    """rep, node and cls: labels shuffled within strata, once for each replicate. The order is that of a hash of (node, rep, seed), so any partitioning gives the same.

    Ranks go by ranges, so no task takes a replicate; sizes are told as they are, so that no join gathers the labels in the driver."""
    own = [stratum] if stratum else []
    reps = labels.select(*own, "node", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    key = F.md5(F.concat_ws(":", F.lit(seed), "rep", "node").cast("binary"))
    to = running(reps.withColumn("_h", key), ["_h", "node"], {"_k": "1L"}, ["rep", *own]).select("rep", *own, "node", "_k")
    # the order of nodes is the same in all replicates
    what = running(labels.select(*own, "node", "cls"), ["node"], {"_k": "1L"}, own).select(*own, "cls", "_k")
    return fresh(to.join(fresh(what), [*own, "_k"]).select("rep", "node", "cls"))


def captured_pairings(pairs: DataFrame) -> DataFrame:
    """One partner for each cell (a, b, disc, shared): the least disc, then the most shared, then the least b."""
    w = W.partitionBy("a").orderBy("disc", F.desc("shared"), "b")
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def uniform(*parts: object) -> Column:
    """A number in (0, 1) from the md5 of ``parts``: the same for any partitioning."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def geometric_sizes(founders: DataFrame, p: float, replicates: int, seed: int = 1) -> DataFrame:
    """rep, founder and n: clone sizes of a pure birth process, geometric from 1 on with chance ``p``, for each founder and replicate."""
    reps = founders.select("founder", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = uniform(seed, F.col("rep"), F.col("founder"))
    return reps.select("rep", "founder", (1 + F.floor(F.ln(u) / math.log1p(-p))).cast("long").alias("n"))


def null_band(values: DataFrame, by: str, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """by, median, lo and hi of ``value`` over replicates."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(0.5), F.lit(high)))
    return values.groupBy(by).agg(q.alias("_q")).select(by, F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(0)).alias("lo"), F.get("_q", F.lit(2)).alias("hi"))


def permutation_moments(counts: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """keys, mean and variance of ``n`` over ``replicates``; replicates without a row count 0."""
    s, q, r = F.sum("n"), F.sum(F.col("n") * F.col("n")), F.lit(replicates)
    return counts.groupBy(*keys).agg((s / r).alias("mean"), ((q - s * s / r) / (r - 1)).alias("variance"))
