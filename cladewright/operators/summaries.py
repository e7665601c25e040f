"""Summary tables: type universes, compositions, quantiles, histograms, pair classes, comparisons of two analyses, tails of count distributions, matched samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cladewright.functions import columns as C

from .scale import cut, running

#: A variance of up to so many times the mean counts as that of a Poisson distribution.
NEARLY = 1.05


def founder_rows(founders: DataFrame, genotype: str = "genotype", none: str = "(unedited)", sep: str = "-") -> DataFrame:
    """tape, site (from 1) and token of each edit that a founder genotype (tape, genotype) spells; blank and unedited ones give none."""
    text = F.trim(F.coalesce(genotype, F.lit("")))
    edits = F.when((text == "") | (text == none), F.array().cast("array<string>")).otherwise(F.split(text, sep))
    return founders.select("tape", F.posexplode(edits).alias("_p", "token")).filter("token <> ''").select("tape", (F.col("_p") + 1).alias("site"), "token")


def founder_wide(founders: DataFrame, none: str = "(unedited)") -> DataFrame:
    """tape, a and b from founders (tape, side: A or B, genotype); ``none``, blank or missing are written as ``none``."""
    g = F.when(F.coalesce(F.lower(F.trim("genotype")), F.lit("")).isin("", "none"), F.lit(none)).otherwise(F.trim("genotype"))
    of = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, g)), F.lit(none))
    return founders.groupBy("tape").agg(of("A").alias("a"), of("B").alias("b"))


def recoded(c: Column, empty: str = "ETY", missing: str = "None") -> Column:
    """A site token in the alphabet of the ancestral-state tables: 0 for unedited, ? for missing."""
    return F.when(c.isNull() | (c == missing), "?").when((c == empty) | (c == C.UNEDITED), "0").otherwise(c)


def remapped(cells: DataFrame, wells: DataFrame, cell: str = "cell", sep: str = "-") -> DataFrame:
    """``cells`` with the last part of a composite id (left-well) replaced by ``wells`` (well, to); ids of wells that are not mapped, or without parts, stay."""
    at = F.length(cell) - F.locate(sep, F.reverse(cell)) + 1
    has = F.locate(sep, F.col(cell)) > 0
    x = cells.withColumn("_left", F.when(has, F.substr(F.col(cell), F.lit(1), at - 1))).withColumn("_well", F.when(has, F.substr(F.col(cell), at + len(sep))))
    out = x.join(F.broadcast(wells.select(F.col("well").alias("_well"), F.col("to").alias("_to"))), "_well", "left")
    return out.select(*[F.coalesce(F.concat("_left", F.lit(sep), "_to"), F.col(cell)).alias(cell) if c == cell else F.col(c) for c in cells.columns])


def universe(cells: DataFrame, least: int = 100) -> DataFrame:
    """cls of the types that have ``least`` cells or more on each side (cells: cls, side A or B)."""
    return cells.groupBy("cls").agg(F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "B").alias("b")).filter((F.col("a") >= least) & (F.col("b") >= least))


def abundant(cells: DataFrame, share: float = 0.0001) -> DataFrame:
    """cls of the types that make up ``share`` or more of both sides."""
    n = cells.groupBy("side", "cls").agg(F.count("*").alias("n")).withColumn("pct", F.col("n") / F.sum("n").over(W.partitionBy("side"))).filter(F.col("pct") >= share)
    return n.groupBy("cls").agg(F.count_distinct("side").alias("_s")).filter("_s = 2").select("cls")


def transcriptome_qc(cells: DataFrame) -> DataFrame:
    """``cells`` (umi, genes, unmatched, exon, doublet, ribo, mito) with ok: floors first, then log2 UMI within the mean - 1 sd and mean + 2 sd of the cells with at most 85 % exons."""
    floor = (F.col("umi") >= 100) & (F.col("genes") >= 50) & (F.col("unmatched") < 0.4)
    log = F.log2(F.col("umi").cast("double"))
    spread = cells.filter(floor & (F.col("exon") <= 85)).agg(F.avg(log).alias("_mean"), F.stddev_samp(log).alias("_sd"))
    inside = (log >= F.col("_mean") - F.col("_sd")) & (log <= F.col("_mean") + 2 * F.col("_sd"))
    ok = floor & inside & (F.col("exon") <= 85) & (F.col("doublet") <= 0.1) & (F.col("ribo") <= 5) & (F.col("mito") <= 5)
    return cells.join(F.broadcast(spread)).withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_mean", "_sd")


def eligible(pairs: DataFrame, age: float, disc: float) -> DataFrame:
    return pairs.filter((F.col("age") >= age) & F.col("disc").between(0, disc))


def pair_grid(hits: DataFrame, cells: int) -> DataFrame:
    """a and b of pairs that hit in all ``cells`` cells of a grid of thresholds (hits: cell, a, b)."""
    return hits.select("cell", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("_n")).filter(F.col("_n") == cells).select("a", "b")


def composition_log(cells: DataFrame, by: str, cls: str) -> DataFrame:
    """by, cls and value: log2(100 * share + 1) of each type in each group, 0 where it is absent."""
    n = cells.groupBy(by, cls).agg(F.count("*").alias("n"))
    grid = n.select(by).distinct().crossJoin(F.broadcast(n.select(cls).distinct()))  # groups and types are few
    full = grid.join(n, [by, cls], "left").na.fill(0, ["n"])
    return full.select(by, cls, F.log2(100 * F.col("n") / F.sum("n").over(W.partitionBy(by)) + 1).alias("value"))


def matched(cells: DataFrame, group: str, value: str, bins: int = 40, seed: int = 1) -> DataFrame:
    """Rows of ``cells`` (id) so that each of ``bins`` even bins of log10 ``value`` has as many of each group: the fewest that any has, those with the least hash."""
    v = F.log10(F.col(value).cast("double"))
    ends = cells.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    x = cells.join(F.broadcast(ends)).withColumn("_bin", at)
    n = x.groupBy("_bin", group).agg(F.count("*").alias("_n"))
    groups = cells.select(group).distinct().agg(F.count("*").alias("_g"))
    few = n.groupBy("_bin").agg(F.min("_n").alias("_few"), F.count("*").alias("_k")).join(F.broadcast(groups)).filter("_k = _g")
    ranked = x.join(F.broadcast(few.select("_bin", "_few")), "_bin").withColumn("_r", F.row_number().over(W.partitionBy("_bin", group).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary")), "id")))
    return ranked.filter("_r <= _few").select(*cells.columns, F.col("_bin").cast("int").alias("bin"))


def quartiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, q1, median and q3 (linear between ranks)."""
    p = rows.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return p.select(*by, "n", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def open_histogram(rows: DataFrame, by: str, value: str, top: int) -> DataFrame:
    """by, category (0, 1, ..., ``top`` with a plus, which is open) and its n and share within by."""
    category = F.when(F.col(value) >= top, F.lit(f"{top}+")).otherwise(F.col(value).cast("string"))
    n = rows.groupBy(by, category.alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(by)))


def runs(rows: DataFrame, order: str, category: str, by: str) -> DataFrame:
    """by, category, first, last and n of each run of one category in the order of ``order`` within by.

    Rows are dealt by ranges of by and order, so that no task takes all of one by; only a row of each range, with its last category and its number of starts, meets those of others.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(by, order, category).repartitionByRange(parts, F.col(by).asc_nulls_last(), F.col(order).asc_nulls_first())
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))
    inner = W.partitionBy(by, "_range").orderBy(order)
    over = W.partitionBy(by).orderBy("_range")  # a row for each range
    ends = dealt.groupBy(by, "_range").agg(F.max_by(F.struct(category), F.struct(F.col(order).isNotNull(), order)).alias("_end"))
    ends = ends.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.lag(f"_end.{category}").over(over).alias("_prior"))
    met = dealt.join(F.broadcast(ends), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    before = F.when(F.row_number().over(inner) == 1, F.col("_prior")).otherwise(F.lag(category).over(inner))
    new = F.coalesce((F.col(category) != before).cast("int"), F.lit(1))
    x = cut(met.select(by, order, category, "_range", new.alias("_new")))
    starts = x.groupBy(by, "_range").agg(F.sum("_new").alias("_s"))
    starts = starts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = x.withColumn("_own", F.sum("_new").over(inner)).join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    x = x.withColumn("_run", F.col("_own") + F.col("_before"))
    return x.groupBy(by, "_run", category).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def pair_key(a: str = "a", b: str = "b") -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """a, b, depth_one, depth_two, shift (two - one) and outcome (both, one only, two only) of pairs (a, b in any order, depth) of two analyses."""
    x = one.select(*pair_key(), F.col("depth").alias("depth_one")).join(two.select(*pair_key(), F.col("depth").alias("depth_two")), ["a", "b"], "full")
    outcome = F.when(F.col("depth_one").isNull(), "two only").when(F.col("depth_two").isNull(), "one only").otherwise("both")
    return x.withColumn("shift", F.col("depth_two") - F.col("depth_one")).withColumn("outcome", outcome)


def pair_classes(pairs: DataFrame, level: float = 0.05) -> DataFrame:
    """``pairs`` (captured, q_a, q_b) with class: captured, both (significant on both sides only), other."""
    both = (F.col("q_a") < level) & (F.col("q_b") < level)
    return pairs.withColumn("class", F.when(F.col("captured"), "captured").when(both, "both").otherwise("other"))


def rolled_up(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """cls, tested, captured, testable (in ``other`` too), retained (captured in both) and partners (of captured pairs, by falling fold, joined by commas); from cls, partner, fold, captured."""
    x = pairs.join(other.select("cls", "partner", F.col("captured").alias("_also")), ["cls", "partner"], "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("captured"), F.struct((-F.col("fold")).alias("f"), "partner"))))
    return x.groupBy("cls").agg(
        F.count("*").alias("tested"), F.count_if("captured").alias("captured"), F.count("_also").alias("testable"), F.count_if(F.col("captured") & F.coalesce("_also", F.lit(False))).alias("retained"),
        F.array_join(F.transform(listed, lambda s: s["partner"]), ",").alias("partners"))


def accuracy(predicted: DataFrame, by: list[str], seeds: int = 5) -> tuple[DataFrame, DataFrame]:
    """by, n and accuracy of predictions (truth, guess, seed); and id and truth of rows that are right under ``seeds`` seeds or more."""
    right = F.col("truth") == F.col("guess")
    table = predicted.groupBy(*by).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))
    robust = predicted.filter(right).groupBy("id", "truth").agg(F.count_distinct("seed").alias("_s")).filter(F.col("_s") >= seeds).select("id", "truth")
    return table, robust


def rate_after_prefix(edits: DataFrame, days: float = 13.5) -> DataFrame:
    """cls and rate: mean edits of each tape beyond the founder prefix over ``days``, summed over tapes, from cls, tape and edits of each cell."""
    per = edits.groupBy("cls", "tape").agg((F.avg("edits") / days).alias("_r"))
    return per.groupBy("cls").agg(F.sum("_r").alias("rate"), F.count("*").alias("tapes"))


def copy_summary(copies: DataFrame) -> DataFrame:
    """sample, barcodes, single, multiple and integrations (copies in all) of each sample."""
    return copies.groupBy("sample").agg(F.count("*").alias("barcodes"), F.count_if(F.col("copies") == 1).alias("single"), F.count_if(F.col("copies") > 1).alias("multiple"), F.sum("copies").alias("integrations"))


def failures(parsed: DataFrame) -> DataFrame:
    """why, site (the first open one, from 1; null if none) and n of parsed reads, and their share of why."""
    first = F.array_position(F.transform("sites", lambda s: s.isNull()), True)
    n = parsed.groupBy("why", F.when(first > 0, first).cast("int").alias("site")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("why")))


def _poisson(n: int, m: float) -> float:
    """P(X >= n) at mean m, summed from the greater terms down."""
    if n <= 0:
        return 1.0
    if m <= 0:
        return 0.0
    if n > m:
        total, term, i = 0.0, math.exp(n * math.log(m) - m - math.lgamma(n + 1)), n
        while term > total * 1e-17:
            total += term
            i += 1
            term *= m / i
        return min(1.0, total)
    total, i, term = 0.0, n - 1, math.exp((n - 1) * math.log(m) - m - math.lgamma(n))
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / m
        i -= 1
    return max(0.0, 1.0 - total)


def _negative_binomial(n: int, m: float, v: float) -> float:
    """P(X >= n) at mean m and variance v > m; a term follows from the one before."""
    if n <= 0:
        return 1.0
    r, p = m * m / (v - m), m / v
    log = math.lgamma(n + r) - math.lgamma(r) - math.lgamma(n + 1) + r * math.log(p) + n * math.log1p(-p)
    if n > m:
        total, term, i = 0.0, math.exp(log), n
        while term > total * 1e-17:
            total += term
            term *= (i + r) / (i + 1) * (1 - p)
            i += 1
        return min(1.0, total)
    total, i, term = 0.0, n - 1, math.exp(log) * n / ((n - 1 + r) * (1 - p))
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / ((i - 1 + r) * (1 - p)) if i else 0.0
        i -= 1
    return max(0.0, 1.0 - total)


@F.pandas_udf(T.DoubleType())
def poisson_tail(k, mean):
    """P(X >= k) of a Poisson distribution; null where either is null."""
    import pandas as pd

    return pd.Series([None if pd.isna(a) or pd.isna(b) else _poisson(int(a), float(b)) for a, b in zip(k, mean, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def negative_binomial_tail(k, mean, variance):
    """P(X >= k) of a negative binomial distribution of that mean and variance, or, up to a variance of ``NEARLY`` times the mean, of a Poisson distribution; null where any is null."""
    import pandas as pd

    tail = lambda n, m, v: _negative_binomial(n, m, v) if v > NEARLY * m and m > 0 else _poisson(n, m)
    return pd.Series([None if pd.isna([a, b, c]).any() else tail(int(a), float(b), float(c)) for a, b, c in zip(k, mean, variance, strict=True)], dtype=float)


def overdispersed_tail(observed: Column, expected: Column, variance: Column, pseudo: float = 1.0) -> Column:
    """``negative_binomial_tail`` of a count against the moments of its null, to each of which ``pseudo`` is added, so that pairings that the null never saw get no p of 0."""
    return negative_binomial_tail(observed, expected + pseudo, variance + pseudo)


def hypergeometric(groups: DataFrame, total: Column, marked: Column, drawn: Column, hits: Column) -> DataFrame:
    """``groups`` with expected, fold and z of ``hits`` among ``drawn`` rows of ``total``, ``marked`` of which count: the moments of random subsets in closed form."""
    mean = drawn * marked / total
    var = drawn * (marked / total) * (1 - marked / total) * (total - drawn) / (total - 1)
    return groups.withColumn("expected", mean).withColumn("fold", F.try_divide(hits, mean)).withColumn("z", F.try_divide(hits - mean, F.sqrt(var)))


def _two_tails(total: int, marked: int, drawn: int, hits: int) -> float:
    """The chance that ``drawn`` of ``total`` rows hold a number of the ``marked`` that is as far from its mean as ``hits``. Either tail is summed outwards from its edge, where terms only fall."""
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    mean = drawn * marked / total
    far = abs(hits - mean) - 1e-9 * max(1.0, mean)
    if far <= 0:
        return 1.0
    of = math.lgamma
    whole = of(total + 1) - of(drawn + 1) - of(total - drawn + 1)
    out = 0.0
    for k, step in ((math.floor(mean - far), -1), (math.ceil(mean + far), 1)):
        if not low <= k <= high:
            continue
        term = math.exp(of(marked + 1) - of(k + 1) - of(marked - k + 1) + of(total - marked + 1) - of(drawn - k + 1) - of(total - marked - drawn + k + 1) - whole)
        sum_ = 0.0
        while low <= k <= high and term > sum_ * 1e-17:
            sum_ += term
            if step > 0:
                term *= (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))
            else:
                term *= k * (total - marked - drawn + k) / ((marked - k + 1) * (drawn - k + 1))
            k += step
        out += sum_
    return min(1.0, out)


@F.pandas_udf(T.DoubleType())
def two_tails(total, marked, drawn, hits):
    """The exact two-sided chance of random subsets (see ``_two_tails``); null where a number is null or there are no rows."""
    import pandas as pd

    rows = zip(total, marked, drawn, hits, strict=True)
    return pd.Series([None if pd.isna(r).any() or not r[0] else _two_tails(*map(int, r)) for r in map(list, rows)], dtype=float)


def tested_subsets(groups: DataFrame, total: Column, marked: Column, drawn: Column, hits: Column, fdr: float = 0.05, fold: float = 1.5) -> DataFrame:
    """``hypergeometric`` with p (two-sided, exact), q (adjusted over all rows) and the flags low and high: q below ``fdr`` and a fold of 1 / ``fold`` or less, or of ``fold`` or more."""
    from .statistics import bh

    x = cut(hypergeometric(groups, total, marked, drawn, hits).withColumn("p", two_tails(total.cast("double"), marked.cast("double"), drawn.cast("double"), hits.cast("double"))))
    sure = F.coalesce(F.col("q") < fdr, F.lit(False))
    return bh(x, "p").withColumn("low", sure & F.coalesce(F.col("fold") <= 1 / fold, F.lit(False))).withColumn("high", sure & F.coalesce(F.col("fold") >= fold, F.lit(False)))


def diverse_clade(below: DataFrame, low: int, high: int, target: int) -> DataFrame:
    """node, tips, kinds and rank of clades of ``low`` to ``high`` tips, most kinds of tips first, then closest to ``target`` tips, then the least node; from node, cls, n (``trees.class_counts``)."""
    c = below.groupBy("node").agg(F.sum("n").alias("tips"), F.count_if(F.col("n") > 0).alias("kinds")).filter(F.col("tips").between(low, high))
    top = c.orderBy(F.desc("kinds"), F.abs(F.col("tips") - target), "node").limit(10)  # the report's length
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("kinds"), F.abs(F.col("tips") - target), "node")))


def log_normal(counts: DataFrame, scale: float = 10_000.0) -> DataFrame:
    """cell, gene and value: ln(1 + scale * n / all of the cell's)."""
    return counts.select("cell", "gene", F.log1p(scale * F.col("n") / F.sum("n").over(W.partitionBy("cell"))).alias("value"))


def variable_genes(values: DataFrame, cells: int, k: int) -> DataFrame:
    """gene, mean, variance and rank of the ``k`` genes of greatest variance over mean, over ``cells`` cells (absent values are 0)."""
    n = F.lit(float(cells))
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    g = values.groupBy("gene").agg((s / n).alias("mean"), ((q - s * s / n) / (n - 1)).alias("variance"))
    top = g.withColumn("_d", F.try_divide("variance", "mean")).orderBy(F.desc("_d"), "gene").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("_d"), "gene"))).drop("_d")


def scaled(values: DataFrame, genes: DataFrame, cells: DataFrame, most: float = 10.0) -> DataFrame:
    """cell, gene and z of every one of ``cells`` (cell) and ``genes`` (gene, mean, variance; those that were chosen, so few), at most ``most``; a value that is not there is 0, and a gene that does not vary gives 0."""
    own = F.broadcast(genes.agg(F.collect_list(F.struct("gene", "mean", "variance")).alias("_g")))
    grid = cells.select("cell").distinct().join(own).select("cell", F.explode("_g").alias("_g")).select("cell", "_g.*")
    held = values.select(F.col("cell").alias("_c"), F.col("gene").alias("_n"), "value").join(F.broadcast(genes.select(F.col("gene").alias("_n"))), "_n", "left_semi")
    met = grid.join(held, (F.col("cell") == F.col("_c")) & (F.col("gene") == F.col("_n")), "left")
    z = F.try_divide(F.coalesce("value", F.lit(0.0)) - F.col("mean"), F.sqrt("variance"))
    return met.select("cell", "gene", F.least(F.lit(most), F.coalesce(z, F.lit(0.0))).alias("z"))


def control_genes(values: DataFrame, sets: DataFrame, bins: int = 24, controls: int = 100, seed: int = 1) -> DataFrame:
    """name and gene of the control genes of each set (name, gene): for each of its genes ``controls`` of those of like mean, each once.

    Genes are ranked by their sum over all cells (ties: the least gene) and dealt in ``bins`` of equal number; a gene's controls are those of its bin with the least md5 of seed, set, gene and control.
    """
    sums = values.groupBy("gene").agg(F.sum("value").alias("_s"))
    ranked = running(sums, ["_s", "gene"], {"place": "1L"}).drop("_s")
    n = ranked.agg(F.max("place").alias("_all"))
    binned = ranked.join(F.broadcast(n)).select("gene", F.floor((F.col("place") - 1) * bins / F.col("_all")).alias("_bin"))
    own = sets.select("name", F.col("gene").alias("_of")).distinct().join(binned.withColumnRenamed("gene", "_of"), "_of")
    key = F.md5(F.concat_ws(":", F.lit(seed), "name", "_of", "gene").cast("binary"))
    tried = F.broadcast(own).join(binned, "_bin").withColumn("_k", F.row_number().over(W.partitionBy("name", "_of").orderBy(key, "gene")))
    return tried.filter(F.col("_k") <= controls).select("name", "gene").distinct()


def module_score(values: DataFrame, sets: DataFrame, cells: DataFrame, bins: int = 24, controls: int = 100, seed: int = 1) -> DataFrame:
    """cell, name and score of every one of ``cells`` and each gene set (name, gene): the mean of its genes less that of their control genes. Values that are not there are 0; genes that no cell has are left out."""
    known = values.select("gene").distinct()
    own = sets.select("name", "gene").distinct().join(known, "gene", "left_semi")
    both = own.withColumn("_own", F.lit(1.0)).unionByName(control_genes(values, own, bins, controls, seed).withColumn("_own", F.lit(-1.0)))
    sizes = both.groupBy("name", "_own").agg(F.count("*").alias("_n"))
    weights = cut(both.join(sizes, ["name", "_own"]).groupBy("name", "gene").agg(F.sum(F.col("_own") / F.col("_n")).alias("_w")))  # sets and controls are few
    sums = values.join(F.broadcast(weights), "gene").groupBy("cell", "name").agg(F.sum(F.col("value") * F.col("_w")).alias("_s"))
    names = F.broadcast(weights.agg(F.array_sort(F.collect_set("name")).alias("_names")))
    grid = cells.select("cell").distinct().join(names).select("cell", F.explode("_names").alias("name"))
    return grid.join(sums, ["cell", "name"], "left").select("cell", "name", F.coalesce("_s", F.lit(0.0)).alias("score"))


def _group_sums(values: DataFrame, cells: DataFrame, first: str) -> DataFrame:
    """gene, n1, n2 and for both groups the sum s, of squares q, of counts before the logarithm e, and the cells k with a value above 0."""
    f = F.col(first)
    held = values.filter("value > 0").join(cells.select("cell", first), "cell")
    v = F.col("value")
    of = lambda on, k: [F.coalesce(F.sum(F.when(on, x)), F.lit(0.0)).alias(f"{n}{k}") for n, x in (("s", v), ("q", v * v), ("e", F.expm1(v)))] + [F.count_if(on).alias(f"k{k}")]
    n = cells.agg(F.count_if(f).alias("n1"), F.count_if(~f).alias("n2"))
    return held.groupBy("gene").agg(*of(f, 1), *of(~f, 2)).join(F.broadcast(n))


def effect_sizes(values: DataFrame, cells: DataFrame, first: str = "first") -> DataFrame:
    """gene, n1, n2, difference of means and Cohen's d (over the root of the mean of both variances) of the ``cells`` (cell, ``first``) where ``first`` holds against the others; values that are not there are 0."""
    x = _group_sums(values, cells, first)
    var = lambda k: (F.col(f"q{k}") - F.col(f"s{k}") ** 2 / F.col(f"n{k}")) / (F.col(f"n{k}") - 1)
    apart = F.try_divide("s1", "n1") - F.try_divide("s2", "n2")
    return x.select("gene", "n1", "n2", apart.alias("difference"), F.try_divide(apart, F.sqrt(F.greatest(F.lit(0.0), (var(1) + var(2)) / 2))).alias("d"))


def markers(values: DataFrame, cells: DataFrame, first: str = "first", least: float = 0.01) -> DataFrame:
    """gene, pct1, pct2, log2fc, u, z and p of the rank-sum test of the ``cells`` where ``first`` holds against the others, for genes that a share of ``least`` of either group has.

    Values are 0 or more, and those that are not there are 0: they are one tie below all others, so only stored values are ranked. z is corrected for ties and continuity, p two-sided from the normal
    distribution; log2fc compares means before the logarithm, 1 added to each.
    """
    f = F.col(first)
    held = values.filter("value > 0").join(cells.select("cell", first), "cell")
    t = held.groupBy("gene", "value").agg(F.count("*").alias("_t"), F.count_if(f).alias("_t1"))
    ranked = running(t, ["value"], {"_upto": "_t"}, ["gene"])
    k, n1, n2 = F.col("_t").cast("double"), F.col("n1").cast("double"), F.col("n2").cast("double")
    rank = F.col("_upto") - (k - 1) / 2
    r = ranked.groupBy("gene").agg(F.sum(F.col("_t1") * rank).alias("_w"), F.sum(k * k * k - k).alias("_ties"), F.sum("_t1").alias("_f"), F.sum("_t").alias("_k"))
    x = _group_sums(values, cells, first).join(r, "gene")
    n, zeros = n1 + n2, n1 + n2 - F.col("_k")
    u = F.col("_w") + F.col("_f") * zeros + (n1 - F.col("_f")) * (zeros + 1) / 2 - n1 * (n1 + 1) / 2
    off = u - n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - (F.col("_ties") + zeros * zeros * zeros - zeros) / (n * (n - 1))))
    z = F.when(sd > 0, F.signum(off) * F.greatest(F.lit(0.0), F.abs(off) - 0.5) / sd)
    out = x.select("gene", (F.col("k1") / n1).alias("pct1"), (F.col("k2") / n2).alias("pct2"), (F.log2(F.col("e1") / n1 + 1) - F.log2(F.col("e2") / n2 + 1)).alias("log2fc"), u.alias("u"), z.alias("z"))
    return out.filter((F.col("pct1") >= least) | (F.col("pct2") >= least)).withColumn("p", two_sided("z"))


@F.pandas_udf(T.DoubleType())
def two_sided(z):
    """The chance of a standard normal value as far from 0 as z on either side; 1 where z is null."""
    import pandas as pd

    return pd.Series([1.0 if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype=float)


def common(one: DataFrame, two: DataFrame, key: str = "gene") -> DataFrame:
    """Rows of both tables (same columns) whose ``key`` is in each."""
    keys = one.select(key).intersect(two.select(key))
    return one.unionByName(two).join(keys, key, "left_semi")
