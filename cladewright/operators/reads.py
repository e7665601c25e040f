"""Operators on reads and patterns: parsing, correction, funnel, rates, spectra, de-noising."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cladewright.functions import columns as C
from cladewright.functions import kernels as K
from cladewright.shipping import ship

from .scale import components, cut, running

SITES = T.ArrayType(T.StringType())
WALKED = T.StructType([T.StructField("sites", SITES), T.StructField("broken", T.BooleanType()), T.StructField("why", T.StringType())])


def spelled(g: K.Grammar = K.GRAMMAR) -> str:
    """A pattern of an array without damage: as many monomers as there are sites, then the terminal one. Its groups are the tokens (empty: unedited)."""
    monomer = f"{g.anchor}.{{{g.body - len(g.anchor)}}}(?:([A-Z]{{1,6}}){g.key})?{g.tail}"
    return monomer * g.sites + g.terminal


def walk(reads: DataFrame, seq: str = "seq", start: str = "start", compat_frame_shift: bool = True, g: K.Grammar = K.GRAMMAR) -> DataFrame:
    """``reads`` with sites, broken and why (see ``kernels.walk``); a null start resolves nothing.

    Arrays that are spelled without damage, with no anchor but their own, are read by one pattern in the JVM; only the others go to the kernel. The kernel is marked so that no filter on what it
    gives is pushed below it: that would run it twice, and the making of its input once for each mention.
    """
    ship(reads.sparkSession)
    tail = F.substr(F.col(seq), F.col(start) + 1)
    groups = "|".join(f"${i + 1}" for i in range(g.sites))
    anchors = (F.length(tail) - F.length(F.replace(tail, F.lit(g.anchor), F.lit("")))) / len(g.anchor)
    read = F.when(anchors == g.sites + 1, F.regexp_replace(tail, f"^.*?{spelled(g)}.*$", f"#{groups}"))
    whole = F.coalesce(F.startswith("_read", F.lit("#")), F.lit(False))

    @F.arrow_udf(WALKED)
    def walked(s: pa.Array, at: pa.Array) -> pa.Array:
        out: list[list] = [[None] * len(s) for _ in WALKED]
        for i in np.flatnonzero(s.is_valid().to_numpy(zero_copy_only=False)).tolist():  # the others are reads that the pattern tells
            for c, x in zip(out, K.walk(s[i].as_py(), at[i].as_py(), compat_frame_shift) if at[i].is_valid else ([None] * g.sites, False, "short"), strict=True):
                c[i] = x
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.list_(pa.string()), pa.bool_(), pa.string()), strict=True)], WALKED.names)

    marked = reads.withColumn("_read", read).withColumn("_w", walked.asNondeterministic()(F.when(~whole, F.coalesce(seq, F.lit(""))), start))
    marked = marked.withColumn("_t", F.when(whole, F.split(F.substr("_read", F.lit(2)), r"\|")))
    first = F.array_position("_t", "")
    states = F.when(first == 0, F.col("_t")).otherwise(F.concat(F.slice("_t", F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")), F.array_repeat(F.lit(C.UNEDITED), (g.sites + 1 - first).cast("int"))))
    return marked.select(
        *reads.columns, F.when(whole, states).otherwise(F.col("_w.sites")).alias("sites"), F.when(whole, F.lit(False)).otherwise(F.col("_w.broken")).alias("broken"),
        F.when(whole, F.when(first == 0, "full").otherwise("unedited")).otherwise(F.col("_w.why")).alias("why"))


def dereplicated(reads: DataFrame, seq: str = "seq", n: str = "n_reads") -> DataFrame:
    """``seq`` and ``n``: each sequence once, and how many reads have it. Amplicons are read many times over; what only counts reads need parse each sequence but once."""
    return reads.groupBy(seq).agg(F.count("*").alias(n))


def _number(n: str | None, where: Column | None = None) -> Column:
    """How many reads (``where`` holds): rows, or the sum of their ``n``."""
    if n is None:
        return F.count("*") if where is None else F.count_if(where)
    return F.coalesce(F.sum(n if where is None else F.when(where, F.col(n)).otherwise(0)), F.lit(0))


def parse_bulk(reads: DataFrame, compat_frame_shift: bool = True) -> DataFrame:
    """``reads`` (seq) with barcode, sites, broken, why and resolved."""
    found = reads.withColumn("_b", C.extract_barcode(F.col("seq"))).withColumn("barcode", F.col("_b.barcode")).withColumn("start", F.col("_b.start")).drop("_b")
    out = walk(found, compat_frame_shift=compat_frame_shift)
    return out.withColumn("resolved", ~F.col("broken") & F.forall("sites", lambda x: x.isNotNull()))


def parse_cells(reads: DataFrame, compat_frame_shift: bool = True, sample: str = "") -> DataFrame:
    """``reads`` (header, seq) of single cells with cell, pcr, umi and sample of the header, barcode, sites, broken, why and resolved; reads with a shorter header go, and those whose sample does not contain ``sample``."""
    # the filter is pushed below the making of headers, which is said again for each mention: so it has one
    fourth = "[^,]*,[^,]*,[^,]*," + (f"[^,]*{re.escape(sample)}" if sample else "")
    named = reads.filter(F.lit("," not in sample) & F.col("header").rlike(f"^{fourth}"))
    named = named.withColumn("_f", C.header_fields(F.col("header")))
    fields = [F.col("_f")[i].alias(c) for i, c in enumerate(("cell", "pcr", "umi", "sample"))]
    found = named.withColumn("_b", C.extract_cell_barcode(F.col("seq"))).select(*reads.columns, *fields, F.col("_b.barcode").alias("barcode"), F.col("_b.start").alias("start"))
    out = walk(found, compat_frame_shift=compat_frame_shift)
    return out.withColumn("resolved", ~F.col("broken") & F.forall("sites", lambda x: x.isNotNull()))


def flagged(parsed: DataFrame, whitelist: DataFrame, vocabulary: DataFrame, length: int = 12) -> DataFrame:
    """``parsed`` (of ``parse_bulk``) with extracted, corrected (the whitelist's barcode), error and valid.

    A barcode must have ``length`` bases; the order of a read's sites counts as an error only then; a read is valid if its barcode is corrected, all sites are resolved
    and every edit is in the vocabulary (insertion). Whitelist (tapebc) and vocabulary are small tables.
    """
    ok = parsed.withColumn("extracted", F.coalesce(F.length("barcode") == length, F.lit(False)))
    # words and entries are asked for several times, and reads are gone through once for them; a filter would be pushed below the count of words
    words = cut(ok.select(F.when(F.col("extracted"), F.col("barcode")).alias("word")).distinct()).filter("word is not null")
    near = unique_nearest(words, cut(whitelist.select(F.col("tapebc").alias("entry")).distinct())).select("word", F.col("nearest").alias("corrected"))
    # words with an entry are that or within two mismatches of it: a few hundred for each entry, so that no barcode's reads are gathered
    ok = ok.join(F.broadcast(near.filter("corrected is not null")), F.col("extracted") & (F.col("barcode") == F.col("word")), "left").drop("word")
    known = F.broadcast(vocabulary.agg(F.collect_set("insertion").alias("_vocab")))
    error = F.col("extracted") & F.col("broken")
    valid = F.col("corrected").isNotNull() & ~error & F.col("resolved") & F.forall("sites", lambda s: (s == C.UNEDITED) | F.array_contains("_vocab", s))
    return ok.join(known).withColumn("error", error).withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_vocab")


def parse_funnel(flags: DataFrame, n: str | None = None) -> DataFrame:
    """metric, n and pct of the six counters of ``flagged`` reads, or of ``n`` reads a row."""
    ok = F.col("extracted")
    return funnel(flags, {"total_reads": F.lit(True), "bc_extractable": ok, "bc_in_whitelist": F.col("corrected").isNotNull(), "ordering_errors": F.col("error"), "all_sites_resolved": ok & ~F.col("error") & F.col("resolved"), "valid_reads": F.col("valid")}, n)


def unique_nearest(words: DataFrame, dictionary: DataFrame, word: str = "word", entry: str = "entry", most: int = 2) -> DataFrame:
    """``words`` with ``nearest``: the dictionary entry within ``most`` mismatches that no other is as near as; null if there is none.

    Strings are compared over the shorter length. Candidates come from an equi-join on the forms with ``most`` characters blanked, once for each distinct word, so
    the work goes with words and entries and not with their product. There are few lengths.
    """
    held, asked = dictionary.select(F.col(entry).alias("_e")).filter("_e is not null").distinct(), words.select(F.col(word).alias("_w")).filter("_w is not null").distinct()
    of = lambda df, c: sorted(r[0] for r in df.select(F.length(c)).distinct().collect())  # noqa: E731  lengths
    wl, el = of(asked, "_w"), of(held, "_e")

    def keyed(df: DataFrame, c: str, mine: list[int], others: list[int]) -> DataFrame:
        n = sorted({min(a, b) for a in mine for b in others})
        met = F.explode(F.filter(F.array(*[F.lit(k) for k in n]), lambda k: k <= F.length(c)))
        forms = F.lit(None).cast("array<string>")
        for k in n:
            forms = F.when(F.col("n") == k, C.masks(F.col(c), k, most)).otherwise(forms)
        return df.select(c, met.alias("n")).select(c, "n", F.explode(forms).alias("m"))

    met = keyed(asked, "_w", wl, el).join(keyed(held, "_e", el, wl), ["n", "m"]).filter("n = least(length(_w), length(_e))").select("_w", "_e").distinct()
    d = met.withColumn("_d", C.hamming(F.col("_w"), F.col("_e"))).filter(F.col("_d") <= most)
    best = d.groupBy("_w").agg(F.min(F.struct("_d", "_e")).alias("_b"), F.collect_list("_d").alias("_all"))
    one = best.select("_w", F.when(F.size(F.filter("_all", lambda x: x == F.col("_b._d"))) == 1, F.col("_b._e")).alias("nearest"))
    return words.join(one, F.col(word) == F.col("_w"), "left").drop("_w")


def funnel(reads: DataFrame, stages: dict[str, Column], n: str | None = None) -> DataFrame:
    """metric, n and pct (of all) of each condition; a row may stand for ``n`` reads."""
    one = reads.agg(*[_number(n, c).alias(k) for k, c in stages.items()], _number(n).alias("_total"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in stages]))
    return one.select("_total", rows.alias("r")).select("r.metric", "r.n", (100 * F.col("r.n") / F.greatest(F.col("_total"), F.lit(1))).alias("pct"))


def counted(reads: DataFrame, barcode: str, sites: str) -> DataFrame:
    """barcode, sites and _n: reads of each pattern. Patterns are few beside reads, and what is exploded later is them."""
    return reads.groupBy(barcode, sites).agg(F.count("*").alias("_n"))


def site_rates(reads: DataFrame, whitelist: DataFrame, barcode: str = "tape", sites: str = "sites", n_sites: int = 6) -> DataFrame:
    """barcode, site, resolved, edited and rate, with zeros for whitelisted barcodes without reads."""
    long = counted(reads, barcode, sites).select(barcode, F.posexplode(sites).alias("site", "s"), "_n").filter("s is not null")
    seen = long.groupBy(barcode, (F.col("site") + 1).alias("site")).agg(F.sum("_n").alias("resolved"), F.sum(F.when(F.col("s") != C.UNEDITED, F.col("_n")).otherwise(0)).alias("edited"))
    grid = whitelist.select(barcode).distinct().select(barcode, F.explode(F.sequence(F.lit(1), F.lit(n_sites))).alias("site"))
    out = grid.join(seen, [barcode, "site"], "left").na.fill(0, ["resolved", "edited"])
    return out.withColumn("rate", F.when(F.col("resolved") > 0, F.col("edited") / F.col("resolved")).otherwise(0.0))


def insertion_peaks(reads: DataFrame, least: int, barcode: str = "tape", sites: str = "sites") -> DataFrame:
    """insertion, peak (its greatest count over barcodes and sites) and admitted."""
    per = counted(reads, barcode, sites).select(barcode, "_n", F.posexplode(sites).alias("site", "insertion")).filter(F.col("insertion") != C.UNEDITED).groupBy(barcode, "site", "insertion").agg(F.sum("_n").alias("n"))
    return per.groupBy("insertion").agg(F.max("n").alias("peak")).withColumn("admitted", F.col("peak") >= least)


def spectrum(reads: DataFrame, sites: str = "sites", least: float = 0.0, pooled: bool = False) -> DataFrame:
    """site (or, ``pooled``, pool: 1-2 or 3-6), insertion, n and share within it, where the share is ``least`` or more."""
    by = "pool" if pooled else "site"
    at = F.when(F.col("p") < 2, "1-2").otherwise("3-6") if pooled else F.col("p") + 1
    long = reads.groupBy(sites).agg(F.count("*").alias("_n")).select("_n", F.posexplode(sites).alias("p", "insertion")).filter(F.col("insertion") != C.UNEDITED)
    per = long.groupBy(at.alias(by), "insertion").agg(F.sum("_n").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(by))).filter(F.round("share", 6) >= least)


def edit_rates_by_position(reads: DataFrame, sites: str = "sites") -> DataFrame:
    """site, edits and rate: the share of reads with an edit at each site."""
    long = reads.groupBy(sites).agg(F.count("*").alias("_n")).select("_n", F.posexplode(sites).alias("p", "s"))
    return long.groupBy((F.col("p") + 1).alias("site")).agg(F.sum(F.when(F.col("s") != C.UNEDITED, F.col("_n")).otherwise(0)).alias("edits"), (F.sum(F.when(F.col("s") != C.UNEDITED, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("rate"))


def symbol_usage(reads: DataFrame, barcode: str = "tape", sites: str = "sites", first: int = 3) -> DataFrame:
    """barcode, insertion, n, rate (its share of the barcode's edits at sites ``first`` and later, times the number of insertions the barcode has) and log2 rate."""
    long = counted(reads, barcode, sites).select(barcode, "_n", F.posexplode(sites).alias("p", "insertion")).filter((F.col("p") >= first - 1) & (F.col("insertion") != C.UNEDITED))
    n = long.groupBy(barcode, "insertion").agg(F.sum("_n").alias("n"))
    w = W.partitionBy(barcode)
    rate = F.col("n") / F.sum("n").over(w) * F.count("*").over(w)
    return n.withColumn("rate", rate).withColumn("log2rate", F.log2("rate"))


def whitelist(counts: DataFrame, share: float = 0.002, apart: int = 3) -> list[str]:
    """Barcodes by descending count (ties by name) that hold ``share`` of all and are ``apart`` or more mismatches from each already taken. No more than 1 / share of them can hold it."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    out: list[str] = []
    for r in counts.filter(F.col("n") >= share * total).orderBy(F.desc("n"), "barcode").collect():
        if all(sum(x != y for x, y in zip(r.barcode, o, strict=False)) >= apart for o in out):
            out.append(r.barcode)
    return out


def rank_abundance(counts: DataFrame, dictionary: DataFrame, top: int = 5000, report: int = 200) -> DataFrame:
    """rank, word, n and share of the ``report`` most abundant barcodes, after the ``top`` raw ones were folded to their unique nearest dictionary entry, where they have one.

    The shares are of all raw counts. ``counts`` has word and n, the dictionary entry.
    """
    raw = counts.orderBy(F.desc("n"), "word").limit(top)
    folded = unique_nearest(raw, dictionary).groupBy(F.coalesce("nearest", "word").alias("word")).agg(F.sum("n").alias("n"))
    first = folded.orderBy(F.desc("n"), "word").limit(report)
    all_ = counts.agg(F.sum("n").alias("_all"))
    return first.join(F.broadcast(all_)).select(F.row_number().over(W.orderBy(F.desc("n"), "word")).alias("rank"), "word", "n", (F.col("n") / F.col("_all")).alias("share"))


def neighbour_pairs(patterns: DataFrame, key: str = "tape") -> DataFrame:
    """key, a, b: patterns (sites) of one barcode that differ by one base at one edited site, by an equi-join on masked keys."""
    places = F.flatten(F.transform("sites", lambda t, i: F.when(t != C.UNEDITED, F.transform(F.sequence(F.lit(1), F.length(t)), lambda p: F.struct(i.alias("i"), p.alias("p")))).otherwise(F.array().cast("array<struct<i:int,p:int>>"))))
    masked = patterns.select(key, "sites", F.explode(places).alias("at")).select(key, "sites", F.transform("sites", lambda t, i: F.when(i == F.col("at.i"), F.concat(F.substr(t, F.lit(1), F.col("at.p") - 1), F.lit("*"), F.substr(t, F.col("at.p") + 1, F.length(t)))).otherwise(t)).alias("mask"))
    text = F.array_join("sites", "|")
    one = masked.select(key, F.array_join("mask", "|").alias("mask"), text.alias("s"))
    return one.withColumnRenamed("s", "a").join(one.withColumnRenamed("s", "b"), [key, "mask"]).filter("a < b").select(key, "a", "b").distinct()


def dechimera(patterns: DataFrame, key: str = "tape") -> DataFrame:
    """``patterns`` (key, sites, n) with rank and chimera: fully edited patterns with a split into a prefix of one and a suffix of another pattern that are both more abundant.

    Patterns are ranked by n (ties by text); those removed still lend their prefixes and suffixes, so that the least rank of each decides.
    """
    down = patterns.withColumn("_down", -F.col("n")).withColumn("_text", F.array_join("sites", "|"))
    ranked = cut(running(down, ["_down", "_text"], {"rank": "1L"}, [key]).withColumn("rank", F.col("rank").cast("int")).drop("_down", "_text"))
    full = F.forall("sites", lambda x: x != C.UNEDITED)
    split = ranked.filter(full).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("sites") - 1)))
    split = split.withColumn("head", F.array_join(F.slice("sites", F.lit(1), F.col("k")), "|")).withColumn("tail", F.array_join(F.slice("sites", F.col("k") + 1, F.size("sites")), "|"))
    for c, best in (("head", "h"), ("tail", "t")):
        split = split.join(split.groupBy(key, "k", c).agg(F.min("rank").alias(best)), [key, "k", c])
    bad = split.filter((F.col("h") < F.col("rank")) & (F.col("t") < F.col("rank"))).select(key, "rank").distinct().withColumn("chimera", F.lit(True))
    return ranked.join(bad, [key, "rank"], "left").na.fill(False, ["chimera"])


def homes(patterns: DataFrame, key: str = "tape") -> DataFrame:
    """``patterns`` with is_home: whether the barcode is the one with most reads of the pattern (ties: the least)."""
    w = W.partitionBy("sites").orderBy(F.desc("n"), key)
    return patterns.withColumn("is_home", F.row_number().over(w) == 1)


def collapse(patterns: DataFrame, ratio: float = 2.0, key: str = "tape") -> DataFrame:
    """key, sites and n after one-base errors were folded (``kernels.collapse_errors``).

    A fold never leaves a connected component of the neighbour graph, and its order holds within it, so a task takes one component of one barcode, not the barcode.
    """
    ship(patterns.sparkSession)
    kind = patterns.schema[key].dataType.simpleString()
    text = F.array_join("sites", "|")
    pairs = neighbour_pairs(patterns, key)
    hashed = lambda c: F.xxhash64(key, c)
    roots = components(pairs.select(hashed("a").alias("a"), hashed("b").alias("b")))
    own = patterns.select(key, "sites", "n", hashed(text).alias("_id")).join(roots.withColumnRenamed("node", "_id"), "_id", "left").withColumn("_group", F.coalesce("root", "_id"))

    def fold(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((tuple(s), int(n)) for s, n in zip(pdf.sites, pdf.n, strict=True)))
        out = K.collapse_errors(rows, ratio)
        return pd.DataFrame({key: [k[0]] * len(out), "sites": [list(p) for p in out], "n": list(out.values())})

    lone = own.withColumn("_k", F.count("*").over(W.partitionBy(key, "_group")))
    folded = lone.filter("_k > 1").select(key, "_group", "sites", "n").groupBy(key, "_group").applyInPandas(fold, f"{key} {kind}, sites array<string>, n long")
    return folded.unionByName(lone.filter("_k = 1").select(key, "sites", "n"))


def denoise(patterns: DataFrame, ratio: float = 2.0, min_reads: int = 2, cross_depth: int = 2, key: str = "tape", folding=collapse) -> tuple[DataFrame, DataFrame]:
    """Clean ``patterns`` (key, sites, n), and key, raw, collapsed, chimera_filtered, ge_min_reads, cross_bc and clean: how many patterns each stage leaves (cross_bc: takes).

    ``folding`` folds errors, chimeras go, then patterns under ``min_reads``; of patterns ``cross_depth`` deep or deeper only those at their home barcode stay.
    """
    folded = folding(patterns, ratio, key)
    kept = cut(dechimera(folded.select(key, "sites", "n"), key).filter("not chimera").select(key, "sites", "n"))
    floor = homes(kept.filter(F.col("n") >= min_reads), key).withColumn("cross", (C.depth(F.col("sites")) >= cross_depth) & ~F.col("is_home"))
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    counts = n(patterns, "raw").join(n(folded, "collapsed"), key).join(n(kept, "chimera_filtered"), key, "left")
    counts = counts.join(floor.groupBy(key).agg(F.count("*").alias("ge_min_reads"), F.count_if("cross").alias("cross_bc"), F.count_if(~F.col("cross")).alias("clean")), key, "left")
    return floor.filter("not cross").select(key, "sites", "n"), counts.na.fill(0)


def one_round_collapse(patterns: DataFrame, ratio: float = 2.0, key: str = "tape") -> DataFrame:
    """The join form of ``collapse``, key, sites and n: each pattern that has a neighbour of ``ratio`` times its count goes to the most abundant one, once."""
    text = F.array_join("sites", "|")
    own = patterns.select(key, text.alias("p"), "n")
    pairs = neighbour_pairs(patterns, key)
    both = pairs.unionByName(pairs.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(own.select(key, F.col("p").alias("a"), F.col("n").alias("na")), [key, "a"]).join(own.select(key, F.col("p").alias("b"), F.col("n").alias("nb")), [key, "b"])
    to = near.filter((F.col("nb") >= ratio * F.col("na")) & (F.col("nb") > F.col("na"))).groupBy(key, "a").agg(F.max_by("b", F.struct("nb", "b")).alias("to"))
    out = own.join(to.withColumnRenamed("a", "p"), [key, "p"], "left").groupBy(key, F.coalesce("to", "p").alias("p")).agg(F.sum("n").alias("n"))
    return out.select(key, F.split("p", r"\|").alias("sites"), "n")


def merge_pairs(pairs: DataFrame, least: int = 15, most: int = 8, share: float = 0.3) -> DataFrame:
    """``pairs`` (r1, r2) with seq and merged: mates that overlap become one read in the sense of r2; of others (a null mate too) r2 stands alone."""
    ship(pairs.sparkSession)

    @F.pandas_udf("string")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([K.merge_pair(x, y, least, most, share) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype=object)

    out = pairs.withColumn("_m", overlap("r1", "r2"))
    return out.withColumn("seq", F.coalesce(C.reverse_complement(F.col("_m")), F.col("r2"))).withColumn("merged", F.col("_m").isNotNull()).drop("_m")


def deep_barcodes(patterns: DataFrame, least: int = 2000, key: str = "tape") -> DataFrame:
    """The rows of ``patterns`` (key, n) whose barcode has ``least`` reads or more in all."""
    deep = patterns.groupBy(F.col(key).alias("_deep")).agg(F.sum("n").alias("_n")).filter(F.col("_n") >= least).select("_deep")
    return patterns.join(deep, F.col(key).eqNullSafe(F.col("_deep")), "left_semi")


def _pieces(start: str, seq: str, g: K.Grammar) -> Column:
    """What stands before the first anchor of an array, and after each."""
    return F.split(F.substr(F.col(seq), F.col(start) + 1), g.anchor, -1)


def junction_failures(parsed: DataFrame, seq: str = "seq", start: str = "start", g: K.Grammar = K.GRAMMAR, n: str | None = None) -> DataFrame:
    """lacks, length, kind, near, n and share (of all that lack the same) of the junctions at which the forward reading of ``parsed`` (``walk``) ended.

    The segment goes from the body of the site's anchor to the next anchor; it lacks the tail, or else the key before it. kind tells segments of whole length (U without an edit, E3 and E4 with an
    insertion of three or four bases), where bases were replaced, from odd ones, where some were lost or added. near says that what it lacks is there but for one base. Sites without a next anchor are left out.
    """
    site = F.array_position(F.transform("sites", lambda x: x.isNull()), True).cast("int")
    x = parsed.select("why", site.alias("_site"), _pieces(start, seq, g).alias("_p"), (F.col(n) if n else F.lit(1)).alias("_of"))
    body, tail = g.body - len(g.anchor), len(g.tail)
    ends = (F.col("why") == "junction") & (F.col("_site") > 0) & (F.size("_p") >= F.col("_site") + 2)
    # a filter before the count would be pushed below the parse, and all that it reads said again for each mention; segments are few beside reads
    x = x.select(F.when(ends, F.substr(F.get("_p", F.col("_site")), F.lit(body + 1))).alias("_seg"), "_of")
    x = x.groupBy("_seg").agg(F.sum(F.when(F.col("_seg").isNotNull(), F.col("_of")).otherwise(0)).alias("_n")).filter("_n > 0").withColumn("length", F.length("_seg"))
    has = F.endswith("_seg", F.lit(g.tail))
    block = F.substr("_seg", F.lit(1), F.greatest(F.lit(0), F.col("length") - tail))
    near = lambda c, word: (F.length(c) >= len(word)) & (C.hamming(F.right(c, F.lit(len(word))), F.lit(word)) <= 1)
    whole = {tail: "U", tail + len(g.key) + 3: "E3", tail + len(g.key) + 4: "E4"}
    kind = F.lit("odd")
    for n, k in whole.items():
        kind = F.when(F.col("length") == n, k).otherwise(kind)
    x = x.select(F.when(has, g.key).otherwise(g.tail).alias("lacks"), "length", kind.alias("kind"), F.when(has, near(block, g.key)).otherwise(near(F.col("_seg"), g.tail)).alias("near"), "_n")
    n = x.groupBy("lacks", "length", "kind", "near").agg(F.sum("_n").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("lacks")))  # a row for each length


def anchor_offsets(parsed: DataFrame, most: int = 41, seq: str = "seq", start: str = "start", g: K.Grammar = K.GRAMMAR, n: str | None = None) -> DataFrame:
    """sites, away, reads and resolved: how far from an array's start its first anchor stands (``most`` for more), by how many anchors stand before its terminal.

    Where the first anchor was missed, the offset is a monomer longer and the array a site shorter. Reads without an array, an anchor, or the terminal as it is spelled, are left out.
    """
    x = parsed.filter(F.col(start).isNotNull()).withColumn("_tail", F.substr(F.col(seq), F.col(start) + 1)).withColumn("_end", F.locate(g.terminal, F.col("_tail")))
    x = x.filter("_end > 0").withColumn("_p", F.split(F.substr("_tail", F.lit(1), F.col("_end") - 1), g.anchor, -1))
    first = F.length(F.get("_p", F.lit(0)))
    whole = ~F.col("broken") & F.forall("sites", lambda s: s.isNotNull())
    return x.groupBy((F.size("_p") - 1).alias("sites"), F.least(F.lit(most), first).alias("away")).agg(_number(n).alias("reads"), _number(n, whole).alias("resolved"))


def order_patterns(parsed: DataFrame, n: str | None = None) -> DataFrame:
    """pattern and n of reads whose sites are out of order: E for an edited site, U for an unedited, a dot for an open one."""
    text = F.array_join(F.transform("sites", lambda s: F.when(s.isNull(), ".").when(s == C.UNEDITED, "U").otherwise("E")), "")
    return parsed.filter("broken").groupBy(text.alias("pattern")).agg(_number(n).alias("n"))
