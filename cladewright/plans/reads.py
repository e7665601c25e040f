"""Queries on reads: funnel, rates, patterns, spectra, correction and de-noising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewright.catalog import VIEWS, query
from cladewright.functions import columns as C
from cladewright.operators import reads as R
from cladewright.operators.scale import cut

DNA = "translate(md5(CAST({} AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_SITE = ", ".join(f"CASE WHEN d >= {i} THEN substr(g, {3 * i - 2}, 3) ELSE 'U' END AS s{i}" for i in range(1, 7))
_PATTERN = " || '|' || ".join(f"s{i}" for i in range(1, 7))

VIEWS["sc_reads"] = f"""SELECT *, {_PATTERN} AS pattern FROM (
  SELECT cell, tape, umi, read_no, side, d, {_SITE} FROM (
    SELECT l_orderkey % 500 AS cell, concat('T', CAST(l_partkey % 11 AS STRING)) AS tape, substr({DNA.format('l_suppkey')}, 1, 8) AS umi,
      l_orderkey * 10 + l_linenumber AS read_no, CASE WHEN l_orderkey % 2 = 0 THEN 'B1' ELSE 'B2' END AS side, (l_linenumber + l_partkey) % 7 AS d,
      {DNA.format('l_partkey % 13')} AS g FROM {{lineitem}}) q) r"""
VIEWS["patterns"] = "SELECT tape, pattern, s1, s2, s3, s4, s5, s6, count(*) AS n FROM {sc_reads} GROUP BY tape, pattern, s1, s2, s3, s4, s5, s6"
VIEWS["barcodes"] = f"""SELECT word, count(*) AS n FROM (SELECT substr({DNA.format('p_partkey')}, 1, 6) AS word FROM {{part}}) q GROUP BY word"""
VIEWS["entries"] = f"""SELECT DISTINCT substr({DNA.format('s_suppkey')}, 1, 6) AS entry FROM {{supplier}}"""


def all_sites() -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(1, 7)])


def with_sites(df: DataFrame) -> DataFrame:
    return df.withColumn("sites", all_sites())


@query("""SELECT metric, n, round(100.0 * n / greatest(total, 1), 4) AS pct FROM (
  SELECT unnest(['total', 'edited', 'full', 'deep', 'first_side']) AS metric, unnest([count(*), count(*) FILTER (d > 0), count(*) FILTER (d = 6), count(*) FILTER (d >= 3), count(*) FILTER (side = 'B1')]) AS n, count(*) AS total FROM {sc_reads})""", "sc_reads")
def read_funnel(reads: DataFrame) -> DataFrame:
    d = C.depth(all_sites())
    return R.funnel(reads, {"total": F.lit(True), "edited": d > 0, "full": d == 6, "deep": d >= 3, "first_side": F.col("side") == "B1"}).withColumn("pct", F.round("pct", 4))


_LONG = " UNION ALL ".join(f"SELECT tape, cell, {i} AS site, s{i} AS s FROM {{sc_reads}}" for i in range(1, 7))


@query(f"""SELECT tape, site, count(*) AS resolved, count(*) FILTER (s <> 'U') AS edited, round(count(*) FILTER (s <> 'U') / count(*), 6) AS rate FROM ({_LONG}) q GROUP BY tape, site
  UNION ALL SELECT 'T99', unnest([1, 2, 3, 4, 5, 6]), 0, 0, 0.0""", "sc_reads")
def site_edit_rate(reads: DataFrame) -> DataFrame:
    known = reads.select("tape").distinct().unionByName(reads.sparkSession.range(1).select(F.lit("T99").alias("tape")))
    return R.site_rates(with_sites(reads), known).withColumn("rate", F.round("rate", 6))


@query("SELECT tape, pattern, n FROM {patterns}", "sc_reads")
def pattern_counts(reads: DataFrame) -> DataFrame:
    return with_sites(reads).groupBy("tape", "sites").agg(F.count("*").alias("n")).select("tape", F.array_join("sites", "|").alias("pattern"), "n")


@query("""WITH d AS (SELECT word, n, entry, hamming(word, entry) AS d FROM {barcodes}, {entries}), m AS (SELECT word, n, min(d) AS m FROM d GROUP BY word, n)
  SELECT m.word, m.n, CASE WHEN m <= 2 AND count(*) = 1 THEN min(entry) END AS nearest FROM m JOIN d ON d.word = m.word AND d.d = m.m GROUP BY m.word, m.n, m""", "barcodes", "entries")
def barcode_unique_nearest(words: DataFrame, entries: DataFrame) -> DataFrame:
    return R.unique_nearest(words, entries)


@query(f"""SELECT s AS insertion, max(n) AS peak, max(n) >= 100 AS admitted FROM (SELECT tape, site, s, count(*) AS n FROM ({_LONG}) q WHERE s <> 'U' GROUP BY tape, site, s) p GROUP BY s""", "sc_reads")
def insertion_peak_vocab(reads: DataFrame) -> DataFrame:
    return R.insertion_peaks(with_sites(reads), 100)


@query(f"""SELECT * FROM (SELECT site, s AS insertion, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY site), 6) AS share FROM ({_LONG}) q WHERE s <> 'U' GROUP BY site, s) z WHERE share >= 0.05""", "sc_reads")
def insertion_spectrum(reads: DataFrame) -> DataFrame:
    return R.spectrum(with_sites(reads), least=0.05).withColumn("share", F.round("share", 6))


@query("""WITH t AS (SELECT word, n FROM {barcodes} ORDER BY n DESC, word LIMIT 5000), d AS (SELECT word, n, entry, hamming(word, entry) AS d FROM t, {entries}), m AS (SELECT word, n, min(d) AS m FROM d GROUP BY word, n),
  f AS (SELECT m.word, m.n, CASE WHEN m <= 2 AND count(*) = 1 THEN min(entry) END AS nearest FROM m JOIN d ON d.word = m.word AND d.d = m.m GROUP BY m.word, m.n, m), g AS (SELECT coalesce(nearest, word) AS word, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1)
  SELECT CAST(row_number() OVER (ORDER BY n DESC, word) AS INT) AS rank, word, n, round(n / (SELECT sum(n) FROM {barcodes}), 6) AS share FROM g QUALIFY rank <= 200""", "barcodes", "entries")
def barcode_rank_topk(words: DataFrame, entries: DataFrame) -> DataFrame:
    return R.rank_abundance(words, entries).withColumn("share", F.round("share", 6))


@query("""WITH p AS (SELECT tape, pattern, string_split(pattern, '|') AS s, n, row_number() OVER (PARTITION BY tape ORDER BY n DESC, pattern) AS rank FROM {patterns}),
  f AS (SELECT tape, pattern, s, rank FROM p WHERE pattern NOT LIKE '%U%'), k AS (SELECT f.*, unnest([1, 2, 3, 4, 5]) AS k FROM f)
  SELECT tape, pattern, n, rank, EXISTS (SELECT 1 FROM k WHERE k.tape = p.tape AND k.pattern = p.pattern
    AND EXISTS (SELECT 1 FROM f a WHERE a.tape = k.tape AND a.rank < k.rank AND a.s[1:k.k] = k.s[1:k.k]) AND EXISTS (SELECT 1 FROM f b WHERE b.tape = k.tape AND b.rank < k.rank AND b.s[k.k+1:6] = k.s[k.k+1:6])) AS chimera FROM p""", "patterns")
def dechimera_flags(patterns: DataFrame) -> DataFrame:
    return R.dechimera(with_sites(patterns)).select("tape", "pattern", "n", F.col("rank").cast("long").alias("rank"), "chimera")


@query("SELECT tape, pattern, n, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, tape) = 1 AS is_home FROM {patterns}", "patterns")
def cross_barcode_home(patterns: DataFrame) -> DataFrame:
    return R.homes(with_sites(patterns)).select("tape", "pattern", "n", "is_home")


@query("""SELECT a.tape, a.pattern AS a, b.pattern AS b FROM {patterns} a JOIN {patterns} b ON a.tape = b.tape AND a.pattern < b.pattern AND length(a.pattern) = length(b.pattern)
  WHERE (CASE WHEN length(a.pattern) = length(b.pattern) THEN hamming(a.pattern, b.pattern) ELSE 9 END) = 1 AND a.d = b.d""".replace("AND a.d = b.d", ""), "patterns")
def neighbour_pairs(patterns: DataFrame) -> DataFrame:
    return R.neighbour_pairs(with_sites(patterns))


@query("""SELECT word, reverse(translate(word, 'ACGT', 'TGCA')) AS rc, n FROM {barcodes}""", "barcodes")
def reverse_complements(words: DataFrame) -> DataFrame:
    return words.select("word", C.reverse_complement(F.col("word")).alias("rc"), "n")


def synthetic_reads(reads: DataFrame) -> DataFrame:
    """Bulk reads with the genotypes of ``reads`` (and so a known parse)."""
    j = F.array_join(F.transform(all_sites(), lambda s: F.concat(F.lit("GGTGAGCACG"), F.when(s == "U", "TGAT").otherwise(F.concat(s, F.lit("GGATGAT"))))), "")
    bc = F.rpad(F.translate("tape", "T0123456789", "ACGTACGTACG"), 12, "ACCATT")
    return reads.select("read_no", "tape", "pattern", F.concat(F.lit("TTGGCATG"), bc, F.lit("GCTCTGGATGAT"), j, F.lit("GGTGAGCCACAAGGCAATCC")).alias("seq"))


@query("SELECT read_no, pattern, false AS broken, true AS resolved FROM {sc_reads}", "sc_reads")
def parsed_reads(reads: DataFrame) -> DataFrame:
    """The array walk gives back the genotypes that the reads were made from."""
    return R.parse_bulk(synthetic_reads(reads)).select("read_no", F.array_join("sites", "|").alias("pattern"), "broken", "resolved")


@query("""WITH n AS (SELECT a.tape, a.pattern AS p, b.pattern AS q, a.n AS na, b.n AS nb FROM {patterns} a JOIN {patterns} b ON a.tape = b.tape AND a.pattern <> b.pattern AND length(a.pattern) = length(b.pattern)
    WHERE (CASE WHEN length(a.pattern) = length(b.pattern) THEN hamming(a.pattern, b.pattern) ELSE 9 END) = 1 AND b.n >= 2 * a.n AND b.n > a.n),
  t AS (SELECT tape, p, arg_max(q, (nb, q)) AS q FROM n GROUP BY tape, p)
  SELECT f.tape, coalesce(t.q, f.pattern) AS p, CAST(sum(f.n) AS BIGINT) AS n FROM {patterns} f LEFT JOIN t ON t.tape = f.tape AND t.p = f.pattern GROUP BY 1, 2""", "patterns")
def one_round_collapse(patterns: DataFrame) -> DataFrame:
    return R.one_round_collapse(with_sites(patterns)).select("tape", F.array_join("sites", "|").alias("p"), "n")


@query(None, "patterns")
def collapsed_patterns(patterns: DataFrame) -> DataFrame:
    return R.collapse(with_sites(patterns)).select("tape", F.array_join("sites", "|").alias("pattern"), "n")


VIEWS["fragments"] = f"SELECT p_partkey AS read_no, concat({DNA.format('p_partkey')}, {DNA.format('p_partkey + 1000000')}) AS f FROM {{part}}"
VIEWS["pairs"] = "SELECT read_no, substr(f, 1, 60) AS r1, CASE WHEN read_no % 5 = 0 THEN repeat('N', 60) ELSE reverse(translate(substr(f, 5, 60), 'ACGT', 'TGCA')) END AS r2 FROM {fragments}"


@query("SELECT read_no, CASE WHEN read_no % 5 = 0 THEN repeat('N', 60) ELSE reverse(translate(f, 'ACGT', 'TGCA')) END AS seq, read_no % 5 <> 0 AS merged FROM {fragments}", "pairs")
def merged_pairs(pairs: DataFrame) -> DataFrame:
    """Merging gives back the fragments that the mates were cut from."""
    return R.merge_pairs(pairs).select("read_no", "seq", "merged")


@query("SELECT count(*) AS pairs, count(*) FILTER (read_no % 5 <> 0) AS merged, round(count(*) FILTER (read_no % 5 <> 0) / count(*), 6) AS rate FROM {fragments}", "pairs")
def merge_rate(pairs: DataFrame) -> DataFrame:
    n = F.count("*")
    hits = F.count(F.when(F.col("merged"), 1))
    return R.merge_pairs(pairs).agg(n.alias("pairs"), hits.alias("merged"), F.round(hits / n, 6).alias("rate"))


_BC = f"substr({DNA.format('tape')}, 1, 12)"


def _monomer(k: int) -> str:
    token = {1: "CASE m WHEN 6 THEN 'ACGGGA' WHEN 7 THEN CASE WHEN d >= 1 THEN 'AAAAAAGGA' ELSE '' END ELSE e1 END", 3: "CASE m WHEN 6 THEN 'ACGGGA' ELSE e3 END"}.get(k, f"CASE m WHEN 6 THEN '' ELSE e{k} END")
    tail = {1: "CASE m WHEN 6 THEN 'TCAT' ELSE 'TGAT' END", 3: "CASE m WHEN 5 THEN 'TCAT' ELSE 'TGAT' END"}.get(k, "'TGAT'")
    return f"'GGTGAGCACG' || {token} || {tail}"


# One read in twenty has each kind of damage (m): 1 left flank, 2 a base of the barcode missing, 3 a base of it wrong, 4 an unknown barcode, 5 the junction of site 3, 6 sites out of order, 7 an insertion
# that is no known one.
VIEWS["bulk_reads"] = f"""SELECT read_no, cell, umi, tape, pattern, d, m, bc, concat('@c', CAST(cell AS STRING), ',P1,', umi, ',S', CAST(cell % 2 AS STRING)) AS header, repeat('I', 40) AS qual,
  'TT' || CASE m WHEN 1 THEN 'GGCTTG' ELSE 'GGCATG' END || CASE m WHEN 2 THEN substr(bc, 1, 11) WHEN 3 THEN translate(substr(bc, 1, 1), 'ACGT', 'CATG') || substr(bc, 2, 11) WHEN 4 THEN 'TTTTTTTTTTTT' ELSE bc END || 'GCTCTGGATGAT'
  || {' || '.join(_monomer(k) for k in range(1, 7))} || 'GGTGAGCCACAAGGCAATCC' AS seq
  FROM (SELECT read_no, cell, umi, tape, pattern, d, read_no % 20 AS m, {_BC} AS bc, {', '.join(f"CASE WHEN s{k} = 'U' THEN '' ELSE s{k} || 'GGA' END AS e{k}" for k in range(1, 7))} FROM {{sc_reads}}) q"""
VIEWS["whitelisted"] = "SELECT DISTINCT bc AS tapebc FROM {bulk_reads}"
VIEWS["known_insertions"] = "SELECT DISTINCT insertion FROM (" + " UNION ALL ".join(f"SELECT s{k} AS insertion FROM {{sc_reads}}" for k in range(1, 7)) + ") q WHERE insertion <> 'U'"
_RESOLVED = "m NOT IN (1, 2, 6) AND (m <> 5 OR d < 2)"
_COUNTERS = f"""SELECT metric, n, round(100.0 * n / greatest(total, 1), 4) AS pct FROM (SELECT count(*) AS total,
    unnest(['total_reads', 'bc_extractable', 'bc_in_whitelist', 'ordering_errors', 'all_sites_resolved', 'valid_reads']) AS metric,
    unnest([count(*), count(*) FILTER (m NOT IN (1, 2)), count(*) FILTER (m NOT IN (1, 2, 4)), count(*) FILTER (m = 6), count(*) FILTER ({_RESOLVED}), count(*) FILTER ({_RESOLVED} AND m <> 4 AND (m <> 7 OR d < 1))]) AS n FROM {{bulk_reads}})"""


@query(_COUNTERS, "bulk_reads", "whitelisted", "known_insertions")
def parse_funnel(reads: DataFrame, whitelist: DataFrame, vocabulary: DataFrame) -> DataFrame:
    # they are gone through twice, for the words and for the counts
    parsed = R.parse_bulk(cut(R.dereplicated(reads)))
    return R.parse_funnel(R.flagged(parsed, whitelist, vocabulary), "n_reads").withColumn("pct", F.round("pct", 4))


@query(f"""SELECT read_no, CASE WHEN m NOT IN (1, 2, 4) THEN bc END AS corrected, m = 6 AS error, {_RESOLVED} AND m <> 4 AND (m <> 7 OR d < 1) AS valid FROM {{bulk_reads}}""", "bulk_reads", "whitelisted", "known_insertions")
def damaged_reads(reads: DataFrame, whitelist: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """What becomes of each damaged read."""
    return R.flagged(R.parse_bulk(reads.select("read_no", "seq")), whitelist, vocabulary).select("read_no", "corrected", "error", "valid")


@query("SELECT read_no, CASE WHEN m NOT IN (1, 2, 3, 4) THEN bc END AS barcode, concat('c', CAST(cell AS STRING)) AS cell, umi, concat('S', CAST(cell % 2 AS STRING)) AS sample, CASE WHEN m IN (5, 6, 7) THEN NULL ELSE pattern END AS pattern FROM {bulk_reads} WHERE cell % 2 = 1", "bulk_reads")
def cell_reads(reads: DataFrame) -> DataFrame:
    """Cells, UMIs and barcodes of single-cell reads of one sample, as headers and sequences say."""
    parsed = R.parse_cells(reads.select("read_no", "m", "header", "seq"), sample="S1")
    sound = ~F.col("m").isin(5, 6, 7)
    return parsed.select("read_no", F.when(~F.col("m").isin(1, 2, 3, 4), F.col("barcode")).alias("barcode"), "cell", "umi", "sample", F.when(sound, F.array_join("sites", "|")).alias("pattern"))


_ONE = """nb AS (SELECT a.tape, a.pattern AS p, b.pattern AS q, a.n AS na, b.n AS nb FROM {patterns} a JOIN {patterns} b ON a.tape = b.tape AND a.pattern <> b.pattern AND length(a.pattern) = length(b.pattern)
    WHERE (CASE WHEN length(a.pattern) = length(b.pattern) THEN hamming(a.pattern, b.pattern) ELSE 9 END) = 1 AND b.n >= 2 * a.n AND b.n > a.n),
  mv AS (SELECT tape, p, arg_max(q, (nb, q)) AS q FROM nb GROUP BY tape, p), co AS (SELECT f.tape, coalesce(mv.q, f.pattern) AS pattern, CAST(sum(f.n) AS BIGINT) AS n FROM {patterns} f LEFT JOIN mv ON mv.tape = f.tape AND mv.p = f.pattern GROUP BY 1, 2)"""


@query(f"""WITH {_ONE}, p AS (SELECT tape, pattern, string_split(pattern, '|') AS s, n, row_number() OVER (PARTITION BY tape ORDER BY n DESC, pattern) AS rank FROM co), f AS (SELECT tape, pattern, s, rank FROM p WHERE pattern NOT LIKE '%U%'), k AS (SELECT f.*, unnest([1, 2, 3, 4, 5]) AS k FROM f),
  ok AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.tape = p.tape AND k.pattern = p.pattern AND EXISTS (SELECT 1 FROM f a WHERE a.tape = k.tape AND a.rank < k.rank AND a.s[1:k.k] = k.s[1:k.k]) AND EXISTS (SELECT 1 FROM f b WHERE b.tape = k.tape AND b.rank < k.rank AND b.s[k.k+1:6] = k.s[k.k+1:6]))),
  fl AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, tape) > 1 AND s[1] <> 'U' AND s[2] <> 'U' AS cr FROM ok WHERE n >= 5)
  SELECT tape, (SELECT count(*) FROM {{patterns}} r WHERE r.tape = t.tape) AS raw, (SELECT count(*) FROM co r WHERE r.tape = t.tape) AS collapsed, (SELECT count(*) FROM ok r WHERE r.tape = t.tape) AS chimera_filtered, (SELECT count(*) FROM fl r WHERE r.tape = t.tape) AS ge_min_reads,
    (SELECT count(*) FROM fl r WHERE r.tape = t.tape AND cr) AS cross_bc, (SELECT count(*) FROM fl r WHERE r.tape = t.tape AND NOT cr) AS clean FROM (SELECT DISTINCT tape FROM {{patterns}}) t""", "patterns")
def stage_counts(patterns: DataFrame) -> DataFrame:
    return R.denoise(with_sites(patterns).select("tape", "sites", "n"), 2.0, 5, 2, folding=R.one_round_collapse)[1]


@query(f"""SELECT * FROM (SELECT CASE WHEN site < 3 THEN '1-2' ELSE '3-6' END AS pool, s AS insertion, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY CASE WHEN site < 3 THEN '1-2' ELSE '3-6' END), 6) AS share FROM ({_LONG}) q WHERE s <> 'U' GROUP BY 1, 2) z WHERE share >= 0.05""", "sc_reads")
def pooled_spectrum(reads: DataFrame) -> DataFrame:
    return R.spectrum(with_sites(reads), least=0.05, pooled=True).withColumn("share", F.round("share", 6))


@query(f"SELECT site, count(*) FILTER (s <> 'U') AS edits, round(count(*) FILTER (s <> 'U') / count(*), 6) AS rate FROM ({_LONG}) q GROUP BY site", "sc_reads")
def edit_rate_by_position(reads: DataFrame) -> DataFrame:
    return R.edit_rates_by_position(with_sites(reads)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH n AS (SELECT tape, s AS insertion, count(*) AS n FROM ({_LONG}) q WHERE s <> 'U' AND site >= 3 GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY tape) * count(*) OVER (PARTITION BY tape) AS rate FROM n)
  SELECT tape, insertion, n, round(rate, 6) AS rate, round(log2(rate), 6) AS log2rate FROM r""", "sc_reads")
def symbol_usage(reads: DataFrame) -> DataFrame:
    return R.symbol_usage(with_sites(reads)).withColumn("rate", F.round("rate", 6)).withColumn("log2rate", F.round("log2rate", 6))


@query("SELECT tape, pattern, n FROM {patterns} WHERE tape IN (SELECT tape FROM {patterns} GROUP BY tape HAVING sum(n) >= (SELECT avg(s) FROM (SELECT sum(n) AS s FROM {patterns} GROUP BY tape) q))", "patterns")
def deep_barcodes(patterns: DataFrame) -> DataFrame:
    """Patterns of barcodes with at least as many reads as they have on average."""
    mean = patterns.groupBy("tape").agg(F.sum("n").alias("s")).agg(F.avg("s")).first()[0]
    return R.deep_barcodes(patterns, mean).select("tape", "pattern", "n")


@query("""WITH j AS (SELECT CASE WHEN m = 6 OR d >= 3 THEN 10 ELSE 4 END AS length FROM {bulk_reads} WHERE m = 6 OR m = 5 AND d >= 2)
  SELECT 'TGAT' AS lacks, length, CASE length WHEN 10 THEN 'E3' ELSE 'U' END AS kind, true AS near, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM j GROUP BY length""", "bulk_reads")
def junction_table(reads: DataFrame) -> DataFrame:
    return R.junction_failures(R.parse_bulk(R.dereplicated(reads)), n="n_reads").withColumn("share", F.round("share", 6))


@query("SELECT 6 AS sites, 5 AS away, count(*) AS reads, count(*) FILTER (m <> 6 AND (m <> 5 OR d < 2)) AS resolved FROM {bulk_reads} WHERE m <> 1", "bulk_reads")
def first_anchors(reads: DataFrame) -> DataFrame:
    return R.anchor_offsets(R.parse_bulk(R.dereplicated(reads)), n="n_reads")


@query("SELECT '.UEUUU' AS pattern, count(*) AS n FROM {bulk_reads} WHERE m = 6", "bulk_reads")
def order_patterns(reads: DataFrame) -> DataFrame:
    return R.order_patterns(R.parse_bulk(R.dereplicated(reads)), "n_reads")
