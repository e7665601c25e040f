"""Column functions: patterns, distances between strings and arrays, vectors."""

from __future__ import annotations

import math

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An unedited site.
UNEDITED = "U"


def hamming(a: Column, b: Column) -> Column:
    """Differing places over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + ((i <= n) & (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))).cast("int"))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTNacgtn", "TGCANtgcan"))


def depth(sites: Column, n_sites: int = 6) -> Column:
    """Edited sites before the first that is unedited or missing, of arrays of up to ``n_sites`` sites."""
    out = F.lit(n_sites)
    for i in range(n_sites - 1, -1, -1):
        out = F.when(F.coalesce(F.get(sites, F.lit(i)) != UNEDITED, F.lit(False)), out).otherwise(i)
    return out


def chain(sites: Column) -> Column:
    return F.slice(sites, F.lit(1), depth(sites))


def chain_text(sites: Column, sep: str = "-") -> Column:
    """The edit chain as text; ``-`` if there is no edit."""
    return F.when(depth(sites) == 0, F.lit("-")).otherwise(F.array_join(chain(sites), sep))


def shared_prefix(a: Column, b: Column, n_sites: int = 6) -> Column:
    """Leading sites that are edited and the same in both, of arrays of up to ``n_sites`` sites."""
    out = F.lit(n_sites)
    for i in range(n_sites - 1, -1, -1):
        x, y = F.get(a, F.lit(i)), F.get(b, F.lit(i))
        out = F.when(F.coalesce((x == y) & (x != UNEDITED), F.lit(False)), out).otherwise(i)
    return out


def tape_distance(a: Column, b: Column) -> Column:
    """Edits on the path between two ordered arrays: both depths less twice the shared prefix."""
    return depth(a) + depth(b) - 2 * shared_prefix(a, b)


def masks(word: Column, n: int, most: int) -> Column:
    """All ways to blank ``most`` of the first ``n`` characters: words that differ in no more than ``most`` of them have one in common."""
    places = F.array(*[F.array(*[F.lit(p + 1) for p in some]) for some in combinations(range(n), min(most, n))])
    return F.transform(places, lambda some: F.aggregate(some, F.substring(word, 1, n), lambda s, p: F.overlay(s, F.lit("*"), p, F.lit(1))))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def day_bin(t: Column, edges: list[float]) -> Column:
    """E-day label of the last edge at or below t; null below the first."""
    out = F.lit(None).cast("string")
    for low in edges:
        out = F.when(t >= low, F.lit(f"E{low:g}")).otherwise(out)
    return out


def right_closed(t: Column, edges: list[float]) -> Column:
    """Number of the bin (low, high] that holds t, from 0; the lowest edge belongs to the first bin; null outside."""
    out = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when(((t > low) if k else (t >= low)) & (t <= high), F.lit(k)).otherwise(out)
    return out


def normal_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def extract_barcode(seq: Column, left: str = "GGCATG", right: str = "CTCTGG", low: int = 5, high: int = 20, spacer: str = "G") -> Column:
    """(barcode, start of the array) between the first left flank and the next right one; the spacer is taken off after the length test. Null if absent."""
    a = F.locate(left, seq)
    b = F.expr("1")
    b = F.locate(right, F.substr(seq, a + len(left)))
    raw = F.substr(seq, a + len(left), b - 1)
    ok = (a > 0) & (b > 0) & (b - 1 >= low) & (b - 1 <= high)
    return F.when(ok, F.struct(F.when(F.endswith(raw, F.lit(spacer)), F.substr(raw, F.lit(1), b - 2)).otherwise(raw).alias("barcode"), (a + len(left) + b - 2 + len(right)).alias("start")))


def extract_cell_barcode(seq: Column, n: int = 12, right: str = "CTCTGG") -> Column:
    """(barcode, start of the array): the n bases before one spacer base, which is not looked at, and the right flank; null if fewer come before."""
    b = F.locate(right, seq)
    return F.when(b - 1 >= n + 1, F.struct(F.substr(seq, b - n - 1, F.lit(n)).alias("barcode"), (b - 1 + len(right)).alias("start")))


def header_fields(c: Column) -> Column:
    """The fields of ``@cell,PCR,umi,sample``, of any number."""
    return F.split(F.when(F.startswith(c, F.lit("@")), F.substr(c, F.lit(2))).otherwise(c), ",")


def token_id(group: Column, site: Column, allele: Column, n_sites: int = 6, base: int = 8192) -> Column:
    """One number for an allele of a site of a tape."""
    return (group * n_sites + site) * base + allele


def log_factorial(n: Column) -> Column:
    """ln n! of a count, without a table: Stirling's series nine steps further on, where it is exact to a double, less the logarithm of these steps."""
    z = n.cast("double")
    steps = F.lit(0.0)
    for k in range(1, 10):
        steps += F.ln(z + k)
    w = z + 10
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7) + 1 / (1188 * w**9)
    return (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + series - steps
