"""Named functions for SQL: register them once for each session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cladewright.functions import kernels as K
from cladewright.shipping import ship

_NODE = "pre int, last int, parent_pre int, depth int, name string, blen double, time double, is_leaf boolean"


@F.udtf(returnType=_NODE)
class NewickNodes:
    """A row for each node of a Newick text."""

    def eval(self, text: str):
        for n in K.newick_nodes(text) if text else ():
            yield tuple(n[c.split()[0]] for c in _NODE.split(", "))


def register(spark: SparkSession) -> None:
    """``newick_nodes(text)``, a table function; ``walk_array(seq, start)``, the sites, broken and why of an array; ``merge_mates(r1, r2)``, one read of two mates or null."""
    ship(spark)
    spark.udtf.register("newick_nodes", NewickNodes)

    @F.pandas_udf("sites array<string>, broken boolean, why string")
    def walk_array(seq: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = [K.walk(s, int(a)) if isinstance(s, str) and a == a and a is not None else ([None] * 6, False, "short") for s, a in zip(seq, start, strict=True)]
        return pd.DataFrame(rows, columns=["sites", "broken", "why"])

    @F.pandas_udf("string")
    def merge_mates(r1: pd.Series, r2: pd.Series) -> pd.Series:
        return pd.Series([K.merge_pair(a, b) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(r1, r2, strict=True)], dtype=object)

    spark.udf.register("walk_array", walk_array)
    spark.udf.register("merge_mates", merge_mates)
