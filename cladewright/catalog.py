"""Registry of the engine's named queries, the SQL views that give them domain rows, and their SQL equivalents.

The driver's tables hold no sequencing data, so views derive reads, genotypes and a tree from them with SQL that both engines read alike. A query gets the
views it names as DataFrames; its oracle is SQL over the same views.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or else the table of that name."""
    queries()
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def oracle(text: str) -> str:
    """SQL with the views that it names as common table expressions."""
    order: list[str] = []

    def need(t: str) -> None:
        for n in _NAME.findall(t):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda t: _NAME.sub(r"\1", t)
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if not ctes:
        return body
    recursive = body[:15].upper() == "WITH RECURSIVE "
    if recursive or body[:5].upper() == "WITH ":
        return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + ",\n" + body[15 if recursive else 5:]
    return f"WITH {ctes}\n{body}"


def query(sql: str | None, *names: str) -> Callable:
    """Register a function of the named views as a query, with its SQL (None where SQL cannot express it)."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in names])
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .plans import files, imputation, lineages, reads, routing, statistics, summaries, timed, trees  # noqa: F401

    return dict(QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return {k: oracle(v) for k, v in ORACLES.items()}
