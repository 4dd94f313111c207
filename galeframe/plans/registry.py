"""Registry of the queries: a DataFrame builder and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.plans.views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def ora(views: str, select: str, ctes: str = "", recursive: bool = False) -> str:
    """SELECT over the named fixture views and further common table expressions."""
    parts = [f"{v} AS ({VIEW_SQL[v]})" for v in views.split()]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + select


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Rounded double without negative zero, as the SQL side writes it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: rnd(n, digits) for n in names})


def R(expr: str, name: str | None = None, digits: int = 4) -> str:
    """The SQL twin of rnd."""
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0" + (f" AS {name}" if name else "")
