"""Registry of queries over the star-schema tables, each with DuckDB SQL that states it independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempolane.sources.domain import CTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def half_up(sql: str) -> str:
    """``round(x, 9)`` in a query's SQL stands for the plans' rounding, floor(x * 1e9 + 0.5) / 1e9: the two engines' own
    functions treat ties of decimal fractions differently."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
        inner = sql[start + 6 : end - 1]
        out += sql[at:start] + (f"(floor(({inner[:-3]}) * 1e9 + 0.5) / 1e9)" if inner.endswith(", 9") else sql[start:end])
        at = end
    return out + sql[at:]


def query(name: str, sql: str | None = None, cte: bool = True):
    """Register a function of (spark, sf_dir) and its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (CTE if cte else "") + half_up(sql)
        return f

    return put
