"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` gives the same rows in DuckDB."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """SQL twin of functions.scalars.rnd."""
    out = f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"
    return f"{out} AS {name}" if name else out
