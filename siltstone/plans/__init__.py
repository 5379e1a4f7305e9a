"""Registered queries: the operators applied to the driver's tables, each with independent DuckDB SQL where SQL can say it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query(spark, sf_dir) under its function's name, with the DuckDB SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
