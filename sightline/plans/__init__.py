"""Queries by name, each with equal SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a query under its function's name; ctes are put before sql, which may begin with CTEs of its own."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            head = ", ".join(ctes)
            if head and body.startswith("with recursive "):
                body = f"with recursive {head}, {body[15:]}"
            elif head and body.startswith("with "):
                body = f"with {head}, {body[5:]}"
            elif head:
                body = f"with {head} {body}"
            ORACLES[f.__name__] = body
        return f

    return put


def load() -> tuple[dict, dict]:
    from . import camera, console, evidence, facts, live, movement, relational, report, roster, text, vision  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
