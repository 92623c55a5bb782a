"""Registration of queries and composition of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wiretally.catalog.views import SQL_VIEWS, Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    rows: str
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(rows: str, sql: str | None = None, name: str | None = None):
    """Register a query under its function name. ``rows`` names the inventory rows it covers."""
    def register(fn: Callable[[Tables], DataFrame]):
        CATALOG[name or fn.__name__] = Query(fn, rows, sql)
        return fn
    return register


def compose(sql: str) -> str:
    """Put the views a statement mentions (and those they mention) in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in SQL_VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(SQL_VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.run(Tables(spark, sf_dir))
