"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prefspark.plans.tables import VIEWS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a ``Tables -> DataFrame`` function, with its SQL twin where one exists."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, build, with_views(sql) if sql else None)
        return build

    return register


def with_views(sql: str) -> str:
    """Prefix the SQL with the common table expressions it names (and those they name in turn)."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view, body in VIEWS.items():
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(body)
                needed.append(view)

    visit(sql)
    ctes = [f"{view} AS ({VIEWS[view]})" for view in needed]
    body = sql.strip()
    recursive = bool(re.match(r"with\s+recursive\b", body, re.I))
    own = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if own:
        ctes.append(body[own.end():])
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def half_up(expr: str, digits: int) -> str:
    """SQL twin of ``numeric.half_up``: decimal half-up rounding, returned as a double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(24,10)), {digits}) AS DOUBLE)"
