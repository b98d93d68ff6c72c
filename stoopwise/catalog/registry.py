"""Registry of queries and access to the given tables and the views derived from them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from stoopwise.catalog.views import VIEWS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _fields(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in Formatter().parse(sql) if name})


class Given:
    """The given tables and derived views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, template: str) -> DataFrame:
        """Run SQL whose tables and views are written in braces."""
        return self.spark.sql(template, **{name: getattr(self, name) for name in _fields(template)})


def plain_sql(template: str) -> str:
    """The same SQL for an engine that knows only the tables: views become CTEs."""
    needed: dict[str, str] = {}

    def visit(sql: str) -> None:
        for name in _fields(sql):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed[name] = VIEWS[name]

    visit(template)
    names = {name: name for name in (*TABLES, *VIEWS)}
    body = template.format(**names).strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS (\n{sql.format(**names).strip()}\n)" for n, sql in needed.items())
    if re.match(r"WITH\s", body, re.IGNORECASE):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a function ``Given -> DataFrame`` under its own name.

    ``covers`` lists the inventory items it stands for; ``sql`` is its twin, with
    tables and views in braces.
    """

    def register(function: Callable[[Given], DataFrame]):
        name = function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Given(spark, sf_dir))

        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, covers, run, plain_sql(sql) if sql else None)
        return function

    return register


def all_queries() -> dict[str, Query]:
    from stoopwise.catalog import (  # noqa: F401
        amenities,
        expressions,
        feeds,
        intake,
        profiles,
        saved,
        streams,
        transit,
        violations,
        walk,
    )

    return dict(_QUERIES)
