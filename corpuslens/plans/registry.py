"""Registry of named queries and the SQL text that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslens.sources.overlay import Tables, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its check SQL when there is one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def sql(views: str, ctes: dict[str, str], body: str) -> str:
    """Check SQL: the named overlay views, extra CTEs in order, then the final SELECT."""
    parts = [with_clause(*views.split())] if views else []
    parts += [f"{n} AS ({q})" for n, q in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_contains(col: str, markers) -> str:
    return "(" + " OR ".join(f"contains({col}, '{m}')" for m in markers) + ")"


def any_suffix(col: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({col}, '{s}')" for s in suffixes) + ")"
