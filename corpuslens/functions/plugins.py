"""Plug-in point: named path predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import paths


PREDICATES: dict[str, Callable[[Column], Column]] = {
    "sensitive": paths.is_sensitive,
    "lockfile": paths.is_lockfile,
    "generated": paths.is_generated,
    "test": paths.is_test,
    "docs": paths.is_docs,
    "data": paths.is_data_file,
    "binary_extension": paths.has_binary_extension,
    "hidden": paths.is_hidden,
}


def register(name: str, predicate: Callable[[Column], Column]) -> None:
    """Add a named path predicate for recipes and custom policies."""
    PREDICATES[name] = predicate


def matching(*, all_of: tuple[str, ...] = (), none_of: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """Combine named predicates into one."""

    def cond(path: Column) -> Column:
        out = F.lit(True)
        for n in all_of:
            out = out & PREDICATES[n](path)
        for n in none_of:
            out = out & ~PREDICATES[n](path)
        return out

    return cond
