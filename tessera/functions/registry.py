"""User functions and aggregates, called by IRI as in queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

FUNCTIONS: dict[str, Callable[..., Column]] = {}
AGGREGATES: dict[str, Callable[..., Column]] = {}


def register_function(name: str, f: Callable[..., Column]) -> None:
    """``f`` maps term columns to a term column. A built-in expression stays in the JVM; a pandas UDF may stand behind it."""
    FUNCTIONS[name] = f


def register_aggregate(name: str, f: Callable[..., Column]) -> None:
    """``f`` maps term columns to an aggregate of a group, for ``groupBy(...).agg(...)``."""
    AGGREGATES[name] = f


def call(name: str, *args: Column) -> Column:
    if name not in FUNCTIONS:
        raise KeyError(f"no function {name}")
    return FUNCTIONS[name](*args)


def aggregate(name: str, *args: Column) -> Column:
    if name not in AGGREGATES:
        raise KeyError(f"no aggregate {name}")
    return AGGREGATES[name](*args)
