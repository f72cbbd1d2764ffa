"""Registered queries of the knowledge-graph engine and their DuckDB SQL."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "bgp_snowflake_filter"
