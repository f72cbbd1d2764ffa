"""The registered queries of the engine."""

from . import analytics, documents, functions, io, more, patterns, rules, scalars, streams, temporal, validation  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
