"""Registered queries over the given tables and their SQL."""

from . import analytic_queries, assembly_queries, data_queries, live_queries, scalar_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
