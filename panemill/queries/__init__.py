"""Registered queries of the library, each with DuckDB SQL that must give the same rows."""

from panemill.queries import approximate, core, reports, stateful, streams
from panemill.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "approximate", "core", "reports", "stateful", "streams"]
