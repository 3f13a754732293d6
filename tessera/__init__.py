"""Tessera: a single-table columnar query engine on Spark's DataFrame API."""

from tessera.engine import Engine, ExecuteOptions, QueryResult, ScanStats
from tessera.errors import QueryError, SchemaError
from tessera.plans.parser import parse
from tessera.sources.schema import parse_schema
from tessera.sources.table import Table
from tessera.sources.writer import TableWriter

__all__ = [
    "Engine", "ExecuteOptions", "QueryError", "QueryResult", "ScanStats", "SchemaError",
    "Table", "TableWriter", "parse", "parse_schema",
]
