"""Statements run against tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import SPARK_ERRORS, QueryError
from tessera.operators.metadata import metadata_aggregates, metadata_values
from tessera.operators.select import compile_statement, compile_unsorted
from tessera.plans import ast
from tessera.plans.binder import Bound, bind, predicate_columns
from tessera.plans.parser import parse
from tessera.sources.footer import proofs
from tessera.sources.session import settings
from tessera.sources.table import Table


@dataclass(frozen=True)
class ExecuteOptions:
    """use_pruning: filters skip row groups. parallel: many tasks rather than one."""

    use_pruning: bool = True
    parallel: bool = True


@dataclass(frozen=True)
class ScanStats:
    """What the footers prove about a scan; None where a table has no footers to read."""

    row_groups_total: int | None = 0
    row_groups_scanned: int | None = 0
    row_groups_fully_matched: int | None = 0
    rows_scanned: int | None = 0
    rows_returned: int = 0
    bytes_read: int | None = 0
    metadata_only: bool = False


@dataclass(frozen=True)
class QueryResult:
    columns: list[str]
    rows: list[tuple]


class Engine:
    """query() gives a lazy DataFrame, run() the rows in the language's order."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def bind(self, table: Table, statement: ast.Select | str) -> Bound:
        return bind(parse(statement) if isinstance(statement, str) else statement, table.schema)

    def query(self, table: Table, statement: ast.Select | str, ordered: bool = False) -> DataFrame:
        """Names and types are checked now, rows are computed on an action.

        Rows have an order only if the statement has ORDER BY or LIMIT, or if ordered.
        A table with names that differ only in case needs spark.sql.caseSensitive
        when the frame runs; run() sets it itself.
        """
        bound = self.bind(table, statement)
        with settings(self.spark, {"spark.sql.caseSensitive": "true"}):
            found = metadata_aggregates(bound, table)
            return found if found is not None else compile_statement(bound, table, ordered)

    def run(
        self, table: Table, statement: ast.Select | str, options: ExecuteOptions = ExecuteOptions()
    ) -> tuple[QueryResult, ScanStats]:
        bound = self.bind(table, statement)
        values = metadata_values(bound, table)
        if values is not None:
            rows = [values] if bound.limit is None or bound.limit > 0 else []
        else:
            rows = self._collected(bound, table, options)
        result = QueryResult([n for _, n in bound.outputs], rows)
        return result, scan_stats(bound, table, options, len(rows), values is not None)

    def _collected(self, bound: Bound, table: Table, options: ExecuteOptions) -> list[tuple]:
        """The rows in the language's order; they come to the driver, so that is where they are put in input order."""
        with settings(self.spark, _wanted(options)):
            try:
                if bound.order_by or bound.limit is not None:
                    return [tuple(r) for r in compile_statement(bound, table, ordered=True).collect()]
                frame, width = compile_unsorted(bound, table)
                return [tuple(r[:width]) for r in sorted(frame.collect(), key=lambda r: r[width:])]
            except SPARK_ERRORS as e:
                if "overflow" in str(e).lower():
                    name = next((i.output_name for i, _ in bound.outputs if getattr(i, "func", "") == "sum"), "SUM")
                    raise QueryError(f"integer overflow in {name}") from e
                raise


def scan_stats(bound: Bound, table: Table, options: ExecuteOptions, returned: int, metadata_only: bool) -> ScanStats:
    """Groups that the filter's proofs leave, their rows, and the bytes of the columns read there."""
    if table.footers is None:
        return ScanStats(None, 0 if metadata_only else None, None, 0 if metadata_only else None, returned, 0 if metadata_only else None, metadata_only)
    groups = table.footers.groups
    if metadata_only:
        return ScanStats(len(groups), rows_returned=returned, metadata_only=True)
    scanned = matched = rows = size = 0
    tested, read = predicate_columns(bound.where), bound.columns
    projected = read - tested | {c for c in tested if _is_output(bound, c)}
    for group in groups:
        may, every = proofs(bound.where, group) if options.use_pruning else (True, bound.where is None)
        if not may:
            continue
        scanned, rows = scanned + 1, rows + group.rows
        matched += every and bound.where is not None
        size += sum(group.bytes.get(c, 0) for c in (projected if every else read))
    return ScanStats(len(groups), scanned, matched, rows, returned, size)


def _is_output(bound: Bound, column: str) -> bool:
    used = {i.column if isinstance(i, ast.AggregateItem) else i.name for i, _ in bound.outputs}
    return column in used | {*bound.group_by} | {k.column for k in bound.order_by}


def _wanted(options: ExecuteOptions) -> dict[str, str]:
    """Spark proves a list of over inFilterThreshold members by its overall range only."""
    wanted = {
        "spark.sql.caseSensitive": "true",
        "spark.sql.parquet.filterPushdown": str(options.use_pruning).lower(),
        "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    }
    if not options.parallel:
        wanted |= {
            "spark.sql.files.maxPartitionBytes": str(2**40),
            "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1",
        }
    return wanted
