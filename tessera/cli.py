"""Command line: load a CSV file, inspect a table, query it."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from tessera.engine import Engine, ExecuteOptions, ScanStats
from tessera.errors import TesseraError
from tessera.functions.render import render_bytes, render_table, write_csv
from tessera.plans.parser import parse
from tessera.sources.csvio import import_csv
from tessera.sources.schema import parse_schema
from tessera.sources.table import Table


def _arguments(args: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="import a CSV file as a new table")
    load.add_argument("csv")
    load.add_argument("table")
    load.add_argument("--schema", required=True, help="name:type,... with type int or str")
    load.add_argument("--parts", action="store_true", help="a folder that all tasks write, for large files")
    load.add_argument("--header", action=argparse.BooleanOptionalAction, default=True)
    inspect = commands.add_parser("inspect", aliases=["info"], help="show a table's layout")
    inspect.add_argument("table")
    query = commands.add_parser("query", help="run a SELECT")
    query.add_argument("table")
    query.add_argument("sql")
    query.add_argument("--no-pruning", action="store_true")
    query.add_argument("--no-parallel", action="store_true")
    query.add_argument("--explain", action="store_true", help="scan statistics on stderr")
    query.add_argument("--format", choices=("table", "csv"), default="table")
    return top.parse_args(args)


def _inspect(table: Table) -> str:
    found = table.footers
    if found is None:
        return f"rows: {table.row_count}\n" + "\n".join(f"{n}: {k.label}" for n, k in table.schema.items())
    lines = [f"size: {render_bytes(found.file_bytes)}", f"rows: {found.rows}", f"row groups: {len(found.groups)}"]
    for name, kind in table.schema.items():
        size = sum(g.bytes[name] for g in found.groups)
        encodings = sorted({e for g in found.groups for e in g.encodings[name]})
        lines.append(f"{name}: {kind.label}, {', '.join(encodings)}, {size / max(found.rows, 1):.3f} bytes a row")
    return "\n".join(lines)


def _explain(stats: ScanStats, seconds: float) -> str:
    if stats.metadata_only:
        groups = "" if stats.row_groups_total is None else f" of {stats.row_groups_total}"
        how = f"answered from metadata, 0{groups} row groups read"
    elif stats.row_groups_total is None:
        how = "footers not read, scan unknown"
    else:
        how = (
            f"row groups: {stats.row_groups_scanned} of {stats.row_groups_total} scanned, "
            f"{stats.row_groups_fully_matched} fully matched; rows scanned: {stats.rows_scanned}; "
            f"bytes read: {render_bytes(stats.bytes_read)}"
        )
    return f"{how}; rows returned: {stats.rows_returned}; {seconds * 1000:.1f} ms"


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = _arguments(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    try:
        if options.command == "load":
            schema = parse_schema(options.schema)
            count = import_csv(spark, options.csv, options.table, schema, options.header, options.parts)
            print(f"{count} rows written to {options.table}")
        elif options.command == "query":
            table, statement = Table.from_parquet(spark, options.table), parse(options.sql)
            began = time.monotonic()
            result, stats = Engine(spark).run(table, statement, ExecuteOptions(not options.no_pruning, not options.no_parallel))
            seconds = time.monotonic() - began
            if options.format == "csv":
                write_csv(result.columns, result.rows, sys.stdout)
            else:
                print(render_table(result.columns, result.rows))
            if options.explain:
                print(_explain(stats, seconds), file=sys.stderr)
        else:
            print(_inspect(Table.from_parquet(spark, options.table)))
    except TesseraError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
